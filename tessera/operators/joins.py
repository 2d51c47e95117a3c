"""Join shapes of the analyzers: semi and anti, ordered fallbacks, prefixes, suffixes, intervals,
as-of, and transitive closure."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut


def covered_and_gaps(usage: DataFrame, coverage: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``usage`` whose keys are in ``coverage``, and those whose keys are not."""
    known = coverage.select(*keys).distinct()
    return usage.join(known, list(keys), "left_semi"), usage.join(known, list(keys), "left_anti")


def within(sets: DataFrame, key: str, item: str, known: DataFrame) -> DataFrame:
    """The keys all of whose items are in ``known`` (item); a key with a null item only has none and counts."""
    items = sets.where(F.col(item).isNotNull())
    lacking = items.join(known.select(F.col(known.columns[0]).alias(item)).distinct(), item, "left_anti").select(key).distinct()
    return sets.select(key).distinct().join(lacking, key, "left_anti")


def fallback_lookup(items: DataFrame, keys: list[Column], table: DataFrame, key: str, value: str, default: Column, name: str = "status") -> DataFrame:
    """``items`` with the value of the first of ``keys`` that the table has; one equi-join for each
    key against a deduplicated table, so nothing multiplies."""
    values = table.groupBy(key).agg(F.min(value).alias(value))
    out, found = items, []
    for i, k in enumerate(keys):
        own = values.select(F.col(key).alias(f"fallback_key_{i}"), F.col(value).alias(f"fallback_{i}"))
        out = out.join(own, k == F.col(f"fallback_key_{i}"), "left")
        found.append(F.col(f"fallback_{i}"))
    return out.withColumn(name, F.coalesce(*found, default)).select(*items.columns, name)


def prefixes(path: Column, separator: str) -> Column:
    """All prefixes of a path at segment ends, itself included: a::b::c gives a, a::b and a::b::c."""
    parts = F.split(path, separator.replace(".", r"\.").replace("/", "/"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def prefix_join(deps: DataFrame, dep: str, modules: DataFrame, module: str, separator: str = "::") -> DataFrame:
    """Dependencies with the modules that equal them or lie below them: each module's prefixes are
    exploded and the join is on equality, never a nested loop."""
    below = modules.select(*modules.columns, F.explode(prefixes(F.col(module), separator)).alias("prefix_of_module"))
    return deps.join(below, F.col(dep) == F.col("prefix_of_module")).drop("prefix_of_module")


def suffix_semi(items: DataFrame, item: str, wrapped: DataFrame, suffix: str, shortest: int, longest: int) -> DataFrame:
    """Rows of ``items`` that end in a value of ``suffix``. The ends of an item, between the shortest
    and longest suffix length, are exploded, so the comparison is an equi-join at any size."""
    ends = F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(item))), lambda n: F.right(F.col(item), n))
    own = items.select(item).distinct().where(F.length(item) >= shortest).select(item, F.explode(ends).alias("item_end"))
    hits = own.join(wrapped.select(F.col(suffix).alias("item_end")).distinct(), "item_end", "left_semi").select(item).distinct()
    return items.join(hits, item, "left_semi")


def interval_join(points: DataFrame, at: Column, spans: DataFrame, start: Column, end: Column, on: list[tuple[str, str]], width: float | None = None) -> DataFrame:
    """Points inside spans with equal keys. With ``width`` spans are exploded over buckets of that
    width and buckets take part in the equality, which bounds the rows that meet under a hot key."""
    keys = [points[a] == spans[b] for a, b in on]
    inside = (at >= start) & (at <= end)
    if width is None:
        return points.join(spans, reduce(and_, keys, inside))
    p = points.withColumn("bucket_p", F.floor(at / width))
    s = spans.withColumn("bucket_s", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    return p.join(s, reduce(and_, [p[a] == s[b] for a, b in on], (F.col("bucket_p") == F.col("bucket_s")) & inside)).drop("bucket_p", "bucket_s")


def as_of(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` up to the row, by keys and order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def closure(edges: DataFrame, paths: bool = True) -> DataFrame:
    """(src, dst, depth, path) for all that is reachable: the shortest path, of equals the least; without
    ``paths`` only the depth. Known paths double in each round: those of exactly k steps are extended by
    those of up to k, so n steps take log n rounds, each written before the next. A pair that is known is
    not extended again, so cycles end, and there is no limit on the depth."""
    step = edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    known = cut(step.select("src", "dst", F.lit(1).alias("depth"), *([F.array("src", "dst").alias("path")] if paths else [])))
    k, more = 1, not known.isEmpty()
    while more:
        ends = known.where(F.col("depth") == k).select("src", F.col("dst").alias("via"), F.col("depth").alias("d1"), *([F.col("path").alias("p1")] if paths else []))
        nexts = known.select(F.col("src").alias("via"), "dst", F.col("depth").alias("d2"), *([F.col("path").alias("p2")] if paths else []))
        told = [(F.col("d1") + F.col("d2")).alias("depth")] + ([F.concat("p1", F.slice("p2", 2, F.size("p2"))).alias("path")] if paths else [])
        found = ends.join(nexts, "via").where(F.col("src") != F.col("dst")).select("src", "dst", F.struct(*told).alias("x"))
        new = found.join(known.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("x").alias("x")).select("src", "dst", "x.*")
        new = cut(new)
        # a path of more than 2k steps has a part of exactly 2k, so without one nothing is left to find
        k, more = 2 * k, not new.where(F.col("depth") == 2 * k).isEmpty()
        known = known.unionByName(new)
    return known
