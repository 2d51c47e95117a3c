"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size; each of its documents is due that many copies. The
whole part is given; the fractional parts are rounded by the pivotal method on words: of two
undecided documents one gives words of expectation to the other until one of them is whole, so
the words taken stay the words due throughout. Documents of a source are dealt to leaves of a
reduction tree by a hash; each leaf settles all but at most one document, and the residuals of
up to ``fan`` leaves meet in the next level until one is left for each source. That last one is
rounded at random, so a source misses its target by less than one
document; as large ones are settled first, that is usually a small one.

Cases: null texts have size 0 and get no copies; a null source is a source and comes last; equal
rows are interchangeable, so the multiset of results repeats on every run; rows that differ in any
column but a map are rounded each for itself; sources of size 0 have target 0; empty tables give no
rows; all columns of ``docs`` are carried, whatever their names. A hot source only has more leaves.
"""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, join_hot

WEIGHTS = (5.0, 2.0, 1.0)  #: by rank of the source, repeating
MOST = 3.0  #: times its size that a document may appear


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``rank`` from 0 by code point, null last: sorted over many
    tasks, numbered by the sizes of the parts before, of which there is one for each task."""
    order = F.col("source").asc_nulls_last()
    ordered = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ordered.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + own).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight of all words, at most ``most`` times
    the own size, what is over going to the others by weight. Each round brings three sums to the
    driver and caps all sources above the level; no source is uncapped again, so it ends."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = cut(ranked(sources).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total = float(known.agg(F.sum("source_size")).collect()[0][0] or 0)
    level = 0.0  # words for each unit of weight
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        r = known.agg(F.sum(F.when(capped, F.col("cap"))).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).collect()[0]
        new = (total - (r["c"] or 0.0)) / r["w"] if r["w"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return known.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def settle(chances: list[float], sizes: list[int], draw: random.Random) -> tuple[list[float], int | None]:
    """Pivotal rounding in the given order: chances become 0 or 1 but for at most one, whose
    position is returned. The sum of chance times size stays."""
    out, held = list(chances), None
    for j, p in enumerate(out):
        if p <= 1e-9 or p >= 1 - 1e-9:
            out[j] = float(round(p))
            continue
        if held is None:
            held = j
            continue
        i, a, b = held, sizes[held], sizes[j]
        # i up and j down, or i down and j up, as far as one of them becomes whole
        up, down = min((1 - out[i]) * a, out[j] * b), min(out[i] * a, (1 - out[j]) * b)
        move = up if draw.random() * (up + down) < down else -down
        out[i] += move / a
        out[j] -= move / b
        held = None
        for k in (i, j):
            if out[k] <= 1e-9 or out[k] >= 1 - 1e-9:
                out[k] = float(round(out[k]))
            else:
                held = k
    return out, held


def row_key(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row but maps, which have none, and the seed."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()), F.lit(seed))


def copies(docs: DataFrame, seed: int = 0, leaf: int = 2_000, fan: int = 64, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): ``key`` (a hash of the row), doc_id,
    source, size, source_size, target, copies. Leaves hold about ``leaf`` documents."""
    rows = docs.select("doc_id", "source", size_in_words().alias("size"), row_key(docs, seed).alias("key"))
    rows = cut(rows)
    n_rows = rows.count()
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goal = targets(sources.select("source", "source_size"), weights, most)
    # as a struct the source equals where both are null
    goal = goal.select(F.struct("source").alias("its"), "source_size", "target")
    plan = cut(goal.join(sources.select(F.struct("source").alias("its"), "n"), "its").select("its", "source_size", "target", F.ceil(F.col("n") / leaf).cast("bigint").alias("leaves")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = join_hot(rows.withColumn("its", F.struct("source")), plan, ["its"], F.col("key")).drop("its").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + 1e-9)
    due = due.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0).cast("bigint")).withColumn(
        "chance", F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0)
    )
    due = due.withColumn("node", F.pmod(F.xxhash64("key", F.lit("leaf")), F.col("leaves")))
    fields = "doc_id {0}, source string, size bigint, key bigint, source_size bigint, target double, leaves bigint, whole bigint, chance double, node bigint, open boolean".format(docs.schema["doc_id"].dataType.simpleString())

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        # large ones first: what stays undecided at the end is then small
        frame = frame.sort_values(["size", "key", "doc_id", "chance"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        first = frame.iloc[0]
        told = f"{seed}|{first['source']}|{first['node']}|{first['leaves']}|{first['key']}".encode()
        draw = random.Random(int.from_bytes(hashlib.blake2b(told, digest_size=8).digest(), "big"))
        chances, held = settle(frame["chance"].tolist(), frame["size"].tolist(), draw)
        if held is not None and first["leaves"] == 1:  # the source's last one
            chances[held], held = float(draw.random() < chances[held]), None
        frame["chance"] = chances
        frame["open"] = False
        if held is not None:
            frame.loc[held, "open"] = True
        return frame

    def settled(frame: DataFrame) -> DataFrame:
        return cut(frame.groupBy("source", "node").applyInPandas(level, fields), n_rows)

    now = settled(due.select(*(f.split()[0] for f in fields.split(", ")[:-1])))
    done = [now.where(~F.col("open"))]
    while (left := now.where("open").agg(F.count("*").alias("n"), F.max("leaves").alias("leaves")).collect()[0])["n"]:
        # residuals of up to ``fan`` nodes meet; sources with fewer nodes wait at their root
        up = now.where("open").withColumn("node", F.floor(F.col("node") / fan).cast("bigint")).withColumn("leaves", F.ceil(F.col("leaves") / fan).cast("bigint")).drop("open")
        now = settled(up)
        done.append(now.where(~F.col("open")))
        if left["leaves"] <= 1:
            raise AssertionError("a residual is left at a root")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("key", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("bigint")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as it is due, its columns unchanged. Rows that agree in
    all columns share one key and, being interchangeable, the sum of their copies."""
    n = copies(docs, **options).groupBy("key").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).where("total > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(docs, options.get("seed", 0)).alias("key"))
    at = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    found = rows.join(cut(n, docs.count()).hint("shuffle_hash"), "key").withColumn("at", at)
    each = F.floor(F.col("total") / F.col("rows")) + F.when(F.col("at") <= F.col("total") % F.col("rows"), 1).otherwise(0)
    return found.withColumn("n", each).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select("row.*")


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    out = copies(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
