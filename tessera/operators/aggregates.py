"""Rollups, priority merges and greedy covers."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut


def percent_floor(part: Column, whole: Column) -> Column:
    """Integer percentage, cut and not rounded; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("bigint")


def priority_merge(df: DataFrame, keys: list[str], rank: Column, flags: list[str], in_trait: Column, order: str, start: str, end: str) -> DataFrame:
    """One row for the occurrences of a name: the highest rank, OR of the flags, the number of
    occurrences, and a line range: that of the last one in a trait, else of the first one."""
    span = F.struct(F.col(start), F.col(end))
    chosen = F.coalesce(F.max_by(F.when(in_trait, span), F.when(in_trait, F.col(order))), F.min_by(span, F.col(order)))
    out = df.groupBy(*keys).agg(F.max(rank).alias("rank"), *(F.bool_or(f).alias(f) for f in flags), F.count("*").alias("n"), chosen.alias("span"))
    return out.select(*keys, "rank", *flags, "n", F.col("span")[start].alias(start), F.col("span")[end].alias(end))


def milestones(cover: DataFrame, total: int, targets: tuple[int, ...]) -> DataFrame:
    """(target, needed, rank): of one greedy run, the first rank that reaches ceil(target * total / 100)."""
    spark = cover.sparkSession
    goals = spark.createDataFrame([(t, math.ceil(t * total / 100)) for t in targets], "target int, needed bigint")
    return goals.join(cover, F.col("cumulative") >= F.col("needed"), "left").groupBy("target", "needed").agg(F.min("rank").alias("rank"))


def greedy_touch(usage: DataFrame, most: int | None = None) -> DataFrame:
    """(rank, item, gain, cumulative): the item that touches most projects not yet touched, again and
    again, until all projects are touched or ``most`` items are taken; of equals the greatest name. ``usage`` has (project, item). Each round is one grouped count
    whose best row is all that reaches the driver."""
    spark = usage.sparkSession
    left, out, covered = cut(usage.select("project", "item").where(F.col("item").isNotNull()).distinct()), [], 0
    for rank in count(1) if most is None else range(1, most + 1):
        best = left.groupBy("item").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), F.desc("item")).head()
        if best is None:
            break
        covered += best["gain"]
        out.append((rank, best["item"], best["gain"], covered))
        done = left.where(F.col("item") == best["item"]).select("project")
        left = left.join(done, "project", "left_anti")
        left = cut(left) if rank % 8 == 0 else left
    return spark.createDataFrame(out, f"rank int, item {usage.schema['item'].dataType.simpleString()}, gain bigint, cumulative bigint")


def greedy_full(usage: DataFrame, most: int | None = None) -> DataFrame:
    """(rank, item, gain, cumulative): the item that completes most projects, a project being complete
    when all its items are taken. Where none completes any, the most used item comes, of equals the
    least name; projects without items are complete from the start and count in ``cumulative``."""
    spark = usage.sparkSession
    edges = usage.select("project", "item").distinct()
    used = edges.where(F.col("item").isNotNull())
    covered = edges.select("project").distinct().join(used.select("project").distinct(), "project", "left_anti").count()
    left, out = cut(used), []
    popular = cut(used.groupBy("item").agg(F.count("*").alias("used")))
    for rank in count(1) if most is None else range(1, most + 1):
        single = left.groupBy("project").agg(F.count("*").alias("n"), F.min("item").alias("item")).where("n = 1").groupBy("item").agg(F.count("*").alias("gain"))
        open_items = left.select("item").distinct().join(popular, "item")
        best = open_items.join(single, "item", "left").select("item", "used", F.coalesce("gain", F.lit(0)).alias("gain")).orderBy(F.desc("gain"), F.desc("used"), "item").head()
        if best is None:
            break
        covered += best["gain"]
        out.append((rank, best["item"], best["gain"], covered))
        left = left.where(F.col("item") != best["item"])
        left = cut(left) if rank % 8 == 0 else left
    return spark.createDataFrame(out, f"rank int, item {usage.schema['item'].dataType.simpleString()}, gain bigint, cumulative bigint")
