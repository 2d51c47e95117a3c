"""Connected components of an edge table, by alternating large and small stars.

Each round is grouped minima and joins. Minima are combined before they are shuffled, and written
before they are joined, so that both sides of a join are plain shuffles: the edges of a vertex with
very many of them are then dealt to several tasks by adaptive execution. Nothing but two numbers
comes to the driver in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links each larger neighbour of a vertex to the least vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), n)
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, label) for every vertex of ``edges`` (u bigint, v bigint): the least vertex it is connected
    with. ``rows`` is a bound on the number of edges, if one is known, of distinct edges that are written
    already and have two ends.

    Cases: edges with a null end and loops link nothing; repeated edges count once; vertices without an
    edge to another one have no row; empty edges give no rows; other columns are not read."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        return r["n"], r["s"]

    now = edges.select("u", "v") if rows is not None else cut(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    before, at = None, state(now)
    while at != before and at[0]:
        before = at
        large = cut(_large_star(now, at[0]), at[0])
        now = cut(_small_star(large, at[0]), at[0])
        at = state(now)
    labels = now.select("u", F.col("v").alias("label"))
    return labels.union(now.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct()).groupBy("u").agg(F.min("label").alias("label"))
