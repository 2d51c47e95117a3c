"""What several operators share: tables, stable keys, the held-out rule, the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import SCRATCH, shared_folder

T = TypeVar("T")
#: What separates words everywhere in this subpackage: ASCII space and the control range tab to CR.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 50_000  #: rows of a few short columns that may be broadcast
SALTS = 64  #: tasks that share a key in a shuffle join with hot keys
ROWS_OF_A_FILE = 50_000  #: narrow rows in a file of an intermediate table, where their number is known


_kept: dict[tuple, object] = {}


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` returns, made once in each Python worker and used by all its tasks: vocabularies
    and what was learned of them. Only pure functions of ``key`` may be kept so."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(name: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest128(*columns: Column) -> Column:
    """Two differently seeded 64-bit hashes as one struct: equal values always agree, and
    different ones collide only at 128-bit odds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second seed"), *columns).alias("b"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts lineage by writing to the shared folder and reading back; survives lost executors. With
    ``rows``, a bound on the number of narrow rows, no more files are written than these fill."""
    path = shared_folder(df.sparkSession)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_OF_A_FILE)))).write.options(**SCRATCH).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Joins a table in which some keys are very frequent to a written one that has each key once: by
    broadcast where that has at most BROADCAST_ROWS rows, by count; beyond, each key is dealt to SALTS
    tasks by ``salt``, a hash of the left row. Keys must not be null or be structs, which may hold nulls."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    dealt = right.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("join_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(dealt, [*on, "join_salt"], how).drop("join_salt")


def slices(batch: pa.RecordBatch, column: str, most_rows: int, most_bytes: int):
    """The batch in pieces of at most so many rows, and bytes of a text column but for single rows."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(size), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        end = max(first + 1, min(first + most_rows, int(np.searchsorted(total, before + most_bytes, "right"))))
        yield batch.slice(first, end - first)
        first = end


def labelled_sample(labels: DataFrame, label: str, rows: dict[int, int]) -> DataFrame:
    """At most about ``rows[v]`` learnable labelled ids for each label value v: (doc_id, y).

    Rows held out, without an id or with a label other than 0 and 1 are left out; an id with
    both labels counts as 0. The choice goes by a hash of the id against one threshold for each
    label, so it is the same on every run and needs no sort.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keep = F.lit(False)
    for value, most in rows.items():
        keep = keep | ((F.col("y") == value) & (chance < F.lit(min(1.0, most / max(1, counts.get(value, 0))))))
    return known.where(keep)
