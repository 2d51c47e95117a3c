"""Line deduplication by distinct-site spread.

Every document's distinct normalised lines (lower case, words with single spaces) are hashed to
128 bits. For each line the sites of all documents that hold it are sketched by HyperLogLog;
sketches of a line merge as they are aggregated, before and after the shuffle. An estimate well
below ``most_sites`` keeps a line and one well above removes it; lines whose estimate is within
``margin`` of the limit get an exact distinct count. Lines of more than ``most_sites`` sites are
boilerplate and go from all documents, copies and short texts included.

Cases: null texts count as empty and stay null; a null site is one site; lines without a word are
never removed; a text may lose all lines and becomes empty, its row stays; equal rows lose the same
lines; an empty table gives no rows; all columns of ``docs`` but the text are carried unchanged,
whatever their names. Three columns are added, line_dedup_total, line_dedup_removed and
line_dedup_emptied; a caller's column of such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_or_empty

LG_K = 10  #: 1,024 registers: a standard error of about 3 %, and exact for the first few sites


def normalised(line: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    """Two 64-bit hashes of the normalised line as one struct."""
    own = normalised(line)
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit("line"), own).alias("b"))


def line_hashes(text: str = "text") -> Column:
    """The distinct hashes of the lines of a text that have a word."""
    own = F.filter(F.transform(F.split(text_or_empty(text), "\n"), normalised), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(own, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))))


def hashed_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(key, site, lines) of each row: hashes of its text, of its site and of its lines. Written once,
    so that texts are split and hashed once for all that follows."""
    site_hash = F.when(F.col(site).isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.col(site).cast("string")))
    return cut(docs.select(F.xxhash64("text").alias("key"), site_hash.alias("site"), line_hashes().alias("lines")))


def _each(hashed: DataFrame, *columns: str) -> DataFrame:
    return hashed.select(*columns, F.explode("lines").alias("x")).select(*columns, F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def boilerplate(hashed: DataFrame, most_sites: int = 10, margin: float = 0.15) -> DataFrame:
    """(a, b) of the lines on more than ``most_sites`` sites, from hashed_lines()."""
    held = _each(hashed, "site")
    spread = held.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    rated = cut(spread.select("a", "b", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") > most_sites * (1 - margin)))
    sure = F.col("n") > most_sites * (1 + margin) + 1
    near = held.join(rated.where(~sure).select("a", "b"), ["a", "b"], "left_semi")
    # each site once for a line before the count, so that a frequent line is small before it moves
    exact = near.groupBy("a", "b", "site").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > most_sites)
    return cut(rated.where(sure).select("a", "b").union(exact.select("a", "b")), rated.count())


def remove_lines(docs: DataFrame, hashed: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without the given lines, and line_dedup_total and line_dedup_removed,
    the numbers of lines before and removed, and line_dedup_emptied, whether no word is left of
    those that the text had. What a text loses depends on the text alone, so texts are joined by hash
    with the lines that go from them."""
    # a text's key is a hash, as is a line's: what meets a wrong text by chance finds no line there
    gone = _each(hashed, "key").join(lines, ["a", "b"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("key"))
    whole = F.split(F.col("row.text"), "\n")
    kept = F.filter(whole, lambda x: ~F.array_contains(F.col("gone"), line_hash(x)))
    found = rows.join(cut(gone, hashed.count()).hint("shuffle_hash"), "key", "left").select("row", "gone", F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    added = {
        "line_dedup_total": F.coalesce(F.size(whole), F.lit(0)),
        "line_dedup_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size(whole) - F.size("kept")),
        "line_dedup_emptied": F.when(F.col("gone").isNull(), False).otherwise(~F.array_join("kept", "").rlike(r"[^\x20\x09-\x0D]")),
    }
    return found.select(
        *(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added),
        *(of.alias(c) for c, of in added.items()),
    )


def dedup_lines(docs: DataFrame, site: str = "source", most_sites: int = 10, margin: float = 0.15) -> DataFrame:
    hashed = hashed_lines(docs, site)
    return remove_lines(docs, hashed, boilerplate(hashed, most_sites, margin))


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text", "source")).select(
        "doc_id", F.col("line_dedup_total").cast("bigint").alias("n_lines"), F.col("line_dedup_removed").cast("bigint").alias("n_removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(source, '(null)') AS site, text FROM documents),
l AS (SELECT n, doc_id, site, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT n, doc_id, site, string_split(coalesce(text, ''), chr(10)) AS x FROM d)),
k AS (SELECT n, doc_id, site, i, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS own FROM l),
b AS (SELECT own FROM k WHERE own <> '' GROUP BY own HAVING count(DISTINCT site) > 10),
j AS (SELECT k.*, b.own IS NOT NULL AS gone FROM k LEFT JOIN b ON k.own = b.own),
g AS (SELECT n, doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY n, doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM g"""
