"""Quality rules with cross-document line frequency.

One pass over the texts gives counts for each document and the hashes of its normalised lines
(lower case, single spaces). Distinct documents that hold a line are counted for each host; lines in
more than ``most_documents`` documents of a host, the same limit for hosts of all sizes, count as
removed there, and a document that keeps too little is rejected as depleted: lines were removed and
fewer than ``least_words`` words or less than ``least_share`` of its words are left.

Cases: null texts count as empty and fail the base rule; a null host is a host of its own; a
document is a distinct pair of doc_id and text, so repeated rows count once, and copies under ids of
their own each count; a null doc_id is an id; equal rows get equal verdicts; empty tables give
empty results; of other columns none is read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, join_hot, text_or_empty

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
FACTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<bigint>"


def repeated_words(words: list[str], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, all its places included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    marked = np.zeros(len(words) + 1, np.int64)
    starts = np.fromiter((i for i, w in enumerate(windows) if seen[w] > 1), np.int64)
    np.add.at(marked, starts, 1)
    np.add.at(marked, starts + size, -1)
    return int((np.cumsum(marked)[:-1] > 0).sum())


def facts(text: str) -> tuple:
    """The fields of FACTS; each distinct normalised line once, with the words of all its places."""
    words = WORDS.findall(text)
    lines, again, seen = Counter(), 0, set()
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if own:
            again += line in seen
            seen.add(line)
            lines[xxhash.xxh3_64_intdigest(" ".join(own).lower()) - (1 << 63)] += len(own)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), again, repeated_words(words), list(lines), list(lines.values())


def documents_facts(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, content (a hash of the text) and FACTS, written to the shared folder."""

    def count(batches):
        for b in batches:
            columns = list(zip(*map(facts, b.column("text").to_pylist()), strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "host", "content", *(x.split()[0] for x in FACTS.split(", "))])

    own = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = own.select("doc_id", "host", F.xxhash64("text").alias("content"), "text").mapInArrow(count, f"doc_id {kind}, host string, content bigint, {FACTS}")
    return cut(rows)


def frequent_lines(known: DataFrame, most_documents: int) -> DataFrame:
    """(host, line) in more distinct documents of the host than the limit."""
    # one row for each document of a host, so that lines can be counted plainly: such counts are summed in
    # each task before they move, and a line that is everywhere stays small
    own = cut(known.groupBy("host", "doc_id", "content").agg(F.first("lines").alias("lines")))
    return own.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_documents)


def judge(docs: DataFrame, host: str = "source", most_documents: int = 20, least_words: int = 5, least_share: float = 0.2) -> DataFrame:
    """doc_id, the counts, base_failed, n_removed_words and kept for every row."""
    known = documents_facts(docs, host)
    bad = cut(frequent_lines(known, most_documents).select("host", "line"))
    held = known.select("host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    lines = join_hot(held, bad, ["host", "line"], F.col("content")).groupBy("host", "content", "line").agg(F.max("n").alias("n"))  # copies agree
    lines = cut(lines.groupBy("host", "content").agg(F.sum("n").alias("n_removed_words")))
    removed = F.coalesce("n_removed_words", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return known.join(lines, ["host", "content"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed.alias("n_removed_words"), (~failed & ~depleted).alias("kept"),
    )


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    return judge(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
x AS (SELECT n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
g AS (SELECT n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM x WINDOW o AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
rep AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM r CROSS JOIN range(0, 5) AS t(k) GROUP BY n),
l AS (SELECT n, host, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT n, host, doc_id, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM l),
m AS (SELECT n, host, doc_id, text, line, len(own) AS n_own, lower(array_to_string(own, ' ')) AS norm FROM k WHERE len(own) > 0),
f AS (SELECT host, norm FROM (SELECT DISTINCT host, norm, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, text FROM m) GROUP BY host, norm HAVING count(*) > 20),
s AS (SELECT m.n, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(CASE WHEN f.norm IS NOT NULL THEN n_own END), 0) AS n_removed_words FROM m LEFT JOIN f ON f.host = m.host AND f.norm = m.norm GROUP BY m.n),
a AS (SELECT d.n, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (n) LEFT JOIN rep USING (n) LEFT JOIN s USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_removed_words AS n_left FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
  NOT base_failed AND NOT (n_removed_words > 0 AND (n_left < 5 OR n_left < 0.2 * n_words)) AS kept FROM b"""
