"""Jaccard self-join on word n-grams by MinHash banding.

1. Documents with the same n-gram set form a class of copies, known by a 128-bit hash of the set;
   from here on there is one member for each class.
2. Each class has ``bands`` hashes over ``rows`` MinHash values. They are shuffled by value; classes
   that share one are candidates, noted as stars around the least member of a bucket, so a bucket
   costs as many rows as it has members.
3. Connected stars make candidate components, which are split into blocks of members that share a
   star where they can. Any two blocks with a common bucket are verified on full n-gram sets: all
   their pairs are compared inside one task, which returns sums of links for members and a spanning
   forest of the verified links. No table of pairs is made, and no bucket has a cap.
4. Components of the forests are the near-duplicate classes.

Words are runs without ASCII white space, compared as they are; a text of one to four words has
its words as its only n-gram. Band and row counts come from ``plan_bands``: at the threshold the
chance of missing a pair is under 1 - recall (0.001), and pairs of similarity 0.4 or less are
rarely compared.

Cases: null and empty texts have no n-grams, no links and a class of their own each; equal rows
are copies; a null doc_id takes part and is never a class id unless its class has no other id; of
rows that tie for a class's least doc_id the one with the least text hash stands for it; an empty
table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut
from tessera.llm.graph import components

WORDS = re.compile(WORD)
WORDS_KEPT = 200_000  #: words whose hashes a worker remembers before it starts anew
BLOCK = 400  #: members of a block
BLOCK_CHARS = 6_000_000  #: characters of a block, for long texts


def plan_bands(threshold: float = 0.8, recall: float = 0.999, far: float = 0.4, most_far: float = 0.1) -> tuple[int, int]:
    """(bands, rows): the fewest values whose chance to miss a pair at the threshold is at most
    1 - recall and to compare a pair of similarity ``far`` at most ``most_far``."""
    for rows in range(1, 40):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if 1 - (1 - far**rows) ** bands <= most_far:
            return bands, rows
    raise ValueError("no plan")


class Shingler:
    """Sorted distinct 64-bit hashes of the n-grams of a text."""

    def __init__(self, size: int = 5):
        self.size, self.known = size, {}
        self.powers = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(size)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORDS.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, len(h) if len(h) < self.size else self.size, np.uint64)
        for i in range(min(self.size, len(h))):
            out += h[i : i + n] * np.uint64(self.powers[i])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, k1, k2 (the hash of the n-gram set), text_hash, n_chars, n (its size), bands."""
    draw = np.random.default_rng(7)
    a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    weights = draw.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches):
        shingle = Shingler(size)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            k1, k2, n, out = [], [], [], []
            for t in batch.column("text").to_pylist():
                h = shingle(t)
                key = xxhash.xxh3_128_intdigest(h.tobytes())
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                n.append(len(h))
                if len(h):
                    least = np.full(len(a), (1 << 64) - 1, np.uint64)
                    for i in range(0, len(h), 1024):
                        np.minimum(least, (h[None, i : i + 1024] * a[:, None] + b[:, None]).min(1), out=least)
                    v = ((least ^ (least >> np.uint64(31))).reshape(bands, rows) * weights).sum(1, dtype=np.uint64) + salt
                    v ^= v >> np.uint64(30)
                    v *= np.uint64(0x94D049BB133111EB)
                    v ^= v >> np.uint64(29)
                    out.append(v.view(np.int64))
                else:
                    out.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), batch.column("n_chars"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), np.concatenate(out) if out else np.zeros(0, np.int64))],
                names=["doc_id", "text_hash", "n_chars", "k1", "k2", "n", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").cast("bigint").alias("n_chars"), "text")
    return cut(own.mapInArrow(sign, f"doc_id {kind}, text_hash bigint, n_chars bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. N-grams in few sets count pair by pair, those in many as columns
    of a matrix product."""
    g = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    held = np.diff(np.concatenate([first, [len(value)]]))
    out = np.zeros((g, g), np.float32)
    for h in range(2, min(12, g) + 1):
        at = first[held == h]
        if len(at):
            members = owner[at[:, None] + np.arange(h)]
            for i in range(h):
                for j in range(i + 1, h):
                    out += np.bincount(members[:, i] * g + members[:, j], minlength=g * g).reshape(g, g)
    many = np.flatnonzero(held > 12)
    columns = np.zeros((g, min(4096, len(many))), np.float32)
    out = out + out.T
    for at in range(0, len(many), 4096):
        some = many[at : at + 4096]
        columns[:] = 0
        for c, k in enumerate(some):
            columns[owner[first[k] : first[k] + held[k]], c] = 1
        out += columns @ columns.T
    return out


def verified(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Which pairs reach the threshold; with ``side`` only pairs of different sides."""
    sizes = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets).astype(np.float64)
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each vertex the least one it is connected with."""
    label = np.arange(len(linked))
    while True:
        around = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, around)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_text_links, is_kept, has_grams for each row of ``docs``
    (doc_id, text). class_id is the least doc_id of all that are connected by links; n_links counts
    the other documents at the threshold or above, n_text_links the other n-gram sets; is_kept
    marks the class's own document and whatever has no n-grams."""
    bands, rows = plan_bands(threshold, recall)
    signed = signatures(docs, bands, rows, size)
    n_docs = signed.count()
    # a class of copies by its 128-bit hash; from here on by a number, which is fixed once written
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("m"), first.alias("first"), F.max("n_chars").alias("n_chars"), F.first("bands").alias("bands"))
    classes = cut(classes.select("k1", "k2", "m", "n_chars", "bands", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("id")), n_docs)
    # one row for each class and band; copies agree on their bands
    buckets = classes.select("id", F.posexplode("bands").alias("band", "value"))
    heads = buckets.groupBy("band", "value").agg(F.min("id").alias("v"), F.count("*").alias("in_bucket")).where("in_bucket > 1").select("band", "value", "v")
    heads = cut(heads, bands * n_docs // 2)
    stars = cut(buckets.join(heads, ["band", "value"]).where("id != v").select(F.col("id").alias("u"), "v").distinct(), bands * n_docs)
    n_stars = stars.count()
    found = components(stars, n_stars).select(F.col("u").alias("id"), F.col("label").alias("comp"))
    members = cut(found.join(classes.select("id", "m", "n_chars", "rep", "rep_hash"), "id"), min(n_docs, 2 * n_stars))
    dealt = _dealt(members, stars, buckets, heads)
    texts = docs.select("text", F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")).alias("key"))
    # never broadcast: the members grow with the input, and a text then moves at most once before it meets its block
    dealt = dealt.select("comp", "i", "j", "block", "id", "m", F.struct(F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash")).alias("key"))
    with_text = texts.join(dealt.hint("shuffle_hash"), "key").drop("key")

    def compare(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)  # repeated rows of one class
        block, m = table.column("block").to_numpy()[at], table.column("m").to_numpy()[at]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        shingle = Shingler(size)
        sets = [shingle(t) for t in table.column("text").take(pa.array(at)).to_pylist()]
        linked = verified(sets, threshold, block if i != j else None)
        label = forest(linked)
        return pa.table({"id": ids, "head": ids[label], "links": linked @ m, "texts": linked.sum(1).astype(np.int64)})

    compared = cut(with_text.groupBy("comp", "i", "j").applyInArrow(compare, "id bigint, head bigint, links bigint, texts bigint"))
    linked = cut(compared.where("id != head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct(), compared.count())
    joined = components(linked, linked.count()).select(F.col("u").alias("id"), "label")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = classes.drop("bands").join(links, "id", "left").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = cut(known, n_docs)
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_hash", "id"))
    heads = cut(known.groupBy("label").agg(least.alias("head")).select("label", F.col("head.rep").alias("class_id"), F.col("head.id").alias("head")), n_docs)
    facts = known.join(heads, "label").select(
        "k1", "k2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_text_links"), "rep_hash", (F.col("id") == F.col("head")).alias("is_first"),
    )
    own = F.col("is_first") & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("rep_hash"))
    return signed.select("doc_id", "text_hash", "k1", "k2", "n").join(facts, ["k1", "k2"], "left").select(
        "doc_id", "text_hash",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"),
        ((F.col("n") == 0) | F.coalesce(own, F.lit(False))).alias("is_kept"), (F.col("n") > 0).alias("has_grams"),
    )


def _dealt(members: DataFrame, stars: DataFrame, buckets: DataFrame, heads: DataFrame) -> DataFrame:
    """``members`` (id, comp, m, n_chars, rep, rep_hash) with ``block`` and, for each two blocks to
    compare of which it is one, a row with ``i`` <= ``j``.

    A component that fits one block is one. In larger ones, members are put together by their least
    star, stars of more than a block being split by hash, and two blocks meet only if a bucket has
    members of both."""

    def parts(n: str, chars: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(chars) / BLOCK_CHARS)).cast("int")

    n = members.count()

    def sized(rows: DataFrame, by: str) -> DataFrame:
        of = rows.groupBy(by).agg(F.count("*").alias("n_of"), F.sum("n_chars").alias("chars_of")).where("n_of > 1")
        return cut(of.select(by, parts("n_of", "chars_of").alias("parts")), n)

    kept = ["id", "comp", "m", "rep", "rep_hash"]
    sizes = sized(members, "comp")
    small = members.join(sizes.where("parts = 1"), "comp", "left_semi").select(*kept, F.lit(0).cast("bigint").alias("block"))
    large = members.join(sizes.where("parts > 1"), "comp").join(stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("star")), "id", "left")
    large = cut(large.withColumn("star", F.least("id", F.coalesce("star", "id"))), n)
    split = sized(large, "star").select("star", F.col("parts").alias("split"))
    own = F.when(F.col("split") > 1, F.xxhash64("star", F.pmod(F.xxhash64("id"), F.col("split")))).otherwise(F.xxhash64(F.lit("bin"), "comp", F.pmod(F.xxhash64("star"), F.col("parts"))))
    large = cut(large.join(split, "star", "left").select(*kept, own.alias("block")), n)
    held = buckets.join(heads, ["band", "value"], "left_semi").join(large.select("id", "comp", "block"), "id").select("band", "value", "comp", "block").distinct()
    held = cut(held)
    met = held.alias("x").join(held.alias("y"), ["band", "value"]).where("x.block <= y.block").select(F.col("x.comp").alias("comp"), F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct()
    met = cut(met)
    each = met.select("comp", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    return small.select(*kept, "block", F.col("block").alias("i"), F.col("block").alias("j")).union(large.join(each, ["comp", "block"]).select(*kept, "block", "i", "j"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs``, one row for each class of near duplicates: that of its least doc_id. Texts without
    n-grams are near no other; of those that are equal, as empty ones are, that of the least doc_id stays,
    null being a text of its own. Of rows that agree in doc_id and text one stays: the one whose columns
    have the least hash, so reruns agree."""
    # as a struct the key equals where both ids are null, and one shuffle serves the join and the groups
    found = near_duplicates(docs, **options).where("is_kept").select("has_grams", "doc_id", "text_hash").distinct()
    bare = found.where("not has_grams").groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("x")).select("x.doc_id", "text_hash")
    kept = cut(found.where("has_grams").select("doc_id", "text_hash").unionByName(bare).select(F.struct("doc_id", "text_hash").alias("key")), docs.count())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")).alias("key"))
    told = F.xxhash64(*(F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()))
    return rows.join(kept.hint("shuffle_hash"), "key", "left_semi").groupBy("key").agg(F.min_by("row", told).alias("row")).select("row.*")


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_text_links")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
y AS (SELECT n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM x WINDOW o AS (PARTITION BY n ORDER BY i)),
g AS (SELECT n, gram FROM y WHERE gram IS NOT NULL UNION SELECT n, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
c AS (SELECT n, count(*) AS c, md5(string_agg(gram, chr(10) ORDER BY gram)) AS key FROM g GROUP BY n),
p AS (SELECT a.n AS n, b.n AS m, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.n <> b.n GROUP BY a.n, b.n),
e AS (SELECT p.n, p.m, a.key AS key_n, b.key AS key_m FROM p JOIN c a ON a.n = p.n JOIN c b ON b.n = p.m WHERE k >= 0.8 * (a.c + b.c - k) - 1e-9),
r(n, m) AS (SELECT n, n FROM d UNION SELECT r.n, e.m FROM r JOIN e ON r.m = e.n),
h AS (SELECT r.n, min(doc_id) AS class_id FROM r JOIN d ON d.n = r.m GROUP BY r.n),
l AS (SELECT n, count(*) AS n_links, count(DISTINCT key_m) FILTER (WHERE key_m <> key_n) AS n_text_links FROM e GROUP BY n)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links FROM d JOIN h USING (n) LEFT JOIN l USING (n)"""
