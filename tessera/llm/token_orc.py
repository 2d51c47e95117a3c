"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on doc_id.

Rows are dealt by ranges of (doc_id, text hash), sorted, encoded and written, so the files in
order of their ``part`` hold the corpus in ascending doc_id order. ``first`` is a document's
place among the ids of its own part; ``with_starts`` adds the sizes of the parts before it. ORC
splits at stripes, so stripes are read in parallel, and a filter on doc_id is answered from file,
stripe and row-group statistics and the Bloom filters.

Cases: a null text counts as empty and has only the end id; a null doc_id comes first; repeated
ids stand in the order of their texts' hashes, so equal rows stay interchangeable; an empty table
gives no rows; a hot id spreads over parts by the hash.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, shared_folder, slices

CACHE = 50_000  #: stretches that a worker remembers from one batch to the next, the most frequent ones
LONGEST_KEPT = 40  #: characters of a stretch that is remembered, which with CACHE bounds the bytes
ASCII_PARTS = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
SIGNS = frozenset(".,;:!?)\"")
#: The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
#: rest follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
SCHEMA = "part int, first bigint, doc_id bigint, n_tokens bigint, ids array<int>"


class Encoder(dict):
    """The vocabulary of ``path`` over whole texts; a dictionary from stretches of text to their
    ids as little-endian 32-bit bytes.

    The file's normaliser and splitter never look across white space, so the ids of a text are
    those of its stretches one after another, and each distinct stretch meets the library once.
    Three cases need not meet it as a whole, as the tests show over all code points they admit:

    * printable ASCII without an apostrophe splits into runs of letters, single digits and runs of
      other signs, whatever stands beside them;
    * letters below U+0180 but for U+0130 pass the normaliser one by one, changing at most their
      case, and the splitter whole, so the model alone gives their ids;
    * such letters before ASCII punctuation split there.

    All else goes to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pieces = self.library.model.tokenize
        self.end = array("i", [end_id]).tobytes()

    def __missing__(self, w: str) -> bytes:
        ids = self._encode(w)
        if len(w) <= LONGEST_KEPT:
            self[w] = ids
        return ids

    def _keep(self, stretches: list[str], found: list[bytes], counts: np.ndarray) -> None:
        """Forgets all but the stretches that were met most often, of equals all or none."""
        least = 2
        if len(counts) > CACHE:
            least = max(least, int(np.partition(counts, -CACHE)[-CACHE]) + 1)
        self.clear()
        self.update((stretches[i], found[i]) for i in np.flatnonzero(counts >= least).tolist() if len(stretches[i]) <= LONGEST_KEPT)
        self[""] = b""

    def _learn_plain(self, stretches: list[str]) -> None:
        """The commonest new stretches, small ASCII letters only, all at once."""
        new = [w for w in stretches if w not in self and w.isascii() and w.isalpha() and w.islower() and len(w) <= LONGEST_KEPT]
        pieces = self.pieces
        self.update(zip(new, [array("i", [x.id for x in pieces(w)]).tobytes() for w in new], strict=True))

    def _encode(self, w: str) -> bytes:
        if w.isascii():
            if w.isalpha():
                low = w.lower()
                return self[low] if low != w else array("i", [x.id for x in self.pieces(w)]).tobytes()
            if w.isprintable() and "'" not in w:
                parts = ASCII_PARTS.findall(w)
                if len(parts) > 1:
                    return b"".join(map(self.__getitem__, parts))
        else:
            head = w if w.isalpha() else w[:-1]
            if head.isalpha() and max(head) < "\u0180" and "\u0130" not in head and (head is w or w[-1] in SIGNS):
                if head is not w:
                    return self[head] + self[w[-1]]
                low = w.lower()
                return self[low] if low != w else array("i", [x.id for x in self.pieces(w.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        return array("i", self.library.encode(w, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after another, and their numbers. Each
        distinct stretch of the batch is looked up once."""
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        self._learn_plain(stretches)
        found = [*map(self.__getitem__, stretches), self.end]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), ids)
        if len(self) > CACHE:
            self._keep(stretches, found, np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(stretches)))
        del found, stretches
        # the end id, the last of the lists, behind the stretches of each text
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        at = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(sizes) - 1)
        del split, coded
        first = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])[:-1]
        own = np.add.reduceat(sizes[at], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        return lists.take(pa.array(at)).flatten().to_numpy(), own


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encodes ``docs`` (doc_id, text) and writes ORC to ``path``."""

    def encode(batches):
        encoder = per_worker(("tokens", tokenizer, end_id), lambda: Encoder(tokenizer, end_id))
        part, first = TaskContext.get().partitionId(), 0
        for b in batches:
            for some in slices(b, "text", 10_000, 8 << 20):
                ids, sizes = encoder.batch(some.column("text"))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), pa.array(first + offsets[:-1]), some.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["part", "first", "doc_id", "n_tokens", "ids"],
                )
                first += int(offsets[-1])

    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    (
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd").option("orc.compression.zstd.level", "1").option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` only theirs, other stripes and row groups being skipped."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``start``, the number of ids before a row: its place in its part and the sizes of the parts
    before. ``sizes`` (part, n) has one row for each writing task, which bounds what is broadcast."""
    if sizes is None:
        sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def with_checksums(rows: DataFrame) -> DataFrame:
    """Adds ids_crc32 over the ids as read, and counts them anew."""

    def check(batches):
        for b in batches:
            ids = b.column("ids")
            at = ids.offsets.to_numpy(zero_copy_only=False)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import documents

    path = shared_folder(spark)
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_checksums(with_starts(read_tokens(spark, path)))
