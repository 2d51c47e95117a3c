"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document has two groups of terms: shapes of its words (case, digits and signs) with marks of
repetition, and its words in lower case. On a bounded labelled sample these give term tables, inverse
document frequencies and a truncated singular value decomposition; terms outside the tables are
dealt to columns by a hash, so every term counts. Words weigh a quarter of shapes: in any language
signs of bad text are alike, its words are not. The sample's vectors are broadcast (rows x dimensions
floats, both bounded by parameters); each document is compared with all of them, block by block, and
the nearest vote with their similarity as weight.

Cases: a null or empty text has only the marker of emptiness as its term and is scored like
any other; equal texts score alike; ties between neighbours go by the order of the sample's
doc_id; without any labelled row all documents score 1.0; empty tables give empty results; whole
texts and whole words count, however long; of other columns none is read, and all are carried where
rows are kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, labelled_sample

BLOCK = 256  #: documents compared at once
WORDS_KEPT = 100_000  #: words whose columns a worker remembers before it starts anew
LONGEST_KEPT = 40  #: characters of a word that is remembered
HASHED_SHAPES, HASHED_WORDS = 64, 256  #: columns for what the term tables have not
WORD_SHARE = 0.25  #: the weight of words beside that of shapes


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; a run of another sign as that
    sign, doubled if it is longer than one."""
    classes = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", lambda m: m[1] if m[1] in "Aa9" else m[1] * 2, classes)


def marks(text: str, words: list[str]) -> dict[str, int]:
    """A word that equals the one before it, and words of lines that occurred before."""
    found = {}
    if same := sum(map(eq, words, words[1:])):
        found["(again)"] = same
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > len(set(lines)):
        found["(line again)"] = (len(lines) - len(set(lines))) * len(words) // len(lines) + 1
    return found


def terms(text: str | None) -> tuple[dict[str, int], dict[str, int]]:
    """Counts of shapes and marks, and of words in lower case."""
    own = (text or "").split()
    if not own:
        return {"(empty)": 1}, {}
    shapes, words = Counter(), Counter()
    for w, n in Counter(own).items():
        shapes[shape(w)] += n
        words[w.lower()] += n
    return shapes | marks(text, own), words


def _hashed(term: str, n: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % n


@dataclass
class Model:
    shapes: dict[str, int]  #: shape or mark -> column
    words: dict[str, int]  #: word -> column, counted from the first word column
    weight: np.ndarray  #: inverse document frequencies, of shape columns and then word columns
    basis: np.ndarray  #: columns x dimensions
    vectors: np.ndarray  #: labelled sample x dimensions, of length 1
    votes: np.ndarray  #: labels

    def shape_column(self, term: str) -> int:
        i = self.shapes.get(term)
        return len(self.shapes) + _hashed(term, HASHED_SHAPES) if i is None else i

    def word_column(self, term: str) -> int:
        i = self.words.get(term)
        return len(self.shapes) + HASHED_SHAPES + (len(self.words) + _hashed(term, HASHED_WORDS) if i is None else i)

    def counts(self, text: str | None, known: dict[str, tuple[int, int]]) -> tuple[list[int], list[int]]:
        """Columns and counts of a text; ``known`` remembers the columns of words."""
        own = (text or "").split()
        if not own:
            return [self.shape_column("(empty)")], [1]
        if len(known) > WORDS_KEPT:
            known.clear()
        columns, n = [], []
        for w, k in Counter(own).items():
            at = known.get(w)
            if at is None:
                at = self.shape_column(shape(w)), self.word_column(w.lower())
                if len(w) <= LONGEST_KEPT:
                    known[w] = at
            columns += at
            n += (k, k)
        for term, k in marks(text, own).items():
            columns.append(self.shape_column(term))
            n.append(k)
        return columns, n

    def embed(self, found: list[tuple[list[int], list[int]]]) -> np.ndarray:
        x = np.zeros((len(found), len(self.weight)), np.float32)
        for i, (columns, n) in enumerate(found):
            x[i] = np.bincount(columns, n, len(self.weight))
        cut_at = len(self.shapes) + HASHED_SHAPES
        for part in (x[:, :cut_at], x[:, cut_at:]):
            part /= np.maximum(1, part.sum(1, keepdims=True))
        x = np.sqrt(x) * self.weight
        x[:, cut_at:] *= WORD_SHARE
        return unit(x @ self.basis if len(self.basis) else x)

    def score(self, found: list[tuple[list[int], list[int]]], k: int) -> np.ndarray:
        """Exact cosines with the whole sample; the k largest (stable order) vote."""
        if not len(self.votes):
            return np.ones(len(found))
        k = min(k, len(self.votes))
        out = []
        for i in range(0, len(found), BLOCK):
            near = np.round(self.embed(found[i : i + BLOCK]) @ self.vectors.T, 5)  # so that copies tie
            # the k-th largest bounds what can vote; of equals at the bound the first ones do
            bound = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            above, at = near > bound, near == bound
            take = above | (at & (np.cumsum(at, 1) <= k - above.sum(1, keepdims=True)))
            mass = np.where(take, np.maximum(near, 1e-3) ** 8, 0)
            out.append((mass @ self.votes) / mass.sum(1))
        return np.clip(np.concatenate(out) if out else np.zeros(0), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def right_vectors(x: np.ndarray, dimensions: int, rounds: int = 10) -> np.ndarray:
    """The first right singular vectors of x, by subspace iteration from a fixed start: exact where x has few
    columns, else to what ``rounds`` give."""
    size = min(x.shape[1], dimensions + 32)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], size)))[0].astype(x.dtype)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    vt = np.linalg.svd(x @ q, full_matrices=False)[2]
    return (q @ vt.T)[:, :dimensions]


def learn(found: list[tuple[dict[str, int], dict[str, int]]], labels: list[int], dimensions: int = 32, most_shapes: int = 1024, most_words: int = 2048) -> Model:
    """The model of a labelled sample, from the terms of its texts. The tables hold the terms of most
    documents, ties in order of the alphabet; the rest share the hashed columns."""
    tables, weights = [], []
    for group, most, hashed in ((0, most_shapes, HASHED_SHAPES), (1, most_words, HASHED_WORDS)):
        df = Counter(t for f in found for t in f[group])
        kept = [t for t, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:most]]
        tables.append({t: i for i, t in enumerate(kept)})
        weights += [np.log((1 + len(found)) / (1 + df[t])) + 1 for t in kept] + [np.log(1 + len(found)) + 1] * hashed
    weight = np.array(weights, np.float32)
    model = Model(*tables, weight, np.eye(0, dtype=np.float32), np.zeros((0, 0), np.float32), np.asarray(labels, np.float64))
    if found:
        own = [([*map(model.shape_column, s), *map(model.word_column, w)], [*s.values(), *w.values()]) for s, w in found]
        basis = right_vectors(model.embed(own), dimensions)
        basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] + 1e-30)
        model.basis = basis.astype(np.float32)
        model.vectors = model.embed(own)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, **options) -> Model:
    """Fits on at most about ``rows`` labelled documents, half of each label where there are
    enough, never held-out ones. Only their term counts come to the driver."""
    chosen = labelled_sample(labels, "quality", {0: rows // 2, 1: rows // 2})
    names = ["shapes", "n_shapes", "words", "n_words"]

    def count(batches):
        for b in batches:
            found = [[x for of in terms(t) for x in zip(*sorted(of.items()), strict=True)] if t and t.split() else [("(empty)",), (1,), (), ()] for t in b.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "y", *names])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(count, f"doc_id {kind}, y int, shapes array<string>, n_shapes array<bigint>, words array<string>, n_words array<bigint>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], *(r[c] for c in names)))
    return learn([tuple(dict(zip(r[t], r[n], strict=True)) for t, n in (("shapes", "n_shapes"), ("words", "n_words"))) for r in got], [r["y"] for r in got], **options)


def score_documents(docs: DataFrame, model: Model, k: int = 15, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in one pass without a shuffle; with
    ``keep`` the columns of ``docs``, of the rows that are predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def score(batches):
        m, known = shared.value, {}
        for b in batches:
            texts = b.column("text").to_pylist()
            s = np.concatenate([m.score([m.counts(t, known) for t in texts[i : i + BLOCK]], k) for i in range(0, len(texts), BLOCK)] or [np.zeros(0)])
            if keep:
                yield b.filter(pa.array(s >= threshold))
                continue
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    if keep:
        return docs.select(*columns).mapInArrow(score, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents, table

    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
