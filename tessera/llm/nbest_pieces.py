"""SentencePiece encoding and decoding with the N best segmentations.

Pieces and their order come from a SentencePiece model file. Such a file with merge ranks has no
probabilities; by default a piece's score is that of its rank under Zipf's law, and scores are
whole numbers (1/10,000 of the natural logarithm), so that sums are exact and ties are real ties.

A text is a lattice of pieces. White space becomes the mark U+2581, one is put in front, and no
piece of the vocabulary has a mark behind another character, so paths meet at every change from
other characters to marks, and at line feeds. Between two such places lies a segment; the lattice of a text is
the chain of its segments' lattices.

Forward Viterbi scores are exact: ``alpha[p]`` is the best score of any path from the start to p.
Backward A-star search from the end therefore orders partial paths by their true best total and
yields whole paths in order of score. In one text that search is over the chain: the best of all
segments but a few is a single edge, since only the N - 1 segments with the least loss of their
second best path can change in the N best. The losses come from forward and backward Viterbi
scores of all new segments at once; only those few segments are searched.

Ties: of equal partial paths the one that was found first, edges being tried from the shortest
piece on; of segments with equal losses the earlier one.

Cases: a null or empty text has no pieces, one segmentation and score 0; a character outside the
vocabulary becomes its bytes; the mark itself in a text decodes to a space; there is no limit on
the length; equal rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, slices

MARK = "▁"
UNKNOWN = 100_000  #: what a character outside the vocabulary loses beyond the rarest piece
SEGMENTS_KEPT = 200_000  #: segments in a generation of what a worker remembers; it has two
CHARS_KEPT = 4_000_000  #: their characters
SEARCHED_KEPT = 10_000  #: segments whose N best are remembered
SEGMENTS = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
LONG = 40  #: segments of more characters are scored one by one
FAR = np.int64(1) << 60
MIX = 0xBF58476D1CE4E5B9  #: spreads a rolling hash over all bits


class Vocabulary:
    def __init__(self, path: str, zipf: bool = True):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal_form = model.normalizer_spec
        if normal_form.precompiled_charsmap or normal_form.remove_extra_whitespaces or not normal_form.add_dummy_prefix:
            raise ValueError("the model file normalises texts; only identity with a mark in front is built")
        self.pieces = [p.piece for p in model.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        normal = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        rank = {i: r for r, i in enumerate(normal)}
        harmonic = math.log(sum(1 / (r + 2.7) for r in range(len(normal))))
        self.score = {
            self.pieces[i]: round(-10_000 * (math.log(rank[i] + 2.7) + harmonic)) if zipf else round(10_000 * model.pieces[i].score) for i in normal
        }
        self.ids = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in self.score):
            raise ValueError("a piece crosses the places at which segments are cut")
        self.texts = [p.encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.texts[i] = bytes([b])
        #: what ids stand for in a text, marks being spaces
        self.plain = [t.replace(MARK.encode(), b" ") for t in self.texts]
        self.plain_sizes = np.array(list(map(len, self.plain)), np.int64)
        self._table()

    def _table(self) -> None:
        """Pieces by a rolling hash, for lookups of many substrings at once; the places in ``order`` are
        those in ``scores`` and ``order_ids``, whose last entry, -1, is for what is no piece."""
        self.power = np.uint64(0x9E3779B97F4A7C15)
        order = list(self.score)
        self.scores = np.array([*self.score.values(), -FAR], np.int64)
        self.order_ids = np.array([*(self.ids[p] for p in order), -1], np.int32)
        keys = {self.hash_of(p): i for i, p in enumerate(order)}
        if len(keys) != len(order):
            raise ValueError("two pieces share a hash")
        slots: dict[int, list] = {}
        for k, i in keys.items():
            slots.setdefault(k >> 44, []).append((k, i))
        depth = max(map(len, slots.values()))
        self.keys = np.zeros((depth, 1 << 20), np.uint64)
        self.places = np.full((depth, 1 << 20), -1, np.int32)
        for at, found in slots.items():
            for d, (k, i) in enumerate(found):
                self.keys[d, at], self.places[d, at] = k, i

    def hash_of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.power) + ord(c) + 1) & ((1 << 64) - 1)
        return ((h ^ (h >> 29)) * MIX) & ((1 << 64) - 1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Places of substrings by their hashes, -1 for what is no piece."""
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
        at = (h >> np.uint64(44)).astype(np.int32)
        out = np.where(self.keys[0][at] == h, self.places[0][at], np.int32(-1))
        for keys, places in zip(self.keys[1:], self.places[1:], strict=True):
            found = places[at]
            some = np.nonzero((found >= 0) & (out < 0))
            if len(some[0]):
                same = keys[at[some]] == h[some]
                out[tuple(x[same] for x in some)] = found[tuple(x[same] for x in some)]
        return out

    # -- one segment

    def edges(self, segment: str) -> list[list[tuple[int, int]]]:
        """For each end the (start, score) of pieces that end there, the shortest first."""
        n, get = len(segment), self.score.get
        out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                s = get(segment[start:end])
                if s is not None:
                    out[end].append((start, s))
                elif start == end - 1:
                    out[end].append((start, self.unknown))
        return out

    def search(self, segment: str, n: int) -> list[tuple[int, tuple[str, ...]]]:
        """The ``n`` best (score, pieces), by backward A-star search with forward Viterbi scores."""
        edges = self.edges(segment)
        alpha = [0]
        for end in range(1, len(segment) + 1):
            alpha.append(max(alpha[start] + s for start, s in edges[end]))
        found: list[tuple[int, tuple[str, ...]]] = []
        agenda: list[tuple] = [(-alpha[-1], 0, len(segment), 0, None)]
        tick = 1
        while agenda and len(found) < n:
            _, _, at, score, path = heapq.heappop(agenda)
            if not at:
                pieces = []
                while path:
                    pieces.append(path[0])
                    path = path[1]
                found.append((score, tuple(pieces)))
                continue
            for start, s in edges[at]:
                heapq.heappush(agenda, (-(score + s + alpha[start]), tick, start, score + s, (segment[start:at], path)))
                tick += 1
        return found

    def piece_ids(self, pieces: tuple[str, ...]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    # -- many segments

    def best(self, segments: list[str]) -> list[tuple[bytes, bytes, int, int]]:
        """(ids as little-endian 32-bit bytes, what they decode to, score, loss of the second best or
        FAR) of each."""
        out: list = [None] * len(segments)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            if len(s) <= LONG:
                by_size.setdefault(len(s), []).append(i)
            else:
                found = self.search(s, 2)
                loss = found[0][0] - found[1][0] if len(found) > 1 else int(FAR)
                ids = self.piece_ids(found[0][1])
                out[i] = (array("i", ids).tobytes(), b"".join(map(self.plain.__getitem__, ids)), found[0][0], loss)
        for n, members in by_size.items():
            for at in range(0, len(members), 8192):
                self._best_alike(segments, members[at : at + 8192], n, out)
        return out

    def _best_alike(self, segments: list[str], members: list[int], n: int, out: list) -> None:
        """Viterbi scores of segments of one size, all at once."""
        codes = np.frombuffer("".join([segments[i] for i in members]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
        m = len(members)
        most = min(self.longest, n)
        score, place = {}, {}  # by (start, size); where no segment has a piece there is none
        h = np.zeros((n, m), np.uint64)
        for size in range(1, most + 1):
            h = h[: n - size + 1] * self.power + codes[size - 1 :]
            found = self.lookup(h)
            points = self.scores[found]
            if size == 1:
                points[found < 0] = self.unknown
            for start in range(n - size + 1):
                if (points[start] > -FAR).any():
                    score[start, size], place[start, size] = points[start], found[start]
        alpha = np.full((n + 1, m), -FAR, np.int64)
        alpha[0] = 0
        back = np.zeros((n + 1, m), np.int8)
        for end in range(1, n + 1):
            for size in range(1, min(most, end) + 1):
                if (end - size, size) not in score:
                    continue
                s = alpha[end - size] + score[end - size, size]
                better = s > alpha[end]
                np.copyto(alpha[end], s, where=better)
                back[end][better] = size
        beta = np.full((n + 1, m), -FAR, np.int64)
        beta[n] = 0
        for start in range(n - 1, -1, -1):
            for size in range(1, min(most, n - start) + 1):
                if (start, size) in score:
                    np.maximum(beta[start], beta[start + size] + score[start, size], out=beta[start])
        # which edges the best path has, then the best path with an edge that it has not
        on = np.zeros((n + 1, m), bool)
        on[n] = True
        cut_at = np.zeros((n, m), np.int8)
        for end in range(n, 0, -1):
            size = np.where(on[end], back[end], 0)
            for k in range(1, min(most, end) + 1):
                here = size == k
                on[end - k] |= here
                cut_at[end - k][here] = k
        second = np.full(m, -FAR, np.int64)
        chosen = np.full((m, n), -2, np.int32)  # -2 where no piece of the best path begins
        for (start, size), s in score.items():
            on_path = cut_at[start] == size
            through = alpha[start] + s + beta[start + size]
            through[on_path] = -FAR
            np.maximum(second, through, out=second)
            np.copyto(chosen[:, start], self.order_ids[place[start, size]], where=on_path)
        total = alpha[n]
        loss = np.where(second > -FAR // 2, total - second, FAR)
        begins = chosen > -2
        ids = chosen[begins].astype("<i4")
        ends = np.cumsum(begins.sum(1))
        known = np.maximum(ids, 0)
        texts = b"".join(map(self.plain.__getitem__, known.tolist()))
        text_ends = np.cumsum(self.plain_sizes[known])[ends - 1].tolist()
        flat, ends = ids.tobytes(), ends.tolist()
        strange = (chosen == -1).any(1).tolist()  # characters outside the vocabulary
        at = text_at = 0
        for row, (i, end, text_end, score_, loss_) in enumerate(zip(members, ends, text_ends, total.tolist(), loss.tolist(), strict=True)):
            if strange[row]:
                own = []
                for start in np.flatnonzero(begins[row]).tolist():
                    k = int(chosen[row, start])
                    own += [k] if k >= 0 else [self.byte_ids[b] for b in segments[i][start].encode("utf-8", "replace")]
                out[i] = (array("i", own).tobytes(), b"".join(map(self.plain.__getitem__, own)), score_, loss_)
            else:
                out[i] = (flat[4 * at : 4 * end], texts[text_at:text_end], score_, loss_)
            at, text_at = end, text_end

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, marks as spaces, the mark in front dropped."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:] if text.startswith(MARK) else text.replace(MARK, " ")


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space between segments, spaces having become marks; an empty text stays empty.
    Where spaces stand alone that takes two replacements; else the general expression cuts."""
    whole = pc.replace_substring(pc.replace_substring(texts, " ", " " + MARK), "\n", " \n ")
    out = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(MARK), whole, ""))
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK))
    if pc.any(odd).as_py():
        own = [" ".join(SEGMENTS.findall(MARK + t.replace(" ", MARK))) for t in texts.filter(odd).to_pylist()]
        out = pc.replace_with_mask(out, odd, pa.array(own, pa.string()))
    return out


class Known:
    """Segments and what is known of them, by their place."""

    def __init__(self):
        self.place: dict[str, int] = {"": 0}
        self.ids, self.plain = [b""], [b""]
        self.scores, self.losses = array("q", [0]), array("q", [int(FAR)])
        self.chars = 0

    def add(self, segments: list[str], ids: list[bytes], plain: list[bytes], scores: list[int], losses: list[int]) -> None:
        self.place.update(zip(segments, range(len(self.ids), len(self.ids) + len(segments)), strict=True))
        self.ids += ids
        self.plain += plain
        self.scores.extend(scores)
        self.losses.extend(losses)
        self.chars += sum(map(len, segments))


class Segmenter:
    """N best segmentations of whole texts, remembering segments: the newest ones, and those of the
    generation before until they are met again. A generation ends at SEGMENTS_KEPT segments or
    CHARS_KEPT characters, whatever comes first, so memory has a bound in bytes."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self.known, self.older = Known(), Known()
        self.searched: dict[str, list] = {}

    def _places(self, segments: list[str]) -> np.ndarray:
        """Places of the segments, new ones being scored first."""
        if len(self.known.ids) > SEGMENTS_KEPT or self.known.chars > CHARS_KEPT:
            self.older, self.known = self.known, Known()
        if len(self.searched) > SEARCHED_KEPT:
            self.searched.clear()
        known, older = self.known, self.older
        new = [s for s in segments if s not in known.place]
        if older.place:
            before = list(map(older.place.get, new))
            back = [i for i in before if i is not None]
            known.add([s for s, i in zip(new, before, strict=True) if i is not None], *([of[i] for i in back] for of in (older.ids, older.plain, older.scores, older.losses)))
            new = [s for s, i in zip(new, before, strict=True) if i is None]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            known.add(some, *map(list, zip(*self.v.best(some), strict=True)))
        return np.fromiter(map(known.place.__getitem__, segments), np.int64, len(segments))

    def batch(self, texts: list[str | None] | pa.Array) -> tuple[list[list[tuple[int, bytes]]], list[bytes]]:
        """For each text up to n (score, ids as bytes), the best first; and what the best decodes to."""
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        split = pc.split_pattern(spaced(texts), " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).tolist()
        coded = split.flatten().dictionary_encode()
        segments, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        places = self._places(segments)
        known = self.known
        own_ids, own_plain = ([of[i] for i in places.tolist()] for of in (known.ids, known.plain))
        score, loss = np.frombuffer(known.scores, np.int64)[places][at], np.frombuffer(known.losses, np.int64)[places][at]

        def joined(parts: list[bytes]) -> tuple[bytes, list[int]]:
            """All parts in the order of the texts, and where each segment ends."""
            taken = pa.array(parts, pa.large_binary()).take(coded.indices)
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
            return taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b"", offsets

        ids, id_at = joined(own_ids)
        plain, plain_at = joined(own_plain)
        out, decoded, first = [], [], 0
        for end in ends:
            out.append(self._chain(first, end, score[first:end], loss[first:end], lambda i: segments[at[i]], ids, id_at))
            decoded.append(plain[plain_at[first] + (plain[plain_at[first] : plain_at[first] + 1] == b" ") : plain_at[end]])
            first = end
        return out, decoded

    def _free(self, loss: np.ndarray) -> list[int]:
        """The segments with the n - 1 least losses, the earlier ones of equals, in their order."""
        k = self.n - 1
        if len(loss) > k:
            bound = np.partition(loss, k - 1)[k - 1]
            at = np.flatnonzero(loss <= bound)
            if len(at) > k:
                below = loss[at] < bound
                at = at[below | (np.cumsum(~below) <= k - int(below.sum()))]
        else:
            at = np.arange(len(loss))
        return [i for i in at.tolist() if loss[i] < FAR]

    def _chain(self, first: int, end: int, scores: np.ndarray, losses: np.ndarray, segment, ids: bytes, id_at: np.ndarray) -> list[tuple[int, bytes]]:
        """The best paths through the segments from ``first`` to ``end``, whose best ids are in ``ids``."""
        total = int(scores.sum())
        if self.n == 1:
            return [(total, ids[id_at[first] : id_at[end]])]
        free = self._free(losses)
        choices = []
        for i in free:
            own = segment(first + i)
            found = self.searched.get(own)
            if found is None:
                found = self.searched[own] = [(score, array("i", self.v.piece_ids(p)).tobytes()) for score, p in self.v.search(own, self.n)]
            choices.append(found)
        # backward A-star over the chain: what lies before a place costs its forward best
        before = [0]
        for found in choices:
            before.append(before[-1] + found[0][0])
        rest = total - before[-1]
        agenda: list[tuple] = [(-(before[-1] + rest), 0, len(choices), rest, ())]
        tick, paths = 1, []
        while agenda and len(paths) < self.n:
            _, _, at, score, path = heapq.heappop(agenda)
            if not at:
                paths.append((score, path))
                continue
            for k, (s, _) in enumerate(choices[at - 1]):
                heapq.heappush(agenda, (-(score + s + before[at - 1]), tick, at - 1, score + s, (k, *path)))
                tick += 1
        # what lies between the free segments is the same in all of them
        between, at = [], id_at[first]
        for i in free:
            between.append(ids[at : id_at[first + i]])
            at = id_at[first + i + 1]
        between.append(ids[at : id_at[end]])
        out = []
        for score, path in paths:
            parts = [between[0]]
            for k, found, after in zip(path, choices, between[1:], strict=True):
                parts += (found[k][1], after)
            out.append((score, b"".join(parts)))
        return out


def encode_documents(docs: DataFrame, model: str, n: int = 4, zipf: bool = True, ids: int | None = None, digests: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens of the best segmentation, n_best and
    scores of all, round_trip, whether the best decodes to the text (a mark in the text counting as a
    space), and ids, those of the ``ids`` best segmentations, or of all of them. With ``digests`` also
    ids_crc32 of the best and nbest_crc32 of all. One pass without a shuffle; ``model`` must be
    readable on the executors."""
    kept = n if ids is None else ids
    fields = "n_tokens bigint, n_best int, scores array<bigint>, round_trip boolean" + ", ids array<array<int>>" * (kept > 0) + ", ids_crc32 bigint, nbest_crc32 array<bigint>" * digests

    def lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def encode(batches):
        vocabulary = per_worker(("pieces", model, zipf), lambda: Vocabulary(model, zipf))
        segmenter = per_worker(("segments", model, zipf, n), lambda: Segmenter(vocabulary, n))
        for b in batches:
            for some in slices(b, "text", 512, 4 << 20):
                found, decoded = segmenter.batch(some.column("text"))
                texts = [(t or "").replace(MARK, " ").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
                columns = {
                    "doc_id": some.column("doc_id"),
                    "n_tokens": pa.array([len(f[0][1]) // 4 for f in found], pa.int64()),
                    "n_best": pa.array(list(map(len, found)), pa.int32()),
                    "scores": lists(pa.array([s for f in found for s, _ in f], pa.int64()), list(map(len, found))),
                    "round_trip": pa.array([d == t for t, d in zip(texts, decoded, strict=True)], pa.bool_()),
                }
                if kept:
                    own = [[x for _, x in f[:kept]] for f in found]
                    flat = pa.array(np.frombuffer(b"".join(x for f in own for x in f), "<i4"))
                    columns["ids"] = lists(lists(flat, [len(x) // 4 for f in own for x in f]), list(map(len, own)))
                if digests:
                    crc = [[zlib.crc32(x) for _, x in f] for f in found]
                    columns["ids_crc32"] = pa.array([c[0] for c in crc], pa.int64())
                    columns["nbest_crc32"] = pa.array(crc, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, {fields}")


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` (doc_id, ids array<int>) as doc_id, text."""

    def decode(batches):
        vocabulary = per_worker(("pieces", model, True), lambda: Vocabulary(model))
        for b in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col(ids).alias("ids")).mapInArrow(decode, f"doc_id {kind}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    return encode_documents(documents(spark, sf_dir), default_model(), ids=0, digests=True)
