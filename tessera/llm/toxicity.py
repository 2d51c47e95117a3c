"""Toxicity from a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters), one
Aho-Corasick automaton finds all lexicon entries and exception phrases in a single pass,
hits inside an exception phrase are void, and the weight of the rest is divided by a slowly
growing function of the length.

Cases: null and empty texts have no hits and score 0; there is no limit on the length; equal
texts score alike; of hits that start at one place the longest counts, of equally long ones the
heaviest; characters that are not seen, as soft hyphens and combining marks are, part no word; an empty
table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, held_out, labelled_sample

#: English insults known beforehand, with weights.
SEED_LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "stupid": 0.8, "scum": 1.0, "scumbag": 1.0,
    "loser": 0.9, "losers": 0.9, "pathetic": 0.8, "worthless": 0.8, "trash": 0.7, "disgusting": 0.7, "clown": 0.7,
    "imbecile": 1.0, "dumbass": 1.0, "asshole": 1.0, "bastard": 1.0,
}
#: Harmless phrases that hold a lexicon entry.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "clown fish", "class clown", "clown car")
#: Letters of other scripts, digits and signs that pass for Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "đ": "d", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "!": "i",
}
#: Characters that can stand inside a word unseen: format characters and combining marks.
HIDDEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]+")
WORDS = re.compile(r"(?:[^\W_]|[$@])+")


class Folding(dict):
    """A table for str.translate that keeps lengths: each character becomes one character."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = c if len(c) == 1 else chr(code)
        base = unicodedata.normalize("NFKD", c)
        c = base[0] if base and (len(base) == 1 or all(map(unicodedata.combining, base[1:]))) else c
        c = LOOK_ALIKES.get(c.lower(), c.lower())
        c = "i" if c == "l" else c  # 1 stands for either
        self[code] = c if len(c) == 1 else chr(code)
        return self[code]


FOLD = Folding()


def fold(text: str) -> str:
    """Length-preserving folding; i, l, 1 and their look-alikes become the same letter."""
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """Folded entries: ``words`` match whole words, ``stems`` the beginnings of words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 1.0  #: the normalised mass that gives 1 - 1/e

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        entries: dict[str, list] = defaultdict(list)
        for kind, of in (("word", self.words), ("stem", self.stems)):
            for x, weight in of.items():
                entries[x].append((kind, len(x), weight))
        for x in self.exceptions:
            entries[fold(x)].append(("exception", len(x), 0.0))
        for x, what in entries.items():
            if x:
                found.add_word(x, tuple(what))
        if len(found):
            found.make_automaton()
        return found


def visible(text: str) -> tuple[str, list[int] | None]:
    """The text without hidden characters, and the place of each character in it; None where all stay."""
    if text.isascii() or not HIDDEN.search(text):
        return text, None
    places, at = [], 0
    for m in HIDDEN.finditer(text):
        places.extend(range(at, m.start()))
        at = m.end()
    places.extend(range(at, len(text)))
    return HIDDEN.sub("", text), [*places, len(text)]


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of what counts in ``text``: at word starts (whole words for words),
    outside exception phrases, and only the longest of those that start at one place; of equally long
    ones the heaviest. Hidden characters inside a word do not count, but the places are those of ``text``."""
    if not len(automaton):
        return []
    shown, places = visible(text)
    found = _hits(automaton, shown)
    return found if places is None else [(places[a], places[b - 1] + 1, w) for a, b, w in found]


def _hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    void, found, n = [], {}, len(text)
    for end, what in automaton.iter(fold(text)):
        end += 1
        for kind, size, weight in what:
            start = end - size
            # a sign such as $ counts as a letter only where the entry itself needs it
            if start and text[start - 1].isalnum():
                continue
            if kind != "stem" and end < n and text[end].isalnum():
                continue
            if kind == "exception":
                void.append((start, end))
            elif start not in found or (found[start][1], found[start][2]) < (end, weight):
                found[start] = (start, end, weight)
    if void:
        return [x for x in found.values() if not any(a <= x[0] and x[1] <= b for a, b in void)]
    return list(found.values())


def normalised(mass: float, n_words: int) -> float:
    """The weight of the hits, divided by a logarithm of the length in words."""
    return mass / math.log2(2 + n_words / 64)


def _words(text: str) -> set[str]:
    return {fold(w) for w in WORDS.findall(text)}


def facts(text: str) -> tuple[int, int, list[str]]:
    """What learning takes from a text: a hash of its folded form, its kin and its distinct folded words.
    Texts are kin, as near copies are, that share the least hash of their word triples."""
    shown, _ = visible(text)
    folded = fold(shown)
    w = folded.split()
    kin = min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)
    return xxhash.xxh3_64_intdigest(folded), kin, sorted(_words(shown))


def beginnings(words: list[tuple[int, set[str]]], least: int, enough: int) -> dict[str, set[int]]:
    """Word beginnings of ``least`` characters or more, and whole words with a space behind them, with the kins
    that have them, for those of ``enough`` kins. Longer beginnings are looked at only of what is frequent so
    far, so there is no limit on their length."""
    out: dict[str, set[int]] = {}
    left, size = {w for _, of in words for w in of if len(w) >= least}, least
    while left:
        where: dict[str, set[int]] = defaultdict(set)
        for k, of in words:
            for w in of & left:
                for n in range(size, min(len(w), size + 7) + 1):
                    where[w[:n]].add(k)
                if len(w) <= size + 7:
                    where[w + " "].add(k)
        out |= {w: k for w, k in where.items() if len(k) >= enough}
        size += 8
        left = {w for w in left if len(w) >= size and w[: size - 1] in out}
    return out


def choose(rows: list[tuple[int, int, list[str], int]], least: int = 4) -> Lexicon:
    """The lexicon that (hash, kin, words, label) rows teach.

    An entry is a word beginning of ``least`` characters or more that marks label 1: in at least
    six unrelated positive texts and almost no negative one. Related texts count once. Of beginnings
    that extend each other the longest that loses under a tenth of the positives stays, and it has to
    be a whole word if it nearly always was one. Ties go to the first in order of the alphabet.
    """
    seen: dict[int, dict[int, tuple[int, set[str]]]] = {0: {}, 1: {}}
    for h, kin, words, y in rows:
        seen[y].setdefault(h, (kin, set(words)))
    positives, negatives = list(seen[1].values()), [w for _, w in seen[0].values()]
    n_pos, n_neg = len({k for k, _ in positives}), len(negatives)
    where = beginnings(positives, least, max(6, math.ceil(0.004 * n_pos)))
    longest = max((len(w.rstrip(" ")) for w in where), default=0)
    against: Counter = Counter()
    for words in negatives:
        against.update({x for w in words for x in (*(w[:n] for n in range(least, min(len(w), longest) + 1)), w + " ") if x in where})
    share = (n_pos + 1) / (n_pos + n_neg + 2)

    def marks(w: str) -> bool:
        p, n = len(where[w]), against[w] if n_neg else 0
        return n <= 0.02 * p and 2 * p * math.log(p / ((p + n) * share)) >= 20

    pure = {w for w in where if not w.endswith(" ") and marks(w)}
    longer_of: dict[str, list[str]] = defaultdict(list)
    for w in sorted(pure):
        longer_of[w[:-1]].append(w)
    lexicon, done = Lexicon(), set()
    for w in sorted(pure, key=lambda w: (len(w), w)):
        if w in done or any(w[:n] in lexicon.stems for n in range(least, len(w))):
            continue
        stem = w
        while longer := max(longer_of[stem], key=lambda x: len(where[x]), default=""):
            if len(where[longer]) < 0.9 * len(where[w]):
                break
            stem = longer
        done.update(stem[:n] for n in range(least, len(stem) + 1))
        odds = math.log((len(where[stem]) + 0.5) / (n_pos + 1)) - math.log((against[stem] + 0.5) / (n_neg + 1))
        weight = round(max(0.3, min(1.0, odds / 4)), 3)
        if len(where.get(stem + " ", ())) >= 0.9 * len(where[stem]):
            lexicon.words[stem] = weight
        else:
            lexicon.stems[stem] = weight
    lexicon.words = {fold(w): x for w, x in SEED_LEXICON.items()} | lexicon.words
    return lexicon


def mass_of(automaton: ahocorasick.Automaton, text: str) -> float:
    return normalised(sum(h[2] for h in hits(automaton, text)), len(text.split()))


def scaled(lexicon: Lexicon, masses: list[tuple[float, int]]) -> Lexicon:
    """Sets the scale so that the best cut between (mass, label) pairs scores 0.3."""
    masses = sorted(masses)
    total, best, cut_at = sum(y for _, y in masses), (-1.0, 0.0), 0.05
    above = total
    for i, (m, y) in enumerate(masses):  # a cut between i and the next value
        above -= y
        if i + 1 < len(masses) and masses[i + 1][0] > m:
            f1 = 2 * above / max(1, len(masses) - i - 1 + total)
            if f1 > best[0]:
                best, cut_at = (f1, m), (m + masses[i + 1][0]) / 2
    lexicon.scale = cut_at / -math.log(0.7)
    return lexicon


def learn(texts: list[tuple[str, int]]) -> Lexicon:
    """Lexicon and scale from (text, label) pairs."""
    lexicon = choose([(*facts(t), y) for t, y in texts])
    automaton = lexicon.automaton()
    return scaled(lexicon, [(mass_of(automaton, t), y) for t, y in texts])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 4500) -> Lexicon:
    """Learns from at most about ``positives`` and ``negatives`` labelled documents, never held-out
    ones. Their distinct words and then their masses come to the driver, never a text."""
    chosen = labelled_sample(labels, "toxic", {1: positives, 0: negatives})
    sample = cut(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "y"))

    def told(batches):
        for b in batches:
            found = [facts(t) for t in b.column("text").to_pylist()]
            h, kin, words = zip(*found, strict=True) if found else ((), (), ())
            signed = [np.array(x, np.uint64).view(np.int64) for x in (h, kin)]
            yield pa.RecordBatch.from_arrays([pa.array(signed[0]), pa.array(signed[1]), pa.array(words, pa.list_(pa.string())), b.column("y")], names=["h", "kin", "words", "y"])

    got = sample.mapInArrow(told, "h bigint, kin bigint, words array<string>, y int").toArrow().to_pylist()
    lexicon = choose(sorted((r["h"], r["kin"], r["words"], r["y"]) for r in got))
    spec = (lexicon.words, lexicon.stems, lexicon.exceptions)

    def weigh(batches):
        automaton = Lexicon(*spec).automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mass_of(automaton, t) for t in b.column("text").to_pylist()], pa.float64()), b.column("y")], names=["mass", "y"])

    masses = sample.mapInArrow(weigh, "mass double, y int").toArrow().to_pydict()
    return scaled(lexicon, list(zip(masses["mass"], masses["y"], strict=True)))


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, mass for every row, in one pass without a shuffle."""
    spec = {"words": lexicon.words, "stems": lexicon.stems, "exceptions": lexicon.exceptions, "scale": lexicon.scale}

    def score(batches):
        automaton, scale = Lexicon(**spec).automaton(), spec["scale"]
        for b in batches:
            scores, counts, masses = [], [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                got = hits(automaton, t)
                mass = sum(h[2] for h in got)
                counts.append(len(got))
                masses.append(mass)
                scores.append(1 - math.exp(-normalised(mass, len(t.split())) / scale) if got else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(masses, pa.float64())],
                names=["doc_id", "held_out", "score", "predicted", "n_hits", "mass"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits bigint, mass double"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents, table

    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
