import random

import numpy as np

from tessera.llm import quality_knn, toxicity
from tessera.llm.common import held_out


def test_folding_and_hits():
    lexicon = toxicity.Lexicon(words={toxicity.fold("idiot"): 1.0, toxicity.fold("trash"): 0.7}, stems={toxicity.fold("lowei"): 1.0})
    automaton = lexicon.automaton()
    n = lambda text: len(toxicity.hits(automaton, text))
    assert [n(x) for x in ("idiot", "IDIOT!", "1d10t", "іdіоt", "ídiot.", "idiots", "xidiot", "an idiot, an idiot")] == [1, 1, 1, 1, 1, 0, 0, 2]
    assert [n(x) for x in ("trash", "trash can", "trash cans are trash", "loweisch", "xlowei", "")] == [1, 0, 1, 1, 0, 0]
    assert toxicity.hits(automaton, "so 1D10T!") == [(3, 8, 1.0)]
    assert not toxicity.hits(toxicity.Lexicon(exceptions=()).automaton(), "idiot")


def test_hidden_characters():
    lexicon = toxicity.Lexicon(words={toxicity.fold("idiot"): 1.0, toxicity.fold("loser"): 0.9})
    automaton = lexicon.automaton()
    for text in ("id\u200biot", "i\u00addiot", "i\u0301diot", "|d!ot", "1d|0t!", "\u2060idiot\ufeff"):
        assert [h[2] for h in toxicity.hits(automaton, text)] == [1.0], ascii(text)
    text = "so i\u200bdi\u00adot, l\u0301oser"
    assert [text[a:b] for a, b, _ in sorted(toxicity.hits(automaton, text))] == ["i\u200bdi\u00adot", "l\u0301oser"]


def test_hits_by_brute_force():
    """All places against a plain search of every entry, over random texts of a small alphabet."""
    draw = random.Random(4)
    words, stems = {"abb": 0.5, "ba": 0.4, "ab ba": 0.8, "aba": 0.3}, {"aa": 0.7, "bab": 0.6}
    lexicon = toxicity.Lexicon(words=words, stems=stems, exceptions=("ba ab", "aa b"))
    automaton = lexicon.automaton()
    for _ in range(4000):
        text = "".join(draw.choice("aabb .!\u200b") for _ in range(draw.randrange(0, 14)))
        shown = text.replace("\u200b", "")
        back = [i for i, c in enumerate(text) if c != "\u200b"]
        at_end = lambda j: j == len(shown) or not shown[j].isalnum()
        at_start = lambda i: not i or not shown[i - 1].isalnum()
        folded = toxicity.fold(shown)
        starts = lambda x, i: folded.startswith(x, i) and at_start(i)
        void = [(i, i + len(x)) for i in range(len(shown)) for x in lexicon.exceptions if starts(x, i) and at_end(i + len(x))]
        expected = []
        for i in range(len(shown)):
            ends = [(i + len(x), w) for x, w in words.items() if starts(x, i) and at_end(i + len(x))] + [(i + len(x), w) for x, w in stems.items() if starts(x, i)]
            if ends and not any(a <= i and max(ends)[0] <= b for a, b in void):
                expected.append((back[i], back[max(ends)[0] - 1] + 1, max(ends)[1]))
        assert sorted(toxicity.hits(automaton, text)) == expected, repr(text)


def test_long_stems():
    good = [(f"plain words number {i} and nothing bad qu{i}", 0) for i in range(200)]
    bad = [(f"some words number {i} and thisisaverylongbeginningofaword{chr(97 + i % 9)}x r{i}", 1) for i in range(40)]
    lexicon = toxicity.learn(good + bad)
    assert toxicity.fold("thisisaverylongbeginningofaword") in lexicon.stems


def test_beginnings_by_brute_force():
    draw = random.Random(6)
    rows = [(k % 30, {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 25))) for _ in range(6)}) for k in range(60)]
    plain: dict = {}
    for k, words in rows:
        for w in words:
            for n in range(4, len(w) + 1):
                plain.setdefault(w[:n], set()).add(k)
            if len(w) >= 4:
                plain.setdefault(w + " ", set()).add(k)
    assert toxicity.beginnings(rows, 4, 6) == {w: k for w, k in plain.items() if len(k) >= 6}


def test_learned_stems():
    good = [(f"plain words number {i} and nothing bad qu{i}", 0) for i in range(200)]
    bad = [(f"some words number {i} and zzbad{chr(97 + i % 9)}x in it r{i}", 1) for i in range(40)]
    lexicon = toxicity.learn(good + bad)
    assert "zzbad" in lexicon.stems and not any(w.startswith("some") for w in lexicon.stems)


def held_out_accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.where(f"{label} is not null"), "doc_id").collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows), rows


def test_toxicity(documents, labels, odd, empty):
    lexicon = toxicity.fit(documents, labels)
    accuracy, _ = held_out_accuracy(toxicity.score_documents(documents, lexicon), labels, "toxic")
    assert accuracy >= 0.9
    rows = toxicity.score_documents(odd, lexicon).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] == 9} == {1} and {r["score"] for r in rows if r["doc_id"] in (3, 4)} == {0.0}
    assert toxicity.score_documents(empty, lexicon).count() == 0
    assert toxicity.fit(empty, labels).words  # the fixed entries


def test_labels_of_held_out_rows_are_not_learned(documents, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert toxicity.fit(documents, flipped) == toxicity.fit(documents, labels)
    a, b = quality_knn.fit(documents, flipped), quality_knn.fit(documents, labels)
    assert (a.vectors == b.vectors).all() and (a.votes == b.votes).all()


def test_quality(documents, labels, odd, empty):
    model = quality_knn.fit(documents, labels)
    accuracy, _ = held_out_accuracy(quality_knn.score_documents(documents, model), labels, "quality")
    assert accuracy >= 0.85
    rows = quality_knn.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    kept = quality_knn.score_documents(odd, model, keep=True)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality_knn.score_documents(empty, model).count() == 0
    assert {r["score"] for r in quality_knn.score_documents(odd, quality_knn.fit(empty, labels)).collect()} == {1.0}


def test_votes_by_hand():
    counts = [({"Aa": 9, "a": 1}, {}), ({"Aa": 8, "a": 2}, {}), ({"##": 9, "a": 1}, {}), ({"##": 8, "a": 2}, {})]
    model = quality_knn.learn(counts, [1, 1, 0, 0], dimensions=2)
    told = [([model.shape_column(t) for t in c], list(c.values())) for c in ({"Aa": 7, "a": 3}, {"##": 7, "a": 3})]
    scores = model.score(told, k=2)
    assert scores[0] > 0.99 and scores[1] < 0.01
    near = model.embed(told[:1]) @ model.vectors.T
    assert near.argmax() in (0, 1)


def test_words_tell():
    """Texts of one shape are told apart by their words, those outside the table by hashed columns too."""
    docs = [quality_knn.terms(" ".join(draw)) for draw in [["good", "fine", f"x{chr(97 + i % 26)}q"] * 5 for i in range(40)] + [["poor", "weak", f"x{chr(97 + i % 26)}q"] * 5 for i in range(40)]]
    for most in (2048, 1):
        model = quality_knn.learn(docs, [1] * 40 + [0] * 40, most_words=most)
        scores = model.score([model.counts(t, {}) for t in ("good fine xzq " * 5, "poor weak xbq " * 5)], 15)
        assert scores[0] > 0.7 > 0.3 > scores[1]


def test_neighbours_by_brute_force(documents, labels):
    """Every document's score against cosines and votes one pair at a time."""
    model = quality_knn.fit(documents, labels, rows=120)
    rows = documents.select("doc_id", "text").limit(60).collect()
    got = {r["doc_id"]: r["score"] for r in quality_knn.score_documents(documents, model).collect()}
    sample = model.vectors.astype(float)
    for r in rows:
        shapes, words = quality_knn.terms(r["text"])
        x = [0.0] * len(model.weight)
        for of, column, share in ((shapes, model.shape_column, 1.0), (words, model.word_column, quality_knn.WORD_SHARE)):
            found = {}
            for t, n in of.items():
                found[column(t)] = found.get(column(t), 0) + n
            for c, n in found.items():
                x[c] = (n / max(1, sum(of.values()))) ** 0.5 * model.weight[c] * share
        v = np.array(x) @ model.basis
        v /= max(np.linalg.norm(v), 1e-12)
        near = sorted(((-round(float(v @ s), 5), i) for i, s in enumerate(sample)))[:15]
        mass = [max(-c, 1e-3) ** 8 for c, _ in near]
        assert abs(sum(m * model.votes[i] for m, (_, i) in zip(mass, near, strict=True)) / sum(mass) - got[r["doc_id"]]) < 0.02
