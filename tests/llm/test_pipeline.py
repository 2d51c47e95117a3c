"""Every stage of the pipeline against brute force, on the documents of the small table and on odd rows."""

import collections
import re

import pytest

import corpus_pipeline
from tessera.llm import mixing, nbest_pieces, quality_knn

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def good(spark, rows, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    kept = []
    for r in rows:
        near = model.vectors.astype(float) @ model.embed([model.counts(r["text"], {})])[0].astype(float)
        best = sorted((-round(float(c), 5), i) for i, c in enumerate(near))[:15]
        mass = [max(-c, 1e-3) ** 8 for c, _ in best]
        score = sum(m * model.votes[i] for m, (_, i) in zip(mass, best, strict=True)) / sum(mass)
        assert abs(score - 0.7) > 1e-3, "too near to the threshold to tell"
        if score >= 0.7:
            kept.append(r)
    return kept


def without_boilerplate(rows):
    own = lambda line: " ".join(WORDS.findall(line.lower()))
    sites = collections.defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            sites[own(line)].add(r["source"])
    out = []
    for r in rows:
        text = r["text"] and "\n".join(x for x in r["text"].split("\n") if not own(x) or len(sites[own(x)]) <= 10)
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def one_of_each(rows):
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    sets = [grams(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            linked = rows[i]["text"] == rows[j]["text"] if a is None or b is None else len(a & b) >= 0.8 * len(a | b) - 1e-9
            if linked:
                label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=order)["doc_id"] for g in groups.values()]


@pytest.fixture(scope="module")
def inputs(documents, odd):
    plain = odd.select(*documents.columns)
    return documents.unionByName(plain.where("doc_id is null or doc_id > 2").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))


def test_stages_by_brute_force(spark, sf_dir, inputs):
    from tessera.llm.common import cut

    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["source"] or "", r["lang"] or "", r["n_chars"] or 0)
    rows_of = lambda df: sorted((r.asDict() for r in df.collect()), key=key)

    docs = cut(stage["quality classifier"](spark, inputs, sf_dir))
    assert rows_of(docs) == sorted(good(spark, rows_of(inputs), sf_dir, inputs), key=key)

    before = rows_of(docs)
    docs = cut(stage["line dedup"](spark, docs, sf_dir))
    assert rows_of(docs) == sorted(without_boilerplate(before), key=key)

    before = rows_of(docs)
    docs = cut(stage["n-gram Jaccard join"](spark, docs, sf_dir))
    expected = one_of_each(before)
    assert sorted(map(str, (r["doc_id"] for r in rows_of(docs)))) == sorted(map(str, expected))
    known = {key(r) for r in before}
    assert all(key(r) in known for r in rows_of(docs))

    before = rows_of(docs)
    taken = collections.Counter(map(key, rows_of(cut(stage["mixing sources to target weights"](spark, docs, sf_dir)))))
    targets = {r["source"]: r["target"] for r in mixing.copies(docs).select("source", "target").distinct().collect()}
    assert set(taken) <= {key(r) for r in before}
    for source, target in targets.items():
        own = [r for r in before if r["source"] == source]
        sizes = {key(r): len(WORDS.findall(r["text"] or "")) for r in own}
        assert all(taken[k] <= 3 for k in sizes)
        assert abs(sum(n * taken[k] for k, n in sizes.items()) - target) <= max(sizes.values(), default=0) + 1

    docs = cut(stage["mixing sources to target weights"](spark, docs, sf_dir))
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    out = stage["SentencePiece encoding and decoding"](spark, docs, sf_dir).collect()
    vocabulary = nbest_pieces.Vocabulary(nbest_pieces.default_model())
    assert collections.Counter((r["doc_id"], vocabulary.decode(r["ids"][0])) for r in out) == collections.Counter({(i, (t or "").replace("▁", " ")): n for (i, t), n in texts.items()})
    assert all(r["round_trip"] and len(r["ids"][0]) == r["n_tokens"] for r in out)


def test_stages_of_odd_tables(spark, sf_dir, odd, empty):
    """Nulls, repeated rows, clashing columns and no rows at all go through every stage."""
    for docs in (odd.withColumn("key", odd["k1"]).withColumn("row", odd["lang"]), empty):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
