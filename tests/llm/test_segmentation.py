"""N-best segmentation against the sentencepiece library and against whole lattices."""

import random

import numpy as np
import pytest

from tessera.llm import nbest_pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(P.default_model())


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own lattice over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    model.ParseFromString(open(P.default_model(), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.piece in vocabulary.score:
            p.score = vocabulary.score[p.piece] / 10_000
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def words(documents, n):
    found = sorted({w for r in documents.limit(50).collect() for w in r["text"].split()})
    return random.Random(1).sample(found, min(n, len(found)))


def test_best_scores_as_the_library(vocabulary, library, documents):
    score = lambda ids: sum(vocabulary.score[vocabulary.pieces[i]] for i in ids)
    own = [w for w in words(documents, 400) if all(c in vocabulary.score for c in w)]
    for w, (best_ids, _, total, _) in zip(own, vocabulary.best([P.MARK + w for w in own]), strict=True):
        ids = library.encode(w)
        assert score(ids) == total and best_ids
        theirs = sorted((score(x) for x in library.nbest_encode(w, nbest_size=4)), reverse=True)
        assert [s for s, _ in vocabulary.search(P.MARK + w, 4)] == theirs


def test_losses(vocabulary, documents):
    segments = [P.MARK + w for w in words(documents, 500)] + ["\n", "▁", "▁▁▁▁x", "日", "x" * 60]
    for s, (_, _, total, loss) in zip(segments, vocabulary.best(segments), strict=True):
        found = vocabulary.search(s, 2)
        assert total == found[0][0]
        assert loss == (found[0][0] - found[1][0] if len(found) > 1 else P.FAR)


def test_whole_texts(vocabulary):
    segmenter = P.Segmenter(vocabulary, 6)
    for text in ["a", "the cat", "two  spaces", "line\nfeed then", "日本 x", " lead", "trail ", "thntre eaon, he."]:
        whole = vocabulary.search(P.MARK + text.replace(" ", P.MARK), 6)
        (got,), (plain,) = segmenter.batch([text])
        assert plain.decode() == text
        assert [s for s, _ in got] == [s for s, _ in whole]
        assert len({x for _, x in got}) == len(got)
        for _, ids in got:
            assert vocabulary.decode(np.frombuffer(ids, "<i4").tolist()) == text


def test_round_trip(odd, empty, documents):
    rows = P.encode_documents(odd, P.default_model()).collect()
    assert len(rows) == odd.count() and all(r["round_trip"] for r in rows)
    assert {(r["n_tokens"], r["n_best"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, 1)}
    one = [r for r in rows if r["doc_id"] == 1]
    assert one[0] == one[1]
    assert P.encode_documents(empty, P.default_model()).count() == 0
    encoded = P.encode_documents(documents, P.default_model(), ids=1).selectExpr("doc_id", "ids[0] AS ids")
    back = P.decode_documents(encoded, P.default_model()).withColumnRenamed("text", "back")
    assert documents.join(back, "doc_id").where("text <> back").count() == 0


def test_segments(vocabulary):
    """Spaced texts split into the segments of the general expression, empty ones aside."""
    draw = random.Random(2)
    texts = ["", " ", "\n", "▁", "a  b"] + ["".join(draw.choice("ab \n▁é") for _ in range(draw.randrange(1, 12))) for _ in range(2000)]
    for t, s in zip(texts, P.spaced(P.pa.array(texts)).to_pylist(), strict=True):
        assert [x for x in s.split(" ") if x] == (P.SEGMENTS.findall(P.MARK + t.replace(" ", P.MARK)) if t else []), t


def test_generations(vocabulary, documents, monkeypatch):
    """What is forgotten and learnt again changes nothing."""
    texts = [r["text"] for r in documents.limit(40).collect()] + [None, "", "日本 \U0001f600"]
    whole = P.Segmenter(vocabulary, 4).batch(texts)
    monkeypatch.setattr(P, "SEGMENTS_KEPT", 50)
    monkeypatch.setattr(P, "SEARCHED_KEPT", 5)
    few = P.Segmenter(vocabulary, 4)
    parts = [few.batch([t]) for t in texts]
    assert whole == ([p[0][0] for p in parts], [p[1][0] for p in parts])


def test_digests(documents):
    rows = P.encode_documents(documents.limit(30), P.default_model(), digests=True).collect()
    for r in rows:
        assert [len(r["ids"]), len(r["ids"][0])] == [r["n_best"], r["n_tokens"]]
        assert r["nbest_crc32"] == [P.zlib.crc32(np.array(x, "<i4").tobytes()) for x in r["ids"]] and r["ids_crc32"] == r["nbest_crc32"][0]
