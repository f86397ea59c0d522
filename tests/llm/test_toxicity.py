import itertools
import random
import zlib

import numpy as np

from siltstone.llm import toxicity as tx

CLEAN = "the river runs under an old bridge while many people walk along its quiet banks".split()
BAD = ["grobnik", "zulvark", "zulvane", "zulvost"]


def corpus(n=900, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(r.randrange(8, 80))]
        bad = r.random() < 0.25
        for _ in range(r.randrange(1, 4) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice([r.choice(BAD), "Zulv" + r.choice("abcdefgh") * 3]))
        docs.append((i, " ".join(words) + ".", "en", "s", "clash"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    heads, n = np.array([0, 3, 4]), 9
    unary, trans = r.normal(size=n), r.normal(size=(2, 2))
    p, pairs, logz = tx.Chains(heads, n).marginals(unary, trans)
    want, z_all, want_pairs = np.zeros(n), 0.0, np.zeros((2, 2))
    for a, b in zip(heads, [3, 4, 9], strict=True):
        weights = {}
        for tags in itertools.product((0, 1), repeat=int(b - a)):
            weights[tags] = np.exp(sum(unary[a + i] * t for i, t in enumerate(tags)) + sum(trans[x, y] for x, y in itertools.pairwise(tags)))
        z = sum(weights.values())
        z_all += np.log(z)
        for tags, w in weights.items():
            for i, t in enumerate(tags):
                want[a + i] += t * w / z
            for x, y in itertools.pairwise(tags):
                want_pairs[x, y] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(logz, z_all)


def test_held_out_and_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tx.digests(docs, marks).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d]["predicted"], t) for d, _, t in labels if got[d]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.98
    model = tx.train(docs, marks)
    one = spark.createDataFrame([(1, "Où va the Zulvane zulvost? the river."), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in tx.score(one, model, spans=True).collect()}
    assert out[1]["__spans"] == [[10, 25]] and out[1]["__score"] > 0.5
    assert out[2]["__spans"] == [] and out[2]["__score"] == out[3]["__score"] < 0.5


def test_windows_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    r = random.Random(7)
    text = " ".join(r.choice([*CLEAN, *BAD, "été.", "Zulvane!", "中文 "]) for _ in range(3000))
    data, offs = tx.utf8(tx.pa.array([text]))
    one, many = model.read(data, offs), model.read(data, offs, 200)
    assert len(many[1]) > 50 and np.allclose(one[0], many[0]) and tx._runs(one[1], 1) == tx._runs(many[1], 1)
    assert all(text[a:b].lower().startswith(("grob", "zulv")) for a, b in tx._runs(many[1], 1)[0])


def test_odd_tables(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tx.digests(docs, none).collect()} == {0.0}
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert tx.digests(docs, marks).count() == docs.count()
    assert tx.digests(empty, marks).count() == 0


def test_a_very_long_document_leaves_both_labels(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE_TOKENS", 30_000)
    rows, labels = corpus(300)
    docs = spark.createDataFrame([*rows, (1000, "calm water. " * 20_000, "en", "s", "clash")], "doc_id long, text string, lang string, source string, score string")
    schema = "doc_id long, quality int, toxic int"
    model = tx.train(docs, spark.createDataFrame([*labels, (1000, 1, 0)], schema))
    short = tx.train(docs, spark.createDataFrame(labels, schema))
    assert model.curve is not None and np.array_equal(model.weights, short.weights)
    # The only toxic document, too long itself, stays.
    assert tx.train(docs, spark.createDataFrame([*((d, 1, 0) for d, _, t in labels if not t), (1000, 1, 1)], schema)).curve is not None
