import random
import re

import numpy as np
import pytest

from siltstone.llm import mixing


def brute_targets(size_by):
    names = sorted((s for s in size_by if s is not None)) + ([None] if None in size_by else [])
    w = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    open_, fixed, total = set(names), {}, sum(size_by.values())
    while open_:
        level = (total - sum(fixed.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * size_by[s]}
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: 3 * size_by[s] for s in over}
        open_ -= over
    return fixed


@pytest.mark.parametrize("bucket,miss", [(16, 200), (512, 40)])
def test_targets_and_takes(spark, monkeypatch, bucket, miss):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN", 4)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(0, 200)), r.choice(["a", "b", "b", "b", "c", "z", "é", None]), "extra") for i in range(3000)]
    rows += [(5000, "tiny source", "tiny", ""), (5001, None, "none", ""), (None, "one two", None, ""), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.digests(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = {}
    for x in out:
        assert x["source_size"] == sizes[x["source"]]
        assert abs(x["target"] - want[x["source"]]) <= 1e-6 * max(1, want[x["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= miss for s in want), {s: (taken[s], want[s]) for s in want}
    again = mixing.digests(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    made = mixing.mixed(df)
    assert made.columns == df.columns
    assert made.groupBy("source").count().count() <= len(want)
    words = sum(len((x["text"] or "").split()) for x in made.collect())
    assert words == sum(x["taken"] for x in out)


def test_unbiased_pairs():
    n, hits = 4000, 0
    for i in range(n):
        out = mixing.pivotal([10, 20, 30], [3.0, 8.0, 7.0], [i * 7919 + k * 104729 + 13 for k in range(3)])
        assert abs(sum(out) - 18) < 1e-6
        hits += out[0]
    assert abs(hits / n - 3) < 0.25


def test_unbiased_classes():
    size = np.array([900, 700, 40, 35, 30, 20, 9, 8, 5, 4, 3, 2, 1] + [10] * 60 + [60] * 20)
    mass = 0.35 * size
    total, hits = mass.sum(), np.zeros(len(size))
    for i in range(3000):
        out = mixing.rounded(size, mass, np.arange(len(size)) * 104729 + i * 7919)
        assert abs(out.sum() - total) < 1e-6
        assert ((out == 0) | (out == size)).sum() >= len(size) - 1
        hits += out / size
    assert np.abs(hits / 3000 - 0.35).max() < 0.05


def test_empty(empty, docs):
    assert mixing.digests(empty).count() == 0
    assert mixing.digests(docs).count() == docs.count()
