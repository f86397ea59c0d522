import random
import re

import numpy as np
import pytest

from siltstone.llm import neardup


def shingle_set(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return tuple(ws), {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            (wa, a), (wb, b) = sets[i], sets[j]
            if wa == wb or (a and b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    name = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, name[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(r.randrange(30, 120))] for _ in range(40)]
    for b in base:
        for _ in range(r.randrange(1, 5)):
            c = list(b)
            for _ in range(r.randrange(0, 4)):
                c[r.randrange(len(c))] = word()
            rows.append(" ".join(c))
    hot = [word() for _ in range(80)]
    for i in range(60):
        c = list(hot)
        for _ in range(r.randrange(0, 3)):
            c[r.randrange(80)] = word() + str(i)
        rows.append("\n".join(c))
    rows += [rows[3], rows[3].upper(), None, "", " ", "one two", "One  two", "one two three four five", hot and " ".join(hot * 40)]
    out = [(i, t) for i, t in enumerate(rows)]
    r.shuffle(out)
    return [*out, out[5], (None, out[6][1]), (None, "alone with no id here at all")]


@pytest.mark.parametrize("block", [256, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block * 200)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, class_id long").repartition(4)
    got = sorted((tuple(r) for r in neardup.digests(df).collect()), key=str)
    assert got == brute(rows)
    if block == 8:
        one = neardup.one_of_each(df)
        assert one.columns == df.columns
        kept = sorted((r["doc_id"] for r in one.collect()), key=str)
        assert kept == sorted({c if c is not None else d for d, c, _ in brute(rows)}, key=str)


def test_pruning_keeps_what_is_near():
    r = np.random.default_rng(0)
    dropped = 0
    for _ in range(300):
        a = r.integers(0, 2**63, 400, dtype=np.uint64)
        b = a.copy()
        b[:44] = r.integers(0, 2**63, 44, dtype=np.uint64)  # Jaccard 0.802
        sig = neardup.signatures(np.concatenate((a, b)), np.array([0, 400, 800]))
        dropped += not len(neardup.surviving(sig, np.array([0]), np.array([1])))
    assert dropped == 0
    far = neardup.signatures(r.integers(0, 2**63, 800, dtype=np.uint64), np.array([0, 400, 800]))
    assert not len(neardup.surviving(far, np.array([0]), np.array([1])))


def test_empty(empty):
    assert neardup.digests(empty).count() == 0
    assert neardup.one_of_each(empty).count() == 0
