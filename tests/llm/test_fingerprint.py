import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprint as fp


def test_spans_and_extensions(monkeypatch):
    r = random.Random(2)
    a = "".join(r.choice("abü") for _ in range(300))
    b = a[:140] + "x" + a[140:]
    for step in (fp.STEP, 64):
        monkeypatch.setattr(fp, "STEP", step)
        fp._table.cache_clear()
        base = fp.of([a, b])
        # The third text is spliced from the start of the one and from within the other.
        own = fp.Texts(base.hashes, np.append(base.start, 0), np.append(base.n, 100), np.append(base.start, 300 + 90), np.append(base.n, 220))
        texts = [a, b, a[:100] + b[90:210]]
        for _ in range(300):
            k, m = r.randrange(3), r.randrange(3)
            x, y = texts[k], texts[m]
            i, j, n = r.randrange(200), r.randrange(200), r.randrange(20)
            one = lambda v: np.array([v])
            assert (own.spans(one(k), one(i), one(i + n)) == own.spans(one(m), one(j), one(j + n)))[0] == (x[i : i + n] == y[j : j + n])
            e, f = 0, 0
            while i + e < len(x) and j + e < len(y) and x[i + e] == y[j + e]:
                e += 1
            while f < min(i, j) and x[i - f - 1] == y[j - f - 1]:
                f += 1
            assert own.extension(one(k), one(i), one(m), one(j))[0] == e
            assert own.extension(one(k), one(i), one(m), one(j), True)[0] == f
    fp._table.cache_clear()


def anchors(s, window, stretch):
    if not s:
        return []
    h = fp._scrambled(fp.of([s[i : i + window] for i in range(max(1, len(s) - window + 1))]).whole()).tolist()
    if stretch > 1:
        while fp.LONG * (stretch // fp.STRETCH) < len(s):
            stretch *= 2
    k = min(stretch, len(h))
    return sorted({i for a in range(len(h) - k + 1) for i in range(a, a + k) if h[i] == min(h[a : a + k])})


def brute(x, y):
    """Likeness by the definition, letter by letter."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    least = max(fp.FINE, min(fp.LEAST, min(len(x), len(y)) // 4))
    window, stretch = (fp.FINE, 1) if min(len(x), len(y)) // 4 < fp.LEAST else (fp.WINDOW, fp.STRETCH)

    def covered(a, b):
        places = {}
        for j in anchors(b, window, stretch):
            places.setdefault(b[j : j + window], j)
        held = set()
        for i in anchors(a, window, stretch):
            j = places.get(a[i : i + window])
            if j is not None:
                p, q = 0, 0
                while p < min(i, j) and a[i - p - 1] == b[j - p - 1]:
                    p += 1
                while i + q < len(a) and j + q < len(b) and a[i + q] == b[j + q]:
                    q += 1
                if p + q >= least:
                    held.update(range(i - p, i + q))
        return len(held)

    total = len(x) + len(y)
    return min(covered(x, y) + covered(y, x), total - 0.5) / total


@pytest.mark.parametrize("long", [1 << 20, 100])
def test_likeness_against_brute_force(monkeypatch, long):
    monkeypatch.setattr(fp, "LONG", long)
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9))) for _ in range(40)]
    texts = ["", "ab", "abcd", "x" * 200]
    for n in (1, 3, 8, 20, 40, 80, 150):
        t = " ".join(r.choice(words) for _ in range(n))
        texts += [t, t[len(t) // 3 :] + t[: len(t) // 3], t.replace("a", "o", 3), t + t[: n * 2]]
    one, two, near_edited, near_next = fp.beside(texts, [*texts[1:], texts[0]])
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        assert np.isclose(near_edited[i], brute(t, fp.edited(t, following))), (t, following)
        assert np.isclose(near_next[i], brute(t, following)), (t, following)
        assert one[i] == fp.fingerprint(t) and two[i] == fp.fingerprint(fp.edited(t, following))
    # Neighbours that aren't each other's, and any pair.
    again = fp.beside(texts[:9], [texts[12]] * 9)
    assert np.allclose(again[3], [brute(t, texts[12]) for t in texts[:9]])
    assert all(np.isclose(fp.common(t, texts[-1]), brute(t, texts[-1])) for t in texts[-6:])


def test_next_documents(docs, empty):
    rows = fp.compare_next(docs).collect()
    src = docs.collect()
    assert sorted(len(d["text"] or "") for d in src) == sorted(r["n_chars"] for r in rows)
    unique = {}
    for d in src:
        unique.setdefault(d["doc_id"], []).append(d["text"] or "")
    order = sorted(unique, key=lambda k: -1 if k is None else k)
    for r in rows:
        if len(unique[r["doc_id"]]) == 1:
            text, nxt = unique[r["doc_id"]][0], unique[order[(order.index(r["doc_id"]) + 1) % len(order)]][0]
            cut = len(text) // 4
            want = text[: len(text) - cut] + nxt[:cut]
            assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert r["fingerprint"] == fp.fingerprint(text)
            assert r["edited_fingerprint"] == fp.fingerprint(want)
            assert np.isclose(r["near_edited"], fp.common(text, want)) and np.isclose(r["near_next"], fp.common(text, nxt))
            assert len(text) < 400 or r["near_edited"] > 0.6
    assert fp.compare_next(empty).count() == 0


def test_one_id_repeated_very_often(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    got = fp.compare_next(rows)
    assert got.count() == 3000
    assert fp.neighbours(rows).where("last").count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_partial_edits_of_short_texts():
    r = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    for n in range(4, 140):
        sample = r.sample(letters, 3 * n)
        text, other = "".join(sample[:n]), "".join(sample[n:])
        for following in (other, ""):
            near = fp.common(text, fp.edited(text, following))
            assert 0.5 < near < 1, (n, following, near)
        assert fp.common(text, other[:n]) == 0


def test_unequal_texts_are_never_wholly_alike():
    text = "".join(random.Random(1).choices("abcdefgh ", k=60_000))
    changed = text[:-1] + "z"
    assert 0.99 < fp.common(text, changed) < 1 and fp.common(text, text) == 1
    assert 0.8 < fp.likeness(fp.fingerprint(text), fp.fingerprint(changed)) < 1
    assert 0.9 < fp.common("ab" * 500, "ba" * 500) < 1


def test_windows_of_a_batch_are_those_of_its_texts(monkeypatch):
    """Shared window hashes equal the spans' own: in spliced, short and empty texts,
    and where places lie too far apart to be shared."""
    rng = np.random.default_rng(5)
    own = ["".join(rng.choice(list("ab é世 "), n)) for n in (0, 1, 2, 3, 5, 11, 12, 13, 14, 50, 700, 0, 23)]
    base = fp.of([*own, own[4]])
    cut = base.n[:-1] // 4
    texts = fp.Texts(base.hashes, base.start[:-1], base.n[:-1] - cut, base.start[1:], base.n[:-1] - cut + np.minimum(cut, base.n[1:]))
    for most in (fp.SHARED, 16):
        monkeypatch.setattr(fp, "SHARED", most)
        for some in (base, texts):
            n = np.maximum(1, some.n)
            text = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            for window in (fp.FINE, fp.WINDOW):
                direct = fp._scrambled(some.spans(text, place, np.minimum(place + window, some.n[text])))
                assert (some._windows(text, place, window) == direct).all()


def test_results_do_not_depend_on_the_size_of_texts():
    """Half of a text stands in another in spans of 30: as many are found in a text of
    more than a million code points as in a shorter one."""
    r = random.Random(1)
    for n in (6000, (1 << 20) + 64_000):
        a = "".join(map(chr, r.choices(range(0x4E00, 0x9000), k=n)))
        b = "".join(a[i : i + 30] + "".join(map(chr, r.choices(range(0xA000, 0xD000), k=30))) for i in range(0, n, 60))
        assert 0.499 < fp.common(a, b) < 0.501


def test_steps_find_what_one_look_finds(monkeypatch):
    r = random.Random(6)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9))) for _ in range(40)]
    texts = ["", "ab", "abcd", "x" * 200, "ab" * 90, "c" * 3]
    for n in (1, 8, 20, 80, 150, 400):
        t = " ".join(r.choice(words) for _ in range(n))
        texts += [t, t[len(t) // 3 :] + t[: len(t) // 3], t[: len(t) // 2] + "o" + t[len(t) // 2 + 1 :], t[:30] * 3]
    r.shuffle(texts)
    for following in ([*texts[1:], texts[0]], texts[::-1]):
        want = fp.beside(texts, following)
        assert np.allclose(want[3], [brute(t, u) for t, u in zip(texts, following, strict=True)])
        for large, step in ((100, fp.STEP), (0, 512)):
            with monkeypatch.context() as m:
                m.setattr(fp, "LARGE", large)
                m.setattr(fp, "STEP", step)
                fp._table.cache_clear()
                got = fp.beside(texts, following)
            assert got[:2] == want[:2] and all((x == y).all() for x, y in zip(got[2:], want[2:], strict=True))
    fp._table.cache_clear()


def test_very_many_texts_in_a_batch():
    r = random.Random(7)
    own = [f"text {i:06d}"[-r.randrange(8) :] for i in range(40_000)]
    following = [*own[1:], own[0]]
    whole, a = fp.beside(own, following), 39_000
    some = fp.beside(own[a:], following[a:])
    assert [x[a:] for x in whole[:2]] == list(some[:2]) and all((x[a:] == y).all() for x, y in zip(whole[2:], some[2:], strict=True))


def test_fingerprints_of_some_texts_are_those_of_all(monkeypatch):
    texts = fp.of(["", "a few words " * 9, "others, and more of them " * 20])
    want = fp.prints(texts, texts.anchors())
    monkeypatch.setattr(fp, "LARGE", 300)
    assert fp.prints(texts, texts.anchors()) == want
    assert fp.prints(texts, texts.anchors(), np.array([2, 0])) == [want[2], want[0]]
