import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import ppm


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def symbols(t, order):
    return [ppm.START] * order + [*lowered(t).encode(), ppm.END]


class Brute:
    """The same model by dictionaries, with exclusion carried symbol by symbol."""

    def __init__(self, texts, order, least=1):
        self.order, counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = symbols(t, order)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][tuple(s[i - k : i])][s[i]] += 1
        self.counts = [{c: {x: n for x, n in d.items() if n >= least} for c, d in level.items()} for level in counts]

    def score(self, t):
        s, total = symbols(t, self.order), 0.0
        for i in range(self.order, len(s)):
            out = set()
            for k in range(self.order, -1, -1):
                node = {x: n for x, n in self.counts[k].get(tuple(s[i - k : i]), {}).items() if x not in out}
                n = sum(node.values())
                if s[i] in node:
                    total += math.log10((node[s[i]] - 0.5) / n)
                    break
                if node:
                    total += math.log10(len(node) / 2 / n)
                out |= set(node)
            else:
                total -= math.log10(ppm.SYMBOLS - len(out))
        return total


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


@pytest.mark.parametrize("prune,head", [(40, 40), (10, 7)])
def test_scores(docs, spark, monkeypatch, prune, head):
    monkeypatch.setattr(ppm, "HEAD", head)
    monkeypatch.setattr(ppm.train, "__defaults__", (ppm.ORDER, prune))
    rows = docs.collect()
    learn = [r["text"] for r in rows if not held(r["doc_id"])]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    counts = Counter(w for t in learn for w in split(t))
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    least = sum(len(lowered(t).encode()) + 1 for t in learn) / 2**prune
    model = Brute(learn, ppm.ORDER, least)
    want = []
    for r in rows:
        ws = split(r["text"])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(learn) + 1) / (n + v + 1))
        score = model.score(r["text"]) if len(r["text"] or "") < 20_000 else None
        want.append((str(r["doc_id"]), held(r["doc_id"]), len(ws) + 1, sum(w in counts for w in ws) + 1, n, base, score))
    got = sorted((str(r[0]), *r[1:]) for r in ppm.scores(docs).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert w[6] is None or math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"abracadabra abracadabra the cat", np.uint8)
    trie = ppm.Trie.of(ppm.grams(data, np.array([0, len(data)]), 3)[0], 3)
    for ctx in ([97, 98, 114], [1, 2, 3], [ppm.START] * 3, [32, 97, 98]):
        c = (ctx[0] << 18) | (ctx[1] << 9) | ctx[2]
        assert abs(sum(10 ** trie.score(np.array([(c << 9) | x for x in range(ppm.SYMBOLS)]))) - 1) < 1e-9


def test_adaptive_and_empty(docs, empty):
    assert ppm.scores(empty).count() == 0
    bits = {r["doc_id"]: r["bits"] for r in ppm.code_lengths(docs.where("length(text) < 9001")).collect()}
    assert 0 < bits[6] < 600 and bits[1] == pytest.approx(math.log2(ppm.SYMBOLS))


@pytest.mark.parametrize("most,shared", [(20, 1 << 17), (6, 40)])
def test_rare_grams_count(spark, monkeypatch, most, shared):
    """A gram seen once or twice in more than 2**24 bytes counts like any other."""
    monkeypatch.setattr(ppm, "GRAMS", most)
    monkeypatch.setattr(ppm, "SHARED", shared)
    monkeypatch.setattr(ppm, "PART", 50)
    ids = [i for i in range(200) if not held(i)]
    rest = [i for i in range(200) if held(i)]
    texts = {ids[0]: "qu\u00e9 vuelvo xylophon zwq", ids[1]: "quick brown xylem", rest[0]: "qu\u00e9 vuelvo xylophon zwq", rest[1]: "xylophone, brownish", rest[2]: "\x01\x02"}
    rows = [(i, texts.get(i, "la " * 3_500 if i % 9 else "ab " * 40)) for i in range(200)]
    rows += [(ids[2], "la " * 7_000_000)]
    got = {r["doc_id"]: r["score"] for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] in texts}
    # What the long text counts follows from a short one: all its grams but the first few repeat.
    short = Brute([t if len(t) < 1e6 else "la " * 4 for i, t in rows if not held(i)], ppm.ORDER)
    for level in short.counts:
        for ctx, nexts in level.items():
            for s in nexts:
                cycle = [*b"la "] * 3
                if (*ctx, s) in {tuple(cycle[a : a + len(ctx) + 1]) for a in range(3)}:
                    nexts[s] += 7_000_000 - 4
    for i, t in texts.items():
        assert math.isclose(got[i], short.score(t), rel_tol=1e-9), i


def test_windows_and_rows_of_long_texts_do_not_matter(docs, monkeypatch):
    want = sorted(map(str, ppm.scores(docs.select("doc_id", "text")).collect()))
    monkeypatch.setattr(ppm, "GRAMS", 6)
    monkeypatch.setattr(ppm, "HEAD", 3)
    monkeypatch.setattr(ppm, "MOST_KEYS", 300)
    monkeypatch.setattr(ppm.gram_windows, "__defaults__", (ppm.ORDER, 500))
    got = sorted(map(str, ppm.scores(docs.select("doc_id", "text")).collect()))
    for a, b in zip(want, got, strict=True):
        x, y = ([p.split("=")[1].rstrip(")") for p in row.split(", ")] for row in (a, b))
        assert x[:5] == y[:5] and all(abs(float(p) - float(q)) < 1e-6 * max(1, abs(float(p))) for p, q in zip(x[5:], y[5:], strict=True))
