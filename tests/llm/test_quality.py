import math
import random
import re
from collections import Counter

from siltstone.llm import quality


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_and_base_rule(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(100)] + [(5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(quality.verdicts(docs, labels).collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    want = sorted(((d["doc_id"], *brute(d["text"])) for d in docs.collect()), key=lambda r: (str(r[0]), r[1]))
    assert [(r[0], *r[1:6]) for r in got] == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(empty, labels.limit(0)).count() == 0


def test_exact_bound():
    for k, n, a in ((0, 50, 0.01), (3, 200, 0.001), (40, 900, 0.05)):
        p = quality.upper_bound(k, n, a)
        cdf = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(cdf - a) < 1e-6 * a + 1e-9


def test_no_uncertified_cutoff():
    few = [(1, "symbol_share", 50, 0, 500), (1, "symbol_share", 0, 1, 20)]
    many = [(1, "symbol_share", 50, 0, 500), (1, "symbol_share", 0, 1, 20_000)]
    assert not quality.certified(few)
    (cut, bound) = quality.certified(many)[1, "symbol_share"]
    assert cut < 50 and bound <= quality.RISK / len(quality.RULES)


def test_nested_cutoffs_cost_no_confidence():
    rule = [(1, "symbol_share", 50, 0, 500)]
    (cut, bound) = quality.certified([*rule, (1, "symbol_share", 0, 1, 1094)])[1, "symbol_share"]
    assert cut == 0 and bound <= quality.RISK / len(quality.RULES)
    assert not quality.certified([*rule, (1, "symbol_share", 0, 1, 1093)])


def by_hand(rows, marks, risk, failure):
    """kept of every document: cutoffs tried one by one from the loosest, on exact
    binomial tails."""
    from math import comb

    good = {}
    for d, q in marks:
        if q is not None and d is not None:
            good[d] = max(good.get(d, 0), q)
    shares = {d: {"symbol_share": r["n_symbols"] / max(1, r["word_chars"]), "dup_line_share": r["n_dup_lines"] / r["n_lines"], "repeat_share": r["n_repeat_words"] / max(1, r["n_words"]), "short_word_share": max(0.0, 1 - r["word_chars"] / max(1, r["n_words"]) / 12)} for d, r in rows.items()}
    band = {d: max(i for i, low in enumerate(quality.BANDS) if r["n_words"] >= low) for d, r in rows.items()}
    tail = lambda k, n, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    tests = (len(quality.BANDS) - 1) * len(quality.RULES)
    failed = {d: r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for d, r in rows.items()}
    over = lambda x, cut: x > (cut + 1) / quality.GRID + 1e-12
    cuts = {}
    for b in range(len(quality.BANDS)):
        for rule in quality.RULES:
            yes = [shares[d][rule] for d in rows if band[d] == b and good.get(d) == 1 and not failed[d]]
            no = [shares[d][rule] for d in rows if band[d] == b and good.get(d) == 0 and not failed[d]]
            best = 0
            for cut in reversed(range(quality.GRID)):
                lost, caught = sum(over(x, cut) for x in yes), sum(over(x, cut) for x in no)
                # The bound stays below the risk if so few would be lost with less chance than failure.
                if not yes or tail(lost, len(yes), risk / len(quality.RULES)) > failure / tests:
                    break
                gain = caught - quality.GOOD_WEIGHT * lost
                if gain > 0 and gain >= best:
                    best, cuts[b, rule] = gain, cut
    return {d: not failed[d] and not any(b == band[d] and over(shares[d][rule], cut) for (b, rule), cut in cuts.items()) for d in rows}, cuts


def test_kept_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    docs, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        ws = [word() + (r.choice("#$%&") * r.randrange(1, 4) if bad and r.random() < 0.8 or r.random() < 0.01 else "") for _ in range(r.randrange(40, 120))]
        docs.append((i, " ".join(ws)))
        marks.append((i, None if i % 11 == 0 else int(not bad), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (3, 0, 1), (None, 1, 1), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    feats = {x["doc_id"]: x for x in quality.features(df).collect()}
    want, cuts = by_hand(feats, [(d, q) for d, q, _ in marks] + [(3, 0)], 0.2, 0.2)
    got = {x["doc_id"]: x["kept"] for x in quality.verdicts(df, labels, 0.2, 0.2).collect()}
    assert cuts and got == want
    failed = {x["doc_id"] for x in quality.verdicts(df, labels, 0.2, 0.2).collect() if x["base_failed"]}
    assert 50 < sum(not k for d, k in got.items() if d not in failed) < 200
