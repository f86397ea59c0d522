"""Quality rules with risk-controlled thresholds.

Rules reject a document whose feature exceeds a cutoff.  The cutoff of a rule in
a stratum is certified on a labelled holdout: among rows labelled good, the exact
(Clopper-Pearson) upper bound on the share that the cutoff rejects must stay
below the rule's share of the risk, at a confidence divided by the number of
(stratum, rule) pairs that the base rule leaves rows in, a Bonferroni correction.  The nested cutoffs of a pair are
tested in fixed sequence, from the loosest on until one fails, which needs no
correction.  Of the certified cutoffs
the one is taken that rejects most rows labelled bad, each good one rejected
counting against it; a rule with no useful certified cutoff rejects nothing.

Strata are bands of the number of words, a fixed set.  All labelled rows count,
as a histogram over a fixed grid of cutoffs, so the driver gets a table whose
size doesn't depend on the data; rows that the base rule rejects are left out.

Null texts have no words.  Null labels and labels of unknown documents don't
count; a document with several labels counts once, as good if any says so.
Extra columns and repeated rows pass; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import MIX_A, MIX_B, GOLD, mix, per_row, settled, slices, spans_hash, utf8, words, SEPARATOR

#: Characters that count as symbols; fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Least words, and most repeated words in a hundred, of the base rule; fixed by the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of good documents that may be rejected in a stratum, and the chance that a bound fails.
RISK, FAILURE = 0.02, 0.05
#: Rows labelled bad that one row labelled good outweighs when cutoffs are compared.
GOOD_WEIGHT = 20
#: Lower ends of the bands of words.
BANDS = (0, 50, 200, 800)
#: Cutoffs of every rule: shares from 0.01 to 1, evenly.
GRID = 100
RULES = ("symbol_share", "dup_line_share", "repeat_share", "short_word_share")

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS.encode())] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def _dups(key: np.ndarray) -> np.ndarray:
    """Whether each element has an equal one."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Whether an element equals an earlier one."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def text_features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    start, end, row = words(data, offs)
    n_words = np.bincount(row, minlength=n).astype(np.int64)
    chars = per_row(((data & 0xC0) != 0x80) & ~SEPARATOR[data], offs)
    symbols = per_row(_symbol[data], offs)
    # Lines: every row has one more than it has line feeds.
    feeds = np.flatnonzero(data == 10)
    l_end = np.concatenate((feeds, offs[1:]))
    l_row = np.concatenate((np.searchsorted(offs, feeds, "right") - 1, np.arange(n)))
    order = np.lexsort((l_end, l_row))
    l_end, l_row = l_end[order], l_row[order]
    l_start = np.empty_like(l_end)
    if len(l_end):
        l_start[1:], l_start[0] = l_end[:-1] + 1, 0
        new = np.concatenate(([True], l_row[1:] != l_row[:-1]))
        l_start[new] = offs[:-1][l_row[new]]
    n_lines = np.bincount(l_row, minlength=n).astype(np.int64)
    filled = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    f_row = l_row[filled]
    key = mix(spans_hash(data, l_start[filled], l_end[filled]) ^ mix(f_row.astype(np.uint64) * GOLD))
    dup_lines = np.bincount(f_row[_later(key)], minlength=n).astype(np.int64)
    # Windows of three words within a row.
    repeat = np.zeros(n, np.int64)
    if len(start) >= 3:
        w = spans_hash(data, start, end)
        del end
        same = row[2:] == row[:-2]
        key = w[:-2] * MIX_A
        key += w[1:-1] * MIX_B
        key += w[2:] * GOLD
        del w
        key = mix(key + mix(row[2:].astype(np.uint64) + GOLD))[same]
        first = np.flatnonzero(same)[_dups(key)] if len(key) else np.zeros(0, np.int64)
        hit = np.zeros(len(start), bool)
        for k in range(3):
            hit[first + k] = True
        repeat = np.bincount(row[hit], minlength=n).astype(np.int64)
    return [n_words, chars, symbols, dup_lines, n_lines, repeat]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text, keyed by `key`."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                got = text_features(*utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got)], ["doc_id", *names])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, failure: float) -> float:
    """Exact upper confidence bound of a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - beta_cdf(k + 1, n - k, mid) > failure else (low, mid)
    return high


def _shares() -> dict[str, Column]:
    whole = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.col("n_lines"),
        "repeat_share": F.col("n_repeat_words") / whole,
        "short_word_share": F.greatest(F.lit(0.0), 1 - F.col("word_chars") / whole / 12),
    }


def _bin(share: Column) -> Column:
    """Number of cutoffs that the share exceeds: cutoff i is (i + 1) / GRID."""
    return F.least(F.greatest(F.ceil(share * GRID) - 1, F.lit(0)), F.lit(GRID)).cast("int")


def _stratum(n_words: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(BANDS):
        out = F.when(n_words >= low, F.lit(i)).otherwise(out)
    return out


def certified(histogram: list[tuple[int, str, int, int, int]], risk: float = RISK, failure: float = FAILURE) -> dict[tuple[int, str], tuple[int, float]]:
    """Cutoff index and bound by (stratum, rule), from rows (stratum, rule, bin,
    good, count)."""
    # In bands below the least number of words the base rule rejects every row.
    tests = sum(low >= LEAST_WORDS for low in BANDS) * len(RULES)
    seen: dict[tuple[int, str], np.ndarray] = {}
    for stratum, rule, at, good, n in histogram:
        seen.setdefault((stratum, rule), np.zeros((2, GRID + 1), np.int64))[good, at] += n
    out = {}
    for where, (bad, good) in seen.items():
        total, best = int(good.sum()), 0
        for cut in reversed(range(GRID)):
            lost, caught = int(good[cut + 1 :].sum()), int(bad[cut + 1 :].sum())
            bound = upper_bound(lost, total, failure / tests)
            if bound > risk / len(RULES):
                break
            gain = caught - GOOD_WEIGHT * lost
            if gain > 0 and gain >= best:
                best, out[where] = gain, (cut, bound)
    return out


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, failure: float = FAILURE) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    feats = settled(features(docs))
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    # What the base rule rejects is neither gained nor lost by a cutoff.
    bins = feats.where(~failed).join(marked, "doc_id").select(_stratum(F.col("n_words")).alias("stratum"), "good", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), _bin(v).alias("bin")) for k, v in _shares().items()))).alias("x"))
    counts = bins.groupBy("stratum", "x.rule", "x.bin", "good").count().collect()
    cutoffs = certified([(r["stratum"], r["rule"], r["bin"], int(r["good"] > 0), r["count"]) for r in counts], risk, failure)
    rejected = F.lit(False)
    for (stratum, rule), (cut, _) in sorted(cutoffs.items()):
        rejected = rejected | ((_stratum(F.col("n_words")) == stratum) & (_bin(_shares()[rule]) > cut))
    return feats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
