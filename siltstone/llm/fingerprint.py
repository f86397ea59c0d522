"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` keeps, for each of two primes, the sums of code * base**i over all
prefixes of the texts of a batch; so any two spans are compared in constant time,
and the longest common extension of two places is found by binary search.  A text
may also be spliced from two spans of the batch (an edited text is the start of one
document and the start of the next); its hashes are put together from those of
its parts, so it has no arrays of its own.

Anchors of a text are windows of WINDOW code points whose hash is the least among
STRETCH neighbouring ones; any common span of LEAST code points holds a common
anchor, however long the texts are.  A fingerprint is the text's length, its whole-text
hash under both primes, and the SKETCH smallest hashes of its anchors.

Likeness of two texts is the share of their code points, counted in both, that
stands in spans they have in common: every anchor of one that is an anchor of the
other is laid beside its first place there and extended to both sides as far as the
texts agree; spans of LEAST code points or more count.  Where one text is short, a
quarter of its length is enough, and its anchors are all windows of FINE.  Equal
texts have likeness 1, others less, and an empty text none with any other.
Texts of more than LARGE code points are compared a step at a time: the anchors of
the shorter of two are held, those of the longer pass by, with the same result.
`likeness` estimates the same from two fingerprints alone.

`neighbours` puts every document beside the next one in ascending order of id:
one shuffle of the text by ranges of ids; only the first document of each range
goes to two places.  Null texts are empty; null ids come first; rows with equal
ids follow in the order of their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import code_points, lean, utf8, windows

#: Code points of an anchor, anchors that compete, and hashes that a fingerprint keeps.
WINDOW, STRETCH, SKETCH = 12, 12, 32
#: Common code points that count, and the windows of texts that are too short for them.
LEAST, FINE = WINDOW + STRETCH - 1, 3
#: Code points from which on anchors are sparser, for callers that set it lower: Spark has no text so long.
LONG = 1 << 31
#: Code points from which on texts are looked at step by step; results don't depend on it.
LARGE = 1 << 20
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
#: Code points of a batch, those that a row counts for at least, and places that one step looks at.
BATCH, ROW, STEP = 1 << 18, 16, 1 << 19
#: Places between the first and the last of a step whose windows are hashed together, at most.
SHARED = 2 * STEP
U = np.uint64


def _mod(x: np.ndarray, which: int) -> np.ndarray:
    p = U(PRIMES[which])
    return x - x // p * p


@cache
def _table(which: int, inverse: bool, step: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of base**step (or its inverse) modulo the prime, by doubling."""
    p = PRIMES[which]
    b = pow(pow(BASES[which], -1, p) if inverse else BASES[which], step, p)
    out, k = np.ones(n, U), 1
    while k < n:
        out[k : 2 * k] = _mod(out[: min(k, n - k)] * U(pow(b, k, p)), which)
        k *= 2
    return out


def _power(which: int, inverse: bool, at: np.ndarray) -> np.ndarray:
    """base**at, from two tables of bounded size."""
    low = _table(which, inverse, 1, STEP)[at & (STEP - 1)]
    if not len(at) or at.max() < STEP:
        return low
    return _mod(low * _table(which, inverse, STEP, STEP)[at // STEP], which)


class PrefixHash:
    """Prefix hashes of the code points of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        n = sum(int(np.count_nonzero((data[a : a + STEP] & 0xC0) != 0x80)) for a in range(0, len(data), STEP))
        self.pre = [np.zeros(n + 1, np.uint32) for _ in PRIMES]
        self.n, carry = 0, [U(0), U(0)]
        for a, b in windows(data, STEP // 4):
            code = code_points(data[a:b]).astype(U) + U(1)
            for w in (0, 1):
                term = _mod(code * _power(w, False, np.arange(self.n, self.n + len(code))), w)
                pre = _mod(np.cumsum(term) + carry[w], w)
                carry[w] = pre[-1]
                self.pre[w][self.n + 1 : self.n + 1 + len(pre)] = pre
            self.n += len(code)

    def spans(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans, alike for equal content at any place."""
        pre = self.pre[which]
        diff = pre[end].astype(np.int64) - pre[start]
        diff += (diff < 0) * PRIMES[which]
        return _mod(diff.astype(U) * _power(which, True, start), which)

    def windows(self, a: int, b: int, window: int) -> np.ndarray:
        """62-bit hashes of the windows that start at each place of [a, b)."""
        out = []
        for w in (0, 1):
            pre = self.pre[w]
            diff = pre[a + window : b + window].astype(np.int64) - pre[a:b]
            diff += (diff < 0) * PRIMES[w]
            whole = _table(w, True, 1, STEP)[a:b] if b <= STEP else _power(w, True, np.arange(a, b))
            out.append(_mod(diff.astype(U) * whole, w))
        return out[0] << U(31) | out[1]


class Texts:
    """Texts over one batch: text i is `length[i]` code points at `start[i]`, then,
    up to `n[i]` in all, the code points at `more[i]`."""

    def __init__(self, hashes: PrefixHash, start: np.ndarray, length: np.ndarray, more: np.ndarray, n: np.ndarray):
        self.hashes, self.start, self.length, self.more, self.n = hashes, start, length, more, n

    def __len__(self) -> int:
        return len(self.n)

    def spans(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [a, b) of texts."""
        cut, start = self.length[text], self.start[text]
        later = np.where(a >= cut, self.more[text] - cut, start) + a
        across = np.flatnonzero((a < cut) & (b > cut))
        ends = np.minimum(later + (b - a), self.hashes.n)
        out = []
        for w in (0, 1):
            h = self.hashes.spans(w, later, ends)
            if len(across):
                x, y, z = start[across] + a[across], start[across] + cut[across], self.more[text[across]]
                rest = self.hashes.spans(w, z, z + b[across] - cut[across])
                h[across] = _mod(self.hashes.spans(w, x, y) + _mod(rest * _power(w, False, y - x), w), w)
            out.append(h)
        return out[0] << U(31) | out[1]

    def whole(self) -> np.ndarray:
        at = np.arange(len(self))
        return self.spans(at, np.zeros(len(self), np.int64), self.n)

    def extension(self, one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Lengths of the longest common spans from place i of texts `one` and j of
        texts `two` on (or, `back`, up to there), by binary search."""
        high = np.minimum(i, j) if back else np.minimum(self.n[one] - i, self.n[two] - j)
        low = np.zeros(len(high), np.int64)
        # Steps that double while spans agree, then halving: short spans are found soon.
        step, open_ = np.full(len(high), 8), np.flatnonzero(low < high)
        while len(open_):
            bottom, top = low[open_], high[open_]
            mid = np.where(step[open_] > 0, np.minimum(bottom + step[open_], top), (bottom + top + 1) // 2)
            p, q = i[open_], j[open_]
            # What stands below is known to agree.
            x = self.spans(one[open_], *((p - mid, p - bottom) if back else (p + bottom, p + mid)))
            y = self.spans(two[open_], *((q - mid, q - bottom) if back else (q + bottom, q + mid)))
            same = x == y
            low[open_], high[open_] = np.where(same, mid, bottom), np.where(same, top, mid - 1)
            step[open_] = np.where(same, step[open_] * 2, 0)
            open_ = open_[low[open_] < high[open_]]
        return low

    def anchors(self, text: np.ndarray | None = None, window: int = WINDOW) -> Anchors:
        """The anchors of some texts, or of all but the large ones."""
        text = np.flatnonzero(self.n <= LARGE) if text is None else text
        wide = self._stretch(text, window)
        found = [f for s in np.unique(wide).tolist() for f in self._found(text[wide == s], window, s)]
        return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)), len(self)) if found else Anchors(*NONE, len(self))

    def steps(self, text: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of the anchors of one text, a step at a time."""
        one = np.array([text])
        for _, place, h in self._found(one, window, int(self._stretch(one, window)[0])):
            yield place, h

    def _stretch(self, text: np.ndarray, window: int) -> np.ndarray:
        """Windows that compete: in texts of more than LONG code points twice, four
        times, ... as many; what is least among more is least among fewer, so texts
        of any two lengths share anchors."""
        if window == FINE:
            return np.ones(len(text), np.int64)
        return STRETCH << np.ceil(np.log2(np.maximum(1, self.n[text] / LONG))).astype(np.int64)

    def _windows(self, text: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
        """Scrambled hashes of the windows at places of texts; a text that is shorter
        than a window counts whole.  Texts of a batch share most windows, so each of
        the batch's is hashed once, unless the places lie far apart."""
        cut = self.length[text]
        at = np.where(place >= cut, self.more[text] - cut, self.start[text]) + place
        odd = (place + window > self.n[text]) | (place < cut) & (place + window > cut)
        a, b = (int(at.min()), min(int(at.max()) + 1, self.hashes.n - window + 1)) if len(at) else (0, 0)
        if b <= a or b - a > SHARED:
            return _scrambled(self.spans(text, place, np.minimum(place + window, self.n[text])))
        h = _scrambled(self.hashes.windows(a, b, window))[np.minimum(at, b - 1) - a]
        few = np.flatnonzero(odd)
        h[few] = _scrambled(self.spans(text[few], place[few], np.minimum(place[few] + window, self.n[text[few]])))
        return h

    def _found(self, text: np.ndarray, window: int, stretch: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Texts, places and hashes, a step at a time.  A text with fewer windows than
        compete has the least one, a shorter one itself."""
        counts = np.maximum(1, self.n[text] - window + 1)
        heads = np.concatenate(([0], np.cumsum(counts)))
        for a in range(0, int(heads[-1]), STEP):
            # Each step looks as far beyond its ends as windows compete.
            lo, hi = max(0, a - stretch + 1), min(int(heads[-1]), a + STEP + stretch - 1)
            at = np.arange(lo, hi)
            k = np.searchsorted(heads, at[[0, -1]], "right") - 1
            k = np.repeat(np.arange(k[0], k[1] + 1), np.diff(np.clip(heads[k[0] : k[1] + 2], lo, hi)))
            place, here = at - heads[k], text[k]
            h = self._windows(here, place, window)
            keep = _least(h, k, np.minimum(stretch, counts[k]), stretch) & (at >= a) & (at < a + STEP) & (self.n[here] > 0)
            yield here[keep], place[keep], h[keep]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))


class Anchors:
    """Texts, places and scrambled hashes of anchors, in order of text and hash and,
    within a hash, place."""

    def __init__(self, text: np.ndarray, place: np.ndarray, h: np.ndarray, n_texts: int):
        # Bits of a key that hold the hash; above them stands the text.
        self.bits = min(48, 64 - max(1, n_texts - 1).bit_length())
        by = np.argsort(self._key(text, h), kind="stable")
        self.text, self.place, self.h = text[by], place[by], h[by]
        self.key = self._key(self.text, self.h)
        self.first = np.searchsorted(self.text, np.arange(n_texts + 1))

    def _key(self, text: np.ndarray, h: np.ndarray) -> np.ndarray:
        return text.astype(U) << U(self.bits) | h >> U(64 - self.bits)

    def of(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the anchors of texts, and which text (of the list) each is of."""
        n = self.first[text + 1] - self.first[text]
        which = np.repeat(np.arange(len(text)), n)
        return np.arange(len(which)) + np.repeat(self.first[text] - (np.cumsum(n) - n), n), which

    def find(self, text: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row of the first anchor of a text that is like one of hash h, or -1."""
        key = self._key(text, h)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(len(key), -1)


def _least(h: np.ndarray, k: np.ndarray, own: np.ndarray, stretch: int) -> np.ndarray:
    """Whether a hash is the least of some run of `stretch` hashes of its text (of
    `own`, if the text has no more)."""
    if stretch == 1 or not len(h):
        return np.ones(len(h), bool)
    top = np.iinfo(np.uint64).max
    # Least of the `stretch` values from each place on, by doubling.
    low, width = h, 1
    while width < stretch:
        step = min(width, stretch - width)
        low = np.minimum(low, np.concatenate((low, np.full(step, top, U)))[step:])
        width += step
    whole = np.zeros(len(h), bool)
    whole[: max(0, len(h) - stretch + 1)] = k[: len(h) - stretch + 1] == k[stretch - 1 :] if len(h) >= stretch else False
    seen = np.where(whole, low, U(0))
    # Greatest of these over the runs that hold a place.
    width = 1
    while width < stretch:
        step = min(width, stretch - width)
        seen = np.maximum(seen, np.concatenate((np.zeros(step, U), seen))[: len(seen)])
        width += step
    out = seen == h
    few = own < stretch
    if few.any():
        at = np.flatnonzero(few)
        first = np.flatnonzero(np.concatenate(([True], k[at][1:] != k[at][:-1])))
        least = np.minimum.reduceat(h[at], first)
        out[at] = h[at] == np.repeat(least, np.diff(np.concatenate((first, [len(at)]))))
    return out


def _scrambled(h: np.ndarray) -> np.ndarray:
    """Order of window hashes that owes nothing to their content; one to one."""
    h = h * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def _covered(texts: Texts, one: np.ndarray, two: np.ndarray, least: np.ndarray, anchors: Anchors) -> np.ndarray:
    """Code points of texts `one` (of pairs) within spans in common with `two`."""
    mine, pair = anchors.of(one)
    other = anchors.find(two[pair], anchors.h[mine])
    hit = np.flatnonzero(other >= 0)
    pair, low, high = _spans(texts, one, two, least, pair[hit], anchors.place[mine[hit]], anchors.place[other[hit]])
    out = np.zeros(len(one), np.int64)
    if not len(pair):
        return out
    by = np.lexsort((low, pair))
    pair, low, high = pair[by], low[by], high[by]
    # Union of spans: what each adds beyond the furthest end before it, in its pair.
    span = int(texts.n.max()) + 1
    ends = np.maximum.accumulate(high + pair * span)
    before = np.concatenate(([0], ends[:-1])) - pair * span
    np.add.at(out, pair, np.maximum(0, high - np.maximum(low, before)))
    return out


def _spans(texts: Texts, one: np.ndarray, two: np.ndarray, least: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs and ends (in texts `one`) of the spans in common that hold place i of
    text `one` and j of `two` of a pair."""
    if not len(pair):
        return pair, i, i
    # Anchors that lie alike in both, with nothing different between, are one span;
    # only its ends are searched.
    by = np.lexsort((i, i - j, pair))
    pair, i, j = pair[by], i[by], j[by]
    near = np.flatnonzero((pair[1:] == pair[:-1]) & (np.diff(i) == np.diff(j)))
    joined = texts.spans(one[pair[near]], i[near], i[near + 1]) == texts.spans(two[pair[near]], j[near], j[near + 1])
    new = np.ones(len(pair), bool)
    new[near[joined] + 1] = False
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(pair)])) - 1
    pair = pair[head]
    low = i[head] - texts.extension(one[pair], i[head], two[pair], j[head], True)
    high = i[tail] + texts.extension(one[pair], i[tail], two[pair], j[tail])
    ok = np.flatnonzero(high - low >= least[pair])
    return pair[ok], low[ok], high[ok]


class Union:
    """Spans of one text, any two of which may overlap, kept apart and in order."""

    def __init__(self):
        self.low = self.high = np.zeros(0, np.int64)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        if not len(low):
            return
        low, high = np.concatenate((self.low, low)), np.concatenate((self.high, high))
        by = np.argsort(low, kind="stable")
        low, high = low[by], np.maximum.accumulate(high[by])
        new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
        self.low, self.high = low[new], high[np.concatenate((new[1:], [len(low)])) - 1]

    def size(self) -> int:
        return int((self.high - self.low).sum())


def _in_steps(texts: Texts, one: int, two: int, least: int, window: int) -> int:
    """Code points of both texts of a pair within spans in common.  Only the distinct
    anchors of the shorter text are held; of the longer one, their first places."""
    if texts.n[one] > texts.n[two]:
        one, two = two, one
    parts = []
    for place, h in texts.steps(one, window):
        keys, first = np.unique(h, return_index=True)
        parts.append((keys, place[first].astype(np.int32)))
    h, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    keys, first = np.unique(h, return_index=True)
    place, there = place[first], np.full(len(keys), -1, np.int32)
    del h, first

    def spans(a: int, b: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        return _spans(texts, np.array([a]), np.array([b]), np.array([least]), np.zeros(len(i), np.int64), i, j)[1:]

    longer, shorter = Union(), Union()
    for i, h in texts.steps(two, window):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        at, i = at[hit], i[hit]
        # Of places in this step the first is written last.
        new = np.flatnonzero(there[at] < 0)[::-1]
        there[at[new]] = i[new]
        longer.add(*spans(two, one, i, place[at].astype(np.int64)))
    for i, h in texts.steps(one, window):
        j = there[np.searchsorted(keys, h)].astype(np.int64)
        shorter.add(*spans(one, two, i[j >= 0], j[j >= 0]))
    return longer.size() + shorter.size()


def compared(texts: Texts, one: np.ndarray, two: np.ndarray, anchors: Anchors) -> np.ndarray:
    """Likeness of pairs of texts, given the anchors of all but the large ones."""
    out, whole = np.zeros(len(one)), texts.whole()
    n, m = texts.n[one], texts.n[two]
    same = (n == m) & (whole[one] == whole[two])
    out[same] = 1.0
    fine = np.minimum(n, m) // 4 < LEAST
    leasts = np.clip(np.minimum(n, m) // 4, FINE, LEAST)
    rest, large = ~same & (n > 0) & (m > 0), np.maximum(n, m) > LARGE
    for at in np.flatnonzero(rest & large).tolist():
        total = n[at] + m[at]
        each = _in_steps(texts, int(one[at]), int(two[at]), int(leasts[at]), FINE if fine[at] else WINDOW)
        out[at] = min(each, total - 0.5) / total
    for short in (False, True):
        at = np.flatnonzero(rest & ~large & (fine == short))
        if not len(at):
            continue
        a, b, least = one[at], two[at], leasts[at]
        own = texts.anchors(np.unique(np.concatenate((a, b))), FINE) if short else anchors
        # Both ways at once: what each has in common with the other.
        each = _covered(texts, np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((least, least)), own)
        total = n[at] + m[at]
        out[at] = np.minimum(each[: len(a)] + each[len(a) :], total - 0.5) / total
    return out


def prints(texts: Texts, anchors: Anchors, some: np.ndarray | None = None) -> list[str]:
    """Fingerprints of some texts, or all, given the anchors of all but the large ones."""
    new = np.ones(len(anchors.h), bool)
    new[1:] = (anchors.h[1:] != anchors.h[:-1]) | (anchors.text[1:] != anchors.text[:-1])
    kept = np.flatnonzero(new)
    first = np.searchsorted(kept, anchors.first)
    some = np.arange(len(texts)) if some is None else some
    out = []
    for i, n, w, a, b in zip(some.tolist(), texts.n[some].tolist(), texts.whole()[some].tolist(), first[some].tolist(), first[some + 1].tolist(), strict=True):
        sketch = anchors.h[kept[a : min(b, a + SKETCH)]]
        if n > LARGE:
            for _, h in texts.steps(i):
                sketch = np.unique(np.concatenate((sketch, h)))[:SKETCH]
        out.append(f"{n:x}.{w:016x}.{sketch.astype('>u8').tobytes().hex()}")
    return out


def of(strings: list[str]) -> Texts:
    """The texts of a list, as one batch."""
    data, offs = utf8(pa.array(strings, pa.large_string()))
    n = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(n) - n
    return Texts(PrefixHash(data), start, n, start, n)


def fingerprint(text: str) -> str:
    one = of([text])
    return prints(one, one.anchors())[0]


def common(a: str, b: str) -> float:
    """Likeness of two texts."""
    both = of([a, b])
    return float(compared(both, np.array([0]), np.array([1]), both.anchors())[0])


def likeness(a: str, b: str) -> float:
    """The share of anchors that two fingerprints have in common, estimated from the
    smallest ones; 1 for equal fingerprints, below 1 for others."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 16] for i in range(0, len(s), 16)} for s in (f.split(".")[2] for f in (a, b)))
    if not x or not y:
        return 0.0
    least = sorted(x | y)[:SKETCH]
    return min(sum(v in x and v in y for v in least) / len(least), 1 - 0.5 / len(least))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the next one's start."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (range, last, tie, id, text): within a range of ids in order, and at
    the end of each, marked `last`, the first document of the range that follows
    (of the first range, after the last)."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(src.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    at = F.lit(0)
    if cuts:
        bounds = F.array(*(F.lit(c) for c in cuts))
        at = F.size(F.filter(bounds, lambda c: c <= low))
    # Ranges are few; only the least id of each comes to the driver.
    firsts = {r["range"]: r["least"] for r in src.select(at.alias("range"), low.alias("least")).groupBy("range").agg(F.min("least").alias("least")).collect()}
    used = sorted(firsts)
    ranged = src.withColumn("range", at)
    # Where the next document stands at the head of another range, it goes there too.
    before = dict(zip(used[1:] + used[:1], used, strict=True)) if used else {}
    head = ranged.where(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).isin([firsts[r] for r in used]) if used else F.lit(False))
    # Of rows that share a head's id, the first; one row a range is left.
    heads = head.groupBy("range").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text", "doc_id")).alias("h")).select("h.doc_id", "h.text", "range")
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    both = ranged.withColumn("last", F.lit(False)).unionByName(heads.withColumn("last", F.lit(True)).withColumn("range", to[F.col("range")]))
    both = both.withColumn("tie", F.xxhash64("text")).withColumn("id", low_column())
    parts = max(n, len(used))
    return both.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "last", "id", "tie", "text").select("range", "last", "doc_id", "text")


def low_column():
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63)))


def beside(own: list[str], following: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Fingerprints of texts and of their edited texts, and the likeness of each text
    to its edited text and to the text that follows."""
    k = len(own)
    chain = own if not k else [*own, following[-1]] if own[1:] == following[:-1] else None
    if chain is None:
        chain, nxt = [x for pair in zip(own, following, strict=True) for x in pair], 2 * np.arange(k) + 1
        mine = 2 * np.arange(k)
    else:
        mine, nxt = np.arange(k), np.arange(k) + 1
    base = of(chain)
    n = base.n[mine]
    cut = n // 4
    # Plain texts first, edited ones after them.
    texts = Texts(base.hashes, np.concatenate((base.start, base.start[mine])), np.concatenate((base.n, n - cut)), np.concatenate((base.start, base.start[nxt])), np.concatenate((base.n, n - cut + np.minimum(cut, base.n[nxt]))))
    late = len(base) + np.arange(k)
    anchors = texts.anchors()
    shown = prints(texts, anchors, np.concatenate((mine, late)))
    near = compared(texts, np.concatenate((mine, mine)), np.concatenate((late, nxt)), anchors)
    return shown[:k], shown[k:], near[:k], near[k:]


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, with their likenesses."""
    lean(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        """(id, text, next text) of the documents of each range."""
        held, ended = None, None
        for batch in batches:
            where, last, ids = (batch.column(i).to_pylist() for i in range(3))
            for i, body in enumerate(batch.column(3).to_pylist()):
                if last[i] and ended == where[i]:
                    continue  # a range that is its own next one ends once
                if held and held[0] == where[i]:
                    yield held[1], held[2], body
                ended = where[i] if last[i] else ended
                held = None if last[i] else (where[i], ids[i], body)

    def compare(some: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, own, following = map(list, zip(*some, strict=True))
        one, two, near_edited, near_next = beside(own, following)
        sha = [hashlib.sha256(edited(a, b).encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(own, following, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), *(pa.array(x, pa.string()) for x in (sha, one, two)), pa.array(near_edited), pa.array(near_next)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for row in pairs(batches):
            more = max(ROW, len(row[1]) + len(row[2]) // 8)
            if some and size + more > BATCH:
                yield compare(some)
                some, size = [], 0
            some.append(row)
            size += more
        if some:
            yield compare(some)

    return neighbours(docs, key, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
