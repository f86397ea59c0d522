"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so tokens are labelled first: in documents marked
toxic, a token is labelled toxic when its word or its beginning stands in toxic
documents far beyond chance, in many contexts; all others are not.  A two-state chain over each sentence is fitted to these labelled tokens,
with hashed features of a token (its word, its first 3, 4 and 5 letters, its last
4, whether it is in capitals) and transition weights, by gradient ascent on the
conditional likelihood.

Forward and backward messages give each token's marginal.  A document's evidence
is the sum of its tokens' marginals beyond FLOOR and the largest one; a logistic
curve in the two, fitted on the documents' labels, gives the score.  `spans`
returns the offsets in code points of runs of offending tokens.

Words are runs of letters, case-folded within ASCII and Latin-1; a sentence ends at . ! ?, a
line feed, or after LONGEST words.  All sentences of a batch are run through at once, so the number of
steps is the longest sentence's length.

Fitting uses at most SAMPLE labelled documents of either label, those with the
least hashes of their ids, as hashed features of SAMPLE_TOKENS tokens at most, half
of them for either label; a document that doesn't fit is passed over, and a label
of which none fits keeps its shortest one; of rows that share an id one is fitted.
Every whole text is scored, some sentences at a time if it is long.  Null and empty texts get the curve's value at no
evidence; rows without labels, null labels, repeated and extra columns don't
matter; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import GOLD, LOWER, SLICE_BYTES, fold, lean, least_hashes, mix, runs, slices, spans_hash, utf8

SAMPLE, SAMPLE_TOKENS = 1000, 2_000_000
FEATURE_BITS, EVIDENCE, PRECISION, FLOOR, OFFENDING = 18, 16.0, 0.9, 0.3, 0.5
STEPS, RATE, RIDGE = 40, 0.5, 1e-4
PREFIXES, SUFFIX, TELLING = (3, 4, 5), 4, (4, 5)
#: Words of a sentence; a longer one is taken as several.
LONGEST = 512
_U, _I = np.uint64, np.int64
_SALT = mix(np.arange(1, 10, dtype=_U) * GOLD)
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_stop = np.zeros(256, bool)
_stop[[ord(c) for c in ".!?\n"]] = True
_upper = np.zeros(256, bool)
_upper[range(65, 91)] = True


class Tokens:
    """Tokens of a slice of texts, their features and their sentences."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.row = runs(_letter, data, offs)
        low = LOWER[data]
        # Capitals of Latin-1 in UTF-8: C3 80 to C3 9E, without the multiplication sign.
        wide = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)) + 1
        low[wide] += 32
        n = self.end - self.start
        self.word = spans_hash(low, self.start, self.end)
        salts = [self.word]
        for k, m in enumerate(PREFIXES):
            salts.append(np.where(n > m, spans_hash(low, self.start, np.minimum(self.start + m, self.end)) ^ _SALT[k], _SALT[k]))
        salts.append(np.where(n > SUFFIX, spans_hash(low, np.maximum(self.end - SUFFIX, self.start), self.end) ^ _SALT[-1], _SALT[-1]))
        caps = np.concatenate(([0], np.cumsum(_upper[data])))
        salts.append((caps[self.end] - caps[self.start] == n).astype(_U) + _U(77))
        salts.append(np.full(len(n), _U(99)))
        self.features = (mix(np.stack(salts, 1)) >> _U(64 - FEATURE_BITS)).astype(np.int32)
        stops = np.concatenate(([0], np.cumsum(_stop[data])))
        broken = np.ones(len(self.start), bool)
        if len(self.start) > 1:
            broken[1:] = (stops[self.start[1:]] > stops[self.end[:-1]]) | (self.row[1:] != self.row[:-1])
        heads = np.flatnonzero(broken)
        place = np.arange(len(broken)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(broken)]))))
        self.heads = np.flatnonzero(place % LONGEST == 0)


class Chains:
    """Sentences ordered by length, for steps over all that are long enough."""

    def __init__(self, heads: np.ndarray, n: int):
        lens = np.diff(np.concatenate((heads, [n])))
        order = np.argsort(-lens, kind="stable")
        self.heads, self.lens = heads[order], lens[order]
        self.wide = np.searchsorted(-self.lens, -np.arange(1, (self.lens[0] if len(lens) else 0) + 1), "right")

    def marginals(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(toxic) of every token, expected transition counts (2 x 2) and the log
        partition function, from log potentials: unary of state 1 against 0."""
        n = len(unary)
        fwd, scale = np.empty((n, 2)), np.empty(n)
        move = np.exp(trans)
        emit = np.stack((np.ones(n), np.exp(np.clip(unary, -30, 30))), 1)
        for t, w in enumerate(self.wide):
            at = self.heads[:w] + t
            a = emit[at] if t == 0 else (fwd[at - 1] @ move) * emit[at]
            s = a.sum(1)
            fwd[at], scale[at] = a / s[:, None], s
        back, pairs = np.empty((n, 2)), np.zeros((2, 2))
        for t in range(len(self.wide) - 1, -1, -1):
            w = self.wide[t]
            at = self.heads[:w] + t
            b = np.ones((w, 2))
            on = self.wide[t + 1] if t + 1 < len(self.wide) else 0
            if on:
                nxt = at[:on] + 1
                later = emit[nxt] * back[nxt] / scale[nxt][:, None]
                b[:on] = later @ move.T
                pairs += move * (fwd[at[:on]].T @ later)
            back[at] = b
        p = fwd * back
        return p[:, 1] / p.sum(1), pairs, float(np.log(scale).sum())


def fit_chain(features: np.ndarray, heads: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transition weights of largest conditional likelihood,
    by Adagrad on the full gradient."""
    chains, size = Chains(heads, len(features)), 1 << FEATURE_BITS
    w, trans = np.zeros(size), np.zeros((2, 2))
    gw, gt = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    joined = np.ones(len(tags), bool)
    joined[heads] = False
    at = np.flatnonzero(joined)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[at - 1], tags[at]), 1)
    flat = features.reshape(-1)
    for _ in range(steps):
        p, pairs, _ = chains.marginals(w[features].sum(1), trans)
        g = np.bincount(flat, np.repeat(tags - p, features.shape[1]), size) - RIDGE * len(tags) * w / 100
        gw += g * g
        w += RATE * g / np.sqrt(gw)
        t = seen - pairs
        gt += t * t
        trans += RATE * t / np.sqrt(gt)
    return w.astype(np.float32), trans


def _contexts(mark: np.ndarray, beside: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a feature, and in how many contexts each stands in toxic and in
    other documents."""
    key = mix(mark.astype(_U) * GOLD + mix(beside)) & ~_U(1) | toxic.astype(_U)
    at = np.unique(key, return_index=True)[1]
    values, back = np.unique(mark[at], return_inverse=True)
    return values, np.bincount(back, toxic[at], len(values)), np.bincount(back, 1 - toxic[at], len(values))


def telling(mark: np.ndarray, before: np.ndarray, after: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Values of a feature that stand in toxic documents far beyond chance: the
    likelihood ratio statistic above EVIDENCE and, with both labels weighing
    alike, a share in toxic documents above PRECISION.  What counts are different
    words before and different words after, whichever are fewer, and not
    documents; so copies of one document, near ones too, are little evidence."""
    values, hit, miss = _contexts(mark, before, toxic)
    _, hit_after, miss_after = _contexts(mark, after, toxic)
    yes, no = max(1.0, hit.sum()), max(1.0, miss.sum())
    hit, miss = np.minimum(hit, hit_after), np.maximum(miss, miss_after)
    share = yes / (yes + no)
    ratio = sum(2 * x * np.log(np.maximum(x, 1e-9) / np.maximum((hit + miss) * s, 1e-9)) for x, s in ((hit, share), (miss, 1 - share)))
    precise = hit / yes > PRECISION * (hit / yes + miss / no)
    return values[precise & (ratio > EVIDENCE)]


def token_tags(word: np.ndarray, features: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents whose word or beginning of TELLING letters is
    telling; shorter beginnings and ends are features of the chain, no evidence."""
    label = toxic[row].astype(np.int64)
    side = np.concatenate(([0], word, [0])).astype(_U)
    same = np.concatenate(([False], row[1:] == row[:-1], [False]))
    before, after = np.where(same[:-1], side[:-2], _U(0)), np.where(same[1:], side[2:], _U(0))
    hit = np.isin(word, telling(word, before, after, label))
    for k in (1 + PREFIXES.index(m) for m in TELLING):
        hit |= np.isin(features[:, k], telling(features[:, k], before, after, label))
    return (hit & (label > 0)).astype(np.int64)


def evidence(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of each document: 1, log of 1 + the sum of marginals beyond FLOOR, the
    largest one."""
    return np.stack((np.ones(len(total)), np.log1p(total), most), 1)


def summed(p: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.zeros(n)
    np.maximum.at(most, row, p)
    return np.bincount(row, np.where(p > FLOOR, p, 0.0), n), most


def sentences(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of one text, about `most` bytes each, that end with a sentence;
    where none ends, they end between words, and a word is never cut."""
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        if to < len(data):
            for ends in (_stop, ~_letter):
                found = np.flatnonzero(ends[data[at:to]])
                if len(found):
                    to = at + int(found[-1]) + 1
                    break
            else:
                rest = np.flatnonzero(~_letter[data[to:]])
                to = to + int(rest[0]) + 1 if len(rest) else len(data)
        yield at, to
        at = to


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - q) - 1e-2 * b)
        b += np.clip(step, -3, 3)
    return b


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: np.ndarray | None):
        self.weights, self.trans, self.curve = weights, trans, curve

    def marginals(self, tokens: Tokens) -> np.ndarray:
        if not len(tokens.start):
            return np.zeros(0)
        return Chains(tokens.heads, len(tokens.start)).marginals(self.weights[tokens.features].sum(1), self.trans)[0]

    def read(self, data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Score of each row, and its offending tokens: row, number within the
        slice, start and end in code points of the row.  One long text is read
        some sentences at a time."""
        n, number, chars, hits = len(offs) - 1, 0, 0, []
        total, largest = np.zeros(n), np.zeros(n)
        for a, b in sentences(data, most) if n == 1 else [(0, len(data))]:
            part, at = data[a:b], offs if n > 1 else np.array([0, b - a])
            tokens = Tokens(part, at)
            p = self.marginals(tokens)
            more, top = summed(p, tokens.row, n)
            total, largest = total + more, np.maximum(largest, top)
            hit = np.flatnonzero(p > OFFENDING)
            seen = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            base = seen[at[tokens.row[hit]]] - chars
            hits.append((tokens.row[hit], hit + number, seen[tokens.start[hit]] - base, seen[tokens.end[hit]] - base))
            number, chars = number + len(p), chars + int(seen[-1])
        if self.curve is None:
            return np.zeros(n), hits
        return 1 / (1 + np.exp(-np.clip(evidence(total, largest) @ self.curve, -30, 30))), hits


def _chosen(docs: DataFrame, labels: DataFrame, sample: int, room: int) -> DataFrame | None:
    """(toxic, __id, __body) of the documents that are fitted, one for an id.  Only
    ids, hashes and numbers of tokens come to the driver."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = marked.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id")
    ids = least_hashes(known, "toxic", "doc_id", sample)
    if not ids.num_rows:
        return None
    spark = docs.sparkSession
    # At most `sample` ids a label, here and below.
    chosen = F.broadcast(spark.createDataFrame(ids.rename_columns(["toxic", "__id"])))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("toxic", "__id", F.xxhash64("text").alias("__body"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                data, offs = utf8(part.column(3))
                _, _, row = runs(_letter, data, offs)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.bincount(row, minlength=part.num_rows))], ["toxic", "__id", "__body", "n"])

    counted = rows.mapInArrow(run, f"toxic int, __id {docs.schema['doc_id'].dataType.simpleString()}, __body long, n long")
    got = counted.groupBy("toxic", "__id").agg(F.min(F.struct("__body", "n")).alias("m")).select("toxic", "__id", "m.*").toArrow().sort_by([("toxic", "ascending"), ("__body", "ascending"), ("__id", "ascending")])
    toxic, n = got["toxic"].to_numpy(), got["n"].to_numpy()
    keep = np.zeros(len(n), bool)
    for label in np.unique(toxic):
        left = room // 2
        for i in np.flatnonzero(toxic == label):
            if n[i] <= left:
                keep[i], left = True, left - n[i]
        if not keep[toxic == label].any():
            keep[np.flatnonzero(toxic == label)[n[toxic == label].argmin()]] = True
    return spark.createDataFrame(got.filter(pa.array(keep)).select(["toxic", "__id", "__body"]))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, room: int) -> list[dict]:
    """toxic, words, features and sentence heads of the documents that are fitted."""
    chosen = _chosen(docs, labels, sample, room)
    if chosen is None:
        return []
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__body"))).select("toxic", "__id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                part = batch.slice(a, 1)
                t = Tokens(*utf8(part.column(2)))
                heads = np.zeros(len(t.start), np.int8)
                heads[t.heads] = 1
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array([x.tobytes()], pa.binary()) for x in (t.word, t.features, heads))], ["toxic", "__id", "word", "features", "heads"])

    made = rows.mapInArrow(run, f"toxic int, __id {docs.schema['doc_id'].dataType.simpleString()}, word binary, features binary, heads binary")
    # Rows alike in id and text are one.
    out = made.groupBy("toxic", "__id").agg(*(F.first(c).alias(c) for c in ("word", "features", "heads"))).toArrow().to_pylist()
    # An order that owes nothing to labels, ids or partitions.
    return sorted(out, key=lambda r: (r["word"], r["features"], r["heads"], r["toxic"]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, room: int | None = None) -> Model:
    kept = _sample(docs, labels, sample, SAMPLE_TOKENS if room is None else room)
    toxic = np.array([r["toxic"] for r in kept], float)
    zero = Model(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros((2, 2)), None)
    if not len(toxic) or toxic.min() == toxic.max():
        return zero
    word = np.frombuffer(b"".join(r["word"] for r in kept), _U)
    features = np.frombuffer(b"".join(r["features"] for r in kept), np.int32).reshape(len(word), -1)
    heads = np.flatnonzero(np.frombuffer(b"".join(r["heads"] for r in kept), np.int8))
    row = np.repeat(np.arange(len(kept)), [len(r["heads"]) for r in kept])
    if not len(word):
        return zero
    tags = token_tags(word, features, row, toxic)
    weights, trans = fit_chain(features, heads, tags)
    model = Model(weights, trans, None)
    p = Chains(heads, len(word)).marginals(weights[features].sum(1), trans)[0]
    model.curve = fit_curve(evidence(*summed(p, row, len(kept))), toxic)
    return model


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Adds __score and, if asked, __spans: [start, end) in code points of runs of
    offending tokens."""
    from pyspark.sql import types as T

    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.schema.get_field_index("text")
            for a, b in slices(batch.column(col)):
                part = batch.slice(a, b - a)
                data, offs = utf8(part.column(col))
                got, hits = sent.value.read(data, offs)
                cols, names = [*part.columns, pa.array(got)], [*part.schema.names, "__score"]
                if spans:
                    cols, names = [*cols, pa.array(_runs(hits, part.num_rows), pa.list_(pa.list_(pa.int64())))], [*names, "__spans"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__score", T.DoubleType()), *([T.StructField("__spans", kind)] if spans else [])]))


def _runs(hits: list[tuple[np.ndarray, ...]], n: int) -> list[list[list[int]]]:
    """[start, end) of runs of offending tokens that follow each other, by row."""
    out: list[list[list[int]]] = [[] for _ in range(n)]
    before = (-1, -2)
    for found in hits:
        for row, number, start, end in zip(*(x.tolist() for x in found), strict=True):
            if before == (row, number - 1):
                out[row][-1][1] = end
            else:
                out[row].append([start, end])
            before = row, number
    return out


def digests(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rem: int = 0) -> DataFrame:
    held = fold("doc_id", held_mod) == held_rem
    model = train(docs.where(~held), labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
