"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
n-grams of letters (n from 1 to ORDER, words padded by one blank) that both hold,
divided by the root of the product of each one's own number.  An n-gram is its
hash among 2**BITS places, each place being held or not.  A text is taken in
segments of SEGMENT letters and blanks, so that places don't fill up; its decision
values are those of its segments, each weighing as its letters.

The kernel is approximated by Nystroem's method on LANDMARKS training texts:
features are the kernels with the landmarks times the inverse root of the
landmarks' own kernel matrix.  One-versus-rest kernel ridge regression in these
features is solved in closed form.  A batch of segments is scored by two matrix
products, (segments x places)(places x landmarks) and (segments x landmarks)
(landmarks x languages).

Every language is learned.  The classifier is fitted on at most SAMPLE labelled
rows of each, those with the least hashes of their ids, and of each of these on
the segment with most n-grams; where there are many languages, on fewer rows of
each, ROWS in all but never under FEWEST a language.  Only presence bits come to
the driver, 2**BITS / 8 bytes a row.  Every whole text is scored, a window at a
time if it is long.

A text that is null or has no letter is `und` with score 0.  Null labels don't
count; null ids, ties, repeated rows and extra columns don't matter; of rows that
share an id one is fitted.  Without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import code_points, fold, lean, least_hashes, mix, per_row, slices, utf8, windows

ORDER, BITS, LANDMARKS, SAMPLE, ROWS, FEWEST, RIDGE = 4, 13, 256, 400, 51_200, 16, 1e-3
UND = "und"
#: Letters and blanks of a segment.
SEGMENT = 4096
#: Segments of one matrix product.
PARTS = 64
_U = np.uint64


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else; by the rule
    `isalpha`, over all code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _spelled(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Codes of letters, each run of others one blank (0), and their rows, a window
    at a time, and whether it is the last one; a window starts with the ORDER - 1
    codes that follow the last whole segment, and with what stands after them."""
    held, n = np.zeros(0, np.uint32), len(offs) - 1
    cuts = list(windows(data)) if n == 1 else [(0, len(data))]
    for a, b in cuts:
        code = _letters()[np.minimum(code_points(data[a:b]), 0x10FFFF)]
        if n > 1:
            row = np.repeat(np.arange(n), per_row((data & 0xC0) != 0x80, offs))
        else:
            code = np.concatenate((held, code))
            row = np.zeros(len(code), np.int64)
        blank = code == 0
        keep = ~blank
        keep[1:] |= blank[1:] & (~blank[:-1] | (row[1:] != row[:-1]))
        keep[:1] = True
        code, row = code[keep], row[keep]
        if b < len(data):
            whole = max(0, len(code) - ORDER + 1) // SEGMENT * SEGMENT
            held = code[whole:]
            code, row = code[: whole + ORDER - 1], row[: whole + ORDER - 1]
        yield code, row, b == len(data)


def presence(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of the rows of a slice: which n-gram places each holds (m x 2**BITS,
    bool), its row and its number of letters, PARTS segments at a time."""
    for code, row, last in _spelled(data, offs):
        n = len(code) if last else max(0, len(code) - ORDER + 1)
        if not n:
            continue
        head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(code)) - np.repeat(head, np.diff(np.concatenate((head, [len(code)]))))
        segment = np.cumsum(place % SEGMENT == 0) - 1
        of = row[place % SEGMENT == 0]
        letters = np.bincount(segment[:n], code[:n] > 0)
        at = np.concatenate((np.flatnonzero(place % SEGMENT == 0), [len(code)]))
        for a in range(0, len(letters), PARTS):
            b = min(a + PARTS, len(letters))
            first, end = at[a], min(at[b], n)
            held = np.zeros((b - a, 1 << BITS), bool)
            key = np.zeros(end - first, _U)
            for k in range(ORDER):
                m = min(end, len(code) - k) - first
                if m <= 0:
                    break
                key = key[:m] * _U(0x100000001B3) + code[first + k : first + k + m] + _U(1)
                ok = row[first + k : first + k + m] == row[first : first + m] if k else code[first:end] > 0
                held[(segment[first : first + m] - a)[ok], (mix(key + _U(k)) >> _U(64 - BITS)).astype(np.int64)[ok]] = True
            held[letters[a:b] == 0] = False
            yield held, of[a:b], letters[a:b]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernels of all pairs of rows, some rows at a time."""
    y, n_b = b.astype(np.float32).T, np.maximum(1, b.sum(1, dtype=np.int64))
    parts = [a[i : i + 256].astype(np.float32) @ y / np.sqrt(np.maximum(1, a[i : i + 256].sum(1, dtype=np.int64))[:, None] * n_b[None, :]) for i in range(0, len(a), 256)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)), np.float32)


def fit(held: np.ndarray, langs: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Landmarks' presence, weights (landmarks x languages) and languages."""
    names, code = np.unique(langs, return_inverse=True)
    names = names.tolist()
    by = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[by], np.arange(len(names)))
    rng = np.random.default_rng(seed)
    each = max(1, LANDMARKS // len(names))
    marks = np.concatenate([rng.permutation(x)[:each] for x in np.split(by, starts[1:])])
    land = held[np.sort(marks)]
    value, vector = np.linalg.eigh(kernel(land, land).astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = kernel(held, land) @ root
    # Rows weigh so that languages weigh alike.
    w = (len(langs) / len(names) / np.bincount(code))[code]
    gram = phi.T @ (phi * w[:, None]) + RIDGE * len(langs) * np.eye(phi.shape[1])
    sums = np.add.reduceat((phi * w[:, None])[by], starts)
    return land, (root @ np.linalg.solve(gram, sums.T)).astype(np.float32), names


def predict(data: np.ndarray, offs: np.ndarray, land: np.ndarray, weights: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray]:
    n = len(offs) - 1
    if not names:
        return [UND] * n, np.zeros(n)
    out, letters = np.zeros((n, len(names))), np.zeros(n)
    for held, row, weight in presence(data, offs):
        np.add.at(out, row, np.clip(kernel(held, land) @ weights, 0, None) * weight[:, None])
        np.add.at(letters, row, weight)
    best = out.argmax(1)
    score = np.where(letters > 0, out.max(1) / np.maximum(out.sum(1), 1e-9), 0.0)
    return [names[b] if ok else UND for b, ok in zip(best, letters > 0, strict=True)], np.clip(score, 0, 1)


def _bits(rows: DataFrame, kind: str) -> DataFrame:
    """label, doc_id and the presence bits of each row's fullest segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, best = batch.slice(i, 1), b""
                for held, _, _ in presence(*utf8(part.column(2))):
                    k = held.sum(1).argmax()
                    if held[k].sum() > np.unpackbits(np.frombuffer(best, np.uint8)).sum():
                        best = np.packbits(held[k]).tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([best], pa.binary())], ["lang", "doc_id", "bits"])

    return rows.mapInArrow(run, f"lang string, doc_id {kind}, bits binary")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Fits on rows with a label, taken by the least hashes of their ids.  Only
    ids and labels are read to choose them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id", "text")
    nothing = np.zeros((0, 1 << BITS), bool), np.zeros((0, 0), np.float32), []
    n_langs = known.select("lang").distinct().count()
    ids = least_hashes(known, "lang", "doc_id", min(sample, max(FEWEST, ROWS // max(1, n_langs))))
    if not ids.num_rows:
        return nothing
    # At most `sample` ids a language.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids.rename_columns(["__lang", "__id"])))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _bits(known.join(chosen, (F.col("lang") == F.col("__lang")) & (F.col("doc_id") == F.col("__id")), "left_semi"), kind)
    rows = rows.where(F.length("bits") > 0).groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not rows.num_rows:
        return nothing
    held = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8)).reshape(rows.num_rows, -1).astype(bool)
    return fit(held, np.array(rows["lang"].to_pylist()))


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[str]], text: str = "text") -> DataFrame:
    """Adds __lang and __score to every row."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        land, weights, names = sent.value
        for batch in batches:
            col = batch.schema.get_field_index(text)
            for a, b in slices(batch.column(col)):
                part = batch.slice(a, b - a)
                lang, score = predict(*utf8(part.column(col)), land, weights, names)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "__lang", "__score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]))


def digests(docs: DataFrame, held_mod: int = 4, held_rem: int = 2) -> DataFrame:
    held = fold("doc_id", held_mod) == held_rem
    model = train(docs.where(~held).select("doc_id", "lang", "text"))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
