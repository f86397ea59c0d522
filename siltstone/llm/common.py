"""Vectorised text helpers shared by the corpus operators.

Everything here works on the UTF-8 buffer of an Arrow string column, so a batch
of documents is one byte array plus row offsets and no Python object is made
per document.  Batches are cut into slices of bounded size; one document longer
than a slice is handled alone, whole.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 1 << 18

U64 = np.uint64
MIX_A, MIX_B, GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
BASE = U64(0x9E3779B97F4A7BF5)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string array; a null is an empty row."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is a range of its own."""
    _, offs = utf8(arr)
    at, n = 0, len(arr)
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes that a pass over one text looks at together.
BLOCK_BYTES = 1 << 17


@cache
def _powers(base: int, step: int, n: int) -> np.ndarray:
    """Powers 0 to n of base**step modulo 2**64."""
    out = np.full(n + 1, U64(pow(base, step, 1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base**at, from two short tables."""
    low, high = at % BLOCK_BYTES, at // BLOCK_BYTES
    small = _powers(int(base), 1, BLOCK_BYTES)[low]
    return small * _powers(int(base), BLOCK_BYTES, 1 << 14)[high] if len(high) and high.max() else small


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial modulo 2**64.
    Both ends ascend; the sums are made a block at a time and kept only where a
    span starts or ends, so memory goes with the spans and not with the bytes."""
    pre_s, pre_e = np.zeros(len(start), U64), np.zeros(len(end), U64)
    carry = U64(0)
    for a in range(0, len(data), BLOCK_BYTES):
        part = data[a : a + BLOCK_BYTES]
        pre = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * _powers(int(BASE), 1, BLOCK_BYTES)[: len(part)], out=pre[1:])
        if a:
            pre *= U64(pow(int(BASE), a, 1 << 64))
        pre += carry
        for at, out in ((start, pre_s), (end, pre_e)):
            i, j = np.searchsorted(at, (a, a + len(part) + 1))
            out[i:j] = pre[at[i:j] - a]
        carry = pre[-1]
    return mix((pre_e - pre_s) * powers(BASE_INV, start) + (end - start).astype(U64) * GOLD)


def runs(inside: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that `inside` (a flag for
    each byte value) marks; a row's end ends a run."""
    starts, ends = [], []
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(len(data), a + BLOCK_BYTES)
        here = inside[data[max(0, a - 1) : b + 1]]
        now = here[a > 0 :][: b - a]
        before = here[: b - a] if a else np.concatenate(([False], now[:-1]))
        after = here[(a > 0) + 1 :][: b - a]
        if len(after) < b - a:
            after = np.concatenate((after, [False]))
        first, last = now & ~before, now & ~after
        i, j = np.searchsorted(offs, (a, b))
        first[offs[i:j] - a] |= now[offs[i:j] - a]
        i, j = np.searchsorted(offs, (a + 1, b + 1))
        last[offs[i:j] - 1 - a] |= now[offs[i:j] - 1 - a]
        starts.append(np.flatnonzero(first) + a)
        ends.append(np.flatnonzero(last) + a + 1)
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    return start, end, np.searchsorted(offs, start, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-separator bytes."""
    return runs(~SEPARATOR, data, offs)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes that start at a character."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    a, b, c, d = (wide[at + k] & m for k, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
    out = np.where(a < 0x80, a, (a & 0x1F) << 6 | b)
    out = np.where(a >= 0xE0, (a & 0xF) << 12 | b << 6 | c, out)
    return np.where(a >= 0xF0, (a & 7) << 18 | b << 12 | c << 6 | d, out)


def windows(data: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `most` bytes that end with a character."""
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        yield at, to
        at = to


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of `flags` within each row."""
    at, carry = np.zeros(len(offs), np.int64), 0
    for a in range(0, len(flags), BLOCK_BYTES):
        total = np.cumsum(flags[a : a + BLOCK_BYTES], dtype=np.int64)
        i, j = np.searchsorted(offs, (a + 1, a + len(total) + 1))
        at[i:j] = carry + total[offs[i:j] - 1 - a]
        carry += int(total[-1])
    return np.diff(at)


def fold(column: Column | str, div: int) -> Column:
    """crc32 of an id as text modulo `div`: the folds of the held-out contracts."""
    return F.pmod(F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")), F.lit(div))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.  One of our own only
    where none is set and driver and tasks are one process, as in tests."""
    ctx = spark.sparkContext
    base = ctx.getConf().get("spark.checkpoint.dir")
    if base is None and not ctx._jsc.sc().getCheckpointDir().isEmpty():
        base = ctx._jsc.sc().getCheckpointDir().get()
    if base is None:
        if not ctx.master.startswith("local[") and ctx.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/siltstone-checkpoints"
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    ctx = df.sparkSession.sparkContext
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        ctx.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows and bytes of an Arrow batch at most (one row may be longer): both sides hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def lean(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers that don't share the
    driver's module path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(":")] + [os.getcwd()]
    lean(spark)
    ctx = spark.sparkContext
    if root in paths or os.path.exists(os.path.join(os.getcwd(), "siltstone", "llm", "common.py")) or getattr(ctx, "_siltstone_shipped", False):
        return spark
    import tempfile

    to = os.path.join(tempfile.mkdtemp(), "siltstone_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "siltstone")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    ctx.addPyFile(to)
    ctx._siltstone_shipped = True
    return spark


def least_hashes(rows: DataFrame, label: str, key: str, each: int) -> pa.Table:
    """(label, key) of about `each` keys of every label, those with the least hashes;
    neither column holds nulls.  Counts by label give a bound on the hash below
    which few more than `each` stand, so only these come to the driver, from all
    tasks alike: at most 2 * each + 64 a label, about."""
    rank, top = F.pmod(F.xxhash64(key), F.lit(1 << 30)), 1 << 30
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    below = {k: min(top, -(-top * (2 * each + 64) // n)) for k, n in counts.items()}
    kind = rows.select(label, key, rank.alias("rank"))
    while counts:
        bound = rows.sparkSession.createDataFrame(list(below.items()), f"__label {rows.schema[label].dataType.simpleString()}, __below long")
        # A row a label.
        got = kind.join(F.broadcast(bound), (F.col(label) == F.col("__label")) & (F.col("rank") < F.col("__below"))).groupBy(label, key).agg(F.first("rank").alias("rank")).toArrow()
        seen = {x["values"]: x["counts"] for x in got[label].value_counts().to_pylist()}
        # Repeated keys may leave too few; then the bound was too low.
        short = [k for k in below if seen.get(k, 0) < each and below[k] < top]
        if not short:
            break
        below |= {k: min(top, below[k] * 8) for k in short}
    else:
        return kind.limit(0).toArrow().select([label, key])
    got = got.sort_by([(label, "ascending"), ("rank", "ascending"), (key, "ascending")])
    where = np.unique(got[label].to_numpy(zero_copy_only=False).astype(str), return_index=True)[1] if got.num_rows else np.zeros(0, np.int64)
    place = np.arange(got.num_rows) - np.maximum.accumulate(np.bincount(where, where, got.num_rows).astype(np.int64)) if got.num_rows else where
    return got.filter(pa.array(place < each)).select([label, key])


def ranked(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds the place of each row in an order, from 0: ranges are sorted alike, and
    only their row counts, one number a range, come to the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return ranged.withColumn(name, F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), part + 1) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")
