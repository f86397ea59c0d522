"""Content expressions: hashes, binary test, versions, chunks and byte strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def is_binary(content: Column) -> Column:
    """Whether the bytes hold a NUL."""
    return F.position(F.lit(b"\0"), content.cast("binary")) > 0


def fingerprint(content: Column) -> Column:
    """Two 64-bit hashes as one tag, to compare content cheaply."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), content)), 16, "0")
    return F.concat(F.lit("xx128:"), F.lower(F.concat(half(1), half(2))))


def le64_hex(n: Column) -> Column:
    """Hex of a number's eight bytes, lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)))


def version_equal(a: Column, b: Column) -> Column:
    """Equal modification times, and whatever else both sides know."""
    same = lambda x, y: F.coalesce(x == y, F.lit(True))
    return F.coalesce((a["modified_ns"] == b["modified_ns"]) & same(a["changed_ns"], b["changed_ns"]) & same(a["identity"], b["identity"]), F.lit(False))


def chunk_array(content: Column, size: int) -> Column:
    """array<struct<chunk_index, offset, bytes>>; empty content has no chunk."""
    n = F.ceil(F.octet_length(content) / size).cast("int")
    one = lambda i: F.struct(i.alias("chunk_index"), (i.cast("long") * size).alias("offset"), F.substring(content, i * size + 1, F.lit(size)).alias("bytes"))
    empty = F.array().cast("array<struct<chunk_index:int,offset:bigint,bytes:binary>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(empty)
