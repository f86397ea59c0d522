"""Comparison of two manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.content import version_equal


def same_content(a: Column, b: Column) -> Column:
    """Equal sizes, and equal hashes where both have one, else equal versions."""
    hashed = a["content_hash"].isNotNull() & b["content_hash"].isNotNull()
    return (a["bytes"] == b["bytes"]) & F.when(hashed, a["content_hash"] == b["content_hash"]).otherwise(version_equal(a["version"], b["version"]))


def _side(files: DataFrame, name: str) -> DataFrame:
    cols = {c: F.col(c) for c in ("bytes", "content_hash", "version") if c in files.columns}
    cols.setdefault("version", F.lit(None).cast("struct<modified_ns:bigint,changed_ns:bigint,identity:string>"))
    return files.select("relative", F.struct(*(v.alias(k) for k, v in cols.items())).alias(name))


def statuses(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(relative, status, prev, cur): unchanged, modified, removed or added."""
    joined = _side(previous, "prev").join(_side(current, "cur"), "relative", "full_outer")
    status = F.when(F.col("cur").isNull(), "removed").when(F.col("prev").isNull(), "added").when(same_content(F.col("prev"), F.col("cur")), "unchanged").otherwise("modified")
    return joined.select("relative", status.alias("status"), "prev", "cur")


def renames(previous: DataFrame, current: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """(from, to, content_hash) where content that each whole manifest holds once
    left one path and came to another."""
    compared = compared if compared is not None else statuses(previous, current)
    once = lambda df: df.where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("content_hash")
    gone = compared.where("status = 'removed'").select(F.col("relative").alias("from"), F.col("prev.content_hash").alias("content_hash"))
    came = compared.where("status = 'added'").select(F.col("relative").alias("to"), F.col("cur.content_hash").alias("content_hash"))
    return gone.join(once(previous), "content_hash", "left_semi").join(came.join(once(current), "content_hash", "left_semi"), "content_hash").select("from", "to", "content_hash")


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(status, relative, renamed_from): every path once; a rename is one row."""
    compared = statuses(previous, current)
    moved = renames(previous, current, compared)
    plain = compared.join(moved.select(F.col("from").alias("relative")), "relative", "left_anti").join(moved.select(F.col("to").alias("relative")), "relative", "left_anti")
    return plain.select("status", "relative", F.lit(None).cast("string").alias("renamed_from")).unionByName(moved.select(F.lit("renamed").alias("status"), F.col("to").alias("relative"), F.col("from").alias("renamed_from")))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def quality(previous: DataFrame, current: DataFrame, complete: bool = True) -> DataFrame:
    """One row: Partial, Metadata or ContentHash."""
    bare = previous.select("content_hash").unionByName(current.select("content_hash")).agg(F.coalesce(F.bool_or(F.col("content_hash").isNull()), F.lit(False)).alias("bare"))
    return bare.select(F.when(F.lit(not complete), "Partial").when(F.col("bare"), "Metadata").otherwise("ContentHash").alias("quality"))


def flags(previous, current) -> dict[str, bool]:
    """What differs between the headers of two reports."""
    return {
        "selection_inputs_changed": tuple(previous.sources) != tuple(current.sources),
        "policy_changed": previous.descriptor != current.descriptor,
        "scan_state_changed": (previous.complete, previous.termination, previous.portable) != (current.complete, current.termination, current.portable),
    }


def is_empty(rows: DataFrame, header: dict[str, bool]) -> bool:
    return not any(header.values()) and not rows.where("status != 'unchanged'").head(1)
