"""Limits over a selection: bytes, entries, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.lineage import settled


def byte_budget(files: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """Adds `kept`: whether the row is in the longest prefix, by path, whose sizes
    add up to `limit` at most.  Paths and sizes alone are dealt to ranges, once; the
    ranges' sums, one number each, tell the range in which the budget ends, and a
    running sum over that range the last path that fits.  The rows themselves are
    only compared with it, so they don't move.  Rows of one path stand or fall
    together; a null size is 0."""
    n = parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = files.groupBy("relative").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    ranged = settled(sizes.repartitionByRange(n, "relative").withColumn("part", F.spark_partition_id()))
    spent, last, cut = 0, None, None
    for r in sorted(ranged.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max("relative").alias("last")).collect(), key=lambda r: r["part"]):
        if spent + r["bytes"] > limit:
            cut = r["part"]
            break
        spent, last = spent + r["bytes"], r["last"]
    if cut is None:
        return files.withColumn("kept", F.lit(True))
    here = ranged.where(F.col("part") == cut).withColumn("sum", F.sum("bytes").over(Window.partitionBy("part").orderBy("relative").rowsBetween(Window.unboundedPreceding, 0)))
    fits = here.where(F.col("sum") <= limit - spent).agg(F.max("relative")).first()[0]
    last = fits if fits is not None else last
    return files.withColumn("kept", F.lit(False) if last is None else F.col("relative") <= F.lit(last))


def over_budget(budgeted: DataFrame, limit: int) -> DataFrame:
    """Skip rows for what the budget leaves out."""
    return budgeted.where(~F.col("kept")).select("relative", F.lit("ScanLimit").alias("kind"), F.lit(f"maximum selected bytes: {limit}").alias("detail"))


def entry_limit(entries: DataFrame, limit: int) -> DataFrame:
    """The first entries by path; in path order so that reruns agree."""
    return entries.orderBy("relative").limit(limit)


def page(files: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page by path; empty past the end."""
    return files.orderBy("relative").offset(offset).limit(limit)


def termination(*reasons: str | None) -> str | None:
    """The first reason wins."""
    return next((r for r in reasons if r), None)
