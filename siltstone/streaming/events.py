"""Watch plans from streams.

Each micro-batch becomes a plan; paths carry over batches by their last event.
Events have no guaranteed order, so they are ordered by (ts, seq); one that comes
behind the watermark can't be placed and asks for a full rescan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import watch


def plan_stream(events: DataFrame, root: str, ignore_files: Iterable[str], store: str, checkpoint: str, on_plan: Callable[[DataFrame, bool, int], None] | None = None, lateness: str = "10 minutes") -> StreamingQuery:
    """Runs over a stream (seq, ts, path, kind) and writes under `store`: `paths`,
    the latest (relative, action, ts, seq) rows of each batch, and `headers`, one
    row a batch.  `on_plan(paths, full_rescan, batch)` is called for each batch."""
    names = list(ignore_files)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        newest = df.agg(F.max("ts")).first()[0]
        if newest is not None:
            try:
                horizon = spark.read.parquet(f"{store}/headers").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                horizon = None
            late = bool(df.where(F.col("ts") < F.lit(horizon) - F.expr(f"interval {lateness}")).head(1)) if horizon is not None else False
            ordered = df.withColumn("seq", F.struct("ts", "seq"))
            paths = watch.marked(ordered, root, names).where("not rejected and not full").groupBy("relative").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("last"))
            header = watch.plan_header(ordered, root, names).first()
            full = bool(header["full_rescan"]) or late
            # Overwriting a batch's own folder makes a repeated batch harmless.
            paths.select("relative", "action", "last.ts", "last.seq").write.mode("overwrite").parquet(f"{store}/paths/batch={number}")
            spark.createDataFrame([(full, late, int(header["rejected_events"]), newest)], "full_rescan boolean, late boolean, rejected_events long, newest timestamp").write.mode("overwrite").parquet(f"{store}/headers/batch={number}")
            if on_plan:
                on_plan(paths, full, number)
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combined(paths: DataFrame) -> DataFrame:
    """(relative, action) over all batches."""
    return paths.groupBy("relative").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"))


def windowed_activity(events: DataFrame, every: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows, with a watermark: an extension."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n"))
