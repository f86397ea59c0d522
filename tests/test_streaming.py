from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators import watch
from siltstone.streaming import events as stream

SCHEMA = "seq long, ts timestamp, path string, kind string"
T0 = datetime(2024, 1, 1)


def rows(n):
    kinds = ["Create", "Modify", "Remove", "RenameTo", "RenameFrom"]
    return [(i, T0 + timedelta(seconds=i), f"/r/src/f{i % 13}.rs", kinds[(i * 7) % 5]) for i in range(n)]


def run(spark, tmp_path, batches):
    src = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = stream.plan_stream(spark.readStream.schema(SCHEMA).parquet(src), "/r", [".gitignore"], str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out/paths")), spark.read.parquet(str(tmp_path / "out/headers"))


def test_stream_equals_batch(spark, tmp_path):
    data = rows(200)
    paths, headers = run(spark, tmp_path, [data[:90], data[90:]])
    want = watch.plan_paths(spark.createDataFrame(data, SCHEMA), "/r", [".gitignore"])
    assert sorted(map(tuple, stream.combined(paths).collect())) == sorted(map(tuple, want.collect()))
    assert headers.count() == 2 and not headers.agg(F.max(F.col("late").cast("int"))).first()[0]


def test_late_events_ask_for_a_rescan(spark, tmp_path):
    late = [(999, T0 - timedelta(hours=2), "/r/src/f1.rs", "Modify")]
    _, headers = run(spark, tmp_path, [rows(50), late])
    assert [r["full_rescan"] for r in headers.orderBy("batch").collect()] == [False, True]
