"""Relations in the shape of a repository scan, derived from the test tables.

The same definitions exist as DuckDB SQL in `SQL`, for the oracles.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.content import sha256
from siltstone.plans.lineage import shared_folder

ROOT = "/work/tree"


def _prefix() -> F.Column:
    k = F.col("doc_id") % 11
    return F.when(k == 0, "target/").when(k == 1, "node_modules/").when(k == 2, ".hidden/").when(k == 3, "build/").when(k == 4, "src/lib/").otherwise("")


def _ext(shift: int = 0) -> F.Column:
    k = (F.col("doc_id") + shift) % 5
    return F.when(k == 0, "rs").when(k == 1, "go").when(k == 2, "ts").when(k == 3, "md").otherwise("tmp")


def relative() -> F.Column:
    return F.concat(_prefix(), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), _ext())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (files only) with their content: doc_id, relative, kind, bytes, content."""
    return documents(spark, sf_dir).select("doc_id", relative().alias("relative"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("bytes"), F.col("text").alias("content"), "source")


def _on_files(rows: DataFrame, root: str, do) -> None:
    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                do(os.path.join(root, r.relative), r)
        yield pd.DataFrame({"n": [0]})

    rows.mapInPandas(run, "n long").count()


def _written(path: str, row) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(row.content.encode("utf-8", "surrogatepass"))


def write_files(rows: DataFrame, root: str) -> None:
    """Rows (relative, content) as files below a folder that all share."""
    _on_files(rows.select("relative", "content"), root, _written)


def remove_files(rows: DataFrame, root: str) -> None:
    _on_files(rows.select("relative"), root, lambda path, row: os.remove(path))


@contextmanager
def on_disk(spark: SparkSession, rows: DataFrame) -> Iterator[str]:
    """A folder with the rows as files; it goes at the end."""
    base = urlparse(shared_folder(spark))
    if base.scheme not in ("", "file"):
        raise ValueError("trees on disk need a spark.checkpoint.dir that is a mounted folder")
    root = os.path.join(base.path, f"tree-{uuid.uuid4().hex}")
    os.makedirs(root)
    try:
        write_files(rows, root)
        yield root
    finally:
        shutil.rmtree(root, ignore_errors=True)


def version() -> F.Column:
    return F.struct((F.col("doc_id") * 1000).alias("modified_ns"), F.lit(None).cast("long").alias("changed_ns"), F.lit(None).cast("string").alias("identity")).alias("version")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a hashed file."""
    return tree(spark, sf_dir).select("doc_id", "relative", "bytes", sha256(F.col("content")).alias("content_hash"), version(), F.lit(True).alias("binary_checked"), "source")


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).where("doc_id % 10 != 0")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without some files, some changed, some under another path."""
    k = F.col("doc_id") % 10
    text = F.when(k == 2, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    path = F.when(k == 3, F.concat(F.lit("moved/"), relative())).otherwise(relative())
    docs = documents(spark, sf_dir).where("doc_id % 10 != 1").withColumn("text", text)
    return docs.select("doc_id", path.alias("relative"), F.octet_length("text").cast("long").alias("bytes"), sha256(F.col("text")).alias("content_hash"), version(), F.lit(True).alias("binary_checked"))


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, path, kind: events about the documents' files."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 997 == 3, "Directory").when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "view", "Modify").when(F.col("event_type") == "error", "Remove").when(F.col("event_type") == "click", "RenameFrom").otherwise("RenameTo")
    path = F.when(F.col("event_id") % 101 == 5, F.lit("/elsewhere/x")).when(F.col("event_id") % 103 == 7, F.concat(F.lit("a/../"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit(ROOT + "/src/u"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".rs")))
    return e.select(F.col("event_id").alias("seq"), "ts", path.alias("path"), kind.alias("kind"))


def removed_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories and files that a plan covers."""
    d = documents(spark, sf_dir)
    dirs = d.where("doc_id % 17 = 0").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx"))).alias("relative"))
    files = d.where("doc_id % 13 = 0").select(relative().alias("relative"))
    return dirs.unionByName(files).distinct()


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: the path of each page's address."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/?([^?#]*)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))


_REL = """(CASE doc_id % 11 WHEN 0 THEN 'target/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN '.hidden/' WHEN 3 THEN 'build/' WHEN 4 THEN 'src/lib/' ELSE '' END
  || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/doc_' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'rs' WHEN 1 THEN 'go' WHEN 2 THEN 'ts' WHEN 3 THEN 'md' ELSE 'tmp' END)"""

#: CTEs by name; each may use those before it.
SQL = {
    "m": f"m AS (SELECT doc_id, {_REL} AS relative, strlen(coalesce(text, '')) AS bytes, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, coalesce(text, '') AS content, coalesce(source, 'none') AS source FROM documents)",
    "n": "n AS (SELECT *, regexp_extract(relative, '[^/]*$') AS name FROM m)",
    "prev": "prev AS (SELECT relative, bytes, content_hash FROM m WHERE doc_id % 10 <> 0)",
    "cur": f"cur AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE '' END || {_REL} AS relative, strlen(t) AS bytes, 'sha256:' || sha256(t) AS content_hash FROM (SELECT *, coalesce(text, '') || CASE WHEN doc_id % 10 = 2 THEN chr(10) || 'changed' ELSE '' END AS t FROM documents) WHERE doc_id % 10 <> 1)",
    "ev": f"""ev AS (SELECT event_id AS seq, ts,
      CASE WHEN event_id % 101 = 5 THEN '/elsewhere/x' WHEN event_id % 103 = 7 THEN 'a/../' || user_id ELSE '{ROOT}/src/u' || user_id % 7 || '/f' || user_id || '.rs' END AS path,
      CASE WHEN event_id % 997 = 3 THEN 'Directory' WHEN event_type = 'signup' THEN 'Create' WHEN event_type = 'view' THEN 'Modify' WHEN event_type = 'error' THEN 'Remove' WHEN event_type = 'click' THEN 'RenameFrom' ELSE 'RenameTo' END AS kind FROM events)""",
    "pre": f"pre AS (SELECT DISTINCT relative FROM (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'xx') AS relative FROM documents WHERE doc_id % 17 = 0 UNION ALL SELECT {_REL} FROM documents WHERE doc_id % 13 = 0))",
    "u": "u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1) AS path FROM pages)",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
