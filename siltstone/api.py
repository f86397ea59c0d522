"""Plain entry points, with options as a dictionary, and reports as files."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import report
from siltstone.operators.report import ScanReport
from siltstone.operators.rules import SourceEvidence
from siltstone.options import ScanDescriptor, ScanOptions
from siltstone.scanner import Scanner
from siltstone.session import ScanSession


def scan_paths(spark: SparkSession, root: str, options: dict | None = None) -> list[str]:
    return [r["relative"] for r in Scanner(spark, root, ScanOptions.decode(options or {})).scan_paths().toLocalIterator()]


def scan_repository(spark: SparkSession, root: str, options: dict | None = None, cache: DataFrame | None = None) -> ScanReport:
    return Scanner(spark, root, ScanOptions.decode(options or {})).scan(cache)


def export_scan_cache(spark: SparkSession, root: str, to: str, options: dict | None = None) -> DataFrame:
    """Scans and leaves the reusable hashes as a table."""
    report.to_cache(scan_repository(spark, root, options).files).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def scan_diagnostics(spark: SparkSession, root: str, options: dict | None = None) -> dict:
    """The summary, its text, and why files were left out."""
    done = scan_repository(spark, root, options)
    row = done.summary()
    return {"summary": row, "text": report.summary_text(row), "warnings": done.sorted_warnings(), "descriptor": asdict(done.descriptor)}


def open_session(spark: SparkSession, root: str, store: str, options: dict | None = None) -> ScanSession:
    """A session whose generations stand in `store`, a folder that all share."""
    return ScanSession.open(spark, root, store, ScanOptions.decode(options or {}))


def save_report(done: ScanReport, to: str) -> None:
    """Tables as JSON lines, sorted; the header as one JSON row."""
    spark = done.files.sparkSession
    done.sorted_files().write.json(f"{to}/files")
    done.sorted_skipped().write.json(f"{to}/skipped")
    header = {"sources": [asdict(s) for s in done.sources], "warnings": done.sorted_warnings(), "descriptor": asdict(done.descriptor), "root": done.root, "complete": done.complete, "termination": done.termination, "portable": done.portable, "cache": done.cache}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{to}/header")


def load_report(spark: SparkSession, at: str) -> ScanReport:
    files = spark.read.schema("absolute string, relative string, bytes long, version struct<modified_ns:bigint,changed_ns:bigint,identity:string>, content_hash string, content_fingerprint string, binary_checked boolean").json(f"{at}/files")
    skipped = spark.read.schema("relative string, kind string, detail string").json(f"{at}/skipped")
    h = json.loads(spark.read.text(f"{at}/header").first()["value"])
    return ScanReport(files.withColumn("binary_checked", F.coalesce("binary_checked", F.lit(False))), skipped, tuple(SourceEvidence(**s) for s in h["sources"]), tuple(map(tuple, h["warnings"])), ScanDescriptor(**h["descriptor"]), h["root"], h["complete"], h["termination"], h["portable"], tuple(h["cache"]))
