"""A scan that is kept up to date: versioned tables, one folder a generation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import limits
from siltstone.operators.report import ScanReport
from siltstone.options import ScanOptions
from siltstone.scanner import Scanner


class StaleSnapshot(RuntimeError):
    """A page of a generation that is no longer the current one was asked for."""


@dataclass
class ScanSession:
    spark: SparkSession
    root: str
    store: str
    options: ScanOptions
    generation: int = 0
    report: ScanReport | None = None
    last_reason: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, store: str, options: ScanOptions | None = None) -> ScanSession:
        out = cls(spark, root, store, options or ScanOptions())
        out._install(Scanner(spark, root, out.options).scan(), None)
        out.options = replace(out.options, cancellation=None)
        return out

    def _install(self, report: ScanReport, reason: str | None) -> None:
        self.generation += 1
        at = f"{self.store}/gen={self.generation}"
        report.files.write.parquet(f"{at}/files")
        report.skipped.write.parquet(f"{at}/skipped")
        self.report = replace(report, files=self.spark.read.parquet(f"{at}/files"), skipped=self.spark.read.parquet(f"{at}/skipped"))
        self.last_reason = reason

    def rescan(self) -> ScanReport:
        self._install(Scanner(self.spark, self.root, self.options).scan(), None)
        return self.report

    def apply_watch_plan(self, plan: DataFrame, full: bool = False) -> str:
        report, reason = Scanner(self.spark, self.root, self.options).scan_watch_plan(self.report, plan, full)
        self._install(report, reason)
        return reason

    def files_page(self, generation: int, offset: int, limit: int) -> DataFrame:
        if generation != self.generation:
            raise StaleSnapshot(f"generation {generation} was replaced by {self.generation}")
        return limits.page(self.report.files, offset, limit)

    def files(self, page: int = 1000):
        """All files, page by page, pinned to the present generation."""
        pinned, at = self.generation, 0
        while rows := self.files_page(pinned, at, page).collect():
            yield from rows
            at += len(rows)
