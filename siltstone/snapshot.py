"""Contents of a finished scan, read later and held to what the report says."""

from __future__ import annotations

import hashlib
import os
import stat
from dataclasses import dataclass

from pyspark.sql import functions as F

from siltstone.operators.report import ScanReport
from siltstone.operators.watch import is_safe_relative


class SnapshotError(RuntimeError):
    """`kind`: UnknownFile, Stale, LimitExceeded, Io or InvalidReport."""

    def __init__(self, kind: str, about: str):
        super().__init__(f"{kind}: {about}")
        self.kind = kind


@dataclass(frozen=True)
class SnapshotContent:
    data: bytes
    evidence: str  # Sha256, or FileVersion where the report has no hash


def _version(info: os.stat_result) -> tuple:
    return info.st_size, info.st_mtime_ns, info.st_ctime_ns, f"{info.st_dev}:{info.st_ino}"


class SnapshotReader:
    """Reads files of a report by path, on the driver.  A file that became a link,
    leads out of the root, or isn't what was scanned is Stale."""

    def __init__(self, report: ScanReport):
        self.report = report
        odd = ~is_safe_relative(F.col("relative")) | (F.col("absolute") != F.concat(F.lit(report.root.rstrip("/") + "/"), "relative")) | (F.col("content_hash").isNull() & F.col("version").isNull())
        if found := report.files.where(odd).head(1):
            raise SnapshotError("InvalidReport", str(found[0]["relative"]))
        if found := report.files.groupBy("relative").count().where("count > 1").head(1):
            raise SnapshotError("InvalidReport", str(found[0]["relative"]))

    def read(self, relative: str, max_bytes: int | None = None) -> SnapshotContent:
        row = self.report.files.where(F.col("relative") == relative).first()
        if row is None:
            raise SnapshotError("UnknownFile", relative)
        if max_bytes is not None and row["bytes"] > max_bytes:
            raise SnapshotError("LimitExceeded", f"{relative} has {row['bytes']} bytes")
        try:
            linked = stat.S_ISLNK(os.lstat(row["absolute"]).st_mode)
            real = os.path.realpath(row["absolute"])
            if linked or not real.startswith(os.path.realpath(self.report.root).rstrip("/") + "/"):
                raise SnapshotError("Stale", relative)
            with open(real, "rb") as f:
                before = os.fstat(f.fileno())
                if not stat.S_ISREG(before.st_mode) or before.st_size != row["bytes"]:
                    raise SnapshotError("Stale", relative)
                data = f.read(row["bytes"] + 1)
                after = os.fstat(f.fileno())
        except OSError as e:
            raise SnapshotError("Io", f"{relative}: {e.strerror}") from e
        if len(data) != row["bytes"] or _version(before) != _version(after):
            raise SnapshotError("Stale", relative)
        if row["content_hash"] is not None:
            if row["content_hash"] != "sha256:" + hashlib.sha256(data).hexdigest():
                raise SnapshotError("Stale", relative)
            return SnapshotContent(data, "Sha256")
        known = row["version"]
        if known["modified_ns"] != before.st_mtime_ns or known["identity"] not in (None, f"{before.st_dev}:{before.st_ino}"):
            raise SnapshotError("Stale", relative)
        return SnapshotContent(data, "FileVersion")
