"""Reports: order, revision, summary, portable and compact forms, caches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.content import le64_hex
from siltstone.operators.rules import SOURCES, SourceEvidence
from siltstone.operators.select import SKIP_KINDS, sort_skipped
from siltstone.options import ScanDescriptor

#: Terminations and their codes in a revision; fixed values.
TERMINATIONS = ("MaxEntries", "MaxTotalBytes", "Timeout", "Cancelled")


def revision_prefix(sources: Iterable[SourceEvidence] = ()) -> bytes:
    out = b"scan-revision\x01"
    for s in sources:
        out += bytes([SOURCES.index(s.kind) + 1]) + b"\0" + s.location.encode() + b"\0" + s.content_hash.encode() + b"\xfe"
    return out


def revision_suffix(portable: bool, termination: str | None) -> bytes:
    return bytes([portable]) + (bytes([TERMINATIONS.index(termination) + 1]) if termination else b"")


def _record(relative: Column, size: Column, content_hash: Column) -> Column:
    text = lambda c: F.hex(F.encode(c, "UTF-8"))
    return F.concat(text(relative), F.lit("00"), le64_hex(size), F.lit("00"), text(F.coalesce(content_hash, F.lit(""))), F.lit("FF"))


def revision(files: DataFrame, sources: Iterable[SourceEvidence] = (), portable: bool = True, termination: str | None = None) -> DataFrame:
    """One row: the SHA-256 over the files in path order.  The digest is defined
    over one sequence; up to some millions of files it is one expression.  See
    `revision_streamed` beyond."""
    record = F.struct("relative", _record(F.col("relative"), F.col("bytes"), F.col("content_hash")).alias("rec"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["rec"]), "")
    hexed = F.concat(F.lit(revision_prefix(sources).hex().upper()), body, F.lit(revision_suffix(portable, termination).hex().upper()))
    return files.agg(F.concat(F.lit("sha256:"), F.sha2(F.unhex(hexed), 256)).alias("revision"))


def revision_streamed(files: DataFrame, sources: Iterable[SourceEvidence] = (), portable: bool = True, termination: str | None = None) -> str:
    """The same digest for any number of files: sorted in parallel, read back a
    partition at a time, so memory is bounded by one partition."""
    digest = hashlib.sha256(revision_prefix(sources))
    rows = files.select("relative", "bytes", "content_hash").orderBy("relative")
    for r in rows.toLocalIterator(prefetchPartitions=True):
        digest.update(r["relative"].encode() + b"\0" + r["bytes"].to_bytes(8, "little") + b"\0" + (r["content_hash"] or "").encode() + b"\xff")
    digest.update(revision_suffix(portable, termination))
    return "sha256:" + digest.hexdigest()


#: Files of a leaf group of `revision_tree`, about.
TREE_LEAVES = 4096


def revision_tree(files: DataFrame) -> DataFrame:
    """Another digest for very large manifests, not comparable with `revision`: files
    are dealt to groups by the hashes of their paths, a group's digest is over its
    files' digests in order, and the last one over those of the groups.  A group has
    TREE_LEAVES files or so however many there are of one folder."""
    groups = max(1, -(-files.count() // TREE_LEAVES))
    text = lambda c: F.encode(c, "UTF-8")
    leaf = F.sha2(F.concat(text(F.col("relative")), F.lit(b"\0"), text(F.col("bytes").cast("string")), F.lit(b"\0"), text(F.coalesce("content_hash", F.lit("")))), 256)
    group = F.pmod(F.conv(F.substring(F.sha2("relative", 256), 1, 8), 16, 10).cast("long"), F.lit(groups))
    per = files.select(group.alias("group"), leaf.alias("leaf")).groupBy("group").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("group", "digest"))), lambda x: x["digest"])
    return per.agg(F.concat(F.lit("tree:"), F.sha2(F.array_join(ordered, "\n"), 256)).alias("revision"))


def summary(files: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row of counts; sums of sizes saturate at the largest long."""
    total = F.coalesce(F.sum(F.col("bytes").cast("decimal(38,0)")), F.lit(0))
    out = files.agg(
        F.count(F.lit(1)).alias("selected_files"),
        F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("selected_bytes"),
        F.count("content_hash").alias("hashed_files"),
        F.count_if("binary_checked").alias("binary_checked_files"),
    )
    return out.crossJoin(skip_summary(skipped)) if skipped is not None else out


def skip_summary(skipped: DataFrame) -> DataFrame:
    """One row: recorded_skips and skipped_by_kind.  (Joining two one-row results
    is the only cross join here.)"""
    per = skipped.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("recorded_skips"), F.map_from_entries(ordered).alias("skipped_by_kind"))


def skip_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def summary_text(row: dict) -> str:
    """A summary row as one line."""
    word = lambda b: "true" if b else "false"
    out = f"files={row['selected_files']} bytes={row['selected_bytes']} hashed={row['hashed_files']} binary_checked={row['binary_checked_files']} skipped={row['recorded_skips']} warnings={row.get('warnings', 0)} ignore_sources={row.get('ignore_sources', 0)} complete={word(row.get('complete', True))} portable={word(row.get('portable', True))}"
    if row.get("termination"):
        out += f" termination={row['termination']}"
    if any(cache := [row.get(k, 0) for k in ("reused_hashes", "content_reads", "fingerprint_reads")]):
        out += " cache_reused_hashes={} cache_content_reads={} cache_fingerprint_reads={}".format(*cache)
    return out


def duplicates(files: DataFrame) -> DataFrame:
    """How often each content occurs."""
    return files.where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


def portable_files(files: DataFrame) -> DataFrame:
    return files.select("relative", "bytes", "content_hash", "binary_checked")


def _hash_text(text: Column) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def portable_skips(skipped: DataFrame) -> DataFrame:
    return skipped.select("relative", "kind", _hash_text(F.col("detail")).alias("detail_hash"))


def portable_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.select("relative", _hash_text(F.col("message")).alias("message_hash"))


def portable_sources(sources: DataFrame) -> DataFrame:
    """Locations stay if they are relative or in angle brackets; absolute ones and
    those with . or .. become null."""
    at = F.col("location")
    marked = at.startswith("<") & at.endswith(">")
    absolute = at.rlike(r"^[/\\]") | at.rlike("^[A-Za-z]:")
    odd = at.rlike(r"(^|/)\.\.(/|$)") | at.rlike(r"^\.(/|$)")
    return sources.select("kind", F.when(marked, at).when(absolute | odd, None).otherwise(F.replace(at, F.lit("\\"), F.lit("/"))).alias("repository_relative"), "content_hash").distinct()


def portable_revision(files: DataFrame, sources: Iterable[SourceEvidence], portable: bool = True, termination: str | None = None) -> DataFrame:
    def shown(location: str) -> str:
        if location.startswith("<") and location.endswith(">"):
            return location
        parts = location.split("/")
        outside = location[:1] in ("/", "\\") or location[1:2] == ":" or ".." in parts or parts[0] == "."
        return "<external>" if outside else location.replace("\\", "/")

    safe = sorted({SourceEvidence(s.kind, shown(s.location), s.content_hash) for s in sources}, key=lambda s: (SOURCES.index(s.kind), s.location != "<external>", s.location, s.content_hash))
    return revision(files, safe, portable, termination)


def to_cache(files: DataFrame) -> DataFrame:
    """Rows whose hash may be used again."""
    return files.where(F.col("content_hash").startswith("sha256:") & F.col("content_fingerprint").isNotNull()).select("relative", "bytes", "content_hash", "content_fingerprint", "version", "binary_checked")


def compact(files: DataFrame) -> DataFrame:
    """No absolute path; evidence of content nested and null where there is none."""
    evidence = F.struct("content_hash", "binary_checked")
    return files.select("relative", "bytes", F.when(F.col("content_hash").isNotNull() | F.col("binary_checked"), evidence).alias("content"))


def expand(compacted: DataFrame, root: str) -> DataFrame:
    return compacted.select(F.concat(F.lit(root.rstrip("/") + "/"), "relative").alias("absolute"), "relative", "bytes", "content.content_hash", F.coalesce("content.binary_checked", F.lit(False)).alias("binary_checked"))


@dataclass
class ScanReport:
    """A finished scan: four tables and a header."""

    files: DataFrame
    skipped: DataFrame
    sources: tuple[SourceEvidence, ...]
    warnings: tuple[tuple[str | None, str], ...]
    descriptor: ScanDescriptor
    root: str = ""
    complete: bool = True
    termination: str | None = None
    portable: bool = True
    #: reused_hashes, content_reads, fingerprint_reads.
    cache: tuple[int, int, int] = (0, 0, 0)

    def revision(self) -> str:
        return revision_streamed(self.files, self.sources, self.portable, self.termination)

    def summary(self) -> dict:
        row = summary(self.files, self.skipped).first().asDict()
        order = {k: i for i, k in enumerate(SKIP_KINDS)}
        row["skipped_by_kind"] = dict(sorted((row["skipped_by_kind"] or {}).items(), key=lambda x: order[x[0]]))
        return row | {"warnings": len(self.warnings), "ignore_sources": len(self.sources), "complete": self.complete, "termination": self.termination, "portable": self.portable} | dict(zip(("reused_hashes", "content_reads", "fingerprint_reads"), self.cache, strict=True))

    def sorted_files(self) -> DataFrame:
        return self.files.orderBy("relative")

    def sorted_skipped(self) -> DataFrame:
        return sort_skipped(self.skipped)

    def sorted_warnings(self) -> list[tuple[str | None, str]]:
        return sorted(self.warnings, key=lambda w: (w[0] is not None, w[0] or "", w[1]))
