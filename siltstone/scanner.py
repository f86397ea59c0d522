"""Scans of directory trees: listing, rules, selection, content, report."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.control import limited
from siltstone.operators import content as content_ops
from siltstone.operators import limits, report, select, watch
from siltstone.operators.report import ScanReport
from siltstone.options import STANDARD_DIRECTORIES, ScanOptions
from siltstone.plans.lineage import settled
from siltstone.sources import tree
from siltstone.sources.repository import known_rule_files, load_rules


class FullRescanRequired(RuntimeError):
    """A plan can't be followed path by path."""


class Scanner:
    def __init__(self, spark: SparkSession, root: str, options: ScanOptions | None = None):
        self.spark, self.root, self.options = spark, root, options or ScanOptions()

    def _listed(self) -> DataFrame:
        """Entries of the tree.  Standard directories aren't entered while no
        override could bring them back."""
        o = self.options
        prune = STANDARD_DIRECTORIES if o.standard_skips and not o.override_rules else ()
        return settled(tree.list_tree(self.spark, self.root, o.walk, prune, o.traversal_parallelism or o.parallelism or 8))

    def _classified(self):
        o, entries = self.options, self._listed()
        named = entries.where(F.col("kind").isin("file", "symlink") & F.col("name").isin(list(o.ignore_files))).select("relative").collect()
        paths = [r["relative"] for r in named]
        rules, portable, complete = load_rules(os.path.realpath(self.root), o, paths)
        # Rule files below skipped directories were never met.
        kept = {r["relative"] for r in select.classify(entries.where(F.col("name").isin(list(o.ignore_files))), o, rules).where("pruned_at is null").select("relative").collect()} if paths else set()
        if set(paths) - kept:
            rules, portable, complete = load_rules(os.path.realpath(self.root), o, sorted(kept))
        if o.override_rules:
            rules.evidence.extend(select._overrides(o).evidence)
        return select.classify(entries, o, rules), rules, portable, complete

    def scan_paths(self) -> DataFrame:
        """Sorted paths of what the policy selects; sizes and content aren't asked."""
        free = Scanner(self.spark, self.root, replace(self.options, max_file_bytes=2**62, max_total_bytes=None).metadata_only())
        out = select.selected(free._classified()[0]).select("relative")
        return out.orderBy("relative") if self.options.max_entries is None else limits.entry_limit(out, self.options.max_entries)

    def scan(self, cache: DataFrame | None = None) -> ScanReport:
        """The report.  One that a timeout or a token ended is incomplete and
        empty: partial results of tasks aren't kept."""
        o = self.options
        if o.timeout_seconds is None and o.cancellation is None:
            return self._scan(cache)
        done, ended = limited(self.spark, lambda: self._scan(cache), o.timeout_seconds, o.cancellation)
        if done is not None:
            return done
        files = self.spark.createDataFrame([], "absolute string, relative string, bytes long, version struct<modified_ns:bigint,changed_ns:bigint,identity:string>, content_hash string, content_fingerprint string, binary_checked boolean")
        skipped = self.spark.createDataFrame([], "relative string, kind string, detail string")
        return ScanReport(files, skipped, (), (), o.descriptor(), os.path.realpath(self.root), False, ended, True)

    def _scan(self, cache: DataFrame | None, read: Callable[[DataFrame], DataFrame] | None = None) -> ScanReport:
        o = self.options
        classified, rules, portable, complete = self._classified()
        ended = None
        if o.max_entries is not None:
            if classified.count() > o.max_entries:
                ended = "MaxEntries"
            classified = limits.entry_limit(classified, o.max_entries)
        errors = classified.where("error is not null")
        skips = [select.skipped(classified, o), errors.select("relative", F.lit("IoError").alias("kind"), F.col("error").alias("detail"))]
        warnings = [(r["relative"], r["error"]) for r in errors.select("relative", "error").collect()] + list(rules.errors)
        root = os.path.realpath(self.root)
        files = select.selected(classified).select(F.concat(F.lit(root + "/"), "relative").alias("absolute"), "relative", "bytes", "version")
        if o.max_total_bytes is not None:
            budget = settled(limits.byte_budget(files, o.max_total_bytes))
            over = limits.over_budget(budget, o.max_total_bytes)
            if over.head(1):
                ended = limits.termination(ended, "MaxTotalBytes")
                skips.append(over)
            files = budget.where("kept").drop("kept")
        stats = (0, 0, 0)
        if o.reads_content:
            files, bad, stats = self._inspected(files, cache, read(files) if read else None)
            skips.append(bad)
        else:
            files = files.withColumns({"content_hash": F.lit(None).cast("string"), "content_fingerprint": F.lit(None).cast("string"), "binary_checked": F.lit(False)})
        skipped = skips[0]
        for more in skips[1:]:
            skipped = skipped.unionByName(more)
        if o.selected_files_only:
            skipped = skipped.limit(0)
        return ScanReport(settled(files), settled(skipped), tuple(rules.sources()), tuple(warnings), o.descriptor(), root, complete and not warnings and ended is None, ended, portable, stats)

    def _inspected(self, files: DataFrame, cache: DataFrame | None, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
        """Files with their hashes, skips, and cache figures.  Under Fast validation a
        file that looks as the cache says isn't read; under Strict it is, and the
        cached hash stays if the fingerprint agrees.  `read`: contents, if they have
        been read already."""
        o = self.options
        files = settled(files)
        columns = ["absolute", "relative", "bytes", "version"]
        looked = files.withColumns({"reusable": F.lit(False), "cached_hash": F.lit(None).cast("string"), "cached_fingerprint": F.lit(None).cast("string")})
        if cache is not None:
            looked = settled(content_ops.with_cache(files, cache, replace(o, cache_validation="Fast")))
        fast = o.cache_validation == "Fast"
        asked = looked.where(~F.col("reusable")) if fast else looked
        if read is None:
            read = settled(self._contents(asked).drop("content"))
        done = read.select("relative", F.col("content_hash").alias("new_hash"), F.col("content_fingerprint").alias("new_fingerprint"), "binary", "content_status")
        joined = settled(asked.join(done, "relative"))
        fine = F.col("content_status") == "Complete"
        binary = F.col("binary") if o.detect_binary_files else F.lit(False)
        same = F.col("reusable") & F.coalesce(F.col("new_fingerprint") == F.col("cached_fingerprint"), F.lit(False))
        checked = F.lit(o.detect_binary_files).alias("binary_checked")
        good = joined.where(fine & ~binary).select(*columns, F.when(F.lit(o.hash_file_contents), F.when(same, F.col("cached_hash")).otherwise(F.col("new_hash"))).alias("content_hash"), F.col("new_fingerprint").alias("content_fingerprint"), checked)
        kind = F.when(~fine, F.when(F.col("content_status") == "IoError", "IoError").otherwise("ConcurrentModification")).otherwise("Binary")
        bad = joined.where(~fine | binary).select("relative", kind.alias("kind"), F.lit(None).cast("string").alias("detail"))
        n = joined.agg(F.count(F.lit(1)).alias("all"), F.count_if("reusable").alias("candidates"), F.count_if(same & fine).alias("same")).first()
        if fast:
            reuse = looked.where("reusable").select(*columns, F.col("cached_hash").alias("content_hash"), F.col("cached_fingerprint").alias("content_fingerprint"), checked)
            stats = (reuse.count() if cache is not None else 0, n["all"], 0)
            return (good.unionByName(reuse) if cache is not None else good), bad, stats
        # A candidate that turns out to differ is read twice by its account: to validate and to hash.
        return good, bad, (n["same"], n["all"] + n["candidates"] - n["same"], n["candidates"])

    def _contents(self, files: DataFrame) -> DataFrame:
        from siltstone.functions.content import fingerprint

        return tree.read_contents(files, self.options.max_file_bytes, self.options.content_validation == "Strict").withColumn("content_fingerprint", fingerprint(F.col("content")))

    def scan_compact(self) -> DataFrame:
        return report.compact(self.scan().files)

    def scan_into(self, sink: Callable[[dict], bool | None]) -> bool:
        """Hands each file over in path order; a sink that returns False stops it.
        Returns whether all were handed over."""
        for row in self.scan().sorted_files().toLocalIterator(prefetchPartitions=True):
            if sink(row.asDict()) is False:
                return False
        return True

    def _chosen(self, contents: DataFrame) -> DataFrame:
        """Whole files; binary ones only where they aren't told apart."""
        whole = contents.where("content_status = 'Complete'")
        return whole.where(~F.col("binary")) if self.options.detect_binary_files else whole

    def _chunks(self, files: DataFrame, chunk: int) -> DataFrame:
        return content_ops.chunks(self._chosen(self._contents(files)), "content", chunk)

    def visit_content(self, chunk: int = 65_536) -> DataFrame:
        """(relative, chunk_index, offset, bytes) of all selected files, each read
        once."""
        return self._chunks(self._undressed().files, chunk)

    def _undressed(self) -> ScanReport:
        """The report of selection alone, without contents."""
        return Scanner(self.spark, self.root, self.options.metadata_only())._scan(None)

    def visit_content_manifest(self, chunk: int = 65_536) -> tuple[DataFrame, ScanReport]:
        """The same, with the report of the scan; both rest on one read, which is
        kept in the shared folder."""
        kept: list[DataFrame] = []

        def read(files: DataFrame) -> DataFrame:
            kept.append(settled(self._contents(files)))
            return kept[0]

        o = self.options if self.options.reads_content else replace(self.options, hash_file_contents=True)
        done = Scanner(self.spark, self.root, o)._scan(None, read)
        return content_ops.chunks(self._chosen(kept[0]).join(done.files.select("relative"), "relative", "left_semi"), "content", chunk), done

    def visit_files(self, visitor: Callable[[], Callable[[str, dict], str | None]], chunk: int = 65_536) -> tuple[DataFrame, dict]:
        """Hands the contents of all selected files to visitors, one a partition,
        made on the executors.  A visitor is called with FileStart, Chunk and FileEnd
        and a dictionary (relative, bytes; offset, chunk; status, bytes_read,
        content_hash, consumer_skipped) and may answer SkipFile, which ends a file, or
        Quit, which ends its partition after that file's FileEnd.  Returns a row a
        file and the counters.  A task may run twice, so a visitor should commit a
        file on FileEnd."""
        files = self._undressed().files
        schema = "relative string, status string, opened boolean, chunks long, bytes_read long, bytes_emitted long, consumer_skipped boolean, content_hash string, quit boolean"
        done = settled(content_ops.visited(self._contents(files), visitor, chunk, self.options.detect_binary_files, schema))
        sums = done.agg(F.count_if(F.col("status") == "Selected").alias("completed"), F.count_if("opened").alias("opened"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "bytes_read", "bytes_emitted")), F.count_if("consumer_skipped").alias("consumer_skipped"), F.coalesce(F.bool_or("quit"), F.lit(False)).alias("stopped")).first()
        return done.drop("quit"), {"discovered": files.count(), **sums.asDict()}

    def _touched(self, paths: DataFrame, rule_files: Iterable[str] | None) -> tuple[DataFrame, object]:
        """Entries for some paths (relative) only, classified; nothing else is
        listed.  `rule_files`: paths below the root of known rule files; if None, the
        tree is searched for them."""
        o = self.options
        if rule_files is None:
            classified, rules, _, _ = self._classified()
            return classified.join(paths.select("relative"), "relative", "left_semi"), rules
        rules, _, _ = load_rules(os.path.realpath(self.root), o, rule_files)
        if o.override_rules:
            rules.evidence.extend(select._overrides(o).evidence)
        entries = settled(tree.stat_paths(self.spark, self.root, paths.select("relative").distinct(), o.walk))
        return select.classify(entries, o, rules), rules

    def visit_changed(self, plan: DataFrame, full_rescan: bool = False, chunk: int = 65_536) -> tuple[DataFrame, list[str]]:
        """Chunks of the paths that a plan (relative, action) says have changed,
        and the removed paths in order.  Only these paths are read."""
        if full_rescan or plan.where(~watch.is_safe_relative(F.col("relative"))).head(1):
            raise FullRescanRequired(self.root)
        entries, _ = self._touched(plan.where("action = 'changed'"), None)
        if entries.where("kind = 'dir'").head(1):
            raise FullRescanRequired(self.root)
        root = os.path.realpath(self.root)
        files = select.selected(entries).select(F.concat(F.lit(root + "/"), "relative").alias("absolute"), "relative", "bytes")
        removed = [r["relative"] for r in plan.where("action = 'removed'").select("relative").distinct().orderBy("relative").toLocalIterator()]
        return self._chunks(files, chunk), removed

    def scan_watch_plan(self, previous: ScanReport, plan: DataFrame, full: bool = False) -> tuple[ScanReport, str]:
        """The report after a plan, and Incremental or the reason for a full scan.
        An incremental one looks at the plan's paths and at the known rule files,
        and lists no folder."""
        o = self.options
        safe = plan.where(~watch.is_safe_relative(F.col("relative"))).head(1) == []
        root = os.path.realpath(self.root)
        same = root == previous.root
        reason = watch.full_rescan_reason(full, previous.complete, previous.termination, o.max_entries, previous.descriptor.matches(o), same, safe)
        if reason is None:
            touched = plan.where("action = 'changed'")
            entries, rules = self._touched(touched, known_rule_files(root, o, previous.sources))
            dirs = bool(entries.where("kind = 'dir'").head(1))
            # A rule file that comes or goes is named by the plan.
            control = bool(plan.where(F.element_at(F.split("relative", "/"), -1).isin(list(o.ignore_files))).head(1))
            reason = watch.full_rescan_reason(False, True, None, None, True, changed_directory=dirs, sources_changed=control or tuple(rules.sources()) != previous.sources)
        if reason is not None:
            return self.scan(report.to_cache(previous.files) if same else None), reason
        files = select.selected(entries).select(F.concat(F.lit(root + "/"), "relative").alias("absolute"), "relative", "bytes", "version")
        stats = (0, 0, 0)
        if o.reads_content:
            good, bad, stats = self._inspected(files, None)
        else:
            good, bad = files.withColumns({"content_hash": F.lit(None).cast("string"), "content_fingerprint": F.lit(None).cast("string"), "binary_checked": F.lit(False)}), previous.skipped.limit(0)
        kept = watch.covered(previous.files, plan.select("relative"), False)
        skips = watch.covered(previous.skipped, plan.select("relative"), False).unionByName(select.skipped(entries, o)).unionByName(bad)
        return replace(previous, files=settled(kept.unionByName(good)), skipped=settled(skips), cache=stats), "Incremental"


def scan_repository(spark: SparkSession, root: str, options: ScanOptions | None = None) -> ScanReport:
    return Scanner(spark, root, options).scan()


def scan_many(spark: SparkSession, roots: Iterable[str], options: ScanOptions | None = None) -> list[ScanReport]:
    """Reports of several roots, in the order given; the first error is raised."""
    return [scan_repository(spark, r, options) for r in roots]


def combined(reports: Iterable[ScanReport]) -> DataFrame:
    """The files of several reports as one table, in order of root and path."""
    each = [r.files.withColumn("root_index", F.lit(i)).withColumn("root", F.lit(r.root)) for i, r in enumerate(reports)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.orderBy("root_index", "relative")


def visit_many(spark: SparkSession, roots: Iterable[str], options: ScanOptions | None = None, chunk: int = 65_536) -> DataFrame:
    """Chunks of all roots, with root_index."""
    each = [Scanner(spark, r, options).visit_content(chunk).withColumn("root_index", F.lit(i)) for i, r in enumerate(roots)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def totals(reports: Iterable[ScanReport]) -> dict:
    """Files and bytes over several reports, and whether all are complete."""
    rows = [(r, r.summary()) for r in reports]
    return {"files": sum(s["selected_files"] for _, s in rows), "bytes": min(sum(s["selected_bytes"] for _, s in rows), 2**63 - 1), "complete": all(r.complete for r, _ in rows), "cancelled": any(r.termination == "Cancelled" for r, _ in rows)}
