"""Change events: plans, invalidation and incremental manifests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import ancestors, base_name, collapse_prefixes, covered_by

#: Event kinds; fixed values.
KINDS = ("Create", "Modify", "Remove", "RenameFrom", "RenameTo", "Directory", "Rescan")
FULL_RESCAN_REASONS = ("StructuralChange", "IncompletePreviousState", "PolicyChanged", "IgnoreInputChanged")
_CONTROL = (".git/config", ".git/info/exclude")


def relative_to(path: Column, root: str) -> Column:
    """Path below the root, or null if it is outside or climbs."""
    root = root.rstrip("/")
    inner = F.when(path == root, "").when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1_000_000)).when(~path.startswith("/"), path)
    clean = F.array_join(F.filter(F.split(inner, "/"), lambda p: (p != "") & (p != ".")), "/")
    return F.when(~F.coalesce(inner.rlike(r"(^|/)\.\.(/|$)"), F.lit(True)), clean)


def is_safe_relative(path: Column) -> Column:
    return (path != "") & ~path.rlike(r"^/|//|/$|(^|/)\.{1,2}(/|$)")


def marked(events: DataFrame, root: str, ignore_files: Iterable[str]) -> DataFrame:
    """Adds relative, rejected, full (asks for a full rescan) and action."""
    names = sorted({n.replace("\\", "/").rsplit("/", 1)[-1] for n in ignore_files})
    rel = F.col("relative")
    rescan = F.col("kind") == "Rescan"
    out = events.withColumn("relative", relative_to(F.col("path"), root))
    control = rel.isin(*_CONTROL) | base_name(rel).isin(names)
    full = rescan | (rel.isNotNull() & ((rel == "") | (F.col("kind") == "Directory") | control))
    action = F.when(F.col("kind").isin("Create", "Modify", "RenameTo"), "changed").when(F.col("kind").isin("Remove", "RenameFrom"), "removed")
    return out.withColumns({"rejected": ~rescan & rel.isNull(), "full": F.coalesce(full, F.lit(False)), "action": action})


def plan_paths(events: DataFrame, root: str, ignore_files: Iterable[str]) -> DataFrame:
    """(relative, action): the last event of each path decides."""
    m = marked(events, root, ignore_files).where(~F.col("rejected") & ~F.col("full"))
    return m.groupBy("relative").agg(F.max_by("action", "seq").alias("action"))


def plan_header(events: DataFrame, root: str, ignore_files: Iterable[str]) -> DataFrame:
    m = marked(events, root, ignore_files)
    return m.agg(F.coalesce(F.bool_or("full"), F.lit(False)).alias("full_rescan"), F.count_if("rejected").alias("rejected_events"))


def covered(rows: DataFrame, prefixes: DataFrame, keep_covered: bool) -> DataFrame:
    """Rows at or below (or not at or below) any of the prefixes, a table
    (relative) of any size: a semi or anti join on the row's own ancestors."""
    each = rows.select("relative").distinct().withColumn("__up", F.explode(F.concat(ancestors(F.col("relative")), F.array("relative"))))
    hit = each.join(prefixes.select(F.col("relative").alias("__prefix")), F.col("__up") == F.col("__prefix"), "left_semi").select("relative").distinct()
    return rows.join(hit, "relative", "left_semi" if keep_covered else "left_anti")


def expand_removed(known: DataFrame, removed: DataFrame) -> DataFrame:
    """Known paths at or below a removed one."""
    return covered(known.select("relative"), removed, True).distinct()


def expand_few(known: DataFrame, removed: Iterable[str]) -> DataFrame:
    """The same for a handful of prefixes on the driver: a filter, no join."""
    return known.where(covered_by(F.col("relative"), collapse_prefixes(removed))).select("relative").distinct()


def invalidate(cache: DataFrame, plan: DataFrame, full_rescan: bool = False) -> DataFrame:
    """The cache entries that stay."""
    return cache.limit(0) if full_rescan else covered(cache, plan.select("relative"), False)


def incremental(previous: DataFrame, plan: DataFrame, changed_now: DataFrame) -> DataFrame:
    """The manifest after a plan: what it doesn't cover, and what the changed
    paths are now (already selected and inspected)."""
    kept = covered(previous, plan.select("relative"), False)
    return kept.unionByName(changed_now.join(plan.where("action = 'changed'").select("relative"), "relative", "left_semi"))


def full_rescan_reason(plan_full: bool, complete: bool, termination: str | None, max_entries: int | None, descriptor_matches: bool, same_root: bool = True, safe_paths: bool = True, changed_directory: bool = False, sources_changed: bool = False) -> str | None:
    """Why a plan can't be applied incrementally; None if it can."""
    if plan_full:
        return "StructuralChange"
    if not complete or termination or max_entries is not None:
        return "IncompletePreviousState"
    if not descriptor_matches:
        return "PolicyChanged"
    if not same_root or not safe_paths or changed_directory:
        return "StructuralChange"
    return "IgnoreInputChanged" if sources_changed else None


#: Foreign notification kinds and what they mean here; fixed values.
NOTIFICATIONS = {"create-file": "Create", "create-folder": "Directory", "modify-data": "Modify", "modify-metadata": "Modify", "rename-from": "RenameFrom", "rename-to": "RenameTo", "remove-file": "Remove", "remove-folder": "Rescan", "any": "Rescan", "other": "Rescan"}


def from_notifications(events: DataFrame) -> DataFrame:
    """Watch events from (seq, notification, paths): accesses go, a rename of
    exactly two paths becomes a pair, whatever is unclear asks for a rescan."""
    table = F.create_map(*(F.lit(x) for kv in NOTIFICATIONS.items() for x in kv))
    kind = F.coalesce(table[F.col("notification")], F.lit("Rescan"))
    pair = F.array(F.struct(F.lit("RenameFrom").alias("kind"), F.get("paths", 0).alias("path")), F.struct(F.lit("RenameTo").alias("kind"), F.get("paths", 1).alias("path")))
    both = F.when((F.col("notification") == "rename-both") & (F.size("paths") == 2), pair)
    plain = F.transform(F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit(""))), lambda p: F.struct(kind.alias("kind"), p.alias("path")))
    out = events.where(~F.col("notification").startswith("access")).select("seq", F.posexplode(F.coalesce(both, plain)).alias("k", "e"))
    return out.select((F.col("seq") * 2 + F.least("k", F.lit(1))).alias("seq"), "e.kind", "e.path")
