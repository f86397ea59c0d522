"""Selection: what becomes of every entry of a tree, and why.

`classify` adds to entries (relative, kind, depth, bytes, ...) the columns
`match`, `disposition` (Selected, Traverse, Skipped, Unselected), `skip_kind` and
`detail`, and `pruned_at`, the shallowest skipped directory above.  Since a rule
file applies only below its own directory, each directory's fate depends on its
path alone, so one pass over the rows is exact: no iteration, join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import ancestors, base_name, depth, extension
from siltstone.operators.rules import RuleSet, ancestor_match, decide_override, repository_match
from siltstone.options import STANDARD_DIRECTORIES, ScanOptions

#: Skip kinds in their order for sorting; fixed values.
SKIP_KINDS = ("Binary", "FileSystemBoundary", "Extension", "Ignored", "IoError", "MaxDepth", "Oversized", "PathEscape", "StandardDirectory", "Hidden", "Override", "Symlink", "SymlinkLoop", "ScanLimit", "ConcurrentModification")


def skip_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SKIP_KINDS)), kind)


def match_column(path: Column, is_dir: Column, options: ScanOptions, rules: RuleSet, overrides: RuleSet) -> Column:
    return repository_match(rules, overrides, options.skip_hidden, path, base_name(path), is_dir, options.dialect)


def _match_skip(match: Column) -> Column:
    return F.when(match == "Ignore", "Ignored").when(match == "OverrideIgnore", "Override").when(match == "Hidden", "Hidden")


def accepts(path: Column, options: ScanOptions) -> Column:
    """Named types decide; where none does, extensions do, and without either all
    files pass."""
    name, types = base_name(path), options.file_types
    listed = F.coalesce(extension(name).isin(list(options.extensions)), F.lit(False)) if options.extensions else F.lit(not types.has_includes)
    if not types.is_active:
        return listed if options.extensions else F.lit(True)
    hit = types.matched(path, name)
    return F.when(hit == "Include", True).when(hit == "Exclude", False).otherwise(listed)


def directory_skip(path: Column, options: ScanOptions, rules: RuleSet, overrides: RuleSet) -> Column:
    """Skip kind of a directory, or null if it is entered."""
    match = match_column(path, F.lit(True), options, rules, overrides)
    standard = F.when((match != "OverrideInclude") & base_name(path).isin(*STANDARD_DIRECTORIES), "StandardDirectory") if options.standard_skips else F.lit(None).cast("string")
    return F.coalesce(_match_skip(match), standard)


def classify(entries: DataFrame, options: ScanOptions, rules: RuleSet | None = None, overrides: RuleSet | None = None) -> DataFrame:
    rules, overrides = rules or RuleSet(), overrides or _overrides(options)
    rules = RuleSet([r for r in rules.rules if options.ignore_policy.allows(r.source)], rules.evidence, rules.errors, rules.prefix)
    path, walk = F.col("relative"), options.walk
    is_dir = F.col("kind") == "dir"
    above = ancestors(path)
    pruned = F.get(F.filter(above, lambda d: directory_skip(d, options, rules, overrides).isNotNull()), 0)
    cut = F.get(above, walk.max_depth - 1) if walk.max_depth else F.lit(None).cast("string")
    out = entries
    if "depth" not in out.columns:
        out = out.withColumn("depth", depth(path))
    if "walk_skip" not in out.columns:
        out = out.withColumn("walk_skip", F.lit(None).cast("string"))
    out = out.withColumn("pruned_at", F.coalesce(pruned, cut)).withColumn("match", match_column(path, is_dir, options, rules, overrides))
    match = F.col("match")
    linked = (F.col("kind") == "symlink") & F.lit(not walk.follow_links)
    too_deep = F.when(is_dir & (F.col("depth") >= walk.max_depth), "MaxDepth") if walk.max_depth is not None else F.lit(None).cast("string")
    file_skip = F.coalesce(
        _match_skip(match),
        F.when((match != "OverrideInclude") & ~accepts(path, options), "Extension"),
        F.when(F.col("bytes") > options.max_file_bytes, "Oversized"),
    )
    skip = (
        F.when(F.col("pruned_at").isNotNull(), None)
        .when((F.col("depth") < walk.effective_min_depth) & ~is_dir, None)
        .when(linked, "Symlink")
        .when(F.coalesce(F.col("walk_skip"), too_deep).isNotNull(), F.coalesce(F.col("walk_skip"), too_deep))
        .when(is_dir, directory_skip(path, options, rules, overrides))
        .when(F.col("kind") == "file", file_skip)
    )
    out = out.withColumn("skip_kind", skip)
    unseen = F.col("pruned_at").isNotNull() | ((F.col("depth") < walk.effective_min_depth) & ~is_dir) | ~F.col("kind").isin("file", "dir", "symlink")
    fate = F.when(unseen, "Unselected").when(F.col("skip_kind").isNotNull(), "Skipped").when(is_dir, "Traverse").when(F.col("kind") == "file", "Selected").otherwise("Unselected")
    detail = F.when(F.col("skip_kind") == "Oversized", F.concat(F.col("bytes").cast("string"), F.lit(" bytes")))
    return out.withColumn("disposition", fate).withColumn("detail", detail)


def _overrides(options: ScanOptions) -> RuleSet:
    out = RuleSet()
    if options.override_rules:
        out.add("\n".join(options.override_rules), "Override", "<overrides>", case_insensitive=options.ignore_case_insensitive)
    return out


def selected(classified: DataFrame) -> DataFrame:
    return classified.where("disposition = 'Selected'")


def skipped(classified: DataFrame, options: ScanOptions, rules: RuleSet | None = None, implied_dirs: bool = False) -> DataFrame:
    """(relative, kind, detail) of everything left out: skipped entries, and, for
    tables that list files only, the directories that their paths imply."""
    out = classified.where("disposition = 'Skipped'").select("relative", F.col("skip_kind").alias("kind"), "detail")
    if implied_dirs:
        dirs = classified.where("pruned_at is not null").select(F.col("pruned_at").alias("relative")).distinct()
        kind = directory_skip(F.col("relative"), options, rules or RuleSet(), _overrides(options))
        if options.walk.max_depth is not None:
            kind = F.coalesce(kind, F.lit("MaxDepth"))
        out = out.unionByName(dirs.select("relative", kind.alias("kind"), F.lit(None).cast("string").alias("detail")))
    return out


def sort_skipped(rows: DataFrame) -> DataFrame:
    return rows.orderBy("relative", skip_order(F.col("kind")), F.col("detail").asc_nulls_first())


class SelectionMatcher:
    """The whole policy for single paths, ancestors included: a path below a
    skipped directory is skipped for that directory's reason."""

    def __init__(self, options: ScanOptions, rules: RuleSet | None = None):
        self.options, self.rules, self.overrides = options, rules or RuleSet(), _overrides(options)

    def matched(self, paths: DataFrame) -> DataFrame:
        """Adds `decision` (SelectedFile, TraverseDirectory, Unselected, or the
        skip kind) to rows (relative, kind, bytes)."""
        rows = classify(paths, self.options, self.rules, self.overrides)
        up = directory_skip(F.col("pruned_at"), self.options, self.rules, self.overrides)
        plain = F.when(F.col("disposition") == "Selected", "SelectedFile").when(F.col("disposition") == "Traverse", "TraverseDirectory").otherwise("Unselected")
        decision = F.when(F.col("pruned_at").isNotNull(), F.coalesce(up, F.lit("MaxDepth"))).otherwise(F.coalesce("skip_kind", plain))
        return rows.withColumn("decision", decision)

    def ignored(self, paths: DataFrame) -> DataFrame:
        """Adds `action`, what the rules alone say, ancestors included."""
        path, is_dir = self.rules.located(F.col("relative")), F.col("kind") == "dir"
        return paths.withColumn("action", ancestor_match(self.rules.rules, path, ancestors(path), base_name(path), is_dir, self.options.dialect))

    def overridden(self, paths: DataFrame) -> DataFrame:
        path = F.col("relative")
        return paths.withColumn("override", decide_override(self.overrides.rules, path, base_name(path), F.col("kind") == "dir", self.options.dialect))
