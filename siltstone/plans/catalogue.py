"""Queries over the test tables, one per operator, each beside its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import content as cf
from siltstone.functions.globs import glob_column
from siltstone.functions.paths import ancestors, base_name, collapse_prefixes, covered_by, depth, extension
from siltstone.operators import content, delta, limits, report, rules, select, watch
from siltstone.operators.filetypes import NamedFileTypes
from siltstone.operators.rules import RuleSet, SourceEvidence
from siltstone.options import STANDARD_DIRECTORIES, IgnorePolicy, ScanOptions, WalkOptions
from siltstone.plans import derive as d
from siltstone.plans.derive import sql
from siltstone.plans.lineage import settled
from siltstone.scanner import Scanner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


STD = ", ".join(f"'{x}'" for x in STANDARD_DIRECTORIES)
#: SQL of "some proper ancestor is a standard directory".
UNDER_STD = f"list_has_any(string_split(relative, '/')[:-2], [{STD}])"
PLAIN = ScanOptions(standard_skips=False, max_file_bytes=2**40)
_ON_DISK = PLAIN.with_(ignore_policy=IgnorePolicy.none(), detect_binary_files=False)
RULES = "*.tmp\n!doc_1*.tmp\n/src3/\nsrc4/de/\n*.md\n!src5/**/doc_*.md\n"


def ruleset() -> RuleSet:
    return RuleSet().add(RULES, "GitIgnore", ".gitignore").add("*.rs\n", "Custom", "src/lib/.scanignore", "src/lib", 1)


# Sources

@query(sql("m", "SELECT relative, bytes, content_hash FROM m"))
def manifest_scan(spark, sf):
    return d.manifest(spark, sf).select("relative", "bytes", "content_hash")


@query(sql("m", "SELECT dense_rank() OVER (ORDER BY source) - 1 AS root_index, relative, bytes FROM m"))
def multi_root_manifest(spark, sf):
    m = d.manifest(spark, sf).withColumn("source", F.coalesce("source", F.lit("none")))
    # Roots are few; their numbers come from a table of roots.
    from pyspark.sql import Window

    roots = m.select("source").distinct().withColumn("root_index", F.row_number().over(Window.orderBy("source")) - 1)
    return m.join(roots, "source").select(F.col("root_index").cast("long").alias("root_index"), "relative", "bytes")


@query(sql("m", f"SELECT relative FROM m WHERE NOT {UNDER_STD} ORDER BY relative"))
def paths_sorted(spark, sf):
    c = select.classify(d.tree(spark, sf).drop("content"), ScanOptions(max_file_bytes=2**40))
    return select.selected(c).select("relative").orderBy("relative")


@query(sql("m", "SELECT relative, bytes, content_hash AS evidence_hash, true AS binary_checked FROM m"))
def compact_manifest(spark, sf):
    c = report.compact(d.manifest(spark, sf))
    return c.select("relative", "bytes", F.col("content.content_hash").alias("evidence_hash"), F.col("content.binary_checked").alias("binary_checked"))


@query(sql("u", "SELECT page_id, path FROM u"))
def url_paths(spark, sf):
    return d.urls(spark, sf)


@query(sql("m", "SELECT relative, len(string_split(relative, '/')) AS depth FROM m"))
def walk_depths(spark, sf):
    return d.tree(spark, sf).select("relative", depth(F.col("relative")).cast("long").alias("depth"))


# Globs

GLOBS = {
    "glob_star": ("src*/*/doc_*1*.*", "^src[^/]*/[^/]*/doc_[^/]*1[^/]*[.][^/]*$"),
    "glob_question": ("src?/??/doc_??*", "^src[^/]/[^/][^/]/doc_[^/][^/][^/]*$"),
    "glob_class": ("**/doc_*[1-3][02468].[!rt]*", "doc_[^/]*[1-3][02468][.][^/rt][^/]*$"),
    "glob_negated_class": ("src1[!0-4]/**", "^src1[^0-4/]/?.*$"),
    "glob_doublestar": ("{target,build}/**/*[05].*", "^(target|build)/.*[05][.][^/]*$"),
    "glob_braces": ("{src1,src2{0,1},src[5-9]}/{en,fr}/*.{rs,ts,md}", "^(src1|src2(0|1)|src[5-9])/(en|fr)/[^/]*[.](rs|ts|md)$"),
    "glob_escape": (r"src*/e\n/doc\_*\.[gm]\*", "^src[^/]*/en/doc_[^/]*[.][gm][*]$"),
    "glob_escape_literal": (r"src*/\e\n/doc\_*\.\go", "^src[^/]*/en/doc_[^/]*[.]go$"),
}


def _glob_query(name: str, pattern: str) -> Query:
    def run(spark, sf):
        return d.tree(spark, sf).where(glob_column(F.col("relative"), pattern)).select("relative")

    run.__name__ = name
    return run


for _name, (_pattern, _regex) in GLOBS.items():
    query(sql("m", f"SELECT relative FROM m WHERE regexp_matches(relative, '{_regex}')"))(_glob_query(_name, _pattern))


@query(sql("m", "SELECT relative FROM m WHERE regexp_matches(lower(relative), '^src[^/]*/[^/]*/doc_[^/]*[.]rs$')"))
def glob_case_insensitive(spark, sf):
    return d.tree(spark, sf).where(glob_column(F.upper("relative"), "SRC*/*/Doc_*.RS", case_insensitive=True)).select("relative")


@query(sql("u", "SELECT page_id FROM u WHERE regexp_matches(path, '^[a-z][a-z]/[0-9][^/]*$')"))
def glob_urls(spark, sf):
    return d.urls(spark, sf).where(glob_column(F.col("path"), "[a-z][a-z]/[0-9]*")).select("page_id")


# Rules

def _actions(spark, sf, text: str, base: str = ""):
    r = RuleSet().add(text, "GitIgnore", ".gitignore", base)
    path = F.col("relative")
    return d.tree(spark, sf).select("relative", F.coalesce(rules.decide(r.rules, path, base_name(path), F.lit(False)), F.lit("None")).alias("action"))


@query(sql("m n", "SELECT relative, CASE WHEN name LIKE 'doc\\_1%' ESCAPE '\\' THEN 'Ignore' WHEN name LIKE '%.rs' THEN 'Include' WHEN name LIKE 'doc%' THEN 'Ignore' ELSE 'None' END AS action FROM n"))
def rule_last_match_wins(spark, sf):
    return _actions(spark, sf, "doc*\n!*.rs\ndoc_1*\n")


@query(sql("m n", "SELECT relative, CASE WHEN regexp_matches(name, '^doc_5.*[.]tmp$') THEN 'Include' WHEN name LIKE '%.tmp' THEN 'Ignore' ELSE 'None' END AS action FROM n"))
def rule_negation(spark, sf):
    return _actions(spark, sf, "# scratch\n*.tmp  \n!doc_5*.tmp\n")


@query(sql("m", "SELECT relative, regexp_matches(relative, '(^|/)fr/') AS below FROM m"))
def rule_dir_only(spark, sf):
    r = RuleSet().add("fr/\n", "GitIgnore", ".gitignore").rules
    path = F.col("relative")
    hit = rules.ancestor_match(r, path, ancestors(path), base_name(path), F.lit(False))
    return d.tree(spark, sf).select("relative", F.coalesce(hit == "Ignore", F.lit(False)).alias("below"))


@query(sql("m", "SELECT relative, CASE WHEN relative LIKE 'src1/en/%' THEN 'Ignore' ELSE 'None' END AS action FROM m"))
def rule_anchored(spark, sf):
    return _actions(spark, sf, "/src1/en/*\n")


@query(sql("m n", "SELECT relative, CASE WHEN relative LIKE 'src/lib/%' AND name LIKE '%.go' THEN 'Ignore' ELSE 'None' END AS action FROM n"))
def rule_nested_base(spark, sf):
    return _actions(spark, sf, "*.go\n", "src/lib")


@query(sql("m n", "SELECT relative, CASE WHEN name LIKE '%.rs' THEN 'Ignore' WHEN name LIKE '%.go' OR name LIKE 'doc_2%' THEN 'Include' WHEN name LIKE '%.ts' THEN 'Ignore' ELSE 'None' END AS action FROM n"))
def source_precedence(spark, sf):
    r = RuleSet().add("*.go\n*.rs\n*.ts\n", "GitIgnore", ".gitignore").add("!*.go\n!*.rs\n!doc?2*\n", "DotIgnore", ".ignore").add("*.rs\n", "Custom", ".scanignore")
    path = F.col("relative")
    return d.tree(spark, sf).select("relative", F.coalesce(rules.decide(r.rules, path, base_name(path), F.lit(False)), F.lit("None")).alias("action"))


def _overridden(spark, sf, *patterns):
    m = select.SelectionMatcher(PLAIN.with_(override_rules=patterns))
    return m.overridden(d.tree(spark, sf)).select("relative", F.coalesce("override", F.lit("None")).alias("override"))


@query(sql("m n", "SELECT relative, CASE WHEN name LIKE '%.rs' OR name LIKE '%.go' THEN 'OverrideInclude' ELSE 'OverrideIgnore' END AS override FROM n"))
def override_whitelist(spark, sf):
    return _overridden(spark, sf, "*.rs", "*.go")


@query(sql("m n", "SELECT relative, CASE WHEN name LIKE '%.md' THEN 'OverrideIgnore' ELSE 'None' END AS override FROM n"))
def override_exclude(spark, sf):
    return _overridden(spark, sf, "!*.md")


@query(sql("m", "SELECT relative FROM m WHERE NOT regexp_matches(relative, '(^|/)[.]')"))
def hidden_filter(spark, sf):
    return select.selected(select.classify(d.tree(spark, sf), PLAIN.with_(skip_hidden=True))).select("relative")


_THETA = "doc_1*\n!*.go\nsrc/lib/\n*[05].md\nsrc2/*/*.ts\n!**/fr/doc_*3.ts\n"


@query(sql("m n", """SELECT relative, CASE WHEN regexp_matches(relative, 'fr/doc_[^/]*3[.]ts$') THEN 'Include' WHEN regexp_matches(relative, '^src2/[^/]*/[^/]*[.]ts$') THEN 'Ignore'
  WHEN regexp_matches(name, '[05][.]md$') THEN 'Ignore' WHEN name LIKE '%.go' THEN 'Include' WHEN name LIKE 'doc!_1%' ESCAPE '!' THEN 'Ignore' ELSE 'None' END AS action FROM n"""))
def rule_theta_join(spark, sf):
    r = RuleSet().add(_THETA, "GitIgnore", ".gitignore")
    paths = d.tree(spark, sf).select("relative", base_name(F.col("relative")).alias("name"), F.lit(False).alias("is_dir"))
    return rules.decide_by_join(paths, rules.relation(spark, r.rules)).select("relative", F.coalesce("action", F.lit("None")).alias("action"))


# Selection

@query(sql("m", f"SELECT relative FROM m WHERE NOT {UNDER_STD}"))
def standard_dirs(spark, sf):
    return select.selected(select.classify(d.tree(spark, sf), PLAIN.with_(standard_skips=True))).select("relative")


@query(sql("m n", "SELECT relative FROM n WHERE name LIKE '%.rs' OR name LIKE '%.md'"))
def extension_filter(spark, sf):
    return select.selected(select.classify(d.tree(spark, sf), PLAIN.with_(extensions=(".RS", "md")))).select("relative")


@query(sql("m n", "SELECT relative FROM n WHERE (name LIKE '%.rs' OR name LIKE '%.md' OR name LIKE '%.ts') AND NOT name LIKE 'doc!_1%' ESCAPE '!'"))
def file_types_select_negate(spark, sf):
    types = NamedFileTypes().with_defaults().with_globs("ones", ["doc_1*"]).with_composed_type("mine", ["rust", "markdown", "ts"]).select(["mine"]).negate(["ones"])
    return select.selected(select.classify(d.tree(spark, sf), PLAIN.with_(file_types=types))).select("relative")


@query(sql("m", "SELECT relative, bytes || ' bytes' AS detail FROM m WHERE bytes > 2000"))
def oversize_filter(spark, sf):
    c = select.classify(d.tree(spark, sf), PLAIN.with_(max_file_bytes=2000))
    return c.where("skip_kind = 'Oversized'").select("relative", "detail")


@query(sql("m", "SELECT relative FROM m WHERE len(string_split(relative, '/')) = 4"))
def depth_limits(spark, sf):
    return select.selected(select.classify(d.tree(spark, sf), PLAIN.with_(walk=WalkOptions(min_depth=4, max_depth=4)))).select("relative")


_CASCADE = ScanOptions(extensions=("rs", "go", "md", "tmp"), max_file_bytes=6000, skip_hidden=True)
_PRUNED = """CASE WHEN relative LIKE '.hidden/%' THEN '.hidden' WHEN relative LIKE 'target/%' THEN 'target' WHEN relative LIKE 'node!_modules/%' ESCAPE '!' THEN 'node_modules'
  WHEN relative LIKE 'build/%' THEN 'build' WHEN relative LIKE 'src3/%' THEN 'src3' WHEN relative LIKE 'src4/de/%' THEN 'src4/de' END"""
_FILE_SKIP = """CASE WHEN relative LIKE 'src/lib/%' AND name LIKE '%.rs' THEN 'Ignored' WHEN relative LIKE 'src5/%' AND name LIKE 'doc!_%.md' ESCAPE '!' THEN NULL WHEN name LIKE '%.md' THEN 'Ignored'
  WHEN regexp_matches(name, '^doc_1.*[.]tmp$') THEN NULL WHEN name LIKE '%.tmp' THEN 'Ignored' WHEN name LIKE '%.ts' THEN 'Extension' WHEN bytes > 6000 THEN 'Oversized' END"""
_FATES = f"""SELECT relative, bytes, pruned_at, CASE WHEN pruned_at IS NOT NULL THEN 'Unselected' WHEN coalesce(skip_kind, big) IS NOT NULL THEN 'Skipped' ELSE 'Selected' END AS disposition,
  CASE WHEN pruned_at IS NULL THEN coalesce(skip_kind, big) END AS skip_kind FROM (SELECT *, {_PRUNED} AS pruned_at, {_FILE_SKIP} AS skip_kind, CASE WHEN bytes > 6000 THEN 'Oversized' END AS big FROM n)"""


def _cascade(spark, sf):
    return select.classify(d.tree(spark, sf).drop("content"), _CASCADE, ruleset())


@query(sql("m n", f"SELECT relative, disposition, skip_kind FROM ({_FATES})"))
def selection_cascade(spark, sf):
    return _cascade(spark, sf).select("relative", "disposition", "skip_kind")


@query(sql("m n", f"""SELECT relative, skip_kind AS kind, CASE WHEN skip_kind = 'Oversized' THEN bytes || ' bytes' END AS detail FROM ({_FATES}) WHERE disposition = 'Skipped'
  UNION ALL SELECT DISTINCT pruned_at, CASE WHEN pruned_at = '.hidden' THEN 'Hidden' WHEN pruned_at LIKE 'src%' THEN 'Ignored' ELSE 'StandardDirectory' END, NULL FROM ({_FATES}) WHERE pruned_at IS NOT NULL"""))
def skip_evidence(spark, sf):
    return select.skipped(_cascade(spark, sf), _CASCADE, ruleset(), implied_dirs=True)


@query(sql("m n", f"SELECT pruned_at AS directory, count(*) AS files FROM ({_FATES}) WHERE pruned_at IS NOT NULL GROUP BY 1"))
def shallowest_pruned_dir(spark, sf):
    return _cascade(spark, sf).where("pruned_at is not null").groupBy(F.col("pruned_at").alias("directory")).agg(F.count(F.lit(1)).alias("files"))


@query(sql("m n", f"""SELECT relative, CASE WHEN pruned_at = '.hidden' THEN 'Hidden' WHEN pruned_at LIKE 'src%' THEN 'Ignored' WHEN pruned_at IS NOT NULL THEN 'StandardDirectory'
  WHEN skip_kind IS NOT NULL THEN skip_kind ELSE 'SelectedFile' END AS decision FROM ({_FATES})"""))
def selection_matcher(spark, sf):
    return select.SelectionMatcher(_CASCADE, ruleset()).matched(d.tree(spark, sf).drop("content")).select("relative", "decision")


@query(sql("m", "SELECT relative FROM m WHERE relative = 'src1' OR relative LIKE 'src1/%' OR relative LIKE 'target/src2/%'"))
def prefix_cover(spark, sf):
    return d.tree(spark, sf).where(covered_by(F.col("relative"), ["src1", "src1/en", "target/src2"])).select("relative")


_FOLDERS = """f AS (SELECT DISTINCT CASE WHEN doc_id % 29 = 0 THEN source WHEN doc_id % 5 = 0 THEN source || '/' || coalesce(lang, 'xx') ELSE regexp_replace(relative, '/[^/]*$', '') END AS prefix FROM (SELECT m.doc_id, m.source, m.relative, docs.lang FROM m JOIN documents docs USING (doc_id)))"""


@query(sql("m", "").rstrip() + ", " + _FOLDERS + " SELECT prefix FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE starts_with(f.prefix, g.prefix || '/'))")
def prefix_collapse(spark, sf):
    """Folders, of which there are as many as sources and languages, collapsed on the driver."""
    k, source = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    folder = F.when(k % 29 == 0, source).when(k % 5 == 0, F.concat(source, F.lit("/"), F.coalesce("lang", F.lit("xx")))).otherwise(F.regexp_replace(d.relative(), "/[^/]*$", ""))
    found = d.documents(spark, sf).select(folder.alias("prefix")).distinct().collect()
    return spark.createDataFrame([(p,) for p in collapse_prefixes(r["prefix"] for r in found)], "prefix string")


@query(sql("m n", "SELECT relative, regexp_extract(name, '[^.]*$') AS extension FROM n"))
def path_extension(spark, sf):
    return d.tree(spark, sf).select("relative", extension(base_name(F.col("relative"))).alias("extension"))


# Limits

@query(sql("m", "SELECT relative, sum(bytes) OVER (ORDER BY relative ROWS UNBOUNDED PRECEDING) <= 100000 AS kept FROM m"))
def byte_budget_prefix(spark, sf):
    return limits.byte_budget(d.tree(spark, sf).select("relative", "bytes"), 100_000).select("relative", "kept")


_ITEM = "printf('o%d/l%d', l_orderkey, l_linenumber)"


@query(f"SELECT path, l_quantity, sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY path RANGE UNBOUNDED PRECEDING) <= (SELECT CAST(sum(l_quantity) AS BIGINT) // 3 FROM lineitem) AS kept FROM (SELECT {_ITEM} AS path, * FROM lineitem)")
def byte_budget_lineitem(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("relative", F.format_string("o%d/l%d", "l_orderkey", "l_linenumber")).withColumn("bytes", F.col("l_quantity").cast("long"))
    third = (items.agg(F.sum("bytes")).first()[0] or 0) // 3
    return limits.byte_budget(items, third).select(F.col("relative").alias("path"), "l_quantity", "kept")


@query(sql("m", "SELECT relative FROM m ORDER BY relative LIMIT 25"))
def entry_limit(spark, sf):
    return limits.entry_limit(d.tree(spark, sf), 25).select("relative")


@query(sql("m", "SELECT relative, bytes FROM m ORDER BY relative LIMIT 20 OFFSET 40"))
def page_files(spark, sf):
    return limits.page(d.tree(spark, sf), 40, 20).select("relative", "bytes")


# Content

@query(sql("m", "SELECT relative, content_hash FROM m"))
def content_hash(spark, sf):
    return content.inspect(d.tree(spark, sf), ScanOptions()).select("relative", "content_hash")


@query(sql("m", "SELECT relative, doc_id % 37 = 0 AS binary FROM m"))
def binary_detect(spark, sf):
    body = F.when(F.col("doc_id") % 37 == 0, F.concat(F.encode("content", "UTF-8"), F.lit(b"x\0y"))).otherwise(F.encode("content", "UTF-8"))
    seen = content.inspect(d.tree(spark, sf).withColumn("content", body), ScanOptions())
    return seen.select("relative", (F.coalesce("skip_kind", F.lit("")) == "Binary").alias("binary"))


@query(sql("m", """SELECT relative, i AS chunk_index, i * 4096 AS "offset", least(4096, bytes - i * 4096) AS bytes FROM (SELECT relative, bytes, unnest(range(0, CAST(ceil(bytes / 4096.0) AS BIGINT))) AS i FROM m)"""))
def content_chunks(spark, sf):
    return content.chunks(d.tree(spark, sf), "content", 4096).select("relative", F.col("chunk_index").cast("long").alias("chunk_index"), "offset", F.octet_length("bytes").cast("long").alias("bytes"))


@query(sql("m", "SELECT relative, sha256(content) AS sha FROM m WHERE bytes > 0"))
def chunk_reassembly_hash(spark, sf):
    return content.reassembled(content.chunks(d.tree(spark, sf), "content", 4096)).select("relative", F.sha2("content", 256).alias("sha"))


@query(sql("m", """SELECT count(*) AS discovered, count(*) FILTER (n <= w) AS completed, count(*) AS opened, CAST(sum(least(n, w)) AS BIGINT) AS chunks,
  CAST(sum(CASE WHEN n <= w THEN bytes ELSE w * 1000 END) AS BIGINT) AS bytes_emitted, count(*) FILTER (n > w) AS consumer_skipped FROM (SELECT bytes, CAST(ceil(bytes / 1000.0) AS BIGINT) AS n, 1 + doc_id % 4 AS w FROM m)"""))
def visit_counters(spark, sf):
    return content.visit(d.tree(spark, sf), (1 + F.col("doc_id") % 4).cast("int"), "content", 1000)[1]


@query(sql("m", "SELECT relative, CASE WHEN CAST(ceil(bytes / 1000.0) AS BIGINT) > 1 + doc_id % 4 THEN 'Skipped' ELSE 'Selected' END AS status FROM m"))
def visit_events(spark, sf):
    return content.visit(d.tree(spark, sf), (1 + F.col("doc_id") % 4).cast("int"), "content", 1000)[0].select("relative", "status")


def _cached(spark, sf, mode: str):
    now = d.manifest(spark, sf)
    old = now.where("doc_id % 3 != 0").withColumn("content_fingerprint", F.col("content_hash"))
    old = old.withColumn("version", F.struct(F.when(F.col("doc_id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("version.modified_ns")).alias("modified_ns"), F.col("version.changed_ns").alias("changed_ns"), F.col("version.identity").alias("identity")))
    old = old.withColumn("content_fingerprint", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("content_fingerprint"))).drop("doc_id", "source")
    return content.with_cache(now.withColumn("content_fingerprint", F.col("content_hash")).drop("content_hash"), old, ScanOptions(cache_validation=mode))


@query(sql("m", "SELECT relative, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS reusable FROM m"))
def cache_reuse_fast(spark, sf):
    return _cached(spark, sf, "Fast").select("relative", "reusable")


@query(sql("m", "SELECT count(*) FILTER (r) AS reused_hashes, count(*) FILTER (NOT r) AS content_reads, count(*) FILTER (r) AS fingerprint_reads FROM (SELECT doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS r FROM m)"))
def cache_stats(spark, sf):
    return content.cache_stats(_cached(spark, sf, "Strict"), ScanOptions(cache_validation="Strict"))


@query(sql("m prev cur", "SELECT r.relative, CASE WHEN p.relative IS NULL THEN 'UnknownFile' WHEN c.relative IS NULL THEN 'Io' WHEN p.bytes = c.bytes AND p.content_hash = c.content_hash THEN 'Ok' ELSE 'Stale' END AS status FROM m r LEFT JOIN prev p USING (relative) LEFT JOIN cur c USING (relative)"))
def snapshot_verify(spark, sf):
    return content.verify_snapshot(d.previous(spark, sf), d.current(spark, sf), d.manifest(spark, sf))


@query("SELECT conv_id, turn, 'sha256:' || sha256(text) AS content_hash FROM conversations")
def turn_hash(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", cf.sha256(F.col("text")).alias("content_hash"))


# Aggregates

@query(sql("m n", f"SELECT count(*) AS selected_files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS selected_bytes FROM ({_FATES}) WHERE disposition = 'Selected'"))
def summary(spark, sf):
    files = select.selected(_cascade(spark, sf)).withColumns({"content_hash": F.lit(None).cast("string"), "binary_checked": F.lit(False)})
    return report.summary(files).select("selected_files", "selected_bytes")


@query(sql("m n", f"SELECT skip_kind AS kind, count(*) AS n FROM ({_FATES}) WHERE disposition = 'Skipped' GROUP BY 1"))
def skip_counts(spark, sf):
    return report.skip_counts(select.skipped(_cascade(spark, sf), _CASCADE))


@query(sql("m", "SELECT content_hash, count(*) AS n FROM m GROUP BY 1"))
def hash_duplicates(spark, sf):
    return report.duplicates(d.manifest(spark, sf))


@query(sql("m", "SELECT source, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, min(relative) AS first_path FROM m GROUP BY 1"))
def per_root_summary(spark, sf):
    m = d.manifest(spark, sf).groupBy(F.coalesce("source", F.lit("none")).alias("source"))
    return m.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.min("relative").alias("first_path"))


def _le8(e: str) -> str:
    return " || ".join(f"lpad(to_hex(({e} >> {8 * i}) & 255), 2, '0')" for i in range(8))


def _revision_sql(sources_hex: str, table: str = "m") -> str:
    rec = f"hex(encode(relative)) || '00' || {_le8('bytes')} || '00' || hex(encode(content_hash)) || 'ff'"
    return f"SELECT 'sha256:' || sha256(unhex('{sources_hex}' || string_agg({rec}, '' ORDER BY relative) || '01')) AS revision FROM {table}"


SOURCES = (SourceEvidence("GitIgnore", ".gitignore", "sha256:00"), SourceEvidence("Explicit", "/etc/rules", "sha256:11"))


@query(sql("m", _revision_sql(report.revision_prefix(SOURCES).hex())))
def revision(spark, sf):
    return report.revision(d.manifest(spark, sf), SOURCES)


# Exports

@query(sql("m", "SELECT relative, bytes, content_hash, true AS binary_checked FROM m"))
def portable_files(spark, sf):
    return report.portable_files(d.manifest(spark, sf))


@query(sql("m n", f"SELECT relative, skip_kind AS kind, CASE WHEN skip_kind = 'Oversized' THEN 'sha256:' || sha256(bytes || ' bytes') END AS detail_hash FROM ({_FATES}) WHERE disposition = 'Skipped'"))
def portable_skips(spark, sf):
    return report.portable_skips(select.skipped(_cascade(spark, sf), _CASCADE))


_LOCATED = "CASE doc_id % 7 WHEN 0 THEN '/' || relative WHEN 1 THEN '../' || relative WHEN 2 THEN '<' || source || '>' WHEN 3 THEN replace(relative, '/', chr(92)) WHEN 4 THEN './' || relative WHEN 5 THEN 'C:' || relative ELSE relative END"


@query(sql("m", f"""SELECT DISTINCT kind, CASE WHEN regexp_matches(l, '^<.*>$') THEN l WHEN regexp_matches(l, '^/|^[A-Za-z]:|(^|/)[.][.]?(/|$)') THEN NULL ELSE replace(l, chr(92), '/') END AS repository_relative, content_hash
  FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'GitIgnore' ELSE 'Explicit' END AS kind, {_LOCATED} AS l, content_hash FROM m)"""))
def portable_sources(spark, sf):
    k, path = F.col("doc_id") % 7, F.col("relative")
    at = F.when(k == 0, F.concat(F.lit("/"), path)).when(k == 1, F.concat(F.lit("../"), path)).when(k == 2, F.concat(F.lit("<"), F.coalesce("source", F.lit("none")), F.lit(">"))).when(k == 3, F.replace(path, F.lit("/"), F.lit("\\")))
    at = at.when(k == 4, F.concat(F.lit("./"), path)).when(k == 5, F.concat(F.lit("C:"), path)).otherwise(path)
    return report.portable_sources(d.manifest(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, "GitIgnore").otherwise("Explicit").alias("kind"), at.alias("location"), "content_hash"))


@query(sql("m", _revision_sql(report.revision_prefix((SOURCES[0], SourceEvidence("Explicit", "<external>", "sha256:11"))).hex())))
def portable_revision(spark, sf):
    return report.portable_revision(d.manifest(spark, sf), SOURCES)


# Delta

_ST = "SELECT coalesce(p.relative, c.relative) AS relative, CASE WHEN c.relative IS NULL THEN 'removed' WHEN p.relative IS NULL THEN 'added' WHEN p.bytes = c.bytes AND p.content_hash = c.content_hash THEN 'unchanged' ELSE 'modified' END AS status, coalesce(c.content_hash, p.content_hash) AS h FROM prev p FULL JOIN cur c ON p.relative = c.relative"
_MV = f"""st AS ({_ST}), mv AS (SELECT a.relative AS "from", b.relative AS "to", a.h AS content_hash FROM st a JOIN st b ON a.h = b.h AND a.status = 'removed' AND b.status = 'added'
  WHERE a.h IN (SELECT content_hash FROM prev GROUP BY 1 HAVING count(*) = 1) AND b.h IN (SELECT content_hash FROM cur GROUP BY 1 HAVING count(*) = 1))"""


def _delta_sql(body: str) -> str:
    return sql("m prev cur", "").rstrip() + ", " + _MV + " " + body


@query(_delta_sql("SELECT relative, status FROM st"))
def delta_status(spark, sf):
    return delta.statuses(d.previous(spark, sf), d.current(spark, sf)).select("relative", "status")


@query(_delta_sql('SELECT "from", "to", content_hash FROM mv'))
def delta_renames(spark, sf):
    return delta.renames(d.previous(spark, sf), d.current(spark, sf))


@query(_delta_sql("""SELECT status, count(*) AS n FROM (SELECT status FROM st WHERE relative NOT IN (SELECT "from" FROM mv) AND relative NOT IN (SELECT "to" FROM mv) UNION ALL SELECT 'renamed' FROM mv) GROUP BY 1"""))
def delta_counts(spark, sf):
    return delta.counts(delta.delta(d.previous(spark, sf), d.current(spark, sf)))


_QUALITY = "SELECT '{}' AS which, CASE WHEN (SELECT count(*) FROM prev WHERE content_hash IS NULL) + (SELECT count(*) FROM cur WHERE {}) = 0 THEN 'ContentHash' ELSE 'Metadata' END AS quality"


@query(sql("m prev cur", _QUALITY.format("whole", "content_hash IS NULL") + " UNION ALL " + _QUALITY.format("bare", "content_hash IS NULL OR bytes % 2 = 1")))
def delta_quality(spark, sf):
    now = d.current(spark, sf)
    bare = now.withColumn("content_hash", F.when(F.col("bytes") % 2 == 0, F.col("content_hash")))
    each = [delta.quality(d.previous(spark, sf), c).select(F.lit(k).alias("which"), "quality") for k, c in (("whole", now), ("bare", bare))]
    return each[0].unionByName(each[1])


@query(_delta_sql("""SELECT relative, status FROM st WHERE status IN ('added', 'removed') AND relative NOT IN (SELECT "from" FROM mv) AND relative NOT IN (SELECT "to" FROM mv)"""))
def delta_duplicate_moves(spark, sf):
    return delta.delta(d.previous(spark, sf), d.current(spark, sf)).where("status in ('added', 'removed')").select("relative", "status")


# Change events

_CLEAN = "SELECT substring(path, 12) AS relative, kind, seq FROM ev WHERE path LIKE '/work/tree/%' AND kind <> 'Directory'"
_PLAN = f"SELECT relative, arg_max(CASE WHEN kind IN ('Create', 'Modify', 'RenameTo') THEN 'changed' ELSE 'removed' END, seq) AS action FROM ({_CLEAN}) GROUP BY 1"
NAMES = (".gitignore", ".ignore", ".scanignore")


@query(sql("ev", _PLAN))
def watch_plan_paths(spark, sf):
    return watch.plan_paths(d.watch_events(spark, sf), d.ROOT, NAMES)


@query(sql("ev", "SELECT coalesce(bool_or(kind = 'Directory' AND path LIKE '/work/tree/%'), false) AS full_rescan, count(*) FILTER (path NOT LIKE '/work/tree/%') AS rejected_events FROM ev"))
def watch_plan_header(spark, sf):
    return watch.plan_header(d.watch_events(spark, sf), d.ROOT, NAMES)


_COVERED = "EXISTS (SELECT 1 FROM pre WHERE m.relative = pre.relative OR starts_with(m.relative, pre.relative || '/'))"


@query(sql("m pre", f"SELECT relative, content_hash FROM m WHERE NOT {_COVERED}"))
def cache_invalidation(spark, sf):
    return watch.invalidate(d.manifest(spark, sf).select("relative", "content_hash"), d.removed_prefixes(spark, sf))


@query(sql("m pre", f"SELECT DISTINCT relative FROM m WHERE {_COVERED}"))
def expand_removed(spark, sf):
    return watch.expand_removed(d.manifest(spark, sf), d.removed_prefixes(spark, sf))


def _update_plan(spark, sf):
    same = delta.statuses(d.previous(spark, sf), d.current(spark, sf)).where("status != 'unchanged'")
    return same.select("relative", F.when(F.col("status") == "removed", "removed").otherwise("changed").alias("action"))


@query(sql("m cur", "SELECT relative, bytes, content_hash FROM cur"))
def incremental_manifest(spark, sf):
    cols = ["relative", "bytes", "content_hash"]
    return watch.incremental(d.previous(spark, sf).select(*cols), _update_plan(spark, sf), d.current(spark, sf).select(*cols))


@query(sql("m prev cur", "").rstrip() + f", r AS ({_revision_sql(report.revision_prefix().hex(), 'cur')}) SELECT revision AS incremental, revision AS whole FROM r")
def incremental_equals_full(spark, sf):
    cols = ["relative", "bytes", "content_hash"]
    made, full = report.revision(incremental_manifest(spark, sf)).withColumnRenamed("revision", "incremental"), report.revision(d.current(spark, sf).select(*cols)).withColumnRenamed("revision", "whole")
    return made.crossJoin(full)


_LEAVES = "hex(encode(relative)) || '00' || hex(encode(CAST(bytes AS VARCHAR))) || '00' || hex(encode(content_hash))"


@query(sql("m", f"""SELECT 'tree:' || sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS revision FROM (SELECT bucket, sha256(string_agg(leaf, '' ORDER BY leaf)) AS digest
  FROM (SELECT CAST('0x' || substr(sha256(relative), 1, 8) AS BIGINT) % (SELECT CAST(ceil(count(*) / {report.TREE_LEAVES}.0) AS BIGINT) FROM m) AS bucket, sha256(unhex({_LEAVES})) AS leaf FROM m) GROUP BY bucket)"""))
def revision_tree(spark, sf):
    return report.revision_tree(d.manifest(spark, sf))


# Trees on disk

@query(sql("m", "SELECT relative, bytes, content_hash FROM m"))
def tree_scan(spark, sf):
    """Every document as a file of a tree that is scanned."""
    with d.on_disk(spark, d.tree(spark, sf)) as root:
        return Scanner(spark, root, _ON_DISK).scan().files.select("relative", "bytes", "content_hash")


@query(sql("m", "SELECT relative, i AS chunk_index, least(4096, bytes - i * 4096) AS bytes FROM (SELECT relative, bytes, unnest(range(0, CAST(ceil(bytes / 4096.0) AS BIGINT))) AS i FROM m)"))
def tree_chunks(spark, sf):
    with d.on_disk(spark, d.tree(spark, sf)) as root:
        parts, _ = Scanner(spark, root, _ON_DISK).visit_content_manifest(4096)
        return settled(parts.select("relative", F.col("chunk_index").cast("long").alias("chunk_index"), F.octet_length("bytes").cast("long").alias("bytes")))


@query(sql("m", "SELECT relative, CASE WHEN doc_id % 10 = 1 THEN 'sha256:' || sha256(content || 'more') ELSE content_hash END AS content_hash FROM m WHERE doc_id % 10 <> 0"))
def tree_incremental(spark, sf):
    """A scan brought up to date after files have gone and changed."""
    docs, k = d.tree(spark, sf), F.col("doc_id") % 10
    with d.on_disk(spark, docs) as root:
        before = Scanner(spark, root, _ON_DISK).scan()
        d.write_files(docs.where(k == 1).withColumn("content", F.concat("content", F.lit("more"))), root)
        d.remove_files(docs.where(k == 0), root)
        plan = docs.where(k < 2).select("relative", F.when(k == 0, "removed").otherwise("changed").alias("action"))
        after, reason = Scanner(spark, root, _ON_DISK).scan_watch_plan(before, plan)
        if reason != "Incremental":
            raise RuntimeError(reason)
        return after.files.select("relative", "content_hash")


# Without a SQL form

@query()
def fingerprint(spark, sf):
    return d.tree(spark, sf).select("relative", cf.fingerprint(F.col("content")).alias("fingerprint"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of every file, by reason: the cascade, summed up."""
    return _cascade(spark, sf).groupBy("disposition", "skip_kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


QUERIES["selection_summary"] = flagship
ORACLES["selection_summary"] = sql("m n", f"SELECT disposition, skip_kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_FATES}) GROUP BY 1, 2")
