import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import globs
from siltstone.functions.paths import base_name
from siltstone.operators import rules, select
from siltstone.operators.filetypes import NamedFileTypes
from siltstone.operators.rules import RuleSet, parse_rule
from siltstone.options import IgnorePolicy, ScanOptions

PATTERNS = ["*.rs", "!oak.rs", "/elm", "a/", "b/*.go", "*fir", "yew*", "!yew1*", "**/x.go", "a/**/c", "[ab].rs", "/*.go", "c/d", "!c/d/e.rs", "o?k.*", "*", "!a/", "{x,y}.go"]
NAMES = ["oak.rs", "a.rs", "x.go", "y.go", "elm", "yew1", "yew2", "fir", "c", "xfir", "e.rs"]
DIRS = ["", "a/", "b/", "a/b/", "c/d/", "a/x/c/"]


def slow(rule, path, is_dir):
    if rule.dir_only and not is_dir:
        return False
    if rule.base:
        if not path.startswith(rule.base + "/"):
            return False
        path = path[len(rule.base) + 1 :]
    subject = path.rsplit("/", 1)[-1] if rule.scope == "Anywhere" else path
    p = rule.pattern
    if "{" not in p and "**" not in p:
        if not set(p) & set("*?[{\\"):
            return subject == p
        if p[0] == "*" and not set(p[1:]) & set("*?[{\\"):
            return subject.endswith(p[1:])
        if p[-1] == "*" and not set(p[:-1]) & set("*?[{\\"):
            return subject.startswith(p[:-1])
    return globs.matches(p, subject)


def slow_decide(all_rules, path, is_dir):
    hits = [r for r in all_rules if slow(r, path, is_dir)]
    return max(hits, key=lambda r: r.precedence).action if hits else None


@pytest.mark.parametrize("seed", range(4))
def test_random_rules(spark, seed):
    r = random.Random(seed)
    rs = RuleSet()
    for source, base in (("GitIgnore", ""), ("GitIgnore", "a"), ("DotIgnore", ""), ("Custom", "a/b"), ("GitExclude", "")):
        rs.add("\n".join(r.sample(PATTERNS, 6)), source, base + "/" + source, base)
    paths = sorted({d + n for d in DIRS for n in NAMES})
    df = spark.createDataFrame([(p, base_name_of(p), k) for p in paths for k in (False, True)], "relative string, name string, is_dir boolean")
    p = F.col("relative")
    want = {(x, k): slow_decide(rs.rules, x, k) for x in paths for k in (False, True)}
    got = df.select("relative", "is_dir", rules.decide(rs.rules, p, F.col("name"), F.col("is_dir")).alias("a")).collect()
    assert {(x["relative"], x["is_dir"]): x["a"] for x in got} == want
    joined = rules.decide_by_join(df, rules.relation(spark, rs.rules)).collect()
    assert {(x["relative"], x["is_dir"]): x["action"] for x in joined} == want


def base_name_of(p):
    return p.rsplit("/", 1)[-1]


@pytest.mark.parametrize(
    "line,want",
    [("", None), ("# x", None), ("\\#x", ("\\#x"[1:], "Ignore", False, "Anywhere")), ("!a/", ("a", "Include", True, "Anywhere")), ("/a  ", ("a", "Ignore", False, "Anchored")), ("a\\ ", ("a\\ ", "Ignore", False, "Anywhere")), ("a/b", ("a/b", "Ignore", False, "Path")), ("/", None), ("\\!x\r", ("!x", "Ignore", False, "Anywhere"))],
)
def test_parse(line, want):
    rule = parse_rule(line)
    assert (rule and (rule.pattern, rule.action, rule.dir_only, rule.scope)) == want


def test_errors_and_encoding():
    rs = RuleSet().add(b"\xef\xbb\xbf{a\nok%\n\xff.x\n", "Custom", "f")
    assert [r.pattern for r in rs.rules] == ["ok%25", "%FF.x"]
    assert rs.errors[0][1].startswith("line 1:")


def test_precedence_and_policy(spark):
    rs = RuleSet().add("a.rs\nb.rs", "GitIgnore", ".gitignore").add("!a.rs\n!b.rs", "DotIgnore", ".ignore").add("b.rs", "Custom", "c")
    df = spark.createDataFrame([("a.rs", "file", 1), ("b.rs", "file", 1)], "relative string, kind string, bytes long")
    pick = lambda o: {r["relative"] for r in select.selected(select.classify(df, o, rs)).collect()}
    assert pick(ScanOptions()) == {"a.rs"}
    assert pick(ScanOptions(ignore_policy=IgnorePolicy(custom_ignore=False))) == {"a.rs", "b.rs"}
    assert pick(ScanOptions(ignore_policy=IgnorePolicy(dot_ignore=False, custom_ignore=False))) == set()


def layered(layers, path, is_dir):
    """The decision layer by layer, from the highest on, by hand."""
    parts, included = path.split("/"), False
    above = ["/".join(parts[:k]) for k in range(len(parts) - 1, 0, -1)]
    for own in layers:
        exact = slow_decide(own, path, is_dir)
        if exact:
            return exact
        near = next((a for a in (slow_decide(own, d, True) for d in above) if a), None)
        if near == "Ignore" and not included:
            return "Ignore"
        included |= near == "Include"
    return "Include" if included else None


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_layer_by_layer(spark, seed):
    r = random.Random(seed)
    rs = RuleSet()
    order = [("GitExclude", ""), ("GitIgnore", ""), ("GitIgnore", "a"), ("DotIgnore", ""), ("Custom", "a")]
    for source, base in order:
        rs.add("\n".join(r.sample(PATTERNS, 5)), source, base + "/" + source, base)
    paths = sorted({d + n for d in DIRS for n in NAMES})
    df = spark.createDataFrame([(p, k) for p in paths for k in ("file", "dir")], "relative string, kind string")
    got = {(x["relative"], x["kind"]): x["action"] for x in select.SelectionMatcher(ScanOptions(), rs).ignored(df).collect()}
    layers = [[x for x in rs.rules if (x.source, x.base) == key] for key in reversed(order)]
    assert got == {(p, k): layered(layers, p, k == "dir") for p in paths for k in ("file", "dir")}
    rs = RuleSet().add("!oak.rs\n", "GitIgnore", ".gitignore").add("out/\n", "DotIgnore", ".ignore")
    one = spark.createDataFrame([("out/oak.rs", "file")], "relative string, kind string")
    assert select.SelectionMatcher(ScanOptions(), rs).ignored(one).first()["action"] == "Ignore"


def test_byte_budget(spark):
    from itertools import accumulate

    from siltstone.operators import limits

    n = 120_000
    path, size = F.concat(F.lit("d"), F.col("id") * 7919 % 101, F.lit("/f"), F.col("id")), F.xxhash64("id") % 50 + 50
    df = spark.range(n, numPartitions=7).select(path.alias("relative"), size.alias("bytes"), F.col("id").alias("extra"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    rows = sorted((r["relative"], r["bytes"]) for r in df.select("relative", "bytes").collect())
    total = list(accumulate(b for _, b in rows))
    for limit in (0, total[0], total[n // 3], total[-1] - 1, total[-1]):
        for _ in range(2):
            got = limits.byte_budget(df, limit)
            assert got.columns == [*df.columns, "kept"]
            assert got.where("kept").count() == sum(t <= limit for t in total)
        assert {r["relative"] for r in got.where("kept").select("relative").collect()} == {p for (p, _), t in zip(rows, total, strict=True) if t <= limit}
    assert limits.byte_budget(df.limit(0), 5).count() == 0


def test_cascade_order(spark):
    rows = [("d", "dir", None), ("d/target", "dir", None), ("d/target/x.rs", "file", 1), ("big.rs", "file", 99), ("l", "symlink", 1), (".h.rs", "file", 1), ("x.PY", "file", 1), ("fir/target/y.py", "file", 1), ("fifo", "other", None)]
    df = spark.createDataFrame(rows, "relative string, kind string, bytes long")
    o = ScanOptions(extensions=["rs"], max_file_bytes=50, skip_hidden=True)
    got = {r["relative"]: (r["disposition"], r["skip_kind"], r["detail"]) for r in select.classify(df, o).collect()}
    assert got == {
        "d": ("Traverse", None, None),
        "d/target": ("Skipped", "StandardDirectory", None),
        "d/target/x.rs": ("Unselected", None, None),
        "big.rs": ("Skipped", "Oversized", "99 bytes"),
        "l": ("Skipped", "Symlink", None),
        ".h.rs": ("Skipped", "Hidden", None),
        "x.PY": ("Skipped", "Extension", None),
        "fir/target/y.py": ("Unselected", None, None),
        "fifo": ("Unselected", None, None),
    }
    types = NamedFileTypes().with_defaults().select(["py"]).negate(["rust"])
    got = {r["relative"]: r["disposition"] for r in select.classify(df, ScanOptions(file_types=types)).collect()}
    assert got["x.PY"] == "Selected" and got["big.rs"] == "Skipped"
    o = ScanOptions(extensions=["rs"], override_rules=("x.*", "target/"))
    got = {r["relative"]: (r["disposition"], r["skip_kind"]) for r in select.classify(df, o).collect()}
    assert got["x.PY"] == ("Selected", None) and got["d/target"] == ("Traverse", None) and got["big.rs"] == ("Skipped", "Override")


def test_options():
    assert ScanOptions().descriptor().matches(ScanOptions(parallelism=3, timeout_seconds=1.0, cache_validation="Strict"))
    assert not ScanOptions().descriptor().matches(ScanOptions(skip_hidden=True))
    assert not ScanOptions.decode({"hash_file_contents": False}).detect_binary_files
    with pytest.raises(ValueError):
        ScanOptions.decode({"nope": 1})
