import hashlib
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siltstone.operators import delta, report, watch
from siltstone.options import IgnorePolicy, ScanOptions, WalkOptions
from siltstone.scanner import FullRescanRequired, Scanner, combined, scan_many, totals, visit_many
from siltstone.session import ScanSession, StaleSnapshot
from siltstone.snapshot import SnapshotError, SnapshotReader
from siltstone.sources import tree


def make(root, files):
    for path, body in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


CORPUS = {
    ".gitignore": "draft.rs\nhall/\n*.tmp\n!ledger.tmp\n",
    "sub/engine.rs": "12 fine legs",
    "sub/draft.rs": "x",
    "hall/a.rs": "x",
    "kettle.tmp": "x",
    "ledger.tmp": "x",
    "target/made.rs": "x",
    "PLAN.md": "plans",
    "blob.rs": b"a\0b",
    ".hooks/on.rs": "hop",
}
POLICY = IgnorePolicy(parent_rules=False, git_exclude=False)


def names(df, kind="kind"):
    return sorted((r["relative"], r[kind]) for r in df.collect())


def test_scan(spark, tmp_path):
    root = make(tmp_path / "r", CORPUS)
    s = Scanner(spark, root, ScanOptions(extensions=("rs", "tmp"), ignore_policy=POLICY))
    done = s.scan()
    assert [r["relative"] for r in done.sorted_files().collect()] == [".hooks/on.rs", "ledger.tmp", "sub/engine.rs"]
    assert names(done.skipped) == [(".gitignore", "Extension"), ("PLAN.md", "Extension"), ("blob.rs", "Binary"), ("hall", "Ignored"), ("kettle.tmp", "Ignored"), ("sub/draft.rs", "Ignored"), ("target", "StandardDirectory")]
    row = done.files.where("relative = 'sub/engine.rs'").first()
    assert row["content_hash"] == "sha256:" + hashlib.sha256(b"12 fine legs").hexdigest()
    assert [e.location for e in done.sources] == [".gitignore"] and done.complete and done.portable
    assert done.revision() == report.revision(done.files, done.sources).first()["revision"]
    assert "files=3 " in report.summary_text(done.summary())
    again = Scanner(spark, make(tmp_path / "other", CORPUS), s.options).scan()
    assert again.revision() == done.revision()
    assert [r["relative"] for r in s.scan_paths().collect()] == [".hooks/on.rs", "blob.rs", "ledger.tmp", "sub/engine.rs"]
    cached = s.scan(report.to_cache(done.files))
    assert cached.revision() == done.revision() and cached.cache == (3, 1, 0) and done.cache == (0, 4, 0)
    # A report made from a cache makes the same cache.
    again = s.scan(report.to_cache(cached.files))
    assert report.to_cache(cached.files).count() == 3 and again.cache == (3, 1, 0)
    strict = Scanner(spark, root, s.options.with_(cache_validation="Strict"))
    spoilt = report.to_cache(done.files).withColumn("content_fingerprint", F.when(F.col("relative") == "ledger.tmp", "xx128:0").otherwise(F.col("content_fingerprint")))
    assert strict.scan(spoilt).cache == (2, 5, 3) and strict.scan(spoilt).revision() == done.revision()
    budget = Scanner(spark, root, s.options.with_(max_total_bytes=4)).scan()
    assert budget.termination == "MaxTotalBytes" and [r["relative"] for r in budget.files.collect()] == [".hooks/on.rs"]
    got = []
    assert not s.scan_into(lambda r: got.append(r["relative"]) or len(got) < 2) and len(got) == 2
    parts = s.visit_content(5).where("relative = 'sub/engine.rs'").orderBy("chunk_index").collect()
    assert b"".join(bytes(p["bytes"]) for p in parts) == b"12 fine legs" and [p["offset"] for p in parts] == [0, 5, 10]


def test_nested_and_parent_rules(spark, tmp_path):
    root = make(tmp_path / "r", {".git/info/exclude": "private.rs\n", ".gitignore": "/app/x.rs\n*.log\n", "app/.gitignore": "*.go\n", "app/x.rs": "1", "app/y.go": "1", "app/z.log": "1", "app/private.rs": "1", "app/ok.rs": "1", "y.go": "1"})
    o = ScanOptions(ignore_policy=IgnorePolicy(explicit_files=("../../mine",)))
    make(tmp_path, {"mine": "*.none\n"})
    got = Scanner(spark, os.path.join(root, "app"), o).scan()
    assert [r["relative"] for r in got.sorted_files().collect()] == [".gitignore", "ok.rs"]
    assert not got.portable


def test_rules_above_the_root(spark, tmp_path):
    """Globs of folders above the scan match what lies below it."""
    root = make(tmp_path / "r", {".git/HEAD": "", ".gitignore": "**/made.rs\n*/spare.rs\na*/cut.rs\n/app/gone.rs\n*.log\napp/sub/*.go\n", "app/.ignore": "*.bak\n"})
    app = {f: "1" for f in ("made.rs", "sub/made.rs", "spare.rs", "cut.rs", "gone.rs", "x.log", "sub/y.go", "y.go", "fine.rs", "sub/gone.rs", "x.bak")}
    make(tmp_path / "r" / "app", app)
    for policy, gone in ((IgnorePolicy(), {"made.rs", "sub/made.rs", "spare.rs", "cut.rs", "gone.rs", "x.log", "sub/y.go", "x.bak"}), (IgnorePolicy(parent_rules=False), {"x.bak"})):
        done = Scanner(spark, os.path.join(root, "app"), ScanOptions(ignore_policy=policy)).scan()
        assert {r["relative"] for r in done.files.collect()} == {".ignore", *app} - gone
    assert {s.location for s in Scanner(spark, os.path.join(root, "app")).scan().sources} == {".gitignore", "app/.ignore"}


def test_abort_and_git_sources(spark, tmp_path, monkeypatch):
    root = make(tmp_path / "r", {".git/info/exclude": "a\n", ".gitignore": "{x\n", "b": "1"})
    make(tmp_path, {"home/.gitconfig": "[core]\nexcludesFile = ~/mine\n", "home/mine": "c\n"})
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("GIT_CONFIG_GLOBAL", raising=False)
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    done = Scanner(spark, root, ScanOptions(ignore_policy=IgnorePolicy(git_global=True))).scan()
    assert not done.portable and not done.complete
    assert [s.location for s in done.sources] == ["<git-global>", ".git/info/exclude", ".gitignore"]
    with pytest.raises(OSError):
        Scanner(spark, root, ScanOptions(walk=WalkOptions(error_policy="Abort"))).scan()


def test_visits_and_snapshots(spark, tmp_path):
    root = make(tmp_path / "r", {"a.txt": "a" * 25, "b.txt": "b" * 25, "c.bin": b"\0", "d.txt": "dd", "e": ""})
    s = Scanner(spark, root)

    def visitor():
        def call(event, about):
            return "SkipFile" if event == "Chunk" and about["relative"] == "a.txt" and about["offset"] == 10 else None

        return call

    rows, sums = s.visit_files(visitor, 10)
    got = {r["relative"]: (r["status"], r["chunks"], r["bytes_read"], r["bytes_emitted"]) for r in rows.collect()}
    assert got == {"a.txt": ("Skipped", 2, 25, 20), "b.txt": ("Selected", 3, 25, 25), "c.bin": ("Binary", 0, 0, 0), "d.txt": ("Selected", 1, 2, 2), "e": ("Selected", 0, 0, 0)}
    assert sums == {"discovered": 5, "completed": 3, "opened": 5, "chunks": 6, "bytes_read": 52, "bytes_emitted": 47, "consumer_skipped": 1, "stopped": False}
    rows, sums = s.visit_files(lambda: lambda event, about: "Quit", 10)
    assert sums["stopped"] and 1 <= rows.where("opened").count() <= 5
    parts, done = s.visit_content_manifest(10)
    assert parts.count() == 7 and done.files.count() == 4 and s.visit_content(10).count() == 7
    reader = SnapshotReader(done)
    assert reader.read("d.txt") == (type(reader.read("d.txt")))(b"dd", "Sha256")
    bare = SnapshotReader(Scanner(spark, root, ScanOptions().metadata_only()).scan())
    assert bare.read("a.txt").evidence == "FileVersion"
    make(tmp_path / "r", {"a.txt": "z" * 25})
    os.remove(tmp_path / "r" / "b.txt")
    os.symlink(tmp_path / "r" / "a.txt", tmp_path / "r" / "b.txt")
    os.remove(tmp_path / "r" / "e")
    for path, kind, most in (("a.txt", "Stale", None), ("b.txt", "Stale", None), ("e", "Io", None), ("nope", "UnknownFile", None), ("d.txt", "LimitExceeded", 1)):
        with pytest.raises(SnapshotError) as e:
            reader.read(path, most)
        assert e.value.kind == kind, path
    with pytest.raises(SnapshotError):
        SnapshotReader(replace(done, files=done.files.withColumn("relative", F.concat(F.lit("../"), "relative"))))
    both = [(r["root_index"], r["relative"]) for r in combined([done, done]).collect()]
    assert both == sorted(both) and len(both) == 8


def test_plans_look_at_their_paths_only(spark, tmp_path, monkeypatch):
    root = make(tmp_path / "r", {".gitignore": "*.log\n", "a/b.txt": "1", "a/c.log": "1", "d.txt": "1"})
    o = ScanOptions(ignore_policy=POLICY)
    before = Scanner(spark, root, o).scan()
    make(tmp_path / "r", {"a/b.txt": "22", "a/new.txt": "3", "a/d.log": "4"})
    os.symlink(tmp_path / "r" / "a", tmp_path / "r" / "l")
    plan = spark.createDataFrame([(p, "changed") for p in ("a/b.txt", "a/new.txt", "a/d.log", "l/b.txt", "l", "gone")], "relative string, action string")
    monkeypatch.setattr(tree, "list_tree", None)
    after, reason = Scanner(spark, root, o).scan_watch_plan(before, plan)
    monkeypatch.undo()
    full = Scanner(spark, root, o).scan()
    assert reason == "Incremental" and after.revision() == full.revision() and names(after.skipped) == names(full.skipped)
    added = spark.createDataFrame([("a/.ignore", "changed")], "relative string, action string")
    assert Scanner(spark, root, o).scan_watch_plan(before, added)[1] == "IgnoreInputChanged"


def test_walk(spark, tmp_path):
    root = make(tmp_path / "r", {"a/b/c/d.txt": "x", "a/e.txt": "y", ".dot/f": "z", "g": "w"})
    os.symlink(tmp_path / "r" / "a", tmp_path / "r" / "a" / "b" / "loop")
    os.symlink("/", tmp_path / "r" / "out")
    all_ = {r["relative"]: r for r in tree.list_tree(spark, root).collect()}
    assert set(all_) == {"a", "a/b", "a/b/c", "a/b/c/d.txt", "a/b/loop", "a/e.txt", ".dot", ".dot/f", "g", "out"}
    assert all_["out"]["kind"] == "symlink" and all_[".dot"]["hidden"] and all_["a/e.txt"]["bytes"] == 1
    follow = {r["relative"]: r["walk_skip"] for r in tree.list_tree(spark, root, WalkOptions(follow_links=True)).collect()}
    assert follow["a/b/loop"] == "SymlinkLoop" and follow["out"] == "PathEscape"
    cut = {r["relative"]: r["walk_skip"] for r in tree.list_tree(spark, root, WalkOptions(max_depth=2), partitions=1).collect()}
    assert cut["a/b"] == "MaxDepth" and "a/b/c" not in cut
    order = [r["relative"] for r in tree.ordered_walk(tree.list_tree(spark, root))]
    assert order == [".dot", ".dot/f", "a", "a/b", "a/b/c", "a/b/c/d.txt", "a/b/loop", "a/e.txt", "g", "out"]
    last = [r["relative"] for r in tree.ordered_walk(tree.list_tree(spark, root), contents_first=True)]
    assert last.index("a") > last.index("a/e.txt") > last.index("a/b")
    assert {r["root_index"] for r in tree.list_tree(spark, [root, root]).collect()} == {0, 1}
    os.symlink(root, tmp_path / "link")
    with pytest.raises(ValueError):
        tree.list_tree(spark, str(tmp_path / "link"), WalkOptions(root_symlink_policy="Reject"))

    def process(depth, path, state, children):
        kept = [c for c in children if not c["name"].startswith(".")]
        return [c | {"state": (state or "") + "/" + c["name"], "enter": c["name"] != "c"} for c in reversed(kept)]

    seen = [(r["relative"], r["state"]) for r in tree.stateful_walk(root, process)]
    assert seen[:3] == [("out", "/out"), ("g", "/g"), ("a", "/a")] and ("a/b/c", "/a/b/c") in seen and "a/b/c/d.txt" not in dict(seen)
    entries = tree.list_tree(spark, root).select("relative", "name", "depth", "kind")
    start = spark.createDataFrame([("", "")], "relative string, state string")
    level = lambda pdf: pdf[pdf["name"] != "g"].assign(state=pdf["state"] + "/" + pdf["name"], enter=pdf["name"] != "c")[["relative", "kind", "state", "enter"]]
    done = {r["relative"]: r["state"] for r in tree.stateful_levels(entries, level, "relative string, kind string, state string, enter boolean", start).collect()}
    assert done["a/b/c"] == "/a/b/c" and "g" not in done and "a/b/c/d.txt" not in done


def test_delta(spark):
    schema = "relative string, bytes long, content_hash string"
    prev = spark.createDataFrame([("calm", 1, "s"), ("edit", 1, "m1"), ("was.rs", 2, "r"), ("twin/was.txt", 3, "dup"), ("twin/stay.txt", 3, "dup"), ("shed.rs", 1, "x")], schema)
    cur = spark.createDataFrame([("calm", 1, "s"), ("edit", 1, "m2"), ("here.rs", 2, "r"), ("twin/here.txt", 3, "dup"), ("twin/stay.txt", 3, "dup"), ("born.rs", 1, "y")], schema)
    got = sorted(tuple(r) for r in delta.delta(prev, cur).fillna("").collect())
    assert got == [("added", "born.rs", ""), ("added", "twin/here.txt", ""), ("modified", "edit", ""), ("removed", "shed.rs", ""), ("removed", "twin/was.txt", ""), ("renamed", "here.rs", "was.rs"), ("unchanged", "calm", ""), ("unchanged", "twin/stay.txt", "")]
    assert delta.quality(prev, cur).first()[0] == "ContentHash" and delta.quality(prev, cur, False).first()[0] == "Partial"
    bare = prev.withColumn("content_hash", F.lit(None).cast("string"))
    assert {r["status"] for r in delta.statuses(bare, bare).collect()} == {"modified"}


def test_session_and_plans(spark, tmp_path):
    root = make(tmp_path / "r", CORPUS)
    o = ScanOptions(ignore_policy=POLICY)
    session = ScanSession.open(spark, root, str(tmp_path / "store"), o)
    make(tmp_path / "r", {"sub/engine.rs": "13 other legs", "sub/fresh.rs": "n"})
    os.remove(tmp_path / "r" / "PLAN.md")
    events = spark.createDataFrame([(1, f"{root}/sub/engine.rs", "Remove"), (2, f"{root}/sub/engine.rs", "Create"), (3, f"{root}/sub/fresh.rs", "Modify"), (4, f"{root}/PLAN.md", "Remove"), (5, "/else", "Modify"), (6, f"{root}/a/../b", "Modify")], "seq long, path string, kind string")
    header = watch.plan_header(events, root, o.ignore_files).first()
    assert (header["full_rescan"], header["rejected_events"]) == (False, 2)
    plan = watch.plan_paths(events, root, o.ignore_files)
    assert session.apply_watch_plan(plan) == "Incremental"
    full = Scanner(spark, root, o).scan()
    assert session.report.revision() == full.revision()
    assert names(session.report.skipped) == names(full.skipped)
    assert session.files_page(2, 0, 2).count() == 2 and len(list(session.files(2))) == full.files.count()
    with pytest.raises(StaleSnapshot):
        session.files_page(1, 0, 1)
    make(tmp_path / "r", {".gitignore": "*.rs\n"})
    assert session.apply_watch_plan(plan) == "IgnoreInputChanged"
    assert session.apply_watch_plan(plan, full=True) == "StructuralChange"
    control = spark.createDataFrame([(1, f"{root}/sub/.gitignore", "Modify")], "seq long, path string, kind string")
    assert watch.plan_header(control, root, o.ignore_files).first()["full_rescan"]


def test_many_roots_and_small_helpers(spark, tmp_path):
    a, b = make(tmp_path / "a", {"x": "1"}), make(tmp_path / "b", {"y": "22"})
    reports = scan_many(spark, [a, b])
    assert [r.files.first()["relative"] for r in reports] == ["x", "y"]
    assert totals(reports) == {"files": 2, "bytes": 3, "complete": True, "cancelled": False}
    assert sorted((r["root_index"], bytes(r["bytes"])) for r in visit_many(spark, [a, b]).collect()) == [(0, b"1"), (1, b"22")]
    plan = spark.createDataFrame([("y", "changed"), ("z", "removed"), ("a", "removed")], "relative string, action string")
    parts, removed = Scanner(spark, b).visit_changed(plan)
    assert [bytes(r["bytes"]) for r in parts.collect()] == [b"22"] and removed == ["a", "z"]
    with pytest.raises(FullRescanRequired):
        Scanner(spark, b).visit_changed(plan, full_rescan=True)
    parts, done = Scanner(spark, b).visit_content_manifest()
    assert parts.count() == 1 and done.complete
    notes = spark.createDataFrame([(1, "access", ["p"]), (2, "rename-both", ["a", "b"]), (3, "rename-both", ["a"]), (4, "remove-folder", ["d"]), (5, "modify-data", ["m"])], "seq long, notification string, paths array<string>")
    assert [tuple(r) for r in watch.from_notifications(notes).orderBy("seq").collect()] == [(4, "RenameFrom", "a"), (5, "RenameTo", "b"), (6, "Rescan", "a"), (8, "Rescan", "d"), (10, "Modify", "m")]
    known = spark.createDataFrame([("src/a",), ("src2",), ("src",), ("lib/x",)], "relative string")
    assert sorted(r[0] for r in watch.expand_few(known, ["src", "src/a"]).collect()) == ["src", "src/a"]
