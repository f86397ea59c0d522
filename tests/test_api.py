import pytest
from pyspark.sql import functions as F

from siltstone import api
from siltstone.control import CancellationToken, limited
from siltstone.operators import walk
from siltstone.options import ScanOptions
from siltstone.scanner import Scanner
from siltstone.sources import tree
from test_scanner import CORPUS, make

OPTIONS = {"extensions": ["rs", "tmp"]}


def test_entry_points(spark, tmp_path):
    root = make(tmp_path / "r", CORPUS)
    assert api.scan_paths(spark, root, OPTIONS) == [".hooks/on.rs", "blob.rs", "ledger.tmp", "sub/engine.rs"]
    done = api.scan_repository(spark, root, OPTIONS)
    api.save_report(done, str(tmp_path / "report"))
    again = api.load_report(spark, str(tmp_path / "report"))
    assert again.revision() == done.revision() and again.descriptor == done.descriptor
    assert again.summary() == done.summary()
    assert api.export_scan_cache(spark, root, str(tmp_path / "cache"), OPTIONS).count() == 3
    assert "files=3" in api.scan_diagnostics(spark, root, OPTIONS)["text"]
    with pytest.raises(ValueError):
        api.scan_paths(spark, root, {"unknown": 1})


def test_limits(spark, tmp_path):
    root = make(tmp_path / "r", {"a": "1"})
    token = CancellationToken()
    token.cancel()
    done = Scanner(spark, root, ScanOptions(cancellation=token)).scan()
    assert (done.termination, done.complete) == ("Cancelled", False)
    assert limited(spark, lambda: 5, timeout=60) == (5, None)
    slow = lambda: spark.range(4).mapInPandas(lambda it: (__import__("time").sleep(30) or x for x in it), "id long").count()
    assert limited(spark, slow, timeout=1.0) == (None, "Timeout")


def test_walk_operators(spark, tmp_path):
    root = make(tmp_path / "r", {"a/b/x": "1", "a/y": "2", "c/z": "3"})
    entries = tree.list_tree(spark, root)
    names = lambda df: sorted(r["relative"] for r in df.collect())
    assert names(walk.filter_entries(entries, F.col("name") != "b")) == ["a", "a/y", "c", "c/z"]
    assert names(walk.filter_entries(entries, ~F.col("name").isin("b", "z"), directories_only=True)) == ["a", "a/y", "c", "c/z"]
    assert [r["relative"] for r in walk.sorted_siblings(entries, F.desc("name")).collect()] == ["c", "a", "a/y", "a/b", "a/b/x", "c/z"]
    seen = []
    got = [r["relative"] for r in walk.filter_directories_stateful([root], lambda r: seen.append(r["name"]) or len(seen) < 2)]
    assert got == ["a", "a/b", "a/y", "c"]
    assert walk.visit(entries, lambda: lambda row: None).first()["visited"] == 6
    assert walk.visit(entries.coalesce(1), lambda: lambda row: "Quit").first().asDict() == {"visited": 1, "quit": True}
    assert walk.without_stdout(entries).count() == 6
