"""Directory trees as tables.

`spark.read.format("file_tree").option("root", dir).load()` lists a tree, dotfiles
included (Spark's own binaryFile source leaves them out).  The driver expands the
roots breadth first until there are enough directories for `partitions`; each
partition then walks its share.  Errors are rows.

`read_contents` reads listed files on the executors, at most `max_bytes` each, and
tells when a file changed meanwhile.  On a cluster the tree must be a path that
executors share.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.paths import normalise
from siltstone.options import WalkOptions

SCHEMA = "root_index int, root string, relative string, name string, depth int, kind string, bytes long, modified_ns long, changed_ns long, identity string, hidden boolean, walk_skip string, error string"


@dataclass(frozen=True)
class Node:
    """A directory to be entered: where it is, and the real directories above it,
    by which loops of followed links are found."""

    root_index: int
    root: str
    path: str
    depth: int
    above: tuple[tuple[int, int], ...]


def _row(node: Node, entry_path: str, depth: int, name: str, kind: str, info: os.stat_result | None, skip: str | None = None, error: str | None = None) -> tuple:
    rel = normalise(os.fsencode(os.path.relpath(entry_path, node.root)))
    size = info.st_size if info is not None and kind == "file" else None
    times = (info.st_mtime_ns, info.st_ctime_ns, f"{info.st_dev}:{info.st_ino}") if info is not None else (None, None, None)
    return node.root_index, node.root, rel, normalise(os.fsencode(name)), depth, kind, size, *times, name.startswith("."), skip, error


def list_directory(node: Node, walk: WalkOptions, device: int | None) -> Iterator[tuple[tuple, Node | None]]:
    """Rows of a directory's entries, and for those to be entered, a node."""
    try:
        with os.scandir(node.path) as it:
            entries = sorted(it, key=lambda e: os.fsencode(e.name))
    except OSError as e:
        yield _row(node, node.path, node.depth, os.path.basename(node.path), "other", None, error=f"read directory: {e.strerror}"), None
        return
    for entry in entries:
        yield from _entry(node, entry.path, entry.name, walk, device)


def _entry(node: Node, path: str, name: str, walk: WalkOptions, device: int | None) -> Iterator[tuple[tuple, Node | None]]:
    """The row of one entry of a directory and, if it is to be entered, a node."""
    depth = node.depth + 1
    try:
        info = os.stat(path, follow_symlinks=False)
        link = stat.S_ISLNK(info.st_mode)
        if link and walk.follow_links:
            info = os.stat(path)
    except OSError as e:
        yield _row(node, path, depth, name, "other", None, error=f"read metadata: {e.strerror}"), None
        return
    if link and not walk.follow_links:
        yield _row(node, path, depth, name, "symlink", info), None
        return
    if not stat.S_ISDIR(info.st_mode):
        inside = not link or _inside(path, node.root)
        kind = "file" if stat.S_ISREG(info.st_mode) else "other"
        yield _row(node, path, depth, name, kind, info, None if inside else "PathEscape"), None
        return
    skip = None
    if walk.max_depth is not None and depth >= walk.max_depth:
        skip = "MaxDepth"
    elif link and not _inside(path, node.root):
        skip = "PathEscape"
    elif link and (info.st_dev, info.st_ino) in node.above:
        skip = "SymlinkLoop"
    elif walk.same_file_system and device is not None and info.st_dev != device:
        skip = "FileSystemBoundary"
    row = _row(node, path, depth, name, "dir", info, skip)
    yield row, None if skip else Node(node.root_index, node.root, path, depth, (*node.above, (info.st_dev, info.st_ino)))


def _inside(path: str, root: str) -> bool:
    real, top = os.path.realpath(path), os.path.realpath(root)
    return real == top or real.startswith(top.rstrip("/") + "/")


def start(root: str, index: int, walk: WalkOptions) -> Node:
    if walk.root_symlink_policy == "Reject" and os.path.islink(root):
        raise ValueError(f"the root is a symbolic link: {root}")
    real = os.path.realpath(root)
    info = os.stat(real)
    if not stat.S_ISDIR(info.st_mode):
        raise NotADirectoryError(root)
    return Node(index, real, real, 0, ((info.st_dev, info.st_ino),))


def walk_tree(node: Node, walk: WalkOptions, enter: Callable[[tuple], bool] | None = None) -> Iterator[tuple]:
    """All rows below a node, each directory before its content.  `enter` may keep
    a directory (given its row) from being entered."""
    device = node.above[0][0]
    stack = [iter(list_directory(node, walk, device))]
    while stack:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            continue
        row, inner = found
        if row[11] is None and row[12] and walk.error_policy == "Abort":
            raise OSError(f"{row[2]}: {row[12]}")
        yield row
        if inner and (enter is None or enter(row)):
            stack.append(iter(list_directory(inner, walk, device)))


class _Share(InputPartition):
    def __init__(self, nodes: list[Node], rows: list[tuple]):
        self.nodes, self.rows = nodes, rows


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["root"].split("\n")
        self.parts = int(options.get("partitions", 8))
        depth = options.get("max_depth")
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.walk = WalkOptions(max_depth=int(depth) if depth else None, follow_links=flag("follow_links"), same_file_system=flag("same_file_system"), error_policy=options.get("error_policy", "Continue"), root_symlink_policy=options.get("root_symlink_policy", "Follow"))
        self.prune = set(filter(None, options.get("prune", "").split("\n")))

    def _enters(self, row: tuple) -> bool:
        return row[3] not in self.prune

    def partitions(self) -> list[_Share]:
        frontier, rows = [start(r, i, self.walk) for i, r in enumerate(self.roots)], []
        while frontier and len(frontier) < self.parts:
            wider = []
            for node in frontier:
                for row, inner in list_directory(node, self.walk, node.above[0][0]):
                    rows.append(row)
                    if inner and self._enters(row):
                        wider.append(inner)
            frontier = wider
        shares = [frontier[i :: self.parts] for i in range(min(self.parts, max(1, len(frontier))))]
        return [_Share(s, rows if i == 0 else []) for i, s in enumerate(shares)]

    def read(self, share: _Share) -> Iterator[tuple]:
        yield from share.rows
        for node in share.nodes:
            yield from walk_tree(node, self.walk, self._enters)


class FileTreeSource(DataSource):
    """Options: root (several, one a line), partitions, max_depth, follow_links,
    same_file_system, error_policy, root_symlink_policy, prune (names of
    directories that aren't entered, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options)


def list_tree(spark: SparkSession, roots: str | Iterable[str], walk: WalkOptions | None = None, prune: Iterable[str] = (), partitions: int = 8) -> DataFrame:
    walk = walk or WalkOptions()
    spark.dataSource.register(FileTreeSource)
    roots = [roots] if isinstance(roots, str) else list(roots)
    for r in roots:
        start(r, 0, walk)
    reader = spark.read.format("file_tree").option("root", "\n".join(map(os.path.abspath, roots))).option("partitions", partitions).option("prune", "\n".join(prune))
    for k in ("max_depth", "follow_links", "same_file_system", "error_policy", "root_symlink_policy"):
        if getattr(walk, k) is not None:
            reader = reader.option(k, str(getattr(walk, k)))
    version = F.struct("modified_ns", "changed_ns", "identity").alias("version")
    return reader.load().select("root_index", "root", "relative", "name", "depth", "kind", "bytes", version, "hidden", "walk_skip", "error")


def stat_paths(spark: SparkSession, root: str, paths: DataFrame, walk: WalkOptions | None = None) -> DataFrame:
    """Rows as of `list_tree` for some paths (relative); what is gone, or lies behind
    a link that isn't followed, has none.  Looked up on the executors."""
    walk = walk or WalkOptions()
    top = start(root, 0, walk)

    def one(relative: str) -> tuple | None:
        folder, _, name = relative.rpartition("/")
        node, parts = top, [p for p in folder.split("/") if p]
        for i, part in enumerate([*parts, name]):
            at = os.path.join(node.path, part)
            try:
                info = os.lstat(at)
            except OSError:
                return None
            if i == len(parts):
                return next((row for row, _ in _entry(node, at, part, walk, top.above[0][0])), None)
            if stat.S_ISLNK(info.st_mode) and not walk.follow_links:
                return None
            node = Node(0, node.root, at, i + 1, node.above)
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [row for r in pdf["relative"] if (row := one(r)) is not None]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"bytes": "Int64", "modified_ns": "Int64", "changed_ns": "Int64"})

    version = F.struct("modified_ns", "changed_ns", "identity").alias("version")
    return paths.select("relative").mapInPandas(run, SCHEMA).select("root_index", "root", "relative", "name", "depth", "kind", "bytes", version, "hidden", "walk_skip", "error")


def ordered_walk(entries: DataFrame, contents_first: bool = False) -> Iterator:
    """Rows in depth-first order, a bounded number at a time."""
    parts = F.split("relative", "/")
    if contents_first:
        # A directory's key ends in a value that sorts after every name.
        parts = F.when(F.col("kind") == "dir", F.array_append(parts, F.lit("\U0010ffff" * 2))).otherwise(parts)
    return entries.orderBy("root_index", parts).toLocalIterator(prefetchPartitions=True)


def unordered_walk(entries: DataFrame) -> Iterator:
    return entries.toLocalIterator(prefetchPartitions=True)


def stateful_walk(root: str, process: Callable[[int, str, object, list[dict]], list[dict]], state: object = None, walk: WalkOptions | None = None) -> Iterator[dict]:
    """Serial walk in which `process(depth, path, state, children)` may drop,
    reorder and annotate a directory's children; a child's `state` key is what its
    own directory inherits, `enter` False prunes it."""
    walk = walk or WalkOptions()
    top = start(root, 0, walk)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pending: list[Iterator] = [iter([(top, state)])]
    while pending:
        found = next(pending[-1], None)
        if found is None:
            pending.pop()
            continue
        if isinstance(found, dict):
            yield {k: v for k, v in found.items() if k != "__node"}
            if found.get("__node") is not None and found.get("enter", True):
                pending.append(iter([(found["__node"], found.get("state"))]))
            continue
        node, inherited = found
        children = [dict(zip(names, row, strict=True)) | {"state": inherited, "__node": inner} for row, inner in list_directory(node, walk, top.above[0][0])]
        rel = normalise(os.fsencode(os.path.relpath(node.path, node.root)))
        pending.append(iter(process(node.depth, rel, inherited, children)))


def stateful_levels(entries: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str, state: DataFrame, max_levels: int = 256) -> DataFrame:
    """The parallel form over a table: level by level, `process` gets a directory's
    children with the inherited `state` column and returns rows (relative, kind,
    state, enter, ...); what it returns for directories is handed down."""
    parent = F.regexp_replace("relative", "/?[^/]*$", "")
    rows, out = entries.withColumn("parent", parent), None
    from siltstone.plans.lineage import settled

    for depth in range(1, max_levels + 1):
        level = rows.where(F.col("depth") == depth).join(state.withColumnRenamed("relative", "parent"), "parent")
        done = settled(level.groupBy("parent").applyInPandas(process, schema))
        if not done.head(1):
            return out if out is not None else done
        out = done if out is None else out.unionByName(done)
        state = done.where("kind = 'dir' and enter").select("relative", "state")
    return out


CONTENT = "relative string, content binary, content_hash string, binary boolean, content_status string"


def read_contents(files: DataFrame, max_bytes: int, strict: bool = True) -> DataFrame:
    """(relative, content, content_hash, binary, content_status) of listed files
    (root, relative, absolute, bytes).  Status: Complete, Grown (more bytes than
    expected or allowed), ConcurrentModification, IoError."""

    def one(path: str, expected: int) -> tuple:
        try:
            with open(path, "rb", buffering=0) as f:
                before = os.fstat(f.fileno())
                cap = min(expected, max_bytes)
                body = b""
                while len(body) <= cap and (piece := f.read(min(65_536, cap + 1 - len(body)))):
                    body += piece
                after = os.fstat(f.fileno()) if strict else before
        except OSError:
            return None, None, None, "IoError"
        if len(body) > cap:
            return None, None, None, "Grown"
        if len(body) != expected or (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
            return None, None, None, "ConcurrentModification"
        return body, "sha256:" + hashlib.sha256(body).hexdigest(), b"\0" in body, "Complete"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), 64):
                some = pdf.iloc[i : i + 64]
                got = [(r, *one(a, int(b))) for r, a, b in zip(some["relative"], some["absolute"], some["bytes"], strict=True)]
                yield pd.DataFrame(got, columns=["relative", "content", "content_hash", "binary", "content_status"])

    return files.select("relative", "absolute", "bytes").mapInPandas(run, CONTENT)
