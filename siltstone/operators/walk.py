"""Operators over walk entries: pruning, sibling order, visits."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.watch import covered
from siltstone.options import WalkOptions
from siltstone.sources.tree import SCHEMA, start, walk_tree


def filter_entries(entries: DataFrame, keep: Column, directories_only: bool = False) -> DataFrame:
    """Entries for which `keep` holds; a directory for which it doesn't takes its
    whole subtree with it."""
    fails = ~F.coalesce(keep, F.lit(False))
    gone = entries.where(fails & (F.col("kind") == "dir")).select("relative")
    left = covered(entries, gone, False)
    return left if directories_only else left.where(~fails)


def sorted_siblings(entries: DataFrame, *keys: str | Column) -> DataFrame:
    """Entries by directory, and within one by the keys (names, unless given)."""
    return entries.orderBy("root_index", F.regexp_replace("relative", "/?[^/]*$", ""), *(keys or ("name",)))


def filter_directories_stateful(roots: Iterable[str], enter: Callable[[dict], bool], walk: WalkOptions | None = None) -> Iterator[dict]:
    """Serial walk over all roots with one predicate, which may keep state."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    as_dict = lambda row: dict(zip(names, row, strict=True))
    walk = walk or WalkOptions()
    for i, root in enumerate(roots):
        for row in walk_tree(start(root, i, walk), walk, lambda r: enter(as_dict(r))):
            yield as_dict(row)


def without_stdout(entries: DataFrame, descriptor: int = 1) -> DataFrame:
    """Leaves out the file that standard output goes to."""
    try:
        info = os.fstat(descriptor)
    except OSError:
        return entries
    return entries.where(~F.coalesce(F.col("version.identity") == f"{info.st_dev}:{info.st_ino}", F.lit(False)))


def visit(entries: DataFrame, visitor: Callable[[], Callable[[dict], str | None]]) -> DataFrame:
    """Calls a visitor, made once a partition, with every entry.  It may answer
    `Quit`, which ends its partition.  One row: visited and quit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, seen, quit_ = visitor(), 0, False
        for pdf in parts:
            for row in pdf.to_dict("records"):
                seen += 1
                if call(row) == "Quit":
                    quit_ = True
                    break
            if quit_:
                break
        yield pd.DataFrame({"visited": [seen], "quit": [quit_]})

    return entries.mapInPandas(run, "visited long, quit boolean").agg(F.coalesce(F.sum("visited"), F.lit(0)).cast("long").alias("visited"), F.coalesce(F.bool_or("quit"), F.lit(False)).alias("quit"))
