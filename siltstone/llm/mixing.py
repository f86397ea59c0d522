"""Mixing sources to target weights by pivotal dependent rounding.

A source that should give r times its words takes floor(r) copies of each of its
documents and one more with probability r - floor(r).  The fractional parts are
rounded jointly: of a pair of documents, words of probability mass move from one
to the other, at random but unbiased, until one of the two is settled, and the
sum of (size x probability) stays what it was.  Larger documents are paired first,
by powers of two of their sizes; what is left of a size is paired with all smaller
documents taken as one, whose probabilities shift together.  So the last document
left is mostly a small one, and a source misses its target by less than its size.

Documents are dealt to buckets by the hash of their id; a bucket is rounded on
its own and leaves at most one unsettled document; those meet, FAN buckets at a
time, level by level, until one a source is left, which is drawn.  A bucket holds
about BUCKET documents however large its source is.  All draws come from hashes,
so reruns agree.

Sizes are counts of words; null texts have none, and a document without words
takes none.  Null ids and sources are values like others (a null source sorts
last).  Rows alike in id, source and text are told apart by a count.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import ranked, settled

#: Words, fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating, and the copies of a document at most.
WEIGHTS, MOST_COPIES = (1.0, 2.0, 3.0), 3.0
#: Documents of a bucket about, and buckets that meet at a level.
BUCKET, FAN = 8192, 64
#: Sources up to which their targets may be broadcast.
BROADCAST_SOURCES = 10_000
SEED = 20_240


def sizes(docs: DataFrame) -> DataFrame:
    """One row a document, without its text."""
    return docs.select("doc_id", "source", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("body"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(per_document: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target.  Where weights ask a source for more than
    `most` times its size, it stops there and the others share the excess: the
    level L with sum(min(most * size, L * weight)) = total.  It rises from total /
    sum of weights, each round by what the sources that stop leave over, until none
    stops any more; a round sums up the table of sources.  All sums are whole
    numbers, so reruns agree."""
    by = per_document.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = ranked(by, F.col("source").asc_nulls_last(), name="rank")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = settled(s.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap")))
    total, left = (float(x or 0) for x in s.agg(F.sum("source_size"), F.sum("w")).first())
    level, stopped = total / left if left else 0.0, -1
    while left:
        stops = F.col("cap") <= F.col("w") * level
        n, spent, left = s.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("w")))).first()
        if n == stopped or not left:
            break
        level, stopped = (total - (spent or 0.0)) / left, n
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def _draw(state: int) -> tuple[int, float]:
    """Next state and a number in [0, 1)."""
    state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return state, ((z ^ (z >> 31)) >> 11) / 2**53


def pivotal(size: list[int], mass: list[float], seeds: list[int]) -> list[float]:
    """Rounds masses (size x probability) pair by pair; each comes out 0 or its
    size but for one at most, which keeps what is left."""
    out, held = list(mass), -1
    for i in range(len(size)):
        if out[i] <= 0.0 or out[i] >= size[i]:
            continue
        if held < 0:
            held = i
            continue
        up, down = min(size[held] - out[held], out[i]), min(out[held], size[i] - out[i])
        _, u = _draw(seeds[i] & 0xFFFFFFFFFFFFFFFF)
        move = up if u * (up + down) < down else -down
        out[held], out[i] = out[held] + move, out[i] - move
        for k in (held, i):
            slack = 1e-9 * size[k]
            out[k] = 0.0 if out[k] <= slack else float(size[k]) if out[k] >= size[k] - slack else out[k]
        open_ = [k for k in (held, i) if 0.0 < out[k] < size[k]]
        held = open_[0] if open_ else -1
    return out


def rounded(size: np.ndarray, mass: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """`pivotal` over size classes from the largest down.  The one that a class
    leaves is settled against all smaller documents together, where they can take
    up its whole mass or give what it lacks; else it joins the next class."""
    mass, kind = mass.astype(float), np.frexp(size.astype(float))[1]
    held: list[int] = []
    for k in sorted(set(kind.tolist()), reverse=True):
        at = held + np.flatnonzero(kind == k).tolist()
        mass[at] = pivotal(size[at].tolist(), mass[at].tolist(), seeds[at].tolist())
        held = [i for i in at if 0.0 < mass[i] < size[i]]
        rest = kind < k
        total, room = float(mass[rest].sum()), float(size[rest].sum() - mass[rest].sum())
        for i in held:
            lacks, has = float(size[i] - mass[i]), float(mass[i])
            if total <= lacks or room <= has:
                continue
            if _draw(int(seeds[i]) + 1 & 0xFFFFFFFFFFFFFFFF)[1] * size[i] < has:
                mass[i], mass[rest] = size[i], mass[rest] * (1 - lacks / total)
            else:
                mass[i], mass[rest] = 0.0, size[rest] - (size[rest] - mass[rest]) * (1 - has / room)
            held = []
    return mass


def _rounded(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["seed", "doc_id", "body", "nth"], kind="stable").reset_index(drop=True)
    open_ = ((pdf["mass"] > 0) & (pdf["mass"] < pdf["size"])).to_numpy()
    some = pdf[open_]
    pdf.loc[open_, "mass"] = rounded(some["size"].to_numpy(), some["mass"].to_numpy(), some["seed"].to_numpy())
    return pdf


def takes(per_document: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to the rows of `sizes`."""
    spark = per_document.sparkSession
    per_document = settled(per_document)
    goal = targets(per_document)
    n_docs, n_sources = per_document.count(), goal.count()
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    goal = F.broadcast(goal) if n_sources <= BROADCAST_SOURCES else goal
    rows = per_document.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_COPIES), F.col("target") / F.col("source_size"))).otherwise(0.0)
    same = Window.partitionBy("doc_id", "source", "body").orderBy("size")
    buckets = max(1, -(-n_docs // BUCKET))
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("whole", F.floor(ratio)).withColumn("mass", (ratio - F.floor(ratio)) * F.col("size"))
    rows = rows.withColumn("seed", F.xxhash64(F.lit(SEED), "doc_id", "body", "nth")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "body", "nth"), F.lit(buckets)))
    schema = rows.select("doc_id", "source", "body", "size", "source_size", "target", "nth", "whole", "mass", "seed", "bucket").schema
    rows = rows.select(*schema.names)
    unsettled = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    level = settled(rows.groupBy("source", "bucket").applyInPandas(_rounded, schema))
    done = [level.where(~unsettled)]
    rest = level.where(unsettled)
    while buckets > 1:
        buckets = -(-buckets // FAN)
        level = settled(rest.withColumn("bucket", F.floor(F.col("bucket") / FAN)).groupBy("source", "bucket").applyInPandas(_rounded, schema))
        done.append(level.where(~unsettled))
        rest = level.where(unsettled)
    # What is left, one document a source, is drawn.
    drawn = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id", "body", "nth"), F.lit(2**53)) / F.lit(float(2**53))
    done.append(rest.withColumn("mass", F.when(drawn * F.col("size") < F.col("mass"), F.col("size").cast("double")).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.when((F.col("mass") > 0) & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    per = takes(sizes(docs)).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("body").alias("__b"), F.col("nth").alias("__n"), F.col("copies").alias("__c")).where("__c > 0")
    src = docs.withColumn("__body", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    # Rows alike in id, source and text are interchangeable: their copies add up and are dealt again.
    per = per.groupBy("__d", "__s", "__b").agg(F.sum("__c").alias("__c"), F.max("__n").alias("__n"))
    joined = src.join(per, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__body") == F.col("__b")))
    one = joined.where("__n = 1").withColumn("__each", F.col("__c"))
    twin = joined.where("__n > 1").withColumn("__k", F.row_number().over(Window.partitionBy("__d", "__s", "__b").orderBy("__body")))
    many = twin.withColumn("__each", F.floor(F.col("__c") / F.col("__n")) + F.when(F.col("__k") <= F.col("__c") % F.col("__n"), 1).otherwise(0)).where("__each > 0")
    cols = docs.columns
    both = one.select(*cols, F.col("__each").cast("int").alias("__each")).unionByName(many.select(*cols, F.col("__each").cast("int").alias("__each")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__each")))).select(*cols)


def digests(docs: DataFrame) -> DataFrame:
    return takes(sizes(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
