"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are compared by their sets of WORDS-word shingles (ASCII lower case; a
text of fewer words is one shingle).  Texts with equal word sequences are one
node that weighs as many documents; from there on only nodes are looked at.

1. Nodes get MinHash signatures; nodes that agree in a band of ROWS values meet in
   a bucket.  Two nodes at the threshold share no band with probability
   (1 - THRESHOLD**ROWS)**BANDS, 4e-7.
2. Pairs of a bucket are compared STEP values at a time and dropped as soon as the
   posterior probability (uniform prior) of a Jaccard of THRESHOLD or more falls
   below TOLERANCE.  Survivors are candidates; components of candidates, clusters.
3. Shingle sets of clustered nodes, and of them alone, are made again from the
   texts, and each cluster's candidates verified exactly.

Buckets and clusters of more than a block of nodes are dealt out as pairs of blocks,
clusters by the sizes of their sets, so that sizes that can't be at the threshold
never meet; no task holds more than two blocks, and no pair is left out.  What leaves a task are
counts and spanning edges, linear in the nodes, never pairs.

Result: a row a document with the class of the component of links it is in (least
doc_id there) and n_links, the number of other documents at THRESHOLD or more,
copies included.  Texts without words are copies of each other.  Null ids are kept
and never name a class unless no other id is in it; repeated rows count as
documents; extra columns don't matter.  Nodes are 64-bit hashes of word sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import GOLD, LOWER, lean, mix, settled, slices, spans_hash, utf8, words
from siltstone.llm.components import components
from siltstone.llm.quality import beta_cdf

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS, STEP, TOLERANCE = 4, 28, 16, 1e-6
HASHES = ROWS * BANDS
#: Nodes of a cell's block at most, and bytes of their shingle sets, about.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Binary digits of the size of the filter that spares texts outside clusters the second pass, in bits: 8 MB at most.
FILTER_BITS = 26
_U, _I = np.uint64, np.int64


@cache
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=_U) * GOLD) | _U(1)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, offsets of each row's (n + 1), and each row's node."""
    data, n = LOWER[data], len(offs) - 1
    start, end, row = words(data, offs)
    w = spans_hash(data, start, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(w)) - first[row]
    # A polynomial of all words names the node; windows of WORDS give shingles.
    node = np.zeros(n, _U)
    np.add.at(node, row, mix(w + place.astype(_U) * GOLD))
    node = mix(node + count.astype(_U))
    full = place + WORDS <= count[row]
    short = (place == 0) & (count[row] < WORDS)
    take = np.flatnonzero(full | short)
    acc = np.zeros(len(take), _U)
    for a in range(0, len(take), 1 << 17):
        part, some = acc[a : a + (1 << 17)], take[a : a + (1 << 17)]
        ends = first[row[some] + 1]
        for k in range(WORDS):
            inside = some + k < ends
            part *= _U(0x9E3779B97F4A7C15)
            part += np.where(inside, w[np.minimum(some + k, len(w) - 1)] | _U(1), _U(0))
        part[:] = mix(part)
    return acc, np.concatenate(([0], np.cumsum(np.bincount(row[take], minlength=n)))), node.view(_I)


def signatures(sh: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES, uint32); rows without shingles get zeros."""
    n = len(offs) - 1
    out = np.zeros((n, HASHES), np.uint32)
    some = np.flatnonzero(offs[:-1] < offs[1:])
    if len(some):
        at = offs[:-1][some]
        for k, a in enumerate(_multipliers()):
            out[some, k] = np.minimum.reduceat(sh * a, at) >> _U(32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket hash of every band (rows x BANDS)."""
    s = sig.astype(_U).reshape(len(sig), BANDS, ROWS)
    acc = np.arange(BANDS, dtype=_U)[None, :] * GOLD
    for k in range(ROWS):
        acc = mix(acc + s[:, :, k])
    return acc.view(_I)


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: matches below which the posterior
    probability of reaching the threshold is under the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        out.append(next((m for m in range(n + 1) if 1 - beta_cdf(m + 1, n - m + 1, threshold) >= tolerance), n))
    return tuple(out)


def surviving(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows aren't dropped."""
    alive, match = np.arange(len(left)), np.zeros(len(left), _I)
    for k, least in enumerate(least_matches()):
        cols = slice(k * STEP, (k + 1) * STEP)
        match = match + (sig[left[alive], cols] == sig[right[alive], cols]).sum(1)
        on = match >= least
        alive, match = alive[on], match[on]
    return alive


def _pairs(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that a cell owns: within its one block (side 2), or across its two."""
    whole = np.flatnonzero(side == 2)
    a, b = (whole, None) if len(whole) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for i in range(len(a)):
        other = a[i + 1 :] if b is None else b
        if len(other):
            yield np.full(len(other), a[i]), other


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index of each one's component, by label spreading."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sh, offs, node = shingles(*utf8(part.column(1)))
                sig = signatures(sh, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array(np.diff(offs)), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "node", "n_shingles", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, n_shingles long, sig binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(bands(sig).reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    return nodes.where("n_shingles > 0").select("node", "sig").mapInArrow(run, "bucket long, node long")


def _cells(members: DataFrame, group: str) -> DataFrame:
    """(cell, node, side) from (group, node, n): groups of up to BLOCK nodes are one
    cell, larger ones a cell for each pair of blocks."""
    m = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    m = m.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = F.xxhash64(F.col(group), F.least("mine", "other"), F.greatest("mine", "other"))
    return m.select(cell.alias("cell"), "node", _side("mine", "other").alias("side"))


def _side(mine: str, other: str) -> Column:
    """2 in a block's own cell, else which of the two blocks."""
    return F.when(F.col(mine) == F.col(other), 2).otherwise((F.col(mine) > F.col(other)).cast("int"))


def _sized_cells(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, node, side) from (node, root) and (node, size).  A cluster whose sets
    fit into a block is one cell.  Of a larger one, sets are dealt by size: sizes of
    two texts at the threshold are of one class (a power of 1 / THRESHOLD) or of two
    that adjoin, so only blocks of such classes meet; a block holds BLOCK_BYTES of
    sets, about, or one set."""
    m = found.join(sizes, "node").withColumn("class", F.floor(F.log(F.col("size").cast("double")) / math.log(1 / THRESHOLD) + 1e-9).cast("int"))
    per = m.groupBy("root", "class").agg(F.count("node").alias("n"), F.sum("size").alias("bytes"))
    whole = per.groupBy("root").agg(F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.collect_list(F.struct("class", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))).alias("per"))
    # A row a cluster; its classes are few, as they are powers.
    one = (F.col("all") <= BLOCK) & (F.col("all_bytes") * 8 <= BLOCK_BYTES)
    m = m.join(whole.select("root", one.alias("one"), F.map_from_entries("per").alias("per")), "root")
    blocks = lambda c: F.coalesce(F.element_at(F.col("per"), c), F.lit(0))
    m = m.withColumn("mine", F.when(F.col("one"), F.struct(F.lit(0).alias("class"), F.lit(0).alias("block"))).otherwise(F.struct(F.col("class"), F.pmod(F.xxhash64("node", F.lit(5)), blocks(F.col("class"))).cast("int").alias("block"))))
    meets = F.flatten(F.transform(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1), lambda c: F.when(blocks(c) > 0, F.transform(F.sequence(F.lit(0), blocks(c) - 1), lambda b: F.struct(c.alias("class"), b.alias("block")))).otherwise(F.array().cast("array<struct<class:int,block:int>>"))))
    m = m.withColumn("other", F.explode(F.when(F.col("one"), F.array(F.col("mine"))).otherwise(meets)))
    return m.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", _side("mine", "other").alias("side"))


def _small_once(members: DataFrame) -> DataFrame:
    """Buckets of a few nodes that hold the same nodes become one."""
    few = members.where(F.col("n") <= 16).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    once = few.select("nodes").distinct().select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"), F.size("nodes").cast("long").alias("n"))
    return members.where(F.col("n") > 16).select("bucket", "node", "n").unionByName(once)


def _candidate_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(node), HASHES)
    lefts, rights = [np.zeros(0, _I)], [np.zeros(0, _I)]
    for left, right in _pairs(side):
        ok = surviving(sig, left, right)
        lefts.append(left[ok])
        rights.append(right[ok])
    return _spanning(node, np.concatenate(lefts), np.concatenate(rights))


def _spanning(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    root = _roots(len(node), left, right)
    on = root != np.arange(len(node))
    return pd.DataFrame({"u": node[on], "v": node[root[on]]})


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, root) of nodes in candidate pairs, roots among them."""
    banded = _banded(nodes)
    shared = banded.groupBy("bucket").agg(F.count("node").alias("n")).where("n > 1")
    members = settled(_small_once(banded.join(shared, "bucket")))
    cells = _cells(members, "bucket").join(nodes.select("node", "sig"), "node")
    edges = cells.groupBy("cell").applyInPandas(_candidate_edges, "u long, v long")
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _filter_of(found: DataFrame) -> np.ndarray:
    """Bits at the places of the clustered nodes' hashes, 16 a node or so, packed into
    words of 64; each task sends words, not nodes."""
    bits = min(FILTER_BITS, max(6, (16 * found.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0).to_numpy(), bits)
            at = np.unique(at)
            first = np.flatnonzero(np.concatenate(([True], at[1:] >> 6 != at[:-1] >> 6))) if len(at) else at
            word = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(_U), first) if len(at) else at.astype(_U)
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(word.view(_I))], ["at", "word"])

    out = np.zeros(1 << (bits - 6), _I)
    got = found.select("node").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[got["at"].to_numpy()] = got["word"].to_numpy()
    return out.view(_U)


def _place(node: np.ndarray, bits: int) -> np.ndarray:
    return (mix(node.view(_U) if node.dtype == _I else node) >> _U(64 - bits)).astype(_I)


def _held(words: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = _place(node, len(words).bit_length() + 5)
    return (words[at >> 6] >> (at & 63).astype(_U) & _U(1)) > 0


def _sets(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, set, size) for the nodes of clusters, set: sorted shingle hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                sh, offs, node = shingles(*utf8(batch.column(0).slice(a, b - a)))
                rows = np.flatnonzero(_held(sent.value, node))
                if len(rows):
                    sets = [np.unique(sh[offs[i] : offs[i + 1]]).tobytes() for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(sets, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64())], ["node", "set", "size"])

    made = docs.select("text").mapInArrow(run, "node long, set binary, size long")
    return made.join(found.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each node in a cell (as documents) and spanning edges."""
    node, side, weight = pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["weight"].to_numpy()
    sets = [np.frombuffer(s, _U) for s in pdf["set"]]
    size = np.array([len(s) for s in sets])
    offs = np.concatenate(([0], np.cumsum(size)))
    whole = np.concatenate(sets)
    sig = signatures(whole, offs)
    value, column = np.unique(whole, return_inverse=True)
    links = np.zeros(len(node), _I)
    lefts, rights = [np.zeros(0, _I)], [np.zeros(0, _I)]
    mark = np.zeros(len(value), bool)
    for left, right in _pairs(side):
        ok = surviving(sig, left, right)
        if not len(ok):
            continue
        i, js = left[0], right[ok]
        mark[column[offs[i] : offs[i + 1]]] = True
        both = np.array([np.count_nonzero(mark[column[offs[j] : offs[j + 1]]]) for j in js])
        mark[column[offs[i] : offs[i + 1]]] = False
        js = js[both >= THRESHOLD * (size[i] + size[js] - both) - 1e-9]
        links[i] += weight[js].sum()
        links[js] += weight[i]
        lefts.append(np.full(len(js), i))
        rights.append(js)
    edges = _spanning(node, np.concatenate(lefts), np.concatenate(rights))
    counted = links > 0
    return pd.concat([pd.DataFrame({"u": node[counted], "v": node[counted], "links": links[counted]}), edges.assign(links=0)])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id and n_links of every document."""
    lean(docs.sparkSession)
    sketched = settled(_sketched(docs))
    by_node = sketched.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = settled(by_node)
    found = settled(clusters(nodes))
    rows = settled(_sets(docs, found).join(nodes.select("node", "weight"), "node"))
    cells = _sized_cells(found, rows.select("node", "size")).join(rows.drop("size"), "node")
    checked = settled(cells.groupBy("cell").applyInPandas(_verified, "u long, v long, links long"))
    links = checked.where("u = v").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    linked = components(checked.where("u != v").select("u", "v"))
    plain = nodes.select("node", "weight", "least").join(linked, "node", "left").join(links, "node", "left")
    plain = settled(plain.select("node", F.coalesce("root", "node").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    names = plain.groupBy("root").agg(F.min("least").alias("class_id"))
    per_node = plain.join(names, "root").select("node", "class_id", "n_links", F.col("root").alias("class_node"))
    return sketched.select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "n_links", "node", "class_node")


def digests(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least id of every class; of rows that share that id,
    one."""
    kept = settled(classes(docs).groupBy("class_node").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select(low("k.doc_id").alias("__id"), F.col("k.node").alias("__node")))
    cols = docs.columns
    named = _with_node(docs).withColumn("__d", low("doc_id"))
    # Copies have ids of their own, so the join spreads even a node that is hot.
    stay = named.join(kept, (F.col("__n") == F.col("__node")) & (F.col("__d") == F.col("__id")))
    return stay.dropDuplicates(["__n", "__d"]).select(*cols)


def low(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def _with_node(docs: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                node = shingles(*utf8(part.column(at)))[2]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node)], [*part.schema.names, "__n"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__n", T.LongType())]))
