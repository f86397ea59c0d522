"""Line dedup over range-partitioned line hashes.

Every long line becomes a row (128-bit hash of its key, document, position).
The rows are range-partitioned by hash, document (largest first) and position
and sorted so within partitions; a streaming pass meets the first occurrence of
a key, its largest document, first, and marks the lines of later documents once
the key has been seen in enough of them.  Since the range key holds the document
too, a line that a third of all documents share spreads over many partitions.
Keys that touch the edge of a partition are settled by a second, small step over
counts; at most two keys a partition, so their verdicts may be broadcast.

The result is a bitmap per document that loses lines (bit i: line i stays),
compressed; documents without a row keep every line.  A document is identified
by doc_id and the hash of its text, so repeated ids do no harm; repeated rows of
one id count as one document.  Null ids are one document below all others.
Null and empty texts are one empty line.  Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lean, settled, slices

#: Fixed by the contract: blanks stripped from a key, its least length, and the documents that make it repeated.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
NO_ID = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "h1 long, h2 long, doc long, body long, pos int, n_lines int, decided boolean"


def identified(docs: DataFrame) -> DataFrame:
    """doc and body: what tells documents apart here."""
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__body", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    split = identified(docs).select("__doc", "__body", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("lines"))
    line = split.select("__doc", "__body", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = line.where(F.length("line") >= least_chars).withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length("key") >= least_chars)
    key = key.withColumn("key", F.translate("key", _UPPER, _LOWER))
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), F.col("__doc").alias("doc"), F.col("__body").alias("body"), "pos", "n_lines")


def _stream(least_docs: int):
    """Marks lines in order of (h1, h2, doc descending, body, pos).  Rows of the
    first and last key of a partition come out undecided."""

    names = ["h1", "h2", "doc", "body", "pos", "n_lines"]

    def settle(cols: list[np.ndarray], inner: np.ndarray) -> pa.RecordBatch:
        """Dropped lines of whole runs, and all lines of edge runs."""
        h1, h2, doc = cols[:3]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new) - 1
        newdoc = new.copy()
        newdoc[1:] |= doc[1:] != doc[:-1]
        docs = np.bincount(run, newdoc)
        first = np.cumsum(newdoc) - np.cumsum(newdoc)[np.flatnonzero(new)][run] == 0
        edge = ~inner[run] if len(run) else np.zeros(0, bool)
        take = np.where(edge, True, (docs[run] >= least_docs) & ~first) if len(run) else edge
        return pa.RecordBatch.from_arrays([*(pa.array(c[take]) for c in cols), pa.array(~edge[take])], [*names, "decided"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, is_first = None, True
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut == 0 and is_first:
                # One key fills the partition so far: at its edge, whatever follows.
                yield settle(cols, np.array([False]))
                held = [c[:0] for c in cols]
                first_key = (cols[0][-1], cols[1][-1])
                is_first = first_key
                continue
            if isinstance(is_first, tuple):
                # Rest of the first key.
                head = (cols[0] == is_first[0]) & (cols[1] == is_first[1])
                if head.any():
                    yield settle([c[head] for c in cols], np.array([False]))
                    cols = [c[~head] for c in cols]
                    if not len(cols[0]):
                        held = cols
                        continue
                    same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                    cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                is_first = False
            done, held = [c[:cut] for c in cols], [c[cut:] for c in cols]
            if cut:
                runs = int(np.sum((done[0][1:] != done[0][:-1]) | (done[1][1:] != done[1][:-1]))) + 1
                inner = np.ones(runs, bool)
                if is_first is True:
                    inner[0], is_first = False, False
                yield settle(done, inner)
        if held is not None and len(held[0]):
            yield settle(held, np.array([False]))

    return run


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, body, pos, n_lines of every line that goes."""
    spark = docs.sparkSession
    lean(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.desc("doc"), "body", "pos"]
    # Ranges are found by a sample, which would split all texts once more.
    lines = settled(long_lines(docs, least_chars)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    marks = settled(lines.mapInArrow(_stream(least_docs), _MARKS))
    edge = marks.where(~F.col("decided"))
    verdict = edge.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= least_docs)
    late = edge.join(F.broadcast(verdict), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    cols = ["doc", "body", "pos", "n_lines"]
    return marks.where("decided").select(*cols).unionByName(late.select(*cols))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, body, n_lines, n_dropped and the compressed keep bitmap of every
    document that loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            maps, counts = [], []
            for total, where in zip(n, gone, strict=True):
                keep = np.ones(total, bool)
                keep[where] = False
                counts.append(int(total - keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc", "body", "n_lines", "n_dropped", "keep"])

    per = dropped_lines(docs, least_chars, least_docs).groupBy("doc", "body", "n_lines").agg(F.collect_list("pos").alias("pos"))
    return per.mapInArrow(run, "doc long, body long, n_lines int, n_dropped long, keep binary")


def kept_lines(text: str, n_lines: int, keep: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join(line for line, bit in zip(text.split("\n"), bits, strict=True) if bit)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with what the bitmaps leave of their texts, and the columns
    __n_lines and __n_dropped."""
    has = bitmaps.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep"))
    joined = identified(docs).join(has, ["__doc", "__body"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lean(docs.sparkSession)
    whole = joined.withColumn("__n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, k, t = (batch.schema.get_field_index(c) for c in ("__n_lines", "__keep", "text"))
            for a, b in slices(batch.column(t)):
                part = batch.slice(a, b - a)
                keep = part.column(k)
                if keep.null_count < part.num_rows:
                    texts = [x if m is None else kept_lines(x, n, m) for x, n, m in zip(part.column(t).to_pylist(), part.column(at).to_pylist(), keep.to_pylist(), strict=True)]
                    part = part.set_column(t, part.schema.field(t), pa.array(texts, part.schema.field(t).type))
                yield part.drop_columns(["__keep"])

    cols = [c for c in whole.columns if c not in ("__doc", "__body")]
    whole = whole.select(*cols)
    out = whole.mapInArrow(run, whole.drop("__keep").schema)
    return out.withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0).cast("long")))


def digests(docs: DataFrame) -> DataFrame:
    src = docs.select("doc_id", "text")
    out = apply_bitmaps(src, keep_bitmaps(src))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.pos, l.line, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
