"""Content operators over tables that hold content in a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.content import chunk_array, fingerprint, is_binary, sha256, version_equal
from siltstone.options import ScanOptions


def inspect(files: DataFrame, options: ScanOptions, content: str = "content") -> DataFrame:
    """Adds content_hash, content_fingerprint, binary_checked and skip_kind.  What
    the options don't ask for isn't computed, so the content column is pruned."""
    if not options.reads_content:
        return files.withColumns({"content_hash": F.lit(None).cast("string"), "content_fingerprint": F.lit(None).cast("string"), "binary_checked": F.lit(False), "skip_kind": F.lit(None).cast("string")})
    body = F.col(content).cast("binary")
    hashed = sha256(body) if options.hash_file_contents else F.lit(None).cast("string")
    binary = F.when(is_binary(body), "Binary") if options.detect_binary_files else F.lit(None).cast("string")
    return files.withColumns({"content_hash": hashed, "content_fingerprint": fingerprint(body), "binary_checked": F.lit(options.detect_binary_files), "skip_kind": binary})


def chunks(files: DataFrame, content: str = "content", size: int = 65_536, *keys: str) -> DataFrame:
    """One row a chunk: keys, chunk_index, offset, bytes."""
    return files.select(*(keys or ("relative",)), F.explode(chunk_array(F.col(content).cast("binary"), size)).alias("c")).select(*(keys or ("relative",)), "c.*")


def visit(files: DataFrame, take: Column | None = None, content: str = "content", size: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """Events and counters of a content visit.  `take` says, per file, how many
    chunks the consumer wants; fewer than there are means it skipped the rest.
    A consumer commits a file on its FileEnd row only, for tasks may run twice."""
    body = F.col(content).cast("binary")
    n = F.ceil(F.octet_length(body) / size).cast("int")
    want = F.least(n, take) if take is not None else n
    parts = F.slice(chunk_array(body, size), F.lit(1), F.greatest(want, F.lit(0)))
    sent = F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["bytes"])), F.lit(0))
    rows = files.select("relative", F.octet_length(body).cast("long").alias("bytes"), sha256(body).alias("content_hash"), F.size(parts).alias("chunks"), sent.alias("emitted"), (want < n).alias("consumer_skipped"))
    status = F.when(F.col("consumer_skipped"), "Skipped").otherwise("Selected")
    events = rows.select("relative", status.alias("status"), "chunks", F.col("emitted").alias("bytes_emitted"), F.when(~F.col("consumer_skipped"), F.col("content_hash")).alias("content_hash"))
    counters = rows.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(~F.col("consumer_skipped")).alias("completed"),
        F.count(F.lit(1)).alias("opened"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"),
        F.coalesce(F.sum("emitted"), F.lit(0)).cast("long").alias("bytes_emitted"),
        F.count_if("consumer_skipped").alias("consumer_skipped"),
    )
    return events, counters


def visited(contents: DataFrame, visitor: Callable[[], Callable[[str, dict], str | None]], size: int, no_binary: bool, schema: str) -> DataFrame:
    """A row a file, from visitors that are made once a partition and see FileStart,
    Chunk and FileEnd of each.  After Quit the rest of a partition isn't handed out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(call: Callable[[str, dict], str | None], file: dict) -> tuple:
        about = {"relative": file["relative"]}
        if file["content_status"] != "Complete" or (no_binary and file["binary"]):
            status = "Binary" if file["content_status"] == "Complete" else file["content_status"]
            return file["relative"], status, file["content_status"] != "IoError", 0, 0, 0, False, None, False
        body = bytes(file["content"])
        answer, sent, n, at = call("FileStart", about | {"bytes": len(body)}), 0, 0, 0
        while answer not in ("SkipFile", "Quit") and at < len(body):
            piece = body[at : at + size]
            answer = call("Chunk", about | {"offset": at, "chunk": piece})
            n, sent, at = n + 1, sent + len(piece), at + len(piece)
        left = answer in ("SkipFile", "Quit") and at < len(body)
        status, digest = ("Skipped", None) if left else ("Selected", file["content_hash"])
        end = call("FileEnd", about | {"status": status, "bytes_read": len(body), "content_hash": digest, "consumer_skipped": left})
        return file["relative"], status, True, n, len(body), sent, left, digest, "Quit" in (answer, end)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = visitor()
        for pdf in parts:
            rows = []
            for file in pdf.to_dict("records"):
                rows.append(one(call, file))
                if rows[-1][-1]:
                    break
            yield pd.DataFrame(rows, columns=names)
            if rows and rows[-1][-1]:
                return

    return contents.select("relative", "content", "content_hash", "binary", "content_status").mapInPandas(run, schema)


def reassembled(chunk_rows: DataFrame, *keys: str) -> DataFrame:
    """Content of each file, from its chunks in any order."""
    keys = keys or ("relative",)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", F.hex("bytes").alias("h"))))
    return chunk_rows.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(ordered, lambda c: c["h"]), "")).alias("content"))


def with_cache(files: DataFrame, cache: DataFrame, options: ScanOptions) -> DataFrame:
    """Adds `reusable`, `cached_hash` and `cached_fingerprint`.  Fast trusts equal size and version;
    Strict compares the content's fingerprint as well (only then is it read)."""
    c = cache.select(F.col("relative").alias("__relative"), F.struct(*(x for x in cache.columns if x != "relative")).alias("__c"))
    out = files.join(c, F.col("relative") == F.col("__relative"), "left").drop("__relative")
    old = F.col("__c")
    ok = (old["bytes"] == F.col("bytes")) & version_equal(old["version"], F.col("version")) & old["content_hash"].startswith("sha256:")
    if options.detect_binary_files:
        ok = ok & old["binary_checked"]
    if options.cache_validation == "Strict":
        ok = ok & (old["content_fingerprint"] == F.col("content_fingerprint"))
    ok = F.coalesce(ok, F.lit(False))
    return out.withColumn("reusable", ok).withColumn("cached_hash", F.when(ok, old["content_hash"])).withColumn("cached_fingerprint", F.when(ok, old["content_fingerprint"])).drop("__c")


def cache_stats(cached: DataFrame, options: ScanOptions) -> DataFrame:
    strict = options.cache_validation == "Strict"
    return cached.agg(F.count_if("reusable").alias("reused_hashes"), F.count_if(~F.col("reusable")).alias("content_reads"), (F.count_if("reusable") if strict else F.lit(0).cast("long")).alias("fingerprint_reads"))


def verify_snapshot(manifest: DataFrame, current: DataFrame, requested: DataFrame) -> DataFrame:
    """status of each requested path: Ok, Stale (content differs from what the
    manifest says), UnknownFile (not in the manifest) or Io (gone)."""
    m = manifest.select("relative", F.col("bytes").alias("m_bytes"), F.col("content_hash").alias("m_hash"), F.lit(True).alias("known"))
    c = current.select("relative", F.col("bytes").alias("c_bytes"), F.col("content_hash").alias("c_hash"), F.lit(True).alias("there"))
    out = requested.select("relative").distinct().join(m, "relative", "left").join(c, "relative", "left")
    same = (F.col("m_bytes") == F.col("c_bytes")) & F.coalesce(F.col("m_hash") == F.col("c_hash"), F.lit(True))
    status = F.when(F.col("known").isNull(), "UnknownFile").when(F.col("there").isNull(), "Io").when(same, "Ok").otherwise("Stale")
    return out.select("relative", status.alias("status"))
