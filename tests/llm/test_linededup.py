import hashlib
import random
from collections import defaultdict

import pytest

from siltstone.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    k = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows, least_chars=40, least_docs=5):
    seen = defaultdict(set)
    ids = [-(2**63) if d is None else d for d, _ in rows]
    for d, (_, t) in zip(ids, rows, strict=True):
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                seen[key_of(line)].add(d)
    out = []
    for d, (raw, t) in zip(ids, rows, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen[key_of(x)]) < least_docs or d == max(seen[key_of(x)])]
        out.append((raw, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in linededup.digests(df).collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    shared = [f"Shared LINE number {i} with éenough characters in it to count" for i in range(6)]
    rows = [(None, shared[0]), (None, None), (3, "")]
    for i in range(n):
        lines = [r.choice([shared[0], shared[0], "\t" + r.choice(shared).upper() + " \r", "short", f"own {i} " * 9, " " * 50]) for _ in range(r.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    return [*rows, rows[9], rows[9]]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_against_brute_force(spark, batch):
    rows = corpus(400, batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(d, t, "extra") for d, t in rows], "doc_id long, text string, keep string").repartition(5)
        assert got(df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plain_and_empty(docs, empty):
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    assert got(docs) == brute(rows)
    assert linededup.digests(empty).count() == 0


def test_bitmaps_hold_no_text(spark):
    rows = corpus(50, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    maps = linededup.keep_bitmaps(df)
    assert [f.name for f in maps.schema] == ["doc", "body", "n_lines", "n_dropped", "keep"]
    assert maps.where("n_dropped = 0").count() == 0
