import os

import random

import duckdb
import pytest

from siltstone.llm import quotes


def thread_rows(seed, turns=40):
    """Conversations in which messages quote earlier ones, nested and re-wrapped."""
    r = random.Random(seed)
    rows = []
    for conv in (1, 2, None):
        said = []
        for turn in range(turns if conv == 1 else 8):
            own = [" ".join(r.choice("ja nein vielleicht gut Stein Wasser Haus".split()) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(1, 3))]
            lines = []
            if said and r.random() < 0.75:
                parent = r.choice(said)
                if r.random() < 0.5:
                    lines.append("Someone wrote:")
                lines += [">" + (" " if not x.startswith(">") else "") + x for x in r.choice([parent["lines"], parent["own"][:1]])]
                lines.append("")
            for i, o in enumerate(own):
                lines += [o] if i == 0 else ["", o]
            said.append({"own": own, "lines": lines})
            rows.append((conv, turn, r.choice(["user", "assistant"]), "\n".join(lines), "extra"))
    rows += [(3, 0, "user", None, ""), (3, 1, None, "", ""), (None, None, "user", "> ja", ""), (4, 0, "u", ">> deep\n> Hello  THERE\nhi", ""), (4, 1, "u", "x", ""), (5, 0, "u", "hello there", ""), (5, 1, "u", "> Hello\n> THERE\n\nhi", ""), (5, 2, "u", ">> hello there\n> hi\nyes", "")]
    return [*rows, rows[4]]


@pytest.mark.parametrize("turns", [1024, 4])
def test_against_sql(spark, monkeypatch, turns):
    monkeypatch.setattr(quotes, "TURNS", turns)
    rows = thread_rows(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent_turn string").repartition(3)
    got = sorted((tuple(r) for r in quotes.linked(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert got == sorted(con.execute(quotes.ORACLE_SQL).fetchall(), key=str)
    assert any(g[7] > 2 for g in got)


def test_reading(spark):
    own, passages = quotes.parse("Ann wrote:\n> > old\n> new  Words\n> here\n\nmine\n")
    assert own == "mine" and passages == [(2, "old"), (1, "new words here"), (0, "mine")]
    df = spark.createDataFrame(thread_rows(7), "conv_id long, turn long, role string, text string, x string")
    place = {}
    for i, r in enumerate(quotes.ordered(df).collect()):
        place.setdefault((r["conv_id"], r["turn"]), i)
        assert r["parent_turn"] is None or place[r["conv_id"], r["parent_turn"]] < i
    assert quotes.linked(df.limit(0)).count() == 0


def test_quoting_documents_against_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}'")
    want = con.sql(quotes.REPLIES_SQL)
    got = quotes.linked(quotes.replies(spark.read.parquet(at)))
    assert sorted(want.columns) == sorted(got.columns)
    cols = want.columns
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(r)) for r in want.fetchall())
    assert sum(r["parent_turn"] is not None for r in got.collect()) > 100
