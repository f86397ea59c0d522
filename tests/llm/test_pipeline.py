from collections import Counter

import corpus_pipeline as cp
import pytest

from siltstone.llm import linededup, mixing, neardup

pytest.importorskip("public_tokenizers")


def rows():
    line = "this line of a licence stands in very many documents, word for word"
    out = []
    for i in range(60):
        own = " ".join(f"wort{i}{j}" for j in range(40))
        out.append((i, own + ("\n" + line if i % 2 else ""), ["en", "de", None][i % 3], f"s{i % 4}", 5))
    out += [(100, out[3][1], "en", "s0", 5), (101, out[4][1].upper(), "de", "s1", 5), (102, "1234 !!", "en", "s1", 5), (103, None, "en", None, None), (104, line, "en", "s1", 5)]
    return out


def test_stages(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows(), columns).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.schema.names == docs.schema.names
            out.write.parquet(str(tmp_path / str(k)))
            out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(out.collect())
        docs = out
    by_lang, by_line, by_copy, by_mix, by_token = seen
    assert {r["doc_id"] for r in by_lang} == {*range(60), 100, 101, 104}
    assert {r["doc_id"] for r in by_line} >= {*range(60), 100, 101} and 104 in {r["doc_id"] for r in by_line}
    assert not [r for r in by_line if "licence" in r["text"] and r["doc_id"] != 104]
    assert all(r["n_chars"] == len(r["text"]) for r in by_line)
    assert Counter(r["doc_id"] for r in by_copy) == Counter([*range(60), 104])
    words = Counter()
    for r in by_mix:
        words[r["source"]] += len(r["text"].split())
    sizes = Counter()
    for r in by_copy:
        sizes[r["source"]] += len(r["text"].split())
    total, weight = sum(sizes.values()), {"s0": 1, "s1": 2, "s2": 3, "s3": 1}
    assert all(abs(words[s] - total * weight[s] / 7) <= 45 for s in weight)
    assert len(by_token) == len(by_mix) and all(r["ids"] and r["decoded"] for r in by_token)
    again = cp.run(spark, str(tmp_path))
    assert Counter(map(str, again.select("doc_id", "ids").collect())) == Counter(str(r) for r in docs.select("doc_id", "ids").collect())
