import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import langid

SOUNDS = {"aa": "ba ka ta ma", "bb": "ish osh ush esh", "cc": "ño ça çé éño"}


def rows(n=400, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SOUNDS))
        text = " ".join("".join(r.choice(SOUNDS[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60)))
        out.append((i, text.capitalize(), None if i % 10 == 0 else lang, lang))
    return out


def test_kernel_against_sets():
    texts = ["Hello, world", "hello wörld!", "abc", None, "12 34"]

    def grams(t):
        runs = "".join(c.lower() if c.isalpha() else " " for c in t or "")
        s = " ".join(runs.split())
        s = (" " if runs[:1] == " " and s else "") + s + (" " if runs[-1:] == " " and s else "")
        return {s[i : i + n] for n in range(1, langid.ORDER + 1) for i in range(len(s) - n + 1)} - {" "}

    whole = presence(texts)
    assert sorted(whole) == [0, 1, 2]
    held = np.concatenate([whole[i] for i in range(3)])
    sets = [grams(t) for t in texts]
    got = langid.kernel(held, held)
    for i in range(3):
        for j in range(3):
            want = len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5
            assert abs(got[i, j] - want) < 0.08


def presence(texts):
    """Presence of the lettered segments of each text."""
    out = {}
    for held, row, letters in langid.presence(*langid.utf8(pa.array(texts, pa.string()))):
        for h, r, n in zip(held, row, letters, strict=True):
            if n:
                out.setdefault(int(r), []).append(h)
    return {k: np.array(v) for k, v in out.items()}


def test_windows_give_the_segments_of_the_whole(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("aä b-ç中.") for _ in range(30_000))
    whole = presence([text, "x"])[0]
    monkeypatch.setattr(langid.windows, "__defaults__", (777,))
    assert np.array_equal(presence([text])[0], whole)
    # A segment is what a text of its own would be, but for n-grams that reach on.
    monkeypatch.setattr(langid, "SEGMENT", 10**9)
    assert len(presence([text])[0]) == 1


def test_score_does_not_fall_with_length():
    r = random.Random(6)
    model = langid.fit(np.concatenate([presence([t])[0][:1] for _, t, _, _ in rows()]), np.array([x[3] for x in rows()]))
    word = lambda: "".join(r.choice(SOUNDS["bb"].split()) for _ in range(3))
    score = [langid.predict(*langid.utf8(pa.array([" ".join(word() for _ in range(n))])), *model) for n in (300, 30_000)]
    assert score[0][0] == score[1][0] == ["bb"] and abs(score[0][1][0] - score[1][1][0]) < 0.1


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, text string, lang string, truth string, score string")
    got = langid.digests(df).collect()
    truth = {d: t for d, _, _, t in data}
    assert len(got) == len(data)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    # Neither label nor id decides a prediction.
    again = langid.classify(df.select("text"), langid.train(df)).collect()
    assert len(again) == len(data)


def test_odd_rows(docs, empty):
    got = langid.digests(docs).collect()
    assert len(got) == docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert langid.digests(empty).count() == 0
    assert {r["lang_pred"] for r in langid.digests(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    r = random.Random(8)
    letters = {f"l{i:03}": [chr(0x4E00 + 6 * i + k) for k in range(6)] for i in range(140)}
    data = [(i * 200 + j, "".join(r.choices(own, k=40)), lang) for i, (lang, own) in enumerate(letters.items()) for j in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.classify(df, langid.train(df)).collect()
    assert {x["__lang"] for x in got} == set(letters)
    assert np.mean([x["__lang"] == x["lang"] for x in got]) > 0.97
