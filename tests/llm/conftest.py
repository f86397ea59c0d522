import random

import pytest

WORD = "the of and alpha beta gamma delta epsilon éclair straße ñandú".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, id long, fingerprint string, key string"


def sample_rows(n=120, seed=3):
    """Nulls in every column, empty, blank, odd and long texts, ties and repeats."""
    r = random.Random(seed)
    texts = [None, "", " ", "\n\n", "a", "one two three four", "x" * 9000, "'s don't <|endoftext|> é İ   中文字 😀", "same line here that is quite long, over forty\n" * 6]
    for _ in range(n):
        texts.append("\n".join(" ".join(r.choice(WORD) + str(r.randrange(9)) * (r.random() < 0.3) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 6))))
    texts += texts[9:20]
    texts.append(" ".join(r.choice(WORD) for _ in range(20_000)))
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or ""), "clash", 1, "x", "k") for i, t in enumerate(texts)]
    return [*rows, rows[30], (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(sample_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
