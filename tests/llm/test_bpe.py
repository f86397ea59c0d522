import hashlib
import random

import pytest

from siltstone.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_digests_equal_the_library(docs, empty, library):
    rows = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(docs, VOCABULARY).collect()}
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = rows[d["doc_id"], hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(empty, VOCABULARY).count() == 0


def test_odd_texts_and_unbroken_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_RUN", 20)
    monkeypatch.setattr(bpe, "_MASK_RUN", bpe.np.uint32(3))
    enc, r = bpe.ChunkEncoder(VOCABULARY, pieces=50, chunks=5), random.Random(1)
    alphabet = "aabcdEFs'tvrel!?.#09 \n\t  é́ßİΣς中文😀" + "<|>"
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(90)))
        if r.random() < 0.2:
            t += "<|endoftext|>" + t + " <|startoftext|>x"
        if r.random() < 0.3:
            t = t.replace(" ", "").replace("\n", "") * 2
        assert enc.encode(t) == enc.direct(t), t
