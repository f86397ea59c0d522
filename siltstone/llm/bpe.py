"""BPE encoding by content-defined chunk reuse.

A text is cut at blanks where a rolling hash of the four characters before meets
a mask, so equal passages are cut alike wherever they stand.  A chunk is encoded
once and reused for every document that holds it; so are, one scale down, the
pieces between blanks of a chunk not met before; a text's unknown pieces go to the
tokenizer together.  The tables are of bounded size,
one pair per Python worker, kept between tasks; the older half goes when full.
A run without any blank is cut by the same hash inside the run; there, two
neighbours are re-encoded together and merged until the pieces agree exactly with
the joint encoding.

Cuts at a blank agree by construction: no token, contraction, special token or
composed character of this vocabulary spans a blank that starts a chunk, and the
pre-tokenizer drops blanks.  Cuts inside a run carry no such promise, hence the
repair.

Null and empty texts give no ids and an empty decoded text.  Rows are never
merged or dropped, other columns pass through untouched, and a column that is
called like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.common import lean, slices

#: Pieces and chunks that a worker keeps in each of two halves, and the longest kept, in characters.
KEPT_PIECES, KEPT_CHUNKS = 160_000, 5_000
PIECE_CHARS, CHUNK_CHARS = 48, 1024
#: Characters of a run without blanks from which it is cut inside.
LONG_RUN = 4096
_MASK_BLANK, _MASK_RUN = np.uint32(31), np.uint32(0x3FF)


_LOWER = bytes(c + 32 * (ord("A") <= c <= ord("Z")) for c in range(256))


def _rolling(code: np.ndarray) -> np.ndarray:
    """Hash of the four characters that end just before each position."""
    c = np.zeros(len(code) + 4, np.uint32)
    c[4:] = code
    h = ((c[:-4] * np.uint32(31) + c[1:-3]) * np.uint32(37) + c[2:-2]) * np.uint32(41) + c[3:-1]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(15)


def cut_points(text: str, window: int = 1 << 17) -> tuple[list[int], set[int]]:
    """All cuts, and those inside a run without blanks; a window at a time."""
    cuts, hits, long_runs, last = [], [], [], 0
    for a in range(0, len(text), window):
        back = min(a, 4)
        code = np.frombuffer(text[a - back : a + window].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = _rolling(code)[back:]
        blank = (code[back:] == 32) | (code[back:] == 10)
        cuts.append(np.flatnonzero(blank & ((h & _MASK_BLANK) == 0)) + a)
        if len(text) > LONG_RUN:
            hits.append(np.flatnonzero((h & _MASK_RUN) == 0) + a)
            edges = np.concatenate(([last], np.flatnonzero(blank) + a, [len(text)] if a + window >= len(text) else []))
            wide = np.flatnonzero(np.diff(edges) > LONG_RUN)
            long_runs.extend(zip(edges[wide].tolist(), edges[wide + 1].tolist(), strict=True))
            last = int(edges[-1])
    at, inner = np.concatenate(cuts) if cuts else np.zeros(0, np.int64), set()
    if long_runs:
        where = np.concatenate(hits)
        for a, b in long_runs:
            inner.update(where[np.searchsorted(where, a + 1) : np.searchsorted(where, b)].tolist())
        at = np.unique(np.concatenate((at, np.fromiter(inner, np.int64, len(inner)))))
    return [0, *(x for x in at.tolist() if x), len(text)], inner


class Halves:
    """Table of bounded size; what was used since the last change of halves stays."""

    def __init__(self, kept: int):
        self.kept, self.new, self.old = kept, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, ids: bytes) -> None:
        if len(self.new) >= self.kept:
            self.old, self.new = self.new, {}
        self.new[key] = ids


class ChunkEncoder:
    """Ids of whole texts, through chunks that are encoded once."""

    def __init__(self, vocabulary: str, pieces: int = KEPT_PIECES, chunks: int = KEPT_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces, self.chunks = Halves(pieces), Halves(chunks)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def learned(self, pieces: dict[str, None]) -> dict[str, bytes]:
        """Ids of pieces that the table lacks: as many as fit are encoded together,
        a blank between, and told apart by the places of their tokens."""
        out: dict[str, bytes] = {}
        # Letters and a mark that follows them are always two pre-tokens.
        marked = {p: None for p in pieces if len(p) > 1 and p[-1] in ",." and p[:-1].isalpha()}
        alone = {p: None for p in pieces if p and p not in marked}
        for p in marked:
            for half in (p[:-1], p[-1]):
                if (ids := self.pieces.get(half)) is None:
                    alone[half] = None
                else:
                    out[half] = ids
        joint = [p for p in alone if "<|" not in p and len(p) <= PIECE_CHARS]
        for p in alone.keys() - set(joint):
            out[p] = self.direct(p)
        for a in range(0, len(joint), 1024):
            some = joint[a : a + 1024]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, places = np.array(got.ids, np.int32), np.array([at for at, _ in got.offsets], np.int64)
            starts = np.cumsum([0, *(len(p) + 1 for p in some[:-1])])
            cuts = [*np.searchsorted(places, starts).tolist(), len(ids)]
            for p, i, j in zip(some, cuts, cuts[1:], strict=False):
                out[p] = ids[i:j].tobytes()
        for p in marked:
            out[p] = out[p[:-1]] + out[p[-1]]
        for p in out:
            if len(p) <= PIECE_CHARS:
                self.pieces.put(p, out[p])
        out[""] = b""
        return out

    def chunked(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; those not met before are put together from pieces."""
        out = [self.chunks.get(c) for c in chunks]
        lacking = [i for i, ids in enumerate(out) if ids is None]
        if not lacking:
            return out
        get, split = self.pieces.get, {}
        for i in lacking:
            if chunks[i] not in split:
                names = chunks[i].replace("\n", " ").split(" ")
                split[chunks[i]] = names, [get(p) for p in names]
        fresh = self.learned(dict.fromkeys(p for names, ids in split.values() for p, x in zip(names, ids, strict=True) if x is None))
        for c, (names, ids) in split.items():
            split[c] = b"".join([fresh[p] if x is None else x for p, x in zip(names, ids, strict=True)])
            if len(c) <= CHUNK_CHARS:
                self.chunks.put(c, split[c])
        for i in lacking:
            out[i] = split[chunks[i]]
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            # The vocabulary is lower case; only special tokens are found before that.
            text = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        cuts, inner = cut_points(text)
        if inner:
            # A special token's string is found before all else: no cut inside one.
            within = {c for m in self.special.finditer(text) for c in range(m.start() + 1, m.end())}
            cuts = [c for c in cuts if c not in within or c not in inner]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        done = [x for a in range(0, len(parts), 4096) for x in self.chunked(parts[a : a + 4096])]
        return self._repaired(parts, done, [c in inner for c in cuts[1:-1]]) if inner else b"".join(done)

    def _repaired(self, parts: list[str], alone: list[bytes], unsure: list[bool]) -> bytes:
        """Join from the left; at an unsure join, take both sides together until
        what stands alone on each side is what the joint encoding says."""
        done, left, left_ids = [], parts[0], alone[0]
        for right, ids, check in zip(parts[1:], alone[1:], unsure, strict=True):
            if check and (joint := self.direct(left + right)) != left_ids + ids:
                left, left_ids = left + right, joint
                continue
            done.append(left_ids)
            left, left_ids = right, ids
        return b"".join([*done, left_ids])


@cache
def _encoder(vocabulary: str) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)


@cache
def _pieces(vocabulary: str) -> list[str]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    if t.decoder is not None:
        raise ValueError("this vocabulary has a decoder of its own")
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab(True).values()) + 1)]


@cache
def _numbers(vocabulary: str) -> list[str]:
    return [str(i) for i in range(len(_pieces(vocabulary)))]


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, f in enumerate(batch.schema.names) if f != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], [*(batch.schema.names[i] for i in keep), name])


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def _ids(rows: list[bytes]) -> pa.ListArray:
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _decoded(vocabulary: str):
    """From ids as bytes to the text that the library's decode gives, special tokens
    included: this vocabulary has no decoder, so its pieces with a blank between."""
    piece = _pieces(vocabulary).__getitem__
    return lambda ids: " ".join(map(piece, memoryview(ids).cast("i")))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of every whole text as array<int> and, if asked, the text
    that they decode to, in the same pass."""
    lean(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, back = _encoder(vocabulary), _decoded(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(text)):
                part = batch.slice(a, b - a)
                rows = [enc.encode(t) for t in part.column(text).to_pylist()]
                out = _replaced(part, ids, _ids(rows))
                yield _replaced(out, decoded, pa.array(list(map(back, rows)), pa.string())) if decoded else out

    kind = _added(df, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        kind = T.StructType([f for f in kind if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    return df.mapInArrow(run, kind)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the ids decode to; a null list gives a null text."""
    lean(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decoded(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(ids)
                values, offs = rows.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), rows.offsets.to_numpy()
                yield _replaced(part, out, pa.array([back(values[a:b].tobytes()) if ok else None for a, b, ok in zip(offs, offs[1:], rows.is_valid().to_pylist(), strict=False)], pa.string()))

    return df.mapInArrow(run, _added(df, out, T.StringType()))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a document: number of tokens, digests of ids and decoded text.  Ids
    and texts don't leave the workers."""
    src = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, back, number = _encoder(vocabulary), _decoded(vocabulary), _numbers(vocabulary).__getitem__
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows = [enc.encode(t) for t in part.column(1).to_pylist()]
                listed = (sha(" ".join(map(number, memoryview(r).cast("i")))) for r in rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array(listed, pa.string()), pa.array((sha(back(r)) for r in rows), pa.string())], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
