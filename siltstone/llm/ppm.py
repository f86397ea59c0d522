"""Language-model scoring by prediction by partial matching over bytes.

Training counts every (context of ORDER bytes, next byte) of the lower-cased
training texts, with start marks before a text and an end symbol after it; lower
orders are sums of these, so a symbol seen after a context is also seen after
each shorter one.  Escapes are estimated as in method D (half the distinct
symbols over the total), and symbols already offered by a longer context are
excluded from the shorter one.  Since the symbols of a context are among those of
its suffix, what is excluded at a level depends only on the context one level up,
so the exclusion sums are worked out once per context and a score takes one
lookup per level that is visited.

Every gram of the training texts counts, however rare.  A score depends on the
gram alone, so each distinct gram of all texts is scored once, in a table that
grows with the corpus: orders of at most SHARED grams go to all tasks, and the
grams are dealt out by the last bytes of context that these cover, so that a task
holds all higher orders of its grams.  The most frequent grams, 2**GRAMS at most,
are sent with their scores; occurrences of others are joined.

`code_lengths(adaptive=True)` instead starts from an empty trie in each document
and counts as it goes.

Unigram figures come beside it: tokens with a share of 2**-HEAD or more (at most
2**HEAD of them) are sent as a table, occurrences of rarer tokens are joined.

Null texts are empty; null ids form a document like others; duplicates score
alike; an empty table, or no training text, gives base and model scores of a
uniform choice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, SLICE_BYTES, fold, lean, mix, settled, slices, spans_hash, utf8, words

#: Bytes of context; the packed gram of ORDER + 1 symbols of 9 bits must fit 63 bits.
ORDER = 5
GRAMS, HEAD = 20, 19
#: Grams of an order that every task may hold (order 1 always fits), and that a task scores, about.
SHARED, PART = 1 << 17, 100_000
#: Keys that one row carries at most, about, before a long text is given several.
MOST_KEYS = 1 << 16
#: Symbols besides the 256 bytes.
END, START, SYMBOLS = 256, 257, 257
_BITS = 9
_I = np.int64
#: Marks grams of texts held out while they are counted.
_HELD = 1 << 60


def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every byte and text end, and the row of each."""
    n, lens = len(offs) - 1, np.diff(offs)
    # Each text is laid out as `order` start marks, its bytes, and the end symbol.
    row = np.repeat(np.arange(n, dtype=np.int32), lens + 1)
    inner = np.arange(len(row)) + (row + 1) * np.int64(order)
    ends = np.cumsum(lens + 1) - 1
    symbol = np.empty(len(row), _I)
    symbol[ends] = END
    body = np.ones(len(row), bool)
    body[ends] = False
    symbol[body] = LOWER[data]
    seq = np.full(len(row) + n * order, START, _I)
    seq[inner] = symbol
    return _packed(seq, order)[inner - order], row


def _packed(seq: np.ndarray, order: int) -> np.ndarray:
    """Every symbol of a sequence with the `order` symbols before it, as one number."""
    m = max(0, len(seq) - order)
    key = seq[:m].copy()
    for k in range(1, order + 1):
        key <<= _BITS
        key |= seq[k : k + m]
    return key


def gram_windows(data: np.ndarray, offs: np.ndarray, order: int = ORDER, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`grams` of a slice; one long text comes a window at a time."""
    if len(offs) != 2 or len(data) <= most:
        yield grams(data, offs, order)
        return
    for a in range(0, len(data), most):
        b = min(len(data), a + most)
        before = LOWER[data[max(0, a - order) : a]]
        seq = np.concatenate((np.full(order - len(before), START, _I), before, LOWER[data[a:b]], np.full(int(b == len(data)), END, _I)))
        key = _packed(seq, order)
        yield key, np.zeros(len(key), np.int32)


def suffix(order: int) -> int:
    """Mask that leaves the last `order` bytes of context and the symbol."""
    return (1 << (_BITS * (order + 1))) - 1


class Table:
    """Read-only map from int64 keys to rows, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, _I)
        self.rows = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            where, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[where], self.rows[where] = keys[put], put
            again = self.keys[slot] != keys[left]
            left, slot = left[again], (slot[again] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(_I)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class Trie:
    """Counts of all orders and the escape figures of every context."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: packed grams and their counts, from order 0 up.  A gram of a
        level must be there, with its first byte cut off, one level down."""
        self.order, self.levels = len(levels) - 1, []
        for gram, count in levels:
            at = np.argsort(gram)
            gram, count = gram[at], count[at].astype(float)
            ctx, node = np.unique(gram >> _BITS, return_inverse=True)
            self.levels.append({"gram": gram, "count": count, "ctx": ctx, "node": node, "total": np.bincount(node, count, len(ctx)), "distinct": np.bincount(node, minlength=len(ctx)).astype(float)})
        self._solve()

    @classmethod
    def of(cls, keys: np.ndarray, order: int = ORDER) -> Trie:
        """The trie of packed grams of the full order, unpruned."""
        return cls([np.unique(keys & suffix(k), return_counts=True) for k in range(order + 1)])

    def _solve(self) -> None:
        """Log probabilities: of a gram when nothing was excluded (`top`) and its
        log count (`lc`); of a context, the escape from it as the longest one
        (`esc`), and after escaping it, the log of its suffix's remaining total
        (`rest`) and the escape from that suffix (`esc2`)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, lv in enumerate(self.levels):
                lv["grams"], lv["ctxs"] = Table(lv["gram"]), Table(lv["ctx"])
                lv["lc"] = np.log10(lv["count"] - 0.5)
                lv["top"] = np.log10(lv["total"])
                lv["esc"] = np.log10(lv["distinct"] / 2) - lv["top"]
                if k:
                    low = self.levels[k - 1]
                    keep = (1 << (_BITS * k)) - 1
                    parent = low["ctxs"].find(lv["ctx"] & (keep >> _BITS))
                    sym = low["grams"].find(lv["gram"] & keep)
                    assert (parent >= 0).all() and (sym >= 0).all(), "every symbol of a context follows its suffix"
                    rest = low["total"][parent] - np.bincount(lv["node"], low["count"][sym], len(lv["ctx"]))
                    novel = low["distinct"][parent] - lv["distinct"]
                    lv["rest"] = np.log10(np.maximum(rest, 1))
                    lv["esc2"] = np.where(novel > 0, np.log10(np.maximum(novel, 1) / 2) - lv["rest"], 0.0)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of every gram."""
        out = np.zeros(len(key))
        left, gram, came = np.arange(len(key)), key, np.full(len(key), -1, np.int32)
        for k in range(self.order, -1, -1):
            lv = self.levels[k]
            gram = gram & ((1 << (_BITS * (k + 1))) - 1)
            row = lv["grams"].find(gram)
            seen, fresh = row >= 0, came < 0
            above = self.levels[k + 1] if k < self.order else None
            if seen.any():
                hit = row[seen]
                norm = lv["top"][lv["node"][hit]]
                if above is not None:
                    norm = np.where(fresh[seen], norm, above["rest"][came[seen]])
                out[left[seen]] += lv["lc"][hit] - norm
            left, gram, came, fresh = left[~seen], gram[~seen], came[~seen], fresh[~seen]
            if not len(left):
                return out
            ctx = lv["ctxs"].find(gram >> _BITS)
            step = np.where(ctx >= 0, lv["esc"][ctx] if len(lv["ctx"]) else 0.0, 0.0)
            if above is not None:
                step = np.where(fresh, step, above["esc2"][came])
            out[left] += step
            came = ctx
        known = len(self.levels[0]["gram"])
        out[left] -= math.log10(max(1, SYMBOLS - known))
        return out


def adaptive_length(data: np.ndarray, order: int = ORDER) -> float:
    """log10 probability of one lower-cased text by a trie that starts empty."""
    seen: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]
    total, text = 0.0, bytes(data)
    for i in range(len(text) + 1):
        s = text[i] if i < len(text) else END
        out: set[int] = set()
        found = False
        for k in range(min(order, i), -1, -1):
            node = seen[k].get(text[i - k : i])
            if node:
                n = sum(c for x, c in node.items() if x not in out)
                d = sum(x not in out for x in node)
                if s in node and s not in out:
                    total += math.log10((node[s] - 0.5) / n)
                    found = True
                    break
                if d:
                    total += math.log10(d / 2 / n)
                out.update(node)
        if not found:
            total -= math.log10(SYMBOLS - len(out))
        for k in range(min(order, i) + 1):
            node = seen[k].setdefault(text[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return total


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n in training texts, more in texts held out, over the columns text and
    held_out; combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, waiting = (np.zeros(0, _I), np.zeros(0, _I)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([held[0], *(k for k, _ in fresh)]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([held[1], *(n for _, n in fresh)]), len(keys)).astype(_I)

        for batch in batches:
            for a, b in slices(batch.column(0)):
                out = np.where(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), _HELD, 0)
                for key, row in gram_windows(*utf8(batch.column(0).slice(a, b - a)), order):
                    fresh.append(np.unique(key | out[row], return_counts=True))
                    waiting += len(fresh[-1][0])
                    # What has come since is merged once it outweighs half of what is held.
                    if waiting > 200_000 + len(held[0]) // 2:
                        held, fresh, waiting = merged(), [], 0
        held_k, held_n = merged()
        out = held_k >= _HELD
        key, back = np.unique(held_k & (_HELD - 1), return_inverse=True)
        n, more = (np.bincount(back[x], held_n[x], len(key)).astype(_I) for x in (~out, out))
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (key, n, more)], ["gram", "n", "more"])

    return docs.select("text", "held_out").mapInArrow(run, "gram long, n long, more long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("more").alias("more"))


def train(docs: DataFrame, order: int = ORDER, prune: int | None = None) -> DataFrame:
    """gram, occurrences and score of every distinct gram of the texts, by the counts
    of those not held out.  If `prune` is given, training grams of every order with
    a share of less than 2**-prune are taken as not seen."""
    spark = docs.sparkSession
    counts = settled(gram_counts(docs, order))
    rows, total = counts.agg(F.count("n"), F.sum("n")).first()
    least = 1 if prune is None else max(1, (total or 0) / 2**prune)
    low = []
    for k in range(order):
        level = counts.groupBy(F.col("gram").bitwiseAND(F.lit(suffix(k))).alias("gram")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        got = level.limit(SHARED + 1).toArrow()
        if got.num_rows > SHARED:
            break
        low.append((got["gram"].to_numpy().astype(_I), got["n"].to_numpy()))
    sent = spark.sparkContext.broadcast(low)
    # Grams that agree in as many bytes of context as there are shared orders go together.
    shared = F.shiftright("gram", _BITS).bitwiseAND(F.lit((1 << (_BITS * len(low))) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        gram, n, more = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
        levels = list(sent.value)
        for k in range(len(levels), order + 1):
            key, back = np.unique(gram & suffix(k), return_inverse=True)
            count = np.bincount(back, n, len(key))
            levels.append((key[count >= least], count[count >= least]))
        score = Trie(levels).score(gram)
        for a in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (gram, n + more, score)], ["gram", "n", "score"])

    return settled(counts.repartition(rows // PART + 1, shared).mapInArrow(run, "gram long, n long, score double"))


def _split(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The most frequent grams, at most `most`, the others, and how many these are."""
    rank = F.floor(F.log2("n") * 16)
    sizes = {r["rank"]: r["count"] for r in table.groupBy(rank.alias("rank")).count().collect()}
    cut, room = math.inf, most
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        cut = at
    left = sum(x for at, x in sizes.items() if at < cut)
    first = rank >= F.lit(float(cut))
    return table.where(first), table.where(~first), left


def token_counts(texts: DataFrame) -> DataFrame:
    """token (64-bit hash of a lower-cased word), n; text ends are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                data, offs = utf8(batch.column(0).slice(a, b - a))
                data = LOWER[data]
                s, e, _ = words(data, offs)
                k, n = np.unique(spans_hash(data, s, e).view(_I), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(_I))], ["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, held_mod: int = 7, held_rem: int = 2, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, counts, unigram and model scores of every document."""
    spark = docs.sparkSession
    lean(spark)
    src = docs.select("doc_id", "text", (fold("doc_id", held_mod) == held_rem).alias("held_out"))
    learn = src.where(~F.col("held_out")).select("text")
    often, seldom, n_seldom = _split(train(src.select("text", "held_out"), order), 2**GRAMS)
    often = often.select("gram", "score").toArrow()
    top = Table(often["gram"].to_numpy().astype(_I)), often["score"].to_numpy()
    tokens = settled(token_counts(learn))
    n_docs = learn.count()
    stats = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    n_all, n_types = stats[0] + n_docs, stats[1] + (n_docs > 0)
    least = max(1.0, n_all / 2**HEAD)
    head = tokens.where(F.col("n") >= least).toArrow()
    rare = stats[1] - head.num_rows
    keys, ns = head["token"].to_numpy().astype(_I), head["n"].to_numpy().astype(_I)
    at = np.argsort(keys)
    model = spark.sparkContext.broadcast((top, keys[at], ns[at], n_all, n_types, n_docs))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "head", "n_rare", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, gram_scores), keys, ns, n_all, n_types, n_docs = model.value
        whole = math.log10(n_all + n_types + 1)

        def batch_of(part: pa.RecordBatch, sums: list[np.ndarray], rare: list[np.ndarray], grams: list[np.ndarray], head: bool) -> pa.RecordBatch:
            """rare and grams: values, then the row of each."""
            n = part.num_rows
            owner = np.concatenate((rare[1], grams[1]))
            by = np.argsort(owner, kind="stable")
            lists = _lists(np.concatenate((rare[0], grams[0]))[by], owner[by], n)
            cols = [part.column(3), part.column(0), part.column(2), *map(pa.array, sums), pa.array(np.full(n, head)), pa.array(np.bincount(rare[1], minlength=n).astype(_I)), lists]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offs = utf8(part.column(1))
                data, n = LOWER[data], part.num_rows
                s, e, row = words(data, offs)
                token = spans_hash(data, s, e).view(_I)
                where = np.minimum(np.searchsorted(keys, token), max(0, len(keys) - 1))
                known = keys[where] == token if len(keys) else np.zeros(len(token), bool)
                count = np.where(known, ns[where] if len(keys) else 0, 0)
                # The end of a text is a token of every text.
                n_tokens = np.bincount(row, minlength=n) + 1
                base = np.bincount(row, np.log10(count + 1.0), n) + math.log10(n_docs + 1) - n_tokens * whole
                n_known = (np.bincount(row[known], minlength=n) + (n_docs > 0)).astype(_I)
                rare, model_score = [token[~known], row[~known]], np.zeros(n)
                sums = [n_tokens.astype(_I), n_known, base, model_score]
                nothing = [np.zeros(0, _I), np.zeros(0, _I)]
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for key, owner in gram_windows(data, offs, order):
                    where = table.find(key)
                    seen = where >= 0
                    model_score += np.bincount(owner[seen], gram_scores[where[seen]], n)
                    held.append((key[~seen], owner[~seen]))
                    # One long text leaves in several rows, the last of which is the document's.
                    if n == 1 and len(held[-1][0]) + len(rare[0]) > MOST_KEYS:
                        for i in range(0, len(rare[0]), MOST_KEYS):
                            yield batch_of(part, sums, [x[i : i + MOST_KEYS] for x in rare], nothing, False)
                        yield batch_of(part, sums, nothing, list(held.pop()), False)
                        rare = nothing
                yield batch_of(part, sums, rare, [np.concatenate([h[i] for h in held]) if held else nothing[i] for i in range(2)], True)

    kind = src.schema["doc_id"].dataType.simpleString()
    numbered = src.withColumn("row", F.monotonically_increasing_id())
    out = numbered.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, head boolean, n_rare long, keys array<long>")
    out = _with_rare(settled(out), tokens.where(F.col("n") < least), seldom) if rare or n_seldom else out.where("head")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows; the rows ascend."""
    lo = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=lo[1:])
    return pa.ListArray.from_arrays(pa.array(lo), pa.array(values))


def _with_rare(scored: DataFrame, rare: DataFrame, seldom: DataFrame) -> DataFrame:
    """Adds what occurrences of rare training tokens and of seldom grams bring, by
    joins on the token or gram and back on the number of the row."""
    each = scored.select("row", "n_rare", F.posexplode("keys").alias("pos", "key")).select("row", "key", (F.col("pos") >= F.col("n_rare")).alias("is_gram"))
    brings = rare.select(F.col("token").alias("key"), F.lit(False).alias("is_gram"), F.log10(F.col("n") + 1.0).alias("gain")).unionByName(seldom.select(F.col("gram").alias("key"), F.lit(True).alias("is_gram"), F.col("score").alias("gain")))
    gain = each.join(brings, ["key", "is_gram"]).groupBy("row").agg(F.count_if(~F.col("is_gram")).alias("more"), F.sum(F.when(~F.col("is_gram"), F.col("gain"))).alias("gain"), F.sum(F.when(F.col("is_gram"), F.col("gain"))).alias("gram_gain"))
    out = scored.where("head").drop("keys").join(gain, "row", "left")
    for to, add in (("n_known", "more"), ("base_score", "gain"), ("score", "gram_gain")):
        out = out.withColumn(to, F.col(to) + F.coalesce(add, F.lit(0)))
    return out


def code_lengths(docs: DataFrame, adaptive: bool = True, trie: Trie | None = None, order: int = ORDER) -> DataFrame:
    """doc_id and bits of every document, adaptive or by a given trie (`Trie.of`)."""
    src = docs.select("doc_id", "text")
    sent = None if adaptive else docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offs = utf8(part.column(1))
                data = LOWER[data]
                if adaptive:
                    got = np.array([adaptive_length(data[x:y], order) for x, y in zip(offs, offs[1:], strict=False)])
                else:
                    got = sum(np.bincount(owner, sent.value.score(key), part.num_rows) for key, owner in gram_windows(data, offs, sent.value.order))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(-got / math.log10(2))], ["doc_id", "bits"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bits double")
