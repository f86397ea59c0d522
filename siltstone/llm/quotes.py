"""Chat formatting by quotation linking.

A line's quote level is the number of leading `>`; a passage is a run of lines of
one level without a blank line.  Passages are normalised (blanks collapsed, lower
case) and hashed.  A quoted passage is joined to the latest earlier message of its
conversation that holds it as its own text; the passages of the lowest level that
is found name the message replied to (the latest, if they name several).  Threads
and depths follow by pointer doubling over (message, parent).

Messages leave without their quotes and without attribution lines (`... wrote:`
before a quote).  In the order (conv_id, thread_turn, turn), which `ordered` lays
out in ranges, every reply stands after what it answers.

The join on (conversation, passage) is done as an as-of step inside blocks of
TURNS turns and over the latest original of each block, so a passage that a very
long conversation repeats all the time is never one group nor a product.

A message is (conv_id, turn); rows that share both are its parts and share its
parent.  Null texts have no passages; a null conv_id is a conversation, messages
without a turn are never quoted nor linked.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import lean, settled, slices

TURNS = 1024
_MARK = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_WROTE = re.compile(r"\bwrote:[ \t]*$")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, normalised passage) in order; level 0 is own text."""
    passages: list[tuple[int, list[str]]] = []
    own, gap = [], True
    lines = text.split("\n")
    marked = [_MARK.match(x) for x in lines]
    for i, (line, mark) in enumerate(zip(lines, marked, strict=True)):
        level, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
        if not level:
            if i + 1 < len(lines) and marked[i + 1] and _WROTE.search(line):
                gap = True
                continue
            own.append(line)
        if not _BLANK.sub("", body):
            gap = True
            continue
        if gap or passages[-1][0] != level:
            passages.append((level, []))
        passages[-1][1].append(body)
        gap = False
    return "\n".join(own).strip(" \t\n\x0b\x0c\r"), [(level, _BLANK.sub(" ", " ".join(p)).strip().lower()) for level, p in passages]


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, and passages (level, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                got = [parse(t or "") for t in part.column(3).to_pylist()]
                own = pa.array([o for o, _ in got], pa.string())
                passages = pa.array([[{"level": lv, "passage": p} for lv, p in ps] for _, ps in got], pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string())])))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], own, passages], ["conv_id", "turn", "role", "text", "passages"])

    lean(messages.sparkSession)
    src = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    out = src.mapInArrow(run, "conv_id long, turn long, role string, text string, passages array<struct<level int, passage string>>")
    hashed = F.transform("passages", lambda p: F.struct(p["level"].alias("level"), F.xxhash64(p["passage"]).alias("hash")))
    return out.withColumn("passages", hashed)


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn of messages that quote an earlier one.  Takes
    the rows of `parsed`."""
    flat = messages.where("turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    block = F.floor(F.col("turn") / TURNS).alias("block")
    quoted = flat.where("level > 0").distinct()
    # Only passages that some message quotes are worth a place.
    wanted = quoted.select("conv_id", "hash").distinct()
    own = flat.where("level = 0").select("conv_id", "hash", "turn").distinct().join(_safe(wanted), _on("conv_id", "hash"), "left_semi")
    marks = own.select("conv_id", "hash", "turn", block, F.col("turn").alias("origin"), F.lit(None).cast("int").alias("level")).unionByName(quoted.select("conv_id", "hash", "turn", block, F.lit(None).cast("long").alias("origin"), "level"))
    near = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = marks.withColumn("found", F.max("origin").over(near)).where("level is not null")
    blocks = own.groupBy("conv_id", "hash", block).agg(F.max("turn").alias("latest"))
    asked = quoted.select("conv_id", "hash", block, F.lit(None).cast("long").alias("latest")).distinct()
    past = Window.partitionBy("conv_id", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    before = blocks.unionByName(asked).withColumn("before", F.max("latest").over(past)).where("latest is null").select("conv_id", "hash", "block", "before")
    hit = here.join(_safe(before, "before"), _on("conv_id", "hash", "block"), "left").withColumn("origin", F.coalesce("found", "before")).where("origin is not null")
    return hit.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("parent_turn"))


def _safe(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"__{c}") for c in df.columns if c not in keep), *keep)


def _on(*names: str):
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn, depth of messages with a parent,
    by pointer doubling: as many rounds as the depth has binary digits."""
    state = settled(links.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = _safe(state.select("conv_id", "turn", F.col("up").alias("next"), F.col("depth").alias("more")), "next", "more")
        joined = state.join(above, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("up") == F.col("__turn")), "left")
        state = settled(joined.select("conv_id", "turn", "parent_turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if not state.where("moved").head(1):
            return state.select("conv_id", "turn", "parent_turn", F.col("up").alias("thread_turn"), "depth")
        state = state.drop("moved")


def linked(messages: DataFrame) -> DataFrame:
    """Every message without quotes, with the turn it replies to, the turn that
    its thread starts with, and its depth there."""
    rows = settled(parsed(messages))
    tree = _safe(threads(parents(rows)), "parent_turn", "thread_turn", "depth")
    out = rows.join(tree, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("turn") == F.col("__turn")), "left")
    n_quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    return out.select("conv_id", "turn", "role", "text", n_quotes.alias("n_quotes"), "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def ordered(messages: DataFrame) -> DataFrame:
    """`linked`, laid out in ranges in reply order; a conversation may span ranges."""
    out = linked(messages)
    key = ["conv_id", "thread_turn", "turn"]
    return out.repartitionByRange(*key).sortWithinPartitions(*key)


ORACLE_SQL = r"""
WITH RECURSIVE l AS (
  SELECT rid, conv_id, turn, role, i, lines[i] AS line, lines[i + 1] AS nxt
  FROM (SELECT rid, conv_id, turn, role, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations))
), m AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body,
         coalesce(regexp_matches(nxt, '^[ \t]*>'), false) AND regexp_matches(line, '\bwrote:[ \t]*$') AND NOT regexp_matches(line, '^[ \t]*>') AS attribution
  FROM l
), g AS (
  SELECT *, (attribution OR regexp_matches(body, '^[\x20\x09-\x0D]*$')) AS gap,
         sum(CASE WHEN attribution OR regexp_matches(body, '^[\x20\x09-\x0D]*$') OR level IS DISTINCT FROM lag_level THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS grp
  FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS lag_level FROM m)
), p AS (
  SELECT rid, conv_id, turn, level, lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'))) AS passage
  FROM g WHERE NOT gap GROUP BY rid, conv_id, turn, level, grp
), hit AS (
  SELECT q.conv_id, q.turn, arg_max(o.turn, (-q.level, o.turn)) AS parent_turn
  FROM p q JOIN p o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.passage = o.passage AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY q.conv_id, q.turn
), tree AS (
  SELECT conv_id, turn, parent_turn, parent_turn AS up, 1 AS depth FROM hit
  UNION ALL
  SELECT t.conv_id, t.turn, t.parent_turn, h.parent_turn, t.depth + 1 FROM tree t JOIN hit h ON t.conv_id IS NOT DISTINCT FROM h.conv_id AND t.up = h.turn
), top AS (SELECT conv_id, turn, any_value(parent_turn) AS parent_turn, min(up) AS thread_turn, max(depth) AS depth FROM tree GROUP BY conv_id, turn),
own AS (
  SELECT rid, conv_id, turn, any_value(role) AS role,
         trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT attribution), ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM m GROUP BY rid, conv_id, turn
)
SELECT own.conv_id, own.turn, own.role, own.text,
       CAST((SELECT count(*) FROM p WHERE p.rid = own.rid AND level > 0) AS BIGINT) AS n_quotes,
       top.parent_turn, coalesce(top.thread_turn, own.turn) AS thread_turn, CAST(coalesce(top.depth, 0) AS BIGINT) AS depth
FROM own LEFT JOIN top ON own.conv_id IS NOT DISTINCT FROM top.conv_id AND own.turn = top.turn
"""


def replies(docs: DataFrame) -> DataFrame:
    """Messages that quote, made of documents: eight documents are a conversation, and
    each but the first quotes the first line of the one before, at two levels if that
    line has an even number of characters."""
    conv, turn = F.floor(F.col("doc_id") / 8).cast("long"), (F.col("doc_id") % 8).cast("long")
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    # A conversation is eight rows however large the table.
    before = F.lag(line).over(Window.partitionBy(conv).orderBy("doc_id"))
    quote = F.concat(F.lit("A wrote:\n> "), before, F.when(F.length(before) % 2 == 0, F.concat(F.lit("\n>> "), before)).otherwise(""), F.lit("\n\n"))
    text = F.concat(F.coalesce(quote, F.lit("")), line, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return docs.where("doc_id is not null").select(conv.alias("conv_id"), turn.alias("turn"), F.col("source").alias("role"), text.alias("text"))


REPLIES_SQL = ORACLE_SQL.replace(
    "WITH RECURSIVE l AS (",
    r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT *, lag(line) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS before FROM d), conversations AS (
  SELECT doc_id // 8 AS conv_id, doc_id % 8 AS turn, source AS role,
         coalesce('A wrote:' || chr(10) || '> ' || before || CASE WHEN length(before) % 2 = 0 THEN chr(10) || '>> ' || before ELSE '' END || chr(10) || chr(10), '') || line || chr(10) || chr(10) || text AS text FROM e
), l AS (""",
    1,
)
