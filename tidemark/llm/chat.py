"""Quotation linking: conversations in reply order, without quotes, from messages that quote each other.

A line that starts with ``>`` marks is a quote; the number of marks is its level. A passage is
one line without its marks, normalised (lower case, blanks collapsed) and hashed. The original
of a quoted passage, of any level, is the first message that says it itself (level 0): the first
before the quoting message in the same conversation, else the first of all other conversations.
Passages of fewer than ``LEAST_CHARS`` characters, such as "yes.", link within their conversation
only. A message answers the original of most of its passages of the lowest level that has any
known one (ties: the earliest turn, then conversation); ``n_linked`` counts the known passages of that level.

Conversations are built from these replies:

* an answer to an earlier turn of its own conversation belongs to the thread of that turn, and so
  do answers to answers; a message that answers no earlier turn starts a thread;
* a conversation whose first turn answers a conversation of a smaller id continues it, and the one
  that this continues; together they are one built conversation, named after the smallest id;
* a built conversation is ordered by conversation id, the turn that starts the thread, turn, role
  and text, so every message stands after what it answers, and threads stand together.

Where several messages share a turn, the turn answers the earliest that any of them answers.

All steps are DataFrame operations. Sides that are joined to have one row for each key, made by
partial minima; a key that holds many rows of the other side is broadcast (``spread_join``), so a
passage, a turn or a conversation may hold any share of the messages. Replies are followed by
pointer doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shuffle_partitions, spread_join, written

LEAST_CHARS = 8
SEGMENT = 256  # messages in a row of the result

_MARKS = r"^([ \t]*>)+"
#: In a text that has any quoted line.
_QUOTED = r"(^|\n)[ \t]*>"


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[ \t\r]+", " "))


def _told(x: Column) -> Column:
    """A text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("1"), x), F.lit("0"))


def message_lines(messages: DataFrame) -> DataFrame:
    """A row for each line of each message: its key, line number, level, body without marks, passage hash or null.

    A null text is one empty line, but another message than an empty text.
    """
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    lines = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(_told(role), F.lit("\x1f"), _told(text))).alias("message_md5"),
        F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line", "raw"),
    )
    marks = F.regexp_extract("raw", _MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[ \t]", "")).cast("int"))
    lines = lines.withColumn("body", F.regexp_replace("raw", _MARKS, "")).withColumn("normal", _normal(F.col("body")))
    return lines.withColumn("passage", F.when(F.length("normal") > 0, F.unhex(F.md5("normal")))).withColumn("telling", F.length("normal") >= LEAST_CHARS).drop("raw", "normal")


def _place(conv: str, turn: str) -> Column:
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """A row for each quoted passage whose original is known: where it stands, its level, and the original's place.

    Messages without a conversation or turn neither quote nor are quoted.
    """
    lines = message_lines(messages).filter("passage IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = lines.filter("level > 0").select("conv_id", "turn", "message_md5", "line", "level", "passage", F.concat(F.col("conv_id").cast("string").cast("binary"), F.lit(b":"), "passage").alias("own"))
    quotes = written(quotes, "quotes")
    wanted = quotes.select("passage").distinct()
    said = written(lines.filter("level = 0").groupBy("passage", "conv_id").agg(F.min("turn").alias("turn"), F.first("telling").alias("telling")), "said")
    # The first two conversations that say a passage: one of them is another than the quoting one.
    nth = F.row_number().over(Window.partitionBy("passage").orderBy("conv_id"))
    first = said.filter("telling").withColumn("nth", nth).filter("nth <= 2")
    nth_place = lambda n: F.max(F.when(F.col("nth") == n, F.struct("conv_id", "turn")))
    anywhere = first.groupBy("passage").agg(nth_place(1).alias("first"), nth_place(2).alias("second")).join(wanted, "passage", "left_semi")
    here = quotes.select("conv_id", "passage", "own").distinct().join(said, ["conv_id", "passage"]).select("own", F.col("turn").alias("here_turn"))
    found = written(spread_join(quotes, written(anywhere, "origins"), "passage", "left"), "quotes-anywhere")
    found = spread_join(found, written(here, "origins-here"), "own", "left")
    local = F.col("here_turn") < F.col("turn")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    return found.select(
        "conv_id", "turn", "message_md5", "line", "level", "passage",
        F.when(local, F.col("conv_id")).otherwise(other["conv_id"]).alias("origin_conv"),
        F.when(local, F.col("here_turn")).otherwise(other["turn"]).alias("origin_turn"),
    ).filter("origin_turn IS NOT NULL")


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message_md5, reply_conv, reply_turn, n_linked): a row for each message that answers a known one."""
    votes = link_quotations(messages).groupBy("conv_id", "turn", "message_md5", "level", "origin_conv", "origin_turn").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn", "message_md5", "level").agg(
        F.max_by(F.struct("origin_conv", "origin_turn"), F.struct("n", (-F.col("origin_turn")).alias("t"), (-F.col("origin_conv")).alias("c"))).alias("origin"),
        F.sum("n").alias("n_linked"),
    )
    best = best.groupBy("conv_id", "turn", "message_md5").agg(F.min_by(F.struct("origin", "n_linked"), "level").alias("b"))
    return best.select("conv_id", "turn", "message_md5", F.col("b.origin.origin_conv").alias("reply_conv"), F.col("b.origin.origin_turn").alias("reply_turn"), "b.n_linked")


def chain_ends(parents: DataFrame) -> DataFrame:
    """(node, root, depth) for rows (node, root = its parent) without cycles: the end of each node's chain and its distance."""
    held = written(parents.select("node", "root", F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        ahead = held.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = spread_join(held, ahead, "root", "left")
        after = written(step.select("node", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")), "chains")
        forget(held)
        if not after.filter("open").limit(1).count():
            return after.drop("open")
        held = after.drop("open")
        held._written_to = after._written_to


def ordered_messages(messages: DataFrame) -> DataFrame:
    """A row for each distinct message (conversation, turn, role, text): what it says itself, what it answers, where it stands.

    ``conversation`` and ``position`` (from 0) place it in a built conversation; ``own_text`` is the text
    without quoted lines. ``reply_conv`` and ``reply_turn`` are null for a message that answers nothing known.
    Messages without a conversation stand in a conversation null.
    """
    distinct = messages.select("conv_id", "turn", "role", "text").distinct()
    texts = message_lines(distinct).groupBy("conv_id", "turn", "role", "message_md5").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "body")))), lambda x: x["body"]), "\n").alias("own_text"),
        F.count_if(F.col("level") > 0).alias("n_quoted"),
        F.max("level").cast("int").alias("max_level"),
    )
    if not distinct.filter(F.col("text").rlike(_QUOTED)).limit(1).count():  # then nothing answers anything
        nothing = F.lit(None).cast("long")
        return _with_position(texts.select(
            F.col("conv_id").alias("conversation"), "conv_id", "turn", "role", "message_md5", "own_text", F.col("n_quoted").cast("long").alias("n_quoted"), "max_level",
            F.lit(0).cast("long").alias("n_linked"), nothing.alias("reply_conv"), nothing.alias("reply_turn"), F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"),
        ))
    found = written(replies(distinct), "replies")
    inside = F.col("reply_conv") == F.col("conv_id")
    turns = found.groupBy("conv_id", "turn").agg(F.min(F.when(inside, F.col("reply_turn"))).alias("up"), F.min(F.when(F.col("reply_conv") < F.col("conv_id"), F.struct("reply_conv", "reply_turn"))).alias("other"))
    turns = written(turns, "answering-turns")
    threads = chain_ends(turns.filter("up IS NOT NULL").select(_place("conv_id", "turn").alias("node"), _place("conv_id", "up").alias("root")))
    threads = written(threads.select(F.col("node").alias("place"), F.split("root", ":")[1].cast("long").alias("thread_turn"), "depth"), "threads")
    # Only conversations that answer another one can continue it; of those the first turn decides.
    answering = turns.filter("other IS NOT NULL")
    begins = distinct.join(answering.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    continued = answering.filter("up IS NULL").join(begins, ["conv_id", "turn"]).select(F.col("conv_id").alias("node"), F.col("other.reply_conv").alias("root"))
    built = written(chain_ends(continued).select(F.col("node").alias("conv_id"), F.col("root").alias("conversation")), "built")

    key = ["conv_id", "turn", "message_md5"]
    rows = written(texts.join(found, key, "left").withColumn("place", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), _place("conv_id", "turn"))), "own-texts")
    rows = written(spread_join(rows, threads, "place", "left").drop("place"), "threaded")
    rows = spread_join(rows, built, "conv_id", "left")
    rows = rows.select(
        F.coalesce("conversation", "conv_id").alias("conversation"), "conv_id", "turn", "role", "message_md5", "own_text",
        F.col("n_quoted").cast("long").alias("n_quoted"), "max_level", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv", "reply_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    return _with_position(rows)


def _with_position(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position`` in their conversation, which may span partitions of the order."""
    order = ["conversation", "conv_id", "thread_turn", "turn", "role", "message_md5"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    inside = F.row_number().over(Window.partitionBy("conversation", "_part").orderBy("_at")) - 1
    sizes = dealt.groupBy("conversation", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conversation").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A conversation goes on in a partition only if it is the partition's first, so there is at most one row for each partition.
    going_on = sizes.withColumn("_before", before).filter("_before IS NOT NULL").select(F.col("conversation").alias("_c"), F.col("_part").alias("_p"), "_before")
    numbered = dealt.withColumn("_inside", inside).join(F.broadcast(going_on), F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    return numbered.withColumn("position", (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long")).select("conversation", "position", *[c for c in rows.columns if c != "conversation"])


def build_conversations(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conversation, segment, messages): the built conversations in reply order, without quotes.

    ``messages`` is an array of (position, conv_id, turn, role, text, n_quoted, n_linked, reply_conv, reply_turn, depth). A
    conversation of more than ``segment`` messages goes on in the next segment. An empty table has none.
    """
    message = F.struct("position", "conv_id", "turn", "role", F.col("own_text").alias("text"), "n_quoted", "n_linked", "reply_conv", "reply_turn", "depth")
    placed = ordered_messages(messages).withColumn("segment", F.floor(F.col("position") / segment).cast("long"))
    return placed.groupBy("conversation", "segment").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def reply_conversations(messages: DataFrame) -> DataFrame:
    """A row for each segment of each built conversation, as plain columns.

    ``places``: for each message ``conv:turn>reply_conv:reply_turn@depth``; ``transcript``: ``role: text``, joined by U+001E.
    """
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    place = lambda m: F.concat(text(m["conv_id"]), F.lit(":"), text(m["turn"]), F.lit(">"), text(m["reply_conv"]), F.lit(":"), text(m["reply_turn"]), F.lit("@"), text(m["depth"]))
    total = lambda c: F.aggregate(F.transform("messages", lambda m: m[c]), F.lit(0).cast("long"), lambda a, x: a + x)
    return build_conversations(messages).select(
        "conversation", "segment",
        F.size("messages").cast("long").alias("n_messages"),
        total("n_quoted").alias("n_quoted"), total("n_linked").alias("n_linked"),
        F.array_join(F.transform("messages", place), ",").alias("places"),
        F.array_join(F.transform("messages", lambda m: F.concat(text(m["role"]), F.lit(": "), m["text"])), "\x1e").alias("transcript"),
    )


#: The same rows in DuckDB's SQL, written from the description above.
ORACLE = rf"""
WITH RECURSIVE messages AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
raw AS (
  SELECT conv_id, turn, role, md5(coalesce('1' || role, '0') || chr(31) || coalesce('1' || text, '0')) AS m,
         unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line
  FROM messages),
lines AS (
  SELECT conv_id, turn, role, m, line,
         length(regexp_replace(regexp_extract(raw, '{_MARKS}', 0), '[ \t]', '', 'g')) AS level,
         regexp_replace(raw, '{_MARKS}', '') AS body,
         trim(regexp_replace(lower(regexp_replace(raw, '{_MARKS}', '')), '[ \t\r]+', ' ', 'g'), ' ') AS passage
  FROM raw),
said AS (SELECT DISTINCT passage, conv_id, turn FROM lines WHERE level = 0 AND passage <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
quotes AS (SELECT * FROM lines WHERE level > 0 AND passage <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
origins AS (
  SELECT q.conv_id, q.turn, q.m, q.line, q.level,
         (SELECT min(s.turn) FROM said s WHERE s.passage = q.passage AND s.conv_id = q.conv_id AND s.turn < q.turn) AS own_turn,
         (SELECT min({{'c': s.conv_id, 't': s.turn}}) FROM said s WHERE s.passage = q.passage AND s.conv_id <> q.conv_id AND length(q.passage) >= {LEAST_CHARS}) AS other
  FROM quotes q),
links AS (
  SELECT *, CASE WHEN own_turn IS NOT NULL THEN conv_id ELSE other.c END AS rc, coalesce(own_turn, other.t) AS rt FROM origins
  WHERE own_turn IS NOT NULL OR other IS NOT NULL),
lowest AS (SELECT * FROM links QUALIFY level = min(level) OVER (PARTITION BY conv_id, turn, m)),
answers AS (
  SELECT conv_id, turn, m, rc, rt, sum(count(*)) OVER (PARTITION BY conv_id, turn, m) AS n_linked FROM lowest GROUP BY conv_id, turn, m, rc, rt
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, m ORDER BY count(*) DESC, rt, rc) = 1),
ups AS (SELECT conv_id, turn, min(rt) FILTER (rc = conv_id) AS up, min({{'c': rc, 't': rt}}) FILTER (rc < conv_id) AS other FROM answers GROUP BY 1, 2),
chain AS (
  SELECT conv_id, turn, up, 1 AS depth FROM ups WHERE up IS NOT NULL
  UNION ALL SELECT c.conv_id, c.turn, u.up, c.depth + 1 FROM chain c JOIN ups u ON u.conv_id = c.conv_id AND u.turn = c.up WHERE u.up IS NOT NULL),
threads AS (SELECT conv_id, turn, min(up) AS thread_turn, max(depth) AS depth FROM chain GROUP BY 1, 2),
begins AS (SELECT conv_id, min(turn) AS turn FROM messages GROUP BY 1),
goes_on AS (SELECT u.conv_id, u.other.c AS up FROM ups u JOIN begins b ON u.conv_id = b.conv_id AND u.turn = b.turn WHERE u.up IS NULL AND u.other IS NOT NULL),
joined AS (
  SELECT conv_id, up FROM goes_on
  UNION ALL SELECT j.conv_id, g.up FROM joined j JOIN goes_on g ON g.conv_id = j.up),
built AS (SELECT conv_id, min(up) AS conversation FROM joined GROUP BY 1),
texts AS (
  SELECT conv_id, turn, role, m, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE level = 0), '') AS own_text, count(*) FILTER (WHERE level > 0) AS n_quoted
  FROM lines GROUP BY ALL),
rows_ AS (
  SELECT coalesce(b.conversation, x.conv_id) AS conversation, x.*, a.rc, a.rt, coalesce(a.n_linked, 0) AS n_linked, coalesce(t.depth, 0) AS depth,
         row_number() OVER (PARTITION BY coalesce(b.conversation, x.conv_id)
           ORDER BY x.conv_id, coalesce(t.thread_turn, x.turn) NULLS FIRST, x.turn NULLS FIRST, x.role NULLS FIRST, x.m) - 1 AS position
  FROM texts x LEFT JOIN answers a ON a.conv_id = x.conv_id AND a.turn = x.turn AND a.m = x.m
  LEFT JOIN threads t ON t.conv_id = x.conv_id AND t.turn = x.turn LEFT JOIN built b ON b.conv_id = x.conv_id)
SELECT conversation, CAST(position // {SEGMENT} AS BIGINT) AS segment, count(*) AS n_messages,
       CAST(sum(n_quoted) AS BIGINT) AS n_quoted, CAST(sum(n_linked) AS BIGINT) AS n_linked,
       string_agg(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '') || '>' || coalesce(CAST(rc AS VARCHAR), '') || ':' || coalesce(CAST(rt AS VARCHAR), '') || '@' || depth, ',' ORDER BY position) AS places,
       string_agg(coalesce(role, '') || ': ' || own_text, chr(30) ORDER BY position) AS transcript
FROM rows_ GROUP BY conversation, position // {SEGMENT}
"""
