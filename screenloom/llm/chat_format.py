"""Logged chats: collapse cumulative snapshots, then render what remains.  DataFrame functions only.

A chat is the sequence of its (role, text) messages by turn.  Rolling hashes over the messages name
every prefix; a chat whose whole sequence is a proper prefix of another chat's is a snapshot of it
and goes, by an anti-join of whole-chat hashes against prefix hashes.  Of equal chats the one with the
smallest id stays.

Hashes are sums of two 64-bit values per message and position, kept exactly as decimals, so a running
sum is a rolling hash.  Texts are hashed once and do not travel until rendering.  A long chat is cut
into spans of turns whose sums are worked out apart and then offset; its rendering is cut into parts
of PART messages, so no task gathers an unbounded chat.

Null role or text: a value of its own when comparing, rendered as ``unknown`` and as no text.  Null
turns come first.  Null chat ids: one chat of its own.  Repeated rows count once; different messages
of one turn follow in a fixed order (role, then text hash).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose messages are numbered in one window.
SPAN = 1024
#: Messages rendered into one row.
PART = 1024
WIDE = "decimal(38,0)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _hash(salt: int, *columns: str | Column) -> Column:
    """64 bits; nulls differ from every value."""
    parts = [x for c in columns for x in (F.isnull(c), c)]
    return F.xxhash64(F.lit(salt), *parts).cast("decimal(20,0)")


def positions(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text hashes, at, h1, h2): the place of every message and the prefix hash up to it."""
    span = F.coalesce(F.floor(F.col(turn) / SPAN), F.lit(-1) * F.lit(2**40))
    rows = chats.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), span.alias("span"),
        _hash(1, text).alias("a"), _hash(2, text).alias("b"),
    ).distinct()
    inside = Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    earlier = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv", "span").agg(F.count("*").alias("n"))
    counts = counts.select("conv", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = _with(rows, counts).withColumn("at", F.row_number().over(inside) + F.col("before")).drop("before")
    termed = placed.withColumn("h1", _hash(3, "at", "role", "a")).withColumn("h2", _hash(4, "at", "role", "b"))
    sums = termed.groupBy("conv", "span").agg(*[F.sum(h).cast(WIDE).alias(s) for h, s in (("h1", "s1"), ("h2", "s2"))])
    zero = F.lit(0).cast(WIDE)
    offsets = sums.select("conv", "span", *[F.coalesce(F.sum(s).over(earlier).cast(WIDE), zero).alias(s) for s in ("s1", "s2")])
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.sum(h).over(running) + F.col(s)).cast(WIDE).alias(h) for h, s in (("h1", "s1"), ("h2", "s2"))]
    return _with(termed, offsets).select("conv", "turn", "role", "a", "b", "at", *totals)


def _with(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Join on (conv, span), null ids included."""
    other = other.withColumnRenamed("conv", "conv_").withColumnRenamed("span", "span_")
    on = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("span") == F.col("span_"))
    return rows.join(other, on).drop("conv_", "span_")


def maximal(placed: DataFrame) -> DataFrame:
    """(conv, n) of the chats that no other chat continues; equal chats by their smallest id."""
    whole = placed.groupBy("conv").agg(F.max(F.struct("at", "h1", "h2")).alias("end"))
    whole = whole.groupBy("end").agg(F.min("conv").alias("conv")).select("conv", "end.*")
    last = placed.groupBy("conv").agg(F.max("at").alias("last")).withColumnRenamed("conv", "conv_")
    inner = placed.join(last, F.col("conv").eqNullSafe(F.col("conv_"))).filter("at < last")
    prefixes = inner.select("at", "h1", "h2").distinct()
    return whole.join(prefixes, ["at", "h1", "h2"], "left_anti").select("conv", F.col("at").alias("n"))


def rendered(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, part, rendered) for each maximal chat; part 0 is all of an ordinary one."""
    placed = positions(chats, conv, turn, role, text)
    kept = maximal(placed).withColumnRenamed("conv", "conv_")
    mine = placed.join(kept, F.col("conv").eqNullSafe(F.col("conv_"))).select("conv", "turn", "role", "a", "b", "at", "n")
    full = chats.select(
        F.struct(
            F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
            _hash(1, text).alias("a"), _hash(2, text).alias("b"),
        ).alias("key"),
        F.col(text).alias("text"),
    )
    key = F.struct("conv", "turn", "role", "a", "b")
    message = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    joined = mine.join(full, key.eqNullSafe(F.col("key"))).select(
        "conv", "n", F.floor((F.col("at") - 1) / PART).alias("part"), "at", message.alias("message")
    )
    # Repeated rows meet the same place again: one message per place.
    gathered = F.array_sort(F.collect_set(F.struct("at", "message")))
    return joined.groupBy("conv", "n", "part").agg(gathered.alias("m")).select(
        F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), "part",
        F.array_join(F.transform("m", lambda x: x["message"]), "").alias("rendered"),
    )


#: Whole sequences as lists; a chat goes if its list begins another's, or equals one with a smaller id.
SQL = """
WITH messages AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
chats AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS seq,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
      ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM messages GROUP BY conv_id),
prefixes AS (SELECT DISTINCT seq[1:k] AS seq FROM (SELECT seq, unnest(range(1, len(seq))) AS k FROM chats)),
kept AS (
  SELECT min(conv_id) AS conv_id FROM chats WHERE seq NOT IN (SELECT seq FROM prefixes) GROUP BY seq)
SELECT c.conv_id, len(c.seq)::BIGINT AS n_turns, 0::BIGINT AS part, c.rendered
FROM chats c JOIN kept k ON c.conv_id = k.conv_id
"""
