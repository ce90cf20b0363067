"""Filter interaction audit: what each of five filters removes, in every order they can be applied.

A document's failures are five bits, so a part of the table is told by at most 32 counts.  The removal
game v(S) of a part is the number of its documents that fail some filter of the coalition S.  Its
Hart-Mas-Colell potential is P({}) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|; the
Shapley value of filter i is P(all) - P(all without i).  Potentials are kept times 5!, which makes every
division exact.  What a step removes is the difference of v between two coalitions that differ by its filter.

Failures are worked out once per document into a narrow stored table.  The smallest id of every distinct
text is found by a map-side combined group-by on digests and joined back by (digest, id), so a text with a
third of all copies is spread by its ids.  Counts are combined before they move: a part of any size is 32 rows.

Null texts are empty texts (and copies of each other).  Null parts are the empty string.  A null id is
smaller than none and larger than none: its row is no copy, makes no copy, and has no labels.  Rows with
equal ids are separate rows, and copies only of smaller ids.  Several labels of one id: it counts as good
(toxic) if any says so.  An empty table has no part and gives no row.  Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.session import stored

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
WORD_GAP = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, digest, mask): bits 0 to 3 say which of the filters A to D the text fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("t"))
    split = read.select("*", F.array_remove(F.split("t", WORD_GAP), "").alias("words"))
    words, chars = F.size("words"), F.length("t")
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    fails = [
        words < LEAST_WORDS,
        F.lit(100) * F.size(F.array_distinct("words")) < LEAST_DISTINCT * words,
        F.lit(100).cast("long") * capitals > MOST_CAPITALS * chars,
        F.col("t").rlike(MARKS),
    ]
    return split.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask_of(fails).alias("mask"))


def mask_of(fails: Sequence[Column]) -> Column:
    """One bit per condition, the first one lowest."""
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)]
    return sum(bits[1:], bits[0]).cast("int")


def with_copies(marked: DataFrame, bit: int) -> DataFrame:
    """Adds ``bit`` to the mask of every row whose text also has a smaller id."""
    first = marked.dropna(subset=["id"]).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    joined = marked.join(first, ["digest", "id"], "left")
    return joined.select("id", "part", (F.col("mask") + F.when(copy, bit).otherwise(0)).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters they fail."""
    told = (
        labels.dropna(subset=["doc_id"]).groupBy(F.col("doc_id").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.join(told, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def games(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part: v_n, v_good, v_toxic and the potential by coalition, and ``each``, what each filter fails.

    ``counted`` has at most one row per part and mask, so a group holds no more rows than there are coalitions.
    """
    size = len(filters)
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    every = F.sequence(F.lit(0), F.lit(2**size - 1))

    def caught(column: str) -> Column:
        """v by coalition: documents that fail any filter of it."""
        zero = F.lit(0).cast("long")
        add = lambda s: lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[column]).otherwise(zero)
        return F.transform(every, lambda s: F.aggregate("cells", zero, add(s))).alias(f"v_{column}")

    total = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("total")
    valued = held.select("part", total, *[caught(c) for c in COUNTS])
    return valued.withColumn("potential", potential(F.col("v_n"), size))


def potential(v: Column, size: int) -> Column:
    """5! (in general size!) times the potential of the game ``v``, by coalition; smaller coalitions come first."""
    scale = factorial(size)

    def grown(known: Column, s: Column) -> Column:
        less = [F.when(s.bitwiseAND(1 << k) != 0, F.get(known, s - (1 << k))).otherwise(F.lit(0).cast("long")) for k in range(size)]
        mine = sum(less, F.get(v, s) * scale)
        # The scaled values divide without a remainder; floor of an exact quotient needs no double.
        return F.array_append(known, F.call_function("div", mine, F.bit_count(s).cast("long")))

    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2**size - 1)), start, grown)


def audit(games_by_part: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, with the counts of that step."""
    size = len(filters)
    steps = []
    for order in permutations(range(size)):
        before = 0
        for step, k in enumerate(order, 1):
            name = "".join(filters[i] for i in order)
            steps.append({"filter_order": name, "step": step, "before": before, "own": 1 << k})
            before |= 1 << k
    kind = "array<struct<filter_order:string,step:int,before:int,own:int>>"
    table = games_by_part.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    own, before, all_ = F.col("own"), F.col("before"), F.lit(2**size - 1)
    v = lambda s, c="n": F.get(F.col(f"v_{c}"), s)
    step = lambda c="n": v(before + own, c) - v(before, c)
    p = lambda s: F.get(F.col("potential"), s)
    return table.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - v(before + own)).alias("kept"),
        step().alias("removed"),
        (v(own) - step()).alias("redundant"),
        (v(all_) - v(all_ - own)).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        (p(all_) - p(all_ - own)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of the five filters over ``docs`` with the ``labels`` of some of them."""
    marked = stored(failures(docs), "failures")
    return audit(games(cells(with_copies(marked, 1 << 4), labels)))


SQL = r"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
fails AS (SELECT doc_id, part,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
  || CASE WHEN 100 * coalesce(list_unique(w), 0) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS f FROM worded),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
cells AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM fails LEFT JOIN told USING (doc_id) GROUP BY 1, 2),
orders(o) AS (SELECT '' UNION ALL
  SELECT o || substr('ABCDE', CAST(i AS INTEGER), 1) FROM orders, range(1, 6) r(i) WHERE NOT contains(o, substr('ABCDE', CAST(i AS INTEGER), 1))),
steps AS (SELECT o, CAST(k AS INTEGER) AS step, substr(o, CAST(k AS INTEGER), 1) AS x, substr(o, 1, CAST(k AS INTEGER) - 1) AS past
  FROM orders, range(1, 6) r(k) WHERE length(o) = 5),
met AS (SELECT part, o, step, x, n, good, toxic, contains(f, x) AS mine, f = x AS alone,
  length(regexp_replace(f, '[' || past || '_]', '', 'g')) < length(f) AS gone FROM cells, steps),
counted AS (SELECT part, o, step, x,
  coalesce(sum(n) FILTER (NOT gone AND NOT mine), 0) AS kept, coalesce(sum(n) FILTER (mine AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (mine AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mine AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (mine AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""
