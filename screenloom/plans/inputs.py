"""Entity tables derived from the shared star-schema and text tables.

Each derivation exists twice, as a DataFrame and as the SQL text the oracle
queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions.keys import TEXT, key_digest, notation_key
from screenloom.session import stored
from screenloom.sources.tables import read_table

# --- labelled documents -------------------------------------------------------

SQL_LABELLED = """
labelled AS (
  SELECT d.text AS smiles, l.toxic AS label, d.source AS source, d.doc_id AS row_id,
         d.lang AS lang, d.n_chars AS n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
keyed AS (
  SELECT * EXCLUDE (smiles),
         nullif(lower(trim(regexp_replace(smiles, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), '') AS smiles
  FROM labelled
),
cleaned AS (
  SELECT * EXCLUDE (label), CAST(label AS INTEGER) AS label
  FROM keyed WHERE smiles IS NOT NULL AND label IN (0, 1)
),
resolved AS (
  SELECT md5(smiles) AS key_digest,
         CAST(CASE WHEN 2 * sum(label) >= count(*) THEN 1 ELSE 0 END AS INTEGER) AS label,
         string_agg(DISTINCT source, '+' ORDER BY source) AS source,
         min(row_id) AS row_id,
         arg_min(lang, row_id) AS lang,
         arg_min(n_chars, row_id) AS n_chars,
         count(*) AS n_merged
  FROM cleaned GROUP BY smiles
)
"""


def digest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents by the digest of their text key.

    The digest is taken before the labels are joined, so no text is shuffled.
    """
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = read_table(spark, sf, "documents")
    return (
        docs.filter(TEXT.is_valid(F.col("text")))
        .select(
            "doc_id",
            key_digest(TEXT.canonical(F.col("text"))).alias("key_digest"),
            "source",
        )
        .join(labels, "doc_id", "left")
        .withColumnRenamed("doc_id", "row_id")
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return (
        read_table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("text").alias("smiles"),
            "label",
            "source",
            F.col("doc_id").alias("row_id"),
            "lang",
            "n_chars",
        )
    )


# --- labelled line items and events (many duplicates, conflicts and ties) ------


def labelled_lineitems(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("smiles"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_linestatus").alias("source"),
        F.col("l_orderkey").alias("row_id"),
        "l_shipdate",
    )


def labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("smiles"),
        (F.col("value") > 10).cast("int").alias("label"),
        F.get_json_object("props", "$.k").alias("source"),
        F.col("event_id").alias("row_id"),
    )


# --- scored rows --------------------------------------------------------------

SQL_SCORED = """
scored AS (
  SELECT event_id AS row_id, event_type AS series,
         value / (value + 40.0::DOUBLE) AS score,
         CAST(CASE WHEN (event_id * 7919) % 100 < value THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM events
)
"""

# (score, n_pos, n_neg) and running counts from the highest score down.
SQL_HIST = (
    SQL_SCORED
    + """,
hist AS (
  SELECT score, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg
  FROM scored GROUP BY score
),
walked AS (
  SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp,
         sum(n_pos) OVER () AS p, sum(n_neg) OVER () AS n
  FROM hist WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""
)


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("series"),
        (value / (value + 40.0)).alias("score"),
        F.when((F.col("event_id") * 7919) % 100 < value, 1).otherwise(0).alias("label"),
    )


# --- orders read as described entities ------------------------------------------

SQL_DESCRIBED = """
described AS (
  SELECT o_orderkey AS row_id,
         translate(CAST(o_orderkey * 7919 AS VARCHAR), '0123456789', 'Cc()1=ON2S') AS input_smiles,
         o_totalprice / 487.3::DOUBLE AS "MolWt",
         (o_custkey % 90) / 10.0::DOUBLE - 2.0::DOUBLE AS "LogP",
         o_orderkey % 9 AS "HBD",
         o_custkey % 14 AS "HBA",
         (o_orderkey % 2000) / 11.0::DOUBLE AS "TPSA",
         o_custkey % 13 AS "RotatableBonds",
         o_orderkey % 40 AS heavy,
         o_orderstatus = 'P' AS nitro,
         o_orderpriority = '2-HIGH' AS ring_amine,
         o_orderpriority = '1-URGENT' AS outlier,
         ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS score,
         CASE WHEN o_custkey % 5 = 0 THEN (o_custkey % 101) / 101.0::DOUBLE END AS calibrated,
         o_orderpriority AS name
  FROM orders
),
shape AS (
  SELECT *, regexp_replace(regexp_replace(input_smiles, '\\[[^\\[\\]]*\\]', '*', 'g'), '%\\d{2}', '', 'g') AS bare
  FROM described
),
screened AS (
  SELECT * EXCLUDE (bare),
    CASE WHEN regexp_replace(input_smiles, 'Cl|Br|[BCNOPSFI]|[bcnops]|->|<-|[-=#$:/\\\\.()]|\\d|\\*', '', 'g') = ''
      AND regexp_matches(bare, '[A-Za-z*]')
      AND list_reduce(list_prepend(0, list_transform(str_split(bare, ''),
            lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)),
            lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END) = 0
      AND (length(bare) - length(replace(bare, '1', ''))) % 2 = 0
      AND (length(bare) - length(replace(bare, '2', ''))) % 2 = 0
    THEN input_smiles END AS canonical_smiles
  FROM shape
)
"""


def _notation(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "Cc()1=ON2S")


def describe(orders: DataFrame) -> DataFrame:
    """Properties, motif flags and a score for every order, batch or stream."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    priority = F.col("o_orderpriority")
    return orders.select(
        key.alias("row_id"),
        _notation(key * 7919).alias("input_smiles"),
        (F.col("o_totalprice") / 487.3).alias("MolWt"),
        (cust % 90 / 10.0 - 2.0).alias("LogP"),
        (key % 9).alias("HBD"),
        (cust % 14).alias("HBA"),
        (key % 2000 / 11.0).alias("TPSA"),
        (cust % 13).alias("RotatableBonds"),
        (key % 40).alias("heavy"),
        (F.col("o_orderstatus") == "P").alias("nitro"),
        (priority == "2-HIGH").alias("ring_amine"),
        (priority == "1-URGENT").alias("outlier"),
        (key * 7919 % 10007 / 10007.0).alias("score"),
        F.when(cust % 5 == 0, cust % 101 / 101.0).alias("calibrated"),
        priority.alias("name"),
    )


def described_orders(spark: SparkSession, sf: str) -> DataFrame:
    return describe(read_table(spark, sf, "orders"))


def screen_notation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("canonical_smiles", notation_key(F.col("input_smiles")))


def screened_orders(spark: SparkSession, sf: str) -> DataFrame:
    return screen_notation(described_orders(spark, sf))


# --- parts read as graphs: line numbers are atoms ---------------------------------

SQL_GRAPH = """
slots AS (
  SELECT l_partkey AS entity_id, CAST(l_linenumber AS INTEGER) AS atom_id,
         count(*) AS cnt, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM lineitem GROUP BY ALL
),
typed AS (
  SELECT entity_id, atom_id, cnt, q,
         CASE WHEN atom_id = 7 THEN 'N' WHEN q % 9 IN (0, 2) THEN 'O' WHEN q % 9 = 1 THEN 'N' ELSE 'C' END AS element
  FROM slots
),
atoms AS (
  SELECT entity_id, atom_id, element,
         CAST(CASE WHEN element = 'N' AND cnt % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS charge,
         CAST(q % 3 AS INTEGER) AS n_h,
         element = 'C' AND q % 4 <> 0 AS aromatic, q
  FROM typed
),
pairs(a, b, in_ring) AS (VALUES (1,2,true),(2,3,true),(3,4,true),(4,5,true),(5,6,true),(1,6,true),(6,7,false)),
bonds AS (
  SELECT x.entity_id, p.a, p.b,
         CAST(CASE WHEN x.aromatic AND y.aromatic THEN 1 ELSE 1 + (x.q + y.q) % 2 END AS INTEGER) AS "order",
         x.aromatic AND y.aromatic AS aromatic, p.in_ring
  FROM pairs p JOIN atoms x ON x.atom_id = p.a
  JOIN atoms y ON y.entity_id = x.entity_id AND y.atom_id = p.b
),
ends AS (
  SELECT entity_id, a AS atom_id, b AS other, "order", aromatic FROM bonds
  UNION ALL SELECT entity_id, b, a, "order", aromatic FROM bonds
)
"""


#: Line numbers in a row of slots.
SLOTS = 7
RING = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 6), (6, 7)]


def part_slots(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_id, block, c1 .. c7, q1 .. q7): lines and quantity at seven line numbers of a part, from 7 * block + 1 on."""
    place = F.col("l_linenumber").cast("bigint") - 1
    slot = F.coalesce(F.pmod(place, F.lit(SLOTS)), F.lit(0)) + 1
    lines = read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity_id"),
        ((place + 1 - slot) / SLOTS).cast("bigint").alias("block"),
        slot.alias("slot"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    at = [F.col("slot") == i for i in range(1, SLOTS + 1)]
    return lines.groupBy("entity_id", "block").agg(
        *[F.count_if(here).alias(f"c{i}") for i, here in enumerate(at, 1)],
        *[F.sum(F.when(here, F.col("q"))).alias(f"q{i}") for i, here in enumerate(at, 1)],
    )


def _element(slot: Column, q: Column) -> Column:
    return F.when(slot == 7, "N").when((q % 9).isin(0, 2), "O").when(q % 9 == 1, "N").otherwise("C")


def _aromatic(slot: Column, q: Column) -> Column:
    return (_element(slot, q) == "C") & (q % 4 != 0)


def part_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of every part: its line numbers, a six-ring with a tail.

    The lines are read and dealt once; atoms and bonds are both unfolded from the stored rows of slots.
    """
    slots = stored(part_slots(spark, sf), "slots")
    q, element, slot = F.col("q"), F.col("element"), F.col("atom_id")
    each = [
        F.struct(
            (F.col("block") * SLOTS + i).cast("int").alias("atom_id"),
            F.col(f"c{i}").alias("cnt"),
            F.col(f"q{i}").alias("q"),
        )
        for i in range(1, SLOTS + 1)
    ]
    atoms = (
        slots.select("entity_id", F.inline(F.array(*each)))
        .filter("cnt > 0")
        .withColumn("element", _element(slot, q))
        .select(
            "entity_id",
            "atom_id",
            "element",
            F.when((element == "N") & (F.col("cnt") % 2 == 0), 1).otherwise(0).alias("charge"),
            (q % 3).cast("int").alias("n_h"),
            ((element == "C") & (q % 4 != 0)).alias("aromatic"),
        )
    )
    pairs = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            ((F.col(f"c{a}") > 0) & (F.col(f"c{b}") > 0)).alias("_there"),
            F.col(f"q{a}").alias("_q_a"),
            F.col(f"q{b}").alias("_q_b"),
        )
        for a, b in RING
    ]
    q_a, q_b = F.col("_q_a"), F.col("_q_b")
    both = _aromatic(F.col("a"), q_a) & _aromatic(F.col("b"), q_b)
    bonds = (
        slots.filter("block = 0 AND entity_id IS NOT NULL")
        .select("entity_id", F.inline(F.array(*pairs)))
        .filter("_there")
        .select(
            "entity_id",
            "a",
            "b",
            F.when(both, 1).otherwise(1 + (q_a + q_b) % 2).cast("int").alias("order"),
            both.alias("aromatic"),
            (F.col("b") != 7).alias("in_ring"),
        )
    )
    return atoms, bonds
