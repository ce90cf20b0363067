"""Queries on shingle bits, graph fingerprints, descriptors, motifs and scaling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions import lexical
from screenloom.functions.keys import text_key
from screenloom.operators import features, graph
from screenloom.plans import inputs as I
from screenloom.plans.registry import query
from screenloom.session import scratch_path, stored
from screenloom.sources import records
from screenloom.sources.tables import read_table


def _bits_text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


# --- text shingles ------------------------------------------------------------

_SQL_SHINGLES = """
words AS (
  SELECT doc_id, str_split(trim(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), ' ') AS t FROM documents
),
grams AS (
  SELECT doc_id, unnest(list_concat(list_concat(t,
      list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])),
      list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS g
  FROM words
),
bits AS (
  SELECT DISTINCT doc_id, CAST(('0x' || substr(md5(g), 1, 8))::BIGINT % 2048 AS INTEGER) AS bit FROM grams
)
"""


@query(
    "shingle_fp",
    f"WITH {_SQL_SHINGLES} SELECT doc_id, string_agg(bit, ',' ORDER BY bit) AS bits, count(*) AS n_bits FROM bits GROUP BY doc_id",
)
def shingle_fp(spark: SparkSession, sf: str) -> DataFrame:
    docs = features.dealt(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", features.shingle_bits(F.col("text")).alias("b"))
    return rows.select("doc_id", _bits_text("b").alias("bits"), F.size("b").cast("bigint").alias("n_bits"))


@query(
    "feature_table",
    f"""WITH {_SQL_SHINGLES}, n AS (SELECT doc_id, count(*) AS on_bits FROM bits GROUP BY doc_id)
    SELECT doc_id, on_bits, 2050 AS width, on_bits + 2 AS n_nonzero FROM n""",
)
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse combined vectors (2,048 bits + 2 descriptors), stored and read back."""
    texts = read_table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    docs = features.dealt(texts, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.size(F.split(text_key(F.col("text")), " ")) + 0.0).alias("n_words"),
        features.shingle_bits(F.col("text")).alias("bits"),
    )
    # A filter on a computed column would compute it twice; bits are stored first.
    docs = stored(docs, "bits")
    table = features.assemble_features(docs, "combined", descriptors=["n_chars", "n_words"])
    path = scratch_path(spark, "features")
    records.write_features(table.select("doc_id", "bits", "features"), path)
    table = records.read_features(spark, path)
    values = vector_to_array("features")
    return table.select(
        "doc_id",
        F.size("bits").cast("bigint").alias("on_bits"),
        F.size(values).alias("width"),
        F.size(F.filter(values, lambda v: v != 0)).cast("bigint").alias("n_nonzero"),
    )


# --- lexical descriptors --------------------------------------------------------


@query(
    "lexical_descriptors",
    f"""WITH {I.SQL_DESCRIBED}, c AS (
      SELECT row_id, input_smiles AS s, regexp_replace(input_smiles, 'Cl|Br', '*', 'g') AS plain FROM described)
    SELECT row_id, CAST(len(regexp_extract_all(s, 'Cl|Br|[BCNOPSFI]|[bcnops]|\\*')) AS INTEGER) AS heavy,
           CAST(len(regexp_extract_all(s, '\\d')) // 2 AS INTEGER) AS rings,
           coalesce(len(regexp_extract_all(plain, '[bcnops]')) / nullif(len(regexp_extract_all(s, 'Cl|Br|[BCNOPSFI]|[bcnops]|\\*')), 0), 0.0) AS aromatic
    FROM c""",
)
def lexical_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("input_smiles")
    return I.described_orders(spark, sf).select(
        "row_id",
        lexical.heavy_atoms(s).alias("heavy"),
        lexical.ring_count(s).alias("rings"),
        lexical.aromatic_fraction(s).alias("aromatic"),
    )


# --- graphs ---------------------------------------------------------------------

def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds, unfolded from one stored table: every round reads them several times."""
    return I.part_graph(spark, sf)


def _h60(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 15))::BIGINT"


_HALF = 2**30


def _sql_round(r: int) -> str:
    return f"""
m{r} AS (
  SELECT e.entity_id, e.atom_id, {_h60('e."order"', f"o.h{r - 1}")} AS m
  FROM ends e JOIN a{r - 1} o ON o.entity_id = e.entity_id AND o.atom_id = e.other
),
d{r} AS (
  SELECT entity_id, atom_id, count(*) AS n, CAST(sum(m % {_HALF}) AS BIGINT) AS s1,
         CAST(sum(m // {_HALF}) AS BIGINT) AS s2 FROM m{r} GROUP BY ALL
),
a{r} AS (
  SELECT a.*, {_h60(str(r), f"a.h{r - 1}", "coalesce(n, 0)", "coalesce(s1, 0)", "coalesce(s2, 0)")} AS h{r}
  FROM a{r - 1} a LEFT JOIN d{r} d ON d.entity_id = a.entity_id AND d.atom_id = a.atom_id
)
"""


_HASH_STEPS = (
    f"""
a0 AS (SELECT entity_id, atom_id, {_h60("element", "charge", "n_h", "aromatic::INT")} AS h0 FROM atoms),"""
    + _sql_round(1)
    + ","
    + _sql_round(2)
)
_PROVENANCE_STEPS = (
    _HASH_STEPS
    + """,
provenance AS (
  SELECT entity_id, CAST(h % 2048 AS INTEGER) AS bit, atom_id AS center, radius
  FROM (SELECT entity_id, atom_id, h0 AS h, 0 AS radius FROM a2 UNION ALL SELECT entity_id, atom_id, h1, 1 FROM a2
        UNION ALL SELECT entity_id, atom_id, h2, 2 FROM a2)
)
"""
)
_SQL_HASHES = f"WITH {I.SQL_GRAPH}, {_HASH_STEPS}"
_SQL_PROVENANCE = f"WITH {I.SQL_GRAPH}, {_PROVENANCE_STEPS}"


@query(
    "neighborhood_fp",
    _SQL_PROVENANCE
    + """, f AS (SELECT DISTINCT entity_id, bit FROM provenance)
    SELECT entity_id, string_agg(bit, ',' ORDER BY bit) AS bits FROM f GROUP BY entity_id""",
)
def neighborhood_fp(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = _graph(spark, sf)
    return graph.fingerprints(atoms, bonds).select("entity_id", _bits_text("bits").alias("bits"))


@query("fp_provenance", _SQL_PROVENANCE + "SELECT entity_id, bit, center, radius FROM provenance")
def fp_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bit_provenance(*_graph(spark, sf))


@query(
    "graph_key",
    _SQL_HASHES
    + f"""SELECT entity_id, md5(concat_ws('|', CAST(count(*) AS VARCHAR),
      CAST(CAST(sum(h2 % {_HALF}) AS BIGINT) AS VARCHAR), CAST(CAST(sum(h2 // {_HALF}) AS BIGINT) AS VARCHAR))) AS graph_key
      FROM a2 GROUP BY entity_id""",
)
def graph_key(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_keys(*_graph(spark, sf))


# Asked bits: the lowest on-bit of each part, and one bit that may be off.
_SQL_ASKED = """,
asked AS (
  SELECT entity_id, min(bit) AS bit FROM provenance GROUP BY entity_id
  UNION SELECT entity_id, CAST(entity_id % 2048 AS INTEGER) FROM provenance
),
hits AS (SELECT entity_id, bit, center, radius FROM asked JOIN provenance USING (entity_id, bit)),
r2 AS (SELECT DISTINCT entity_id, bit, center AS atom_id FROM hits WHERE radius = 2),
r1 AS (
  SELECT entity_id, bit, atom_id FROM r2
  UNION SELECT r2.entity_id, bit, other FROM r2 JOIN ends USING (entity_id, atom_id)
  UNION SELECT entity_id, bit, center FROM hits WHERE radius = 1
),
reached AS (
  SELECT entity_id, bit, atom_id FROM r1
  UNION SELECT r1.entity_id, bit, other FROM r1 JOIN ends USING (entity_id, atom_id)
  UNION SELECT entity_id, bit, center FROM hits WHERE radius = 0
)
"""


def _asked(provenance: DataFrame) -> DataFrame:
    parts = provenance.groupBy("entity_id").agg(F.min("bit").alias("lowest"))
    other = (F.col("entity_id") % 2048).cast("int")
    return parts.select("entity_id", F.explode(F.array_distinct(F.array("lowest", other))).alias("bit"))


@query(
    "bit_provenance",
    _SQL_PROVENANCE
    + _SQL_ASKED
    + """
    SELECT a.entity_id, a.bit, coalesce(n_environments, 0) AS n_environments, coalesce(n_atoms, 0) AS n_atoms,
      CASE WHEN n_environments > 0 THEN 'Approximate mapping (hashed fingerprint)' ELSE 'Bit not active in this molecule' END AS note
    FROM asked a
    LEFT JOIN (SELECT entity_id, bit, count(*) AS n_environments FROM hits GROUP BY ALL) h USING (entity_id, bit)
    LEFT JOIN (SELECT entity_id, bit, count(*) AS n_atoms FROM reached GROUP BY ALL) r USING (entity_id, bit)""",
)
def bit_provenance(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = _graph(spark, sf)
    provenance = graph.provenance_of(stored(graph.environment_hashes(atoms, bonds), "hashes"))
    return graph.map_bits(_asked(provenance), provenance, bonds)


@query("bit_atoms", _SQL_PROVENANCE + _SQL_ASKED + "SELECT entity_id, bit, atom_id FROM reached")
def bit_atoms(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = _graph(spark, sf)
    provenance = graph.provenance_of(stored(graph.environment_hashes(atoms, bonds), "hashes"))
    return graph.bit_atoms(_asked(provenance), provenance, bonds)


_SQL_WEIGHTS = "CASE element WHEN 'C' THEN 12.011::DOUBLE WHEN 'N' THEN 14.007::DOUBLE ELSE 15.999::DOUBLE END"

_SQL_DESCRIPTORS = (
    "WITH "
    + I.SQL_GRAPH
    + f""",
kinds AS (
  SELECT element || ':' || CAST(aromatic::INT AS VARCHAR) || ':' || n_h AS atom_type,
         round(avg(atom_id) / 10.0::DOUBLE - 0.2::DOUBLE, 4) AS logp, round(avg(atom_id + n_h) * 2.5::DOUBLE, 4) AS tpsa
  FROM atoms GROUP BY 1
),
degree AS (
  SELECT entity_id, atom_id, count(*) AS degree, bool_or(aromatic OR "order" > 1) AS unsaturated FROM ends GROUP BY ALL
),
full_atoms AS (
  SELECT a.*, coalesce(degree, 0) AS degree, coalesce(unsaturated, false) AS unsaturated, logp, tpsa
  FROM atoms a LEFT JOIN degree USING (entity_id, atom_id)
  LEFT JOIN kinds k ON k.atom_type = element || ':' || CAST(aromatic::INT AS VARCHAR) || ':' || n_h
),
by_bond AS (
  SELECT b.entity_id, count(*) AS n_bonds,
    count(*) FILTER (b."order" = 1 AND NOT b.aromatic AND NOT in_ring AND x.degree > 1 AND y.degree > 1) AS rotatable
  FROM bonds b JOIN degree x ON x.entity_id = b.entity_id AND x.atom_id = b.a
  JOIN degree y ON y.entity_id = b.entity_id AND y.atom_id = b.b GROUP BY ALL
),
descriptors AS (
  SELECT entity_id, round(sum({_SQL_WEIGHTS} + n_h * 1.008::DOUBLE), 6) AS "MolWt", round(sum(logp), 6) AS "LogP",
    count(*) FILTER (element IN ('N', 'O') AND n_h > 0) AS "HBD", count(*) FILTER (element IN ('N', 'O')) AS "HBA",
    round(sum(tpsa), 6) AS "TPSA", coalesce(max(rotatable), 0) AS "RotatableBonds",
    coalesce(max(n_bonds), 0) - count(*) + 1 AS "RingCount", count(*) FILTER (aromatic) / count(*) AS "AromaticFraction",
    coalesce(count(*) FILTER (element = 'C' AND NOT unsaturated AND degree + n_h = 4) / nullif(count(*) FILTER (element = 'C'), 0), 0) AS "FractionCSP3",
    count(*) AS heavy
  FROM full_atoms LEFT JOIN by_bond USING (entity_id) GROUP BY entity_id
)
"""
)


def _part_descriptors(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    kind = graph.atom_type(F.col("element"), F.col("aromatic"), F.col("n_h"))
    contributions = atoms.groupBy(kind.alias("atom_type")).agg(
        F.round(F.avg("atom_id") / 10.0 - 0.2, 4).alias("logp"),
        F.round(F.avg(F.col("atom_id") + F.col("n_h")) * 2.5, 4).alias("tpsa"),
    )
    rows = graph.descriptors(atoms, bonds, contributions)
    return rows.withColumns({c: F.round(c, 6) for c in ("MolWt", "LogP", "TPSA")})


@query("descriptors", _SQL_DESCRIPTORS + "SELECT * FROM descriptors")
def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return _part_descriptors(*_graph(spark, sf))


@query(
    "combined_features",
    f"{_SQL_DESCRIPTORS}, {_PROVENANCE_STEPS}"
    + """, f AS (SELECT DISTINCT entity_id, bit FROM provenance),
    fp AS (SELECT entity_id, string_agg(bit, ',' ORDER BY bit) AS bits FROM f GROUP BY entity_id)
    SELECT * FROM fp JOIN (SELECT entity_id, "MolWt", "LogP", "HBD", "HBA", "TPSA", "RotatableBonds", "RingCount",
      "AromaticFraction", "FractionCSP3" FROM descriptors WHERE "MolWt" IS NOT NULL) USING (entity_id)""",
)
def combined_features(spark: SparkSession, sf: str) -> DataFrame:
    """Entities valid in both families: one equi-join, no positions."""
    atoms, bonds = _graph(spark, sf)
    fp = graph.fingerprints(atoms, bonds).select("entity_id", _bits_text("bits").alias("bits"))
    desc = _part_descriptors(atoms, bonds).select("entity_id", *K.DESCRIPTOR_NAMES)
    return fp.join(desc.dropna(), "entity_id")


_SQL_MOTIFS = (
    "WITH "
    + I.SQL_GRAPH
    + """,
nitro AS (
  SELECT DISTINCT n.entity_id FROM atoms n
  JOIN ends e ON e.entity_id = n.entity_id AND e.atom_id = n.atom_id
  JOIN atoms o ON o.entity_id = e.entity_id AND o.atom_id = e.other
  JOIN ends e2 ON e2.entity_id = n.entity_id AND e2.atom_id = n.atom_id AND e2.other <> e.other
  JOIN atoms o2 ON o2.entity_id = e2.entity_id AND o2.atom_id = e2.other
  WHERE n.element = 'N' AND n.charge = 1 AND NOT n.aromatic AND o.element = 'O' AND NOT o.aromatic
    AND o2.element = 'O' AND NOT o2.aromatic AND e."order" = 2 AND NOT e.aromatic AND (e2."order" = 1 OR e2.aromatic)
),
ring AS (
  SELECT entity_id FROM atoms WHERE atom_id <= 6 AND element = 'C' AND aromatic GROUP BY entity_id HAVING count(*) = 6
),
amine AS (
  SELECT DISTINCT entity_id FROM ring JOIN bonds USING (entity_id) WHERE b = 7 AND ("order" = 1 OR aromatic)
)
"""
)


@query(
    "motif_alerts",
    _SQL_MOTIFS
    + """SELECT entity_id, entity_id IN (SELECT entity_id FROM nitro) AS nitro,
      entity_id IN (SELECT entity_id FROM amine) AS ring_amine FROM (SELECT DISTINCT entity_id FROM atoms)""",
)
def motif_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.motif_flags(*_graph(spark, sf))


# --- connected pieces -------------------------------------------------------------


@query(
    "component_count",
    "WITH RECURSIVE "
    + I.SQL_GRAPH
    + """,
reach(entity_id, atom_id, other) AS (
  SELECT entity_id, atom_id, atom_id FROM atoms
  UNION
  SELECT r.entity_id, r.atom_id, e.other FROM reach r JOIN ends e ON e.entity_id = r.entity_id AND e.atom_id = r.other
),
lowest AS (SELECT entity_id, atom_id, min(other) AS low FROM reach GROUP BY 1, 2)
SELECT entity_id, count(*) FILTER (low = atom_id) AS n_components FROM lowest GROUP BY entity_id""",
)
def component_count(spark: SparkSession, sf: str) -> DataFrame:
    return graph.count_components(*_graph(spark, sf))


# --- scaling --------------------------------------------------------------------


@query(
    "standardize",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                 stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_orderkey % 10 < 7)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 5) AS quantity,
           round((l_extendedprice - mp) / sp, 5) AS price FROM lineitem, s""",
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the training rows, applied to all."""
    rows = read_table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )
    scaler = features.Scaler.fit(rows.filter(F.col("l_orderkey") % 10 < 7), ["quantity", "price"])
    return scaler.apply(rows).withColumns(
        {c: F.round(c, 5) for c in ("quantity", "price")}
    )
