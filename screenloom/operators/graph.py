"""Neighbourhood hashes, fingerprints, graph keys, descriptors and motifs.

Graphs are two tables: ``atoms(entity_id, atom_id, element, charge, n_h,
aromatic)`` and ``bonds(entity_id, a, b, order, aromatic, in_ring)``.

Work is spread over (entity, atom), never over the entity alone, so one huge
entity is split over all tasks.  What an atom hears from its neighbours is kept
as sums of their hashes: an order-free digest that combines on the map side and
needs no list of neighbours, whatever the degree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.groups import roots, whole_groups
from screenloom.functions.keys import halves, hash60
from screenloom.session import stored

ENTITY, ATOM = "entity_id", "atom_id"

# An atom with more bonds than this is a hub; its messages go out from HUB_SALTS copies.
HUB_DEGREE = 10_000
HUB_SALTS = 64
# Hubs there can be at most: among many bonds, only atoms with a larger degree count as hubs.
MOST_HUBS = 100_000
# Atoms and bonds of an entity whose pieces are counted in one task; larger ones take rounds over all tasks.
WHOLE = 20_000


def bond_ends(bonds: DataFrame) -> DataFrame:
    """Each bond seen from both of its ends: (entity_id, atom_id, other, ...)."""
    rest = [c for c in bonds.columns if c not in (ENTITY, "a", "b")]
    return bonds.select(
        ENTITY,
        *rest,
        F.inline(
            F.array(
                F.struct(F.col("a").alias(ATOM), F.col("b").alias("other")),
                F.struct(F.col("b").alias(ATOM), F.col("a").alias("other")),
            )
        ),
    )


def find_hubs(bonds: DataFrame, degree: int | None = None) -> DataFrame:
    """(entity_id, atom_id) of atoms with more than ``degree`` bonds; usually none.

    Degrees add up to twice the bonds, so without a given degree there are MOST_HUBS rows at most, few
    enough to broadcast, whatever the table.
    """
    if degree is None:
        degree = max(HUB_DEGREE, 2 * bonds.count() // MOST_HUBS)
    # Such an atom lies in an entity with more than half as many bonds (a bond of an atom with itself counts twice).
    busy = bonds.groupBy(ENTITY).agg(F.count("*").alias("_n")).filter(F.col("_n") * 2 > degree).select(ENTITY)
    busy = stored(busy, "busy")
    within = bonds.select(ENTITY, "a", "b")
    within = within.limit(0) if busy.isEmpty() else within.join(busy, ENTITY, "left_semi")
    return stored(
        bond_ends(within)
        .groupBy(ENTITY, ATOM)
        .agg(F.count("*").alias("_degree"))
        .filter(F.col("_degree") > degree)
        .select(ENTITY, ATOM),
        "hubs",
    )


def _salt(df: DataFrame, atom: str, hubs: DataFrame | None, salt: Column) -> DataFrame:
    """Add ``_salt``: 0, or ``salt`` on rows that belong to a hub."""
    if hubs is None:
        return df.withColumn("_salt", F.lit(0))
    marked = hubs.select(ENTITY, F.col(ATOM).alias(atom), F.lit(True).alias("_hub"))
    joined = df.join(F.broadcast(marked), [ENTITY, atom], "left")
    salts = F.when(F.col("_hub"), salt).otherwise(F.array(F.lit(0)))
    return joined.withColumn("_salt", F.explode(salts)).drop("_hub")


def environment_hashes(
    atoms: DataFrame,
    bonds: DataFrame,
    radius: int = K.FP_RADIUS,
    hubs: DataFrame | None = None,
) -> DataFrame:
    """One row per atom with ``h0`` .. ``h<radius>``: 60-bit hashes of its growing neighbourhood.

    Every atom also hears itself, so a round is one join and one aggregation and
    reads the round before exactly once.  The digest of what an atom hears is
    order-free: a count and two sums, combined on the map side.

    Atoms hear hubs (see ``find_hubs``, which is asked where no hubs are given) from one of several salted
    copies, so no task serves all neighbours of a hub.
    """
    hubs = find_hubs(bonds) if hubs is None else hubs
    hubs = None if hubs.isEmpty() else hubs
    heard_by = bond_ends(bonds.select(ENTITY, "a", "b", "order")).select(
        ENTITY, ATOM, "other", "order", F.lit(False).alias("_self")
    )
    itself = atoms.select(
        ENTITY,
        ATOM,
        F.col(ATOM).alias("other"),
        F.lit(None).cast("int").alias("order"),
        F.lit(True).alias("_self"),
    )
    one_of = F.array(F.pmod(F.xxhash64(ATOM), F.lit(HUB_SALTS)).cast("int"))
    ends = _salt(heard_by.unionByName(itself), "other", hubs, one_of)
    state = atoms.select(
        ENTITY,
        ATOM,
        hash60(
            F.col("element"), F.col("charge"), F.col("n_h"), F.col("aromatic").cast("int")
        ).alias("h0"),
    )
    all_of = F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))
    for r in range(1, radius + 1):
        known = [f"h{i}" for i in range(r)]
        said = _salt(state.withColumnRenamed(ATOM, "other"), "other", hubs, all_of)
        message = hash60(F.col("order"), F.col(known[-1]))
        low, high = halves(F.col("_m"))
        own, far = F.col("_self"), ~F.col("_self")
        state = (
            ends.join(said.hint("merge"), [ENTITY, "other", "_salt"])
            .withColumn("_m", F.when(far, message))
            .groupBy(ENTITY, ATOM)
            .agg(
                *[F.sum(F.when(own, F.col(h))).alias(h) for h in known],
                F.count("_m").alias("_n"),
                F.coalesce(F.sum(low), F.lit(0)).alias("_s1"),
                F.coalesce(F.sum(high), F.lit(0)).alias("_s2"),
            )
            .filter(F.col("h0").isNotNull())
            .select(
                ENTITY,
                ATOM,
                *known,
                hash60(
                    F.lit(r), F.col(known[-1]), F.col("_n"), F.col("_s1"), F.col("_s2")
                ).alias(f"h{r}"),
            )
        )
    return state


def bit_provenance(
    atoms: DataFrame,
    bonds: DataFrame,
    radius: int = K.FP_RADIUS,
    n_bits: int = K.FP_BITS,
    hubs: DataFrame | None = None,
) -> DataFrame:
    """(entity_id, bit, center, radius): which neighbourhoods set which bit."""
    return provenance_of(environment_hashes(atoms, bonds, radius, hubs), radius, n_bits)


def provenance_of(hashes: DataFrame, radius: int = K.FP_RADIUS, n_bits: int = K.FP_BITS) -> DataFrame:
    """The same from ``environment_hashes``, which have a row per atom and so are the smaller table to store."""
    rounds = F.array(
        *[
            F.struct((F.col(f"h{r}") % n_bits).cast("int").alias("bit"), F.lit(r).alias("radius"))
            for r in range(radius + 1)
        ]
    )
    return hashes.select(ENTITY, F.col(ATOM).alias("center"), F.inline(rounds)).select(
        ENTITY, "bit", "center", "radius"
    )


def fold_bits(provenance: DataFrame) -> DataFrame:
    """(entity_id, bits): sorted distinct on-bits, at most n_bits of them per row."""
    return (
        provenance.select(ENTITY, "bit")
        .distinct()
        .groupBy(ENTITY)
        .agg(F.array_sort(F.collect_list("bit")).alias("bits"))
    )


def fingerprints(
    atoms: DataFrame, bonds: DataFrame, radius: int = K.FP_RADIUS, n_bits: int = K.FP_BITS
) -> DataFrame:
    return fold_bits(bit_provenance(atoms, bonds, radius, n_bits))


def graph_keys(
    atoms: DataFrame,
    bonds: DataFrame,
    radius: int = K.FP_RADIUS,
    hubs: DataFrame | None = None,
) -> DataFrame:
    """(entity_id, graph_key): equal for equal graphs however atoms are numbered.

    Graphs the neighbourhood refinement cannot tell apart share a key.
    """
    low, high = halves(F.col(f"h{radius}"))
    return (
        environment_hashes(atoms, bonds, radius, hubs)
        .groupBy(ENTITY)
        .agg(F.count("*").alias("_n"), F.sum(low).alias("_s1"), F.sum(high).alias("_s2"))
        .select(
            ENTITY,
            F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_s1", "_s2")])).alias(
                "graph_key"
            ),
        )
    )


def _bit_hits(asked: DataFrame, provenance: DataFrame) -> DataFrame:
    """Provenance of the asked bits; stored, as every round below reads it."""
    return stored(asked.select(ENTITY, "bit").distinct().join(provenance, [ENTITY, "bit"]), "hits")


def _grow(hits: DataFrame, bonds: DataFrame, radius: int) -> DataFrame:
    ends = bond_ends(bonds.select(ENTITY, "a", "b"))

    def centers(r: int) -> DataFrame:
        return hits.filter(F.col("radius") == r).select(ENTITY, "bit", F.col("center").alias(ATOM))

    reached = centers(radius)
    for r in range(radius - 1, -1, -1):
        step = reached.join(ends, [ENTITY, ATOM]).select(ENTITY, "bit", F.col("other").alias(ATOM))
        reached = reached.unionByName(step).unionByName(centers(r)).distinct()
    return reached


def bit_atoms(
    asked: DataFrame, provenance: DataFrame, bonds: DataFrame, radius: int = K.FP_RADIUS
) -> DataFrame:
    """(entity_id, bit, atom_id): atoms in the union of the environments behind each asked bit.

    The frontier of a bit grows one bond per round and is made distinct each
    time, so it never exceeds the atoms of the entity.
    """
    return _grow(_bit_hits(asked, provenance), bonds, radius)


def map_bits(
    asked: DataFrame, provenance: DataFrame, bonds: DataFrame, radius: int = K.FP_RADIUS
) -> DataFrame:
    """Per asked (entity_id, bit): number of environments and of atoms, and a note.

    A bit the entity does not set keeps its row.  ``bit_atoms`` gives the atoms
    themselves.
    """
    hits = _bit_hits(asked, provenance)
    environments = hits.groupBy(ENTITY, "bit").agg(F.count("*").alias("n_environments"))
    atoms = _grow(hits, bonds, radius).groupBy(ENTITY, "bit").agg(F.count("*").alias("n_atoms"))
    return (
        asked.select(ENTITY, "bit")
        .distinct()
        .join(environments, [ENTITY, "bit"], "left")
        .join(atoms, [ENTITY, "bit"], "left")
        .fillna(0, ["n_environments", "n_atoms"])
        .withColumn(
            "note",
            F.when(F.col("n_environments") > 0, K.NOTE_ACTIVE_BIT).otherwise(K.NOTE_INACTIVE_BIT),
        )
    )


def count_components(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(entity_id, n_components): connected pieces of every entity.

    Entities of at most WHOLE atoms and bonds meet whole in a task, many to a pass of numpy, and are done after
    one shuffle.  Larger ones, if there are any, are spread over all tasks (see ``_contracted``).  Both tables
    are read twice at least, so they should be stored ones.
    """
    points = atoms.select(ENTITY, F.col(ATOM).alias("a"), F.col(ATOM).alias("b"), F.lit(True).alias("own"))
    links = bonds.filter(F.col("a") != F.col("b")).filter(F.col(ENTITY).isNotNull())
    rows = points.unionByName(links.select(ENTITY, "a", "b", F.lit(False).alias("own")))
    large = stored(rows.groupBy(ENTITY).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select(ENTITY), "large")
    if large.isEmpty():
        return _taken_apart(rows)
    large = large.withColumnRenamed(ENTITY, "_large")
    part = lambda t, how: t.join(large, t[ENTITY].eqNullSafe(large["_large"]), how)
    spread = _contracted(part(atoms, "left_semi"), part(bonds, "left_semi"))
    return _taken_apart(part(rows, "left_anti")).unionByName(spread)


def _taken_apart(rows: DataFrame) -> DataFrame:
    """(entity_id, n_components) from rows (entity_id, a, b, own): atoms as a = b with ``own``, and links."""
    kind = rows.schema[ENTITY].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["_group"]):
            yield _pieces(table)

    dealt = rows.withColumn("_group", F.xxhash64(ENTITY)).repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInArrow(count, f"{ENTITY} {kind}, n_components long")


def _pieces(table: pa.Table) -> pa.RecordBatch:
    """Pieces of each entity: its atoms less those nodes that are not the first of their piece."""
    entity = table[ENTITY].combine_chunks().dictionary_encode(null_encoding="encode")
    ends = pa.concat_arrays([*table["a"].chunks, *table["b"].chunks]).dictionary_encode(null_encoding="encode")
    many, rows = len(ends.dictionary), table.num_rows
    code = np.tile(entity.indices.to_numpy().astype(np.int64) * many, 2) + ends.indices.to_numpy()
    node, at = np.unique(code, return_inverse=True)
    a, b, own = at[:rows], at[rows:], table["own"].to_numpy()
    label, owner = roots(a[~own], b[~own], len(node)), node // many
    there = np.zeros(len(node), bool)
    there[a[own]] = True
    n = len(entity.dictionary)
    atoms = np.bincount(owner[there], minlength=n)
    pieces = atoms - np.bincount(owner[label != np.arange(len(node))], minlength=n)
    with_atoms = pa.array(atoms > 0)
    return pa.RecordBatch.from_arrays(
        [entity.dictionary.filter(with_atoms), pa.array(pieces).filter(with_atoms)], [ENTITY, "n_components"]
    )


def _contracted(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(entity_id, n_components) for entities of any size.

    Star contraction: a round links every larger neighbour of an atom to the atom's smallest one, and then
    every smaller neighbour, and the atom, to the smallest of them.  Links get fewer and flatter until
    they are stars around the smallest atom of each piece; rounds grow with the logarithm of the atoms.  An atom
    with very many bonds is only ever aggregated, or joined as the many side to its one row.  Each round
    is stored, which keeps the lineage flat.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = stored(bonds.filter("a <> b").select(ENTITY, u, v).distinct(), "links")
    seen = _print_of(links)
    while seen[0]:
        links = stored(_small_star(_large_star(links)), "stars")
        now = _print_of(links)
        if now == seen:
            break
        seen = now
    # An atom that is the larger end of a link is not the smallest of its piece.
    inner = links.select(ENTITY, F.col("u").alias(ATOM)).distinct().groupBy(ENTITY).agg(F.count("*").alias("_inner"))
    pieces = F.col("_atoms") - F.coalesce("_inner", F.lit(0))
    whole = atoms.select(ENTITY, ATOM).distinct().groupBy(ENTITY).agg(F.count("*").alias("_atoms"))
    return whole.join(inner, ENTITY, "left").select(ENTITY, pieces.alias("n_components"))


def _print_of(links: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(ENTITY, "u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(ENTITY, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(ENTITY, "u").agg(F.min("v").alias("_low")).withColumn("_low", F.least("u", "_low"))
    moved = both.filter("v > u").join(least, [ENTITY, "u"])
    return moved.select(ENTITY, F.col("v").alias("u"), F.col("_low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(ENTITY, "u").agg(F.min("v").alias("_low"))
    moved = links.join(least, [ENTITY, "u"]).filter("v <> _low").select(ENTITY, F.col("v").alias("u"), F.col("_low").alias("v"))
    return moved.union(least).distinct()


def atom_type(element: Column, aromatic: Column, n_h: Column) -> Column:
    """Default atom type: element, aromatic flag, hydrogens."""
    return F.concat_ws(":", element, aromatic.cast("int").cast("string"), n_h.cast("string"))


def atomic_weight(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*K.ATOMIC_WEIGHTS.items())])
    return F.try_element_at(table, element)


def descriptors(
    atoms: DataFrame,
    bonds: DataFrame,
    contributions: DataFrame | None = None,
    components: DataFrame | None = None,
) -> DataFrame:
    """The nine descriptors of each entity, in their fixed order, plus ``heavy``.

    ``contributions(atom_type, logp, tpsa)`` holds the additive group
    contributions; without it LogP and TPSA are null.  ``components(entity_id,
    n_components)`` corrects the ring count of entities in several pieces; the
    default is one piece.
    """
    ends = bond_ends(bonds.select(ENTITY, "a", "b", "order", "aromatic"))
    degree = ends.groupBy(ENTITY, ATOM).agg(
        F.count("*").alias("degree"),
        F.max(F.when(F.col("aromatic") | (F.col("order") > 1), 1).otherwise(0)).alias("unsaturated"),
    )
    full = atoms.join(degree, [ENTITY, ATOM], "left").fillna(0, ["degree", "unsaturated"])
    if contributions is not None:
        kind = atom_type(F.col("element"), F.col("aromatic"), F.col("n_h"))
        table = contributions.select("atom_type", "logp", "tpsa")
        full = full.withColumn("atom_type", kind).join(table, "atom_type", "left")
    else:
        nothing = F.lit(None).cast("double")
        full = full.withColumn("logp", nothing).withColumn("tpsa", nothing)

    polar = F.col("element").isin("N", "O")
    carbon = F.col("element") == "C"
    weight = atomic_weight(F.col("element")) + F.col("n_h") * K.HYDROGEN_WEIGHT
    heavy = F.col("element") != "H"
    sp3 = carbon & (F.col("unsaturated") == 0) & (F.col("degree") + F.col("n_h") == 4)
    by_atom = full.groupBy(ENTITY).agg(
        F.sum(weight).alias("MolWt"),
        F.sum("logp").alias("LogP"),
        F.count_if(polar & (F.col("n_h") > 0)).alias("HBD"),
        F.count_if(polar).alias("HBA"),
        F.sum("tpsa").alias("TPSA"),
        F.count("*").alias("_atoms"),
        F.count_if(heavy).alias("heavy"),
        F.count_if(F.col("aromatic")).alias("_aromatic"),
        F.count_if(carbon).alias("_carbons"),
        F.count_if(sp3).alias("_sp3"),
    )
    ends_degree = degree.select(ENTITY, ATOM, "degree")
    flagged = (
        bonds.select(ENTITY, "a", "b", "order", "aromatic", "in_ring")
        .join(
            ends_degree.select(ENTITY, F.col(ATOM).alias("a"), F.col("degree").alias("_da")),
            [ENTITY, "a"],
        )
        .join(
            ends_degree.select(ENTITY, F.col(ATOM).alias("b"), F.col("degree").alias("_db")),
            [ENTITY, "b"],
        )
    )
    rotatable = (
        (F.col("order") == 1)
        & ~F.col("aromatic")
        & ~F.col("in_ring")
        & (F.col("_da") > 1)
        & (F.col("_db") > 1)
    )
    by_bond = flagged.groupBy(ENTITY).agg(
        F.count("*").alias("_bonds"), F.count_if(rotatable).alias("RotatableBonds")
    )
    rows = by_atom.join(by_bond, ENTITY, "left").fillna(0, ["_bonds", "RotatableBonds"])
    if components is not None:
        rows = rows.join(components.select(ENTITY, "n_components"), ENTITY, "left")
        pieces = F.coalesce(F.col("n_components"), F.lit(1))
    else:
        pieces = F.lit(1)
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return rows.select(
        ENTITY,
        "MolWt",
        "LogP",
        "HBD",
        "HBA",
        "TPSA",
        "RotatableBonds",
        (F.col("_bonds") - F.col("_atoms") + pieces).alias("RingCount"),
        share("_aromatic", "heavy").alias("AromaticFraction"),
        share("_sp3", "_carbons").alias("FractionCSP3"),
        "heavy",
    )


def nitro_entities(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Entities with an N+ that has a double bond to one O and a single bond to another."""
    ends = bond_ends(bonds.select(ENTITY, "a", "b", "order", "aromatic"))
    plain = ~F.col("aromatic")
    oxygen = atoms.filter((F.col("element") == "O") & plain).select(
        ENTITY, F.col(ATOM).alias("other")
    )
    nitrogen = atoms.filter((F.col("element") == "N") & (F.col("charge") == 1) & plain)
    loose = F.col("aromatic") | (F.col("order") == 1)
    return (
        ends.join(oxygen, [ENTITY, "other"], "left_semi")
        .groupBy(ENTITY, ATOM)
        .agg(
            F.max((~F.col("aromatic") & (F.col("order") == 2)).cast("int")).alias("_double"),
            F.max(loose.cast("int")).alias("_single"),
        )
        .filter((F.col("_double") == 1) & (F.col("_single") == 1))
        .join(nitrogen, [ENTITY, ATOM], "left_semi")
        .select(ENTITY)
        .distinct()
    )


def ring_amine_entities(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Entities with a nitrogen on a six-ring of aromatic carbons.

    From a carbon that carries the nitrogen two three-step walks must meet at the opposite carbon without
    sharing a step: two disjoint pairs of middle carbons.  Pairs without two disjoint ones all share a carbon
    or lie within three, so counts per carbon decide, and walks never meet each other.
    """
    loose = F.col("aromatic") | (F.col("order") == 1)
    ends = bond_ends(bonds.filter(loose).select(ENTITY, "a", "b"))
    carbon = atoms.filter((F.col("element") == "C") & F.col("aromatic")).select(ENTITY, ATOM)
    nitrogen = atoms.filter((F.col("element") == "N") & ~F.col("aromatic")).select(ENTITY, ATOM)
    as_other = lambda t: t.withColumnRenamed(ATOM, "other")
    from_carbon = ends.join(carbon, [ENTITY, ATOM], "left_semi")
    among = from_carbon.join(as_other(carbon), [ENTITY, "other"], "left_semi").select(ENTITY, ATOM, "other").distinct()
    # A carbon with one neighbour is on no ring; the many single neighbours of a large atom go here.
    twice = among.groupBy(ENTITY, ATOM).agg(F.count("*").alias("_n")).filter("_n > 1").select(ENTITY, ATOM)
    ring_step = stored(
        among.join(twice, [ENTITY, ATOM], "left_semi").join(as_other(twice), [ENTITY, "other"], "left_semi"), "ring_steps"
    )
    anchors = (
        from_carbon.join(as_other(nitrogen), [ENTITY, "other"], "left_semi")
        .select(ENTITY, F.col(ATOM).alias("v0"))
        .distinct()
    )

    def step(walks: DataFrame, i: int) -> DataFrame:
        edges = ring_step.select(ENTITY, F.col(ATOM).alias(f"v{i - 1}"), F.col("other").alias(f"v{i}"))
        walks = walks.join(edges, [ENTITY, f"v{i - 1}"])
        for seen in range(i - 1):
            walks = walks.filter(F.col(f"v{seen}") != F.col(f"v{i}"))
        return walks

    walks = anchors
    for i in (1, 2, 3):
        walks = step(walks, i)
    goal = [ENTITY, "v0", "v3"]
    pairs = walks.select(*goal, F.least("v1", "v2").alias("p"), F.greatest("v1", "v2").alias("q")).distinct()
    return disjoint_pairs(pairs, goal).select(ENTITY).distinct()


def disjoint_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The groups in which some two of the distinct pairs (p < q) have no member in common.

    Pairs that all meet each other share one member or are the three sides of a triangle.
    """
    members = pairs.select(*by, F.explode(F.array("p", "q")).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    told = members.groupBy(*by).agg(F.max("_c").alias("_most"), F.count("*").alias("_members"), F.sum("_c").alias("_ends"))
    shared, triangle = F.col("_most") * 2 == F.col("_ends"), (F.col("_ends") == 6) & (F.col("_members") == 3)
    return told.filter(~shared & ~triangle).select(*by)


def motif_flags(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(entity_id, nitro, ring_amine) for every entity."""
    hit = lambda t, name: t.withColumn(name, F.lit(True))
    return (
        atoms.select(ENTITY)
        .distinct()
        .join(hit(nitro_entities(atoms, bonds), "nitro"), ENTITY, "left")
        .join(hit(ring_amine_entities(atoms, bonds), "ring_amine"), ENTITY, "left")
        .fillna(False, ["nitro", "ring_amine"])
    )
