import random

import pytest
from pyspark.sql import functions as F

from screenloom.functions import lexical
from screenloom.operators import graph
from screenloom.plans import feature_queries, inputs

ATOMS = "entity_id BIGINT, atom_id INT, element STRING, charge INT, n_h INT, aromatic BOOLEAN"
BONDS = "entity_id BIGINT, a INT, b INT, order INT, aromatic BOOLEAN, in_ring BOOLEAN"

RING = [(i, (i + 1) % 6, 1, True, True) for i in range(6)]


def ring_atoms(h):
    return [("C", 0, h[i], True) for i in range(6)]


# name: (atoms as element, charge, hydrogens, aromatic; bonds as a, b, order, aromatic, in_ring)
MOLECULES = {
    "ethanol": ([("C", 0, 3, False), ("C", 0, 2, False), ("O", 0, 1, False)],
                [(0, 1, 1, False, False), (1, 2, 1, False, False)]),
    "benzene": (ring_atoms([1] * 6), RING),
    "nitrobenzene": (ring_atoms([0, 1, 1, 1, 1, 1]) + [("N", 1, 0, False), ("O", 0, 0, False), ("O", -1, 0, False)],
                     RING + [(0, 6, 1, False, False), (6, 7, 2, False, False), (6, 8, 1, False, False)]),
    "aniline": (ring_atoms([0, 1, 1, 1, 1, 1]) + [("N", 0, 2, False)], RING + [(0, 6, 1, False, False)]),
    "methane": ([("C", 0, 4, False)], []),
    # CC(=O)Oc1ccccc1C(=O)O
    "aspirin": (ring_atoms([0, 0, 1, 1, 1, 1])
                + [("O", 0, 0, False), ("C", 0, 0, False), ("O", 0, 0, False), ("C", 0, 3, False),
                   ("C", 0, 0, False), ("O", 0, 0, False), ("O", 0, 1, False)],
                RING + [(0, 6, 1, False, False), (6, 7, 1, False, False), (7, 8, 2, False, False),
                        (7, 9, 1, False, False), (1, 10, 1, False, False), (10, 11, 2, False, False),
                        (10, 12, 1, False, False)]),
}
NAMES = list(MOLECULES)


def tables(spark, shuffle_seed=None, only=NAMES):
    atoms, bonds = [], []
    for name in only:
        e, (mine, links) = NAMES.index(name), MOLECULES[name]
        number = list(range(len(mine)))
        if shuffle_seed is not None:
            random.Random(shuffle_seed + e).shuffle(number)
        atoms += [(e, number[i], *a) for i, a in enumerate(mine)]
        bonds += [(e, number[a], number[b], *rest) for a, b, *rest in links]
    return spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)


def test_keys_and_bits_ignore_numbering(spark):
    plain, mixed = tables(spark), tables(spark, shuffle_seed=4)
    key = lambda t: {r.entity_id: r.graph_key for r in graph.graph_keys(*t).collect()}
    assert key(plain) == key(mixed) and len(set(key(plain).values())) == len(NAMES)
    bits = lambda t: {r.entity_id: r.bits for r in graph.fingerprints(*t).collect()}
    found = bits(plain)
    assert found == bits(mixed)
    assert all(b == sorted(set(b)) and 0 <= b[0] and b[-1] < 2048 for b in found.values())
    # All ring atoms of benzene look alike: one bit per radius.
    assert len(found[NAMES.index("benzene")]) == 3
    wide = graph.fingerprints(*plain, radius=3).count()
    assert wide == len(NAMES)


def test_hub_salting_changes_nothing(spark):
    n = 200
    atoms = spark.createDataFrame(
        [(0, i, "C" if i % 3 else "O", 0, i % 2, False) for i in range(n)], ATOMS
    )
    bonds = spark.createDataFrame([(0, 0, i, 1 + i % 2, False, False) for i in range(1, n)], BONDS)
    hubs = graph.find_hubs(bonds, degree=50)
    assert [tuple(r) for r in hubs.collect()] == [(0, 0)]
    rows = lambda h: sorted(map(tuple, graph.environment_hashes(atoms, bonds, 2, h).collect()))
    assert rows(hubs) == rows(None)
    assert graph.find_hubs(bonds).count() == 0


def test_bit_mapping(spark):
    atoms, bonds = tables(spark, only=["ethanol", "benzene"])
    provenance = graph.bit_provenance(atoms, bonds)
    benzene = NAMES.index("benzene")
    rows = provenance.filter(F.col("entity_id") == benzene).collect()
    by_radius = {r.radius: r.bit for r in rows}
    off = next(b for b in range(2048) if b not in by_radius.values())
    asked = spark.createDataFrame([(benzene, b) for b in [*by_radius.values(), off]], "entity_id BIGINT, bit INT")
    got = {r.bit: r for r in graph.map_bits(asked, provenance, bonds).collect()}
    assert all(got[b].n_environments == 6 and got[b].n_atoms == 6 for b in by_radius.values())
    assert got[off].n_environments == 0 and got[off].note == "Bit not active in this molecule"
    ethanol = NAMES.index("ethanol")
    end = provenance.filter(f"entity_id = {ethanol} AND center = 0 AND radius = 1").first()
    one = graph.bit_atoms(spark.createDataFrame([(ethanol, end.bit)], "entity_id BIGINT, bit INT"), provenance, bonds)
    assert {0, 1} <= {r.atom_id for r in one.collect()}


def test_descriptors(spark):
    atoms, bonds = tables(spark)
    contributions = spark.createDataFrame([("C:1:1", 0.3, 0.0), ("O:0:0", 0.1, 17.0)], "atom_type STRING, logp DOUBLE, tpsa DOUBLE")
    rows = {NAMES[r.entity_id]: r for r in graph.descriptors(atoms, bonds, contributions).collect()}
    a = rows["aspirin"]
    assert a.MolWt == pytest.approx(180.16, abs=0.05)
    assert (a.heavy, a.RingCount, a.HBD, a.HBA, a.RotatableBonds) == (13, 1, 1, 4, 3)
    assert a.AromaticFraction == pytest.approx(6 / 13) and a.FractionCSP3 == pytest.approx(1 / 9)
    assert a.LogP == pytest.approx(4 * 0.3 + 3 * 0.1) and a.TPSA == pytest.approx(51.0)
    assert (rows["methane"].RingCount, rows["methane"].FractionCSP3, rows["methane"].RotatableBonds) == (0, 1.0, 0)
    assert rows["ethanol"].MolWt == pytest.approx(46.07, abs=0.01)
    plain = graph.descriptors(atoms, bonds).first()
    assert plain.LogP is None and plain.TPSA is None
    pieces = spark.createDataFrame([(NAMES.index("methane"), 2)], "entity_id BIGINT, n_components INT")
    two = {r.entity_id: r.RingCount for r in graph.descriptors(atoms, bonds, components=pieces).collect()}
    assert two[NAMES.index("methane")] == 1


def test_motifs(spark):
    rows = {NAMES[r.entity_id]: r for r in graph.motif_flags(*tables(spark, shuffle_seed=2)).collect()}
    assert {n for n, r in rows.items() if r.nitro} == {"nitrobenzene"}
    assert {n for n, r in rows.items() if r.ring_amine} == {"nitrobenzene", "aniline"}
    assert len(rows) == len(NAMES)


@pytest.mark.parametrize(
    "text, heavy, rings, aromatic",
    [
        ("CC(=O)Oc1ccccc1C(=O)O", 13, 1, 6),
        ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", 14, 2, 9),
        ("CCCCc1oc2ccccc2c1C(=O)c1cc(I)c(OCCN(CC)CC)c(I)c1", 31, 3, 15),
        ("[NH3+][C@@H]1CC1Cl", 5, 1, 0),
    ],
)
def test_lexical_counts(spark, text, heavy, rings, aromatic):
    df = spark.createDataFrame([(text,)], "t STRING")
    t = F.col("t")
    row = df.select(lexical.heavy_atoms(t), lexical.ring_count(t), lexical.aromatic_atoms(t)).first()
    assert tuple(row) == (heavy, rings, aromatic)


def test_components(spark):
    n = 70
    atoms = [(0, (i * 37) % n, "C", 0, 2, False) for i in range(n)] + [(1, i, "C", 0, 4, False) for i in range(3)]
    # One long chain in scrambled order; entity 1 is a pair and a single atom.
    bonds = [(0, (i * 37) % n, ((i + 1) * 37) % n, 1, False, False) for i in range(n - 1)] + [(1, 2, 0, 1, False, False)]
    a, b = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)
    pieces = graph.count_components(a, b)
    assert {r.entity_id: r.n_components for r in pieces.collect()} == {0: 1, 1: 2}
    rings = {r.entity_id: r.RingCount for r in graph.descriptors(a, b, components=pieces).collect()}
    assert rings == {0: 0, 1: 0}


def test_components_of_random_graphs_and_a_hub(spark):
    rng = random.Random(6)
    atoms, bonds, want = [], [], {}
    for e in range(8):
        n = 60
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 70))]
        # Entity 7: one atom bound to all others but two; repeats and self links say nothing new.
        links = links if e < 7 else [(31, i) for i in range(n - 2)] * 2
        label = list(range(n))
        for _ in range(n):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        want[e] = len(set(label))
        atoms += [(e, i, "C", 0, 0, False) for i in range(n)]
        bonds += [(e, a, b, 1, False, False) for a, b in links]
    pieces = graph.count_components(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS))
    assert {r.entity_id: r.n_components for r in pieces.collect()} == want


@pytest.mark.parametrize("whole", [20_000, 100, 0])
def test_small_entities_take_no_rounds_and_all_sizes_agree(spark, monkeypatch, whole):
    rng = random.Random(9)
    atoms, bonds, want = [(None, i % 4, "C", 0, 0, False) for i in range(150)], [(None, 0, 1, 1, False, False)] * 3, {None: 4}
    for e in range(40):
        n = rng.choice([1, 5, 12, 90])
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n))]
        label = list(range(n))
        for _ in range(n):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        want[e] = len(set(label))
        atoms += [(e, i, "C", 0, 0, False) for i in range(n)]
        bonds += [(e, a, b, 1, False, False) for a, b in links]
    bonds += [(77, 0, 1, 1, False, False), (0, 0, None, 1, False, False)]
    monkeypatch.setattr(graph, "WHOLE", whole)
    written, kinds = graph.stored, []
    monkeypatch.setattr(graph, "stored", lambda df, kind="table": (kinds.append(kind), written(df, kind))[1])
    pieces = graph.count_components(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS))
    assert {r.entity_id: r.n_components for r in pieces.collect()} == want and pieces.count() == len(want)
    # No table of links is written round by round where every entity is small.
    assert ("stars" in kinds) == (whole < 20_000)


def test_parts_keep_atoms_at_any_line_number(spark, tmp_path):
    rng = random.Random(2)
    numbers = [None, -8, -7, -1, 0, *range(1, 16), 20]
    lines = [(rng.choice([1, 2, 3, None]), rng.choice(numbers), rng.choice([None, 1.0, 7.9, 30.0])) for _ in range(300)]
    lines += [(9, 1, None), (9, 2, 4.0), (9, 8, 4.0), (9, 9, 4.0)]
    schema = "l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    atoms, bonds = inputs.part_graph(spark, str(tmp_path))
    assert atoms.schema["atom_id"].dataType.simpleString() == "int"
    total = {}
    for part, line, quantity in lines:
        known = total.setdefault((part, line), [0, None])
        known[0] += 1
        known[1] = known[1] if quantity is None else (known[1] or 0) + int(quantity)
    rows = {(r.entity_id, r.atom_id): r for r in atoms.collect()}
    assert set(rows) == set(total) and atoms.count() == len(total)
    for at, (count, q) in total.items():
        element = "N" if at[1] == 7 else "C" if q is None else "O" if q % 9 in (0, 2) else "N" if q % 9 == 1 else "C"
        got = rows[at]
        assert (got.element, got.charge) == (element, int(element == "N" and count % 2 == 0))
        assert got.n_h == (None if q is None else q % 3)
    ring = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 6), (6, 7)]
    want = {(p, a, b) for p in (1, 2, 3, 9) for a, b in ring if (p, a) in total and (p, b) in total}
    assert {(r.entity_id, r.a, r.b) for r in bonds.collect()} == want and bonds.count() == len(want)


def has_ring_amine(n, links, nitrogen):
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(n)}
    for v0 in {c for c, x in nitrogen}:
        walks = [(v1, v2, v3) for v1 in near[v0] for v2 in near[v1] - {v0} for v3 in near[v2] - {v0, v1}]
        for a in walks:
            if any(a[2] == b[2] and not set(a[:2]) & set(b[:2]) for b in walks):
                return True
    return False


def test_ring_amines_of_random_graphs(spark):
    """Meeting walks are told by counts of middle carbons; compared with all pairs of walks."""
    rng = random.Random(3)
    atoms, bonds, want = [], [], set()
    for e in range(60):
        n = rng.randint(5, 9)
        links = list({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(4, 11))})
        carbons = [(rng.randrange(n), 100)]
        atoms += [(e, i, "C", 0, 0, True) for i in range(n)] + [(e, 100, "N", 0, 2, False)]
        bonds += [(e, a, b, 1, True, True) for a, b in links] + [(e, c, x, 1, False, False) for c, x in carbons]
        if has_ring_amine(n, links, carbons):
            want.add(e)
    got = graph.ring_amine_entities(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS))
    assert {r.entity_id for r in got.collect()} == want and 5 < len(want) < 55


def test_ring_amine_at_a_carbon_with_many_neighbours(spark):
    """10,000 single neighbours of a ring carbon, each with a nitrogen, give no walks of their own."""
    ring = [(i, (i + 1) % 6) for i in range(6)]
    atoms = [(0, i, "C", 0, 0, True) for i in range(6)] + [(0, 100 + i, "C", 0, 0, True) for i in range(10_000)]
    atoms += [(0, 50_000 + i, "N", 0, 2, False) for i in range(10_000)]
    bonds = [(0, a, b, 1, True, True) for a, b in ring] + [(0, 0, 100 + i, 1, True, True) for i in range(10_000)]
    bonds += [(0, 100 + i, 50_000 + i, 1, False, False) for i in range(10_000)]
    a, b = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)
    assert graph.ring_amine_entities(a, b).count() == 0
    more = b.union(spark.createDataFrame([(0, 3, 50_000, 1, False, False)], BONDS))
    assert [r.entity_id for r in graph.ring_amine_entities(a, more).collect()] == [0]


def test_hubs_are_found_in_the_plan(spark, monkeypatch):
    """An atom with a third of all bonds is split; no number of hubs is an error, and results stay."""
    bonds = [(0, 0, i, 1, False, False) for i in range(1, 101)]
    bonds += [(0, i, i + 1, 2, False, False) for i in range(1, 100)] + [(0, 101 + i, 102 + i, 1, False, False) for i in range(99)]
    atoms = [(0, i, "C", 0, i % 3, False) for i in range(202)]
    a, b = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)
    rows = lambda: sorted(tuple(r) for r in graph.environment_hashes(a, b).collect())
    want = rows()
    monkeypatch.setattr(graph, "HUB_DEGREE", 50)
    assert [r.atom_id for r in graph.find_hubs(b).collect()] == [0]
    assert rows() == want
    monkeypatch.setattr(graph, "HUB_DEGREE", 1)
    monkeypatch.setattr(graph, "MOST_HUBS", 150)
    assert 0 < graph.find_hubs(b).count() <= 150 and rows() == want


def test_hubs_by_bonds_with_themselves_are_found(spark):
    bonds = [(1, 5, 5, 1, False, False)] * 3 + [(2, 0, i, 1, False, False) for i in range(1, 6)] + [(3, 0, i, 1, False, False) for i in range(1, 7)]
    hubs = graph.find_hubs(spark.createDataFrame(bonds, BONDS), degree=5).collect()
    assert {(r.entity_id, r.atom_id) for r in hubs} == {(1, 5), (3, 0)}


def test_rounds_hold_no_table_of_atoms_whole(spark):
    atoms, bonds = tables(spark)
    plan = graph.environment_hashes(atoms, bonds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_asked_bits_are_mapped_from_one_row_an_atom(spark, tmp_path, monkeypatch):
    lines = [(part, slot, 1.0 * (part * slot % 50)) for part in range(1, 30) for slot in range(1, 8) if (part + slot) % 5]
    spark.createDataFrame(lines, "l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = {}
    for module in (graph, feature_queries):
        written = module.stored
        keep = lambda df, kind="table", written=written: rows.setdefault(kind, written(df, kind))
        monkeypatch.setattr(module, "stored", keep)
    found = feature_queries.bit_atoms(spark, str(tmp_path)).collect()
    assert rows["hashes"].count() == len(lines) and "provenance" not in rows
    provenance = graph.provenance_of(rows["hashes"])
    bits = {}
    for r in provenance.collect():
        bits.setdefault(r.entity_id, set()).add(r.bit)
    asked = feature_queries._asked(provenance).collect()
    assert len(asked) == len(set(asked)) and {tuple(r) for r in asked} == {(e, b) for e, on in bits.items() for b in (min(on), e % 2048)}
    assert {(r.entity_id, r.bit) for r in found} == {(e, b) for e, b in map(tuple, asked) if b in bits[e]}
