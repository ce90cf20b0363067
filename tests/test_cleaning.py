import pytest
from pyspark.sql import functions as F

from screenloom.functions.keys import NOTATION, notation_is_valid, text_key
from screenloom.operators import cleaning, merging, summaries, voting

ROWS = [
    (0, "CCO", 0, "test"),
    (1, "c1ccccc1", 1, "test"),
    (2, "INVALID", 0, "test"),
    (3, "CC(=O)O", 1, "test"),
    (4, None, 0, "test"),
    (5, "", 1, "test"),
    (6, "CCO", 1, "test"),
]
SCHEMA = "row_id BIGINT, smiles STRING, label INT, source STRING"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_tagging_and_filters(frame):
    tagged = cleaning.tag_valid(frame, rule=NOTATION)
    assert tagged.filter("_valid").count() == 4
    assert tagged.filter("NOT _valid AND smiles IS NOT NULL").count() == 0
    kept = cleaning.drop_invalid(tagged)
    assert kept.count() == 4 and "_valid" not in kept.columns
    assert cleaning.drop_invalid(frame.select("smiles")).count() == 6


def test_clean_resolves_tie_to_one(frame):
    rows = {r.smiles: r for r in cleaning.clean(frame, rule=NOTATION).collect()}
    assert set(rows) == {"CCO", "c1ccccc1", "CC(=O)O"}
    assert rows["CCO"].label == 1 and rows["CCO"].row_id == 0 and rows["CCO"].n_merged == 2
    with pytest.raises(cleaning.TooFewRows):
        cleaning.clean(frame, rule=NOTATION, min_rows=100)


def test_votes_sources_and_first_row(spark):
    rows = [
        (7, "a", 1, "x"),
        (3, "a", 0, "y"),
        (5, "a", 1, None),
        (1, "b", 1, "y"),
        (2, "b", 0, "x"),
        (4, "b", 0, "x"),
        (8, "c", 1, None),
        (9, None, 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 13):
        out = {r.smiles: r for r in voting.resolve_labels(df.repartition(parts)).collect()}
        assert set(out) == {"a", "b", "c"}
        assert (out["a"].label, out["a"].source, out["a"].row_id) == (1, "x+y", 3)
        assert (out["b"].label, out["b"].source, out["b"].row_id) == (0, "x+y", 1)
        assert out["c"].source == ""
    assert {r.n_rows for r in voting.duplicate_keys(df).collect()} == {3}
    assert voting.label_conflicts(df).count() == 2


def test_labels_truncate_unless_strict(spark):
    df = spark.createDataFrame([(0.7,), (1.9,), (2.0,), (1.0,), (None,), (float("nan"),)], "label DOUBLE")
    loose = cleaning.binary_labels(cleaning.drop_unlabelled(df))
    assert sorted(r.label for r in loose.collect()) == [0, 1, 1]
    assert [r.label for r in cleaning.binary_labels(df, strict=True).collect()] == [1]


def test_union_skips_empty_and_fails_when_all_are(spark, frame):
    one = merging.standardize_source(frame.select("smiles", "label"), "A", "Drug", "Y")
    both = merging.union_sources([one, one.limit(0), one])
    assert both.count() == 14 and both.columns == ["smiles", "label", "source"]
    with pytest.raises(ValueError):
        merging.union_sources([one.limit(0)])


def test_column_resolution():
    assert merging.resolve_column(["id", "SMILES"]) == "SMILES"
    assert merging.resolve_key_alias(["name", "Drug", "smi"]) == "Drug"
    with pytest.raises(ValueError):
        merging.resolve_column(["a"])
    with pytest.raises(ValueError):
        merging.resolve_key_alias(["a"])


def test_text_key(spark):
    df = spark.createDataFrame([(" A  b\n\tC ",), (" \n ",), (None,), ("x y",)], "t STRING")
    assert [r.k for r in df.select(text_key(F.col("t")).alias("k")).collect()] == ["a b c", None, None, "x y"]


@pytest.mark.parametrize(
    "text, ok",
    [
        ("CC(=O)Oc1ccccc1C(=O)O", True),
        ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", True),
        ("  CC(=O)O  ", True),
        ("NCCCC[C@@H](N[C@@H](CCc1ccccc1)C(=O)O)C(=O)N1CCC[C@H]1C(=O)O", True),
        ("C%12CCCC%12", True),
        ("NOT_A_MOLECULE", False),
        ("INVALID_SMILES", False),
        ("", False),
        ("   ", False),
        (None, False),
        ("!@#$%^&*()", False),
        ("()", False),
        ("CC)C(", False),
        ("C1CC", False),
        ("C" * 40000, True),
    ],
)
def test_notation_screen(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(notation_is_valid(F.col("t"))).first()[0] is ok


def test_balance_and_summary(spark, frame):
    row = summaries.class_balance(frame).first()
    assert row.total == row.toxic + row.nontoxic == 7
    assert row.imbalance_ratio == pytest.approx(4 / 3) and not row.imbalanced
    only = summaries.class_balance(frame.filter("label = 1")).first()
    assert only.imbalance_ratio == float("inf") and only.imbalanced
    assert summaries.class_balance(frame.limit(0)).first().toxic_ratio == 0
    assert summaries.class_weights(frame.filter("label = 0")).first().scale_pos_weight == 1.0
    assert summaries.dataset_summary(frame).first().missing_smiles == 1
    assert summaries.validity_summary(cleaning.tag_valid(frame.limit(0))).first().invalid_share is None


def test_cv_summary_error_row(spark):
    schema = "model STRING, fold INT, roc_auc DOUBLE, accuracy DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE, train_roc_auc DOUBLE, error STRING"
    rows = [("a", 0, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0, None), ("a", 1, 0.7, 0.5, 0.5, 0.5, 0.5, 1.0, None), ("b", 0, *[None] * 6, "boom")]
    out = {r.model: r for r in summaries.cv_summary(spark.createDataFrame(rows, schema)).collect()}
    assert out["a"].cv_roc_auc_mean == pytest.approx(0.6)
    assert out["a"].cv_roc_auc_std == pytest.approx(0.1)
    assert out["b"].cv_roc_auc_mean == 0.0 and out["b"].error == "boom" and out["b"].cv_f1_mean is None
    long = summaries.comparison_long(spark.createDataFrame([("a", 0.5, 0.6)], "model STRING, cv_roc_auc_mean DOUBLE, cv_f1_mean DOUBLE"))
    assert {(r.metric, r.value) for r in long.collect()} == {("Roc Auc", 0.5), ("F1", 0.6)}
