import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from screenloom.llm import bpe_tree, pfair_mix, pii_boost
from screenloom.session import stored


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(4)
    spoken = {"en": "the house of a man and his dog was old", "de": "das haus und der alte mann mit dem hund", "fr": "la maison du vieil homme et le chien"}
    rows = []
    for i in range(400):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(spoken[lang].split()) + " " + rng.choice("abcdefghij") * 3 for _ in range(60))
        rows.append((i, text, "en" if i == 4 else lang, ("web", "book")[i % 5 == 0], len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_the_mixture_gives_the_positions_of_the_last_stage(spark, mixture):
    out = stored(corpus_pipeline.mix_sources(spark, mixture.repartition(3), ""), "mixed")
    got = corpus_pipeline.encode(spark, out, "").select("doc_id", "position").collect()
    placed = pfair_mix.placements(mixture).orderBy("slot", "place").select("key").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == [r.key for r in placed]
    assert sorted(r.position for r in got) == list(range(400))


def test_a_recognised_language_is_carried_on(spark, mixture):
    out = corpus_pipeline.identify_language(spark, mixture, "")
    assert out.columns == mixture.columns
    assert out.filter("doc_id = 4").first()["lang"] == "de"
    assert out.filter(F.col("doc_id") % 3 == 0).filter("lang = 'en'").count() > 120


def test_every_example_teaches_and_counts(spark, monkeypatch):
    """More examples than the old bound of 4,000 a label: each reaches the trees, and the threshold is that of all held-out ones."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"host {rng.randint(1, 254)}.{rng.randint(1, 254)}.{rng.randint(1, 254)}.{rng.randint(1, 254)} was up" for _ in range(12))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    grow = pii_boost.fit_all
    monkeypatch.setattr(pii_boost, "fit_all", lambda binned, settings: (seen.append(binned.n), grow(binned, settings))[1])
    kept = {}
    margins = pii_boost._margins
    monkeypatch.setattr(pii_boost, "_margins", lambda examples, model: kept.setdefault("it", margins(examples, model)))
    model = pii_boost.fit(docs)
    held = kept["it"].filter("kind = 1").toPandas()
    assert seen[0] + len(held) > 20_000
    assert model["ip"].threshold == pii_boost.calibrated_threshold(held["margin"].to_numpy(), held["y"].to_numpy(float))


def test_completed_trees_give_the_same_margins():
    rng = np.random.default_rng(2)
    depth = pii_boost.DEPTH
    feature = rng.integers(-1, 4, (5, 2 << depth))
    feature[:, 1 << depth :] = -1
    threshold, value = rng.normal(size=feature.shape), rng.normal(size=feature.shape)
    x = rng.normal(size=(300, 4))
    model = pii_boost.BoostedModel(feature, threshold, value, value, depth)
    assert np.allclose(pii_boost.completed(model).margin(x), model.margins(x))


def test_one_worker_encodes_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "a", "Hello  w\u00f6rld\n\n\U0001f600 123", "ab " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    apart = docs.select("doc_id", bpe_tree.encoded(docs, path, public_tokenizers.PATTERN).alias("ids"))
    apart = apart.select("doc_id", "ids", bpe_tree.decoded(apart, path).alias("body")).orderBy("doc_id").collect()
    made = docs.select("doc_id", bpe_tree.there_and_back(docs, path, public_tokenizers.PATTERN).alias("m"))
    assert made.select("doc_id", "m.*").orderBy("doc_id").collect() == apart
    plan = made.select(F.sha2(F.array_join(F.col("m.ids").cast("array<string>"), " ").cast("binary"), 256), F.sha2("m.body", 256))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
