"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, lang_pred string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeiortn") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 2, 3, 40, 120])) for _ in range(n)]
    base = words(rng, 150)
    near = [base.replace(" ", "  ", 1), base.upper(), base + " end", base]
    odd = [None, None, "", "   \n\t", "12 345 .", "a", "rr" * 4000, "é ñ ü 漢字 🙂\x00", words(rng, 5000), texts[0]]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", 1, "x", "y", "z") for i, t in enumerate(texts + near + odd)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
