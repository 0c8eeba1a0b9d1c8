import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "über", "naïve", "X1", "…"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(60)
    texts = [prose(rng.randint(1, 80)) for _ in range(40)]
    texts += [base, base, base.replace(" ", "\n"), base + " ", "\t" + base, base.replace("alpha", "omega", 1), base + " end"]
    texts += ["", None, " \n\t", "\n\n", "a", "a b", "A  B", "a\tb c", "x" * 5000, prose(30_000), "ſecret K 門 \U0001f600", "a\x1cb\x85c\xa0d"]
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or ""), "row", 7, "digest") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[-1]]  # repeated rows
    rows += [(6, "other text under an id that is taken", None, None, None, None, None, None), (None, base, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, digest string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
