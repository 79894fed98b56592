import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]


@pytest.fixture
def make_docs(spark):
    """docs from texts or (doc_id, text, lang, source); extra columns with clashing names ride along."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows)]
        full = [(*r, None if r[1] is None else len(r[1]), "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCS + ", node string, row int").withColumnRenamed("row", "part")

    return make
