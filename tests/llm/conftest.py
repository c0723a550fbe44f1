import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, k1 long, length int, part string, fp string, component_id long"
WORDS = "the and of to in is on at by for with was that this from are have not but they which".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "x", "y" * rnd.randrange(4)]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and blank texts, one very long text, repeated rows, copies, and extra columns with names the operators use."""
    texts = [None, "", "   \n\t ", "One", "two words", prose(1, 40), prose(1, 40), prose(2, 30_000), "é漢字 <|endoftext|> 🙂  x y", "!!! ---"]
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, 0.5, "h", 1, 1, "p", "f", 9) for i, t in enumerate(texts)]
    rows += [rows[5], rows[1], (None, prose(3, 12), "en", None, None, None, None, None, None, None, None, None), (None, None, None, *[None] * 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
