from pathlib import Path

import pytest

from glasspool.llm.text import prepared

FOLDER = Path("/root/testdata/sf0.001")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, hash string, word string, counts string, marks string, class string, bin string"
)
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
NEAR = [f"alpha{i}" for i in range(200)]


def odd_rows():
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "One two"), (7, LONG), (8, LONG),
        (9, " ".join(NEAR)), (10, " ".join([*NEAR[:199], "omega"])), (11, " ".join([*NEAR[:198], "psi", "omega"])),
        (12, "write to a.b@c.example now, +49 (30) 1234-5678 or 10.0.0.255"), (None, "no id here"), (None, None),
        (13, "same row"), (13, "same row"), (14, "é😀 " * 40), (15, "<|endoftext|> a b"),
    ]
    return [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else "s", k, "r", "h", "w", "c", "m", "k", "b") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long, tied and repeated texts, null ids, and columns with clashing names."""
    return prepared(spark).createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return prepared(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    if not FOLDER.exists():
        pytest.skip("test tables are not here")
    return prepared(spark).read.parquet(f"{FOLDER}/documents.parquet")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
