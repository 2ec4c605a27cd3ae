import pytest

# columns that operators use for themselves, and names that need quoting
EXTRA = {"size": "int", "fp": "string", "row": "string", "tag": "string", "key": "int", "shard": "int", "slot": "string",
         "taken": "int", "h": "int", "h1": "int", "h2": "int", "words": "int", "seed": "int", "n": "int", "body": "string", "a.b": "int", "group_size": "int", "copies": "int"}
LONG = " ".join(f"wort{i % 977} und" for i in range(30_000))
EDGE = [
    (1, "the cat sat on the mat and the dog ran away", "en", "a"),
    (2, "the cat sat on the mat and the dog ran away", "en", "a"),     # exact copy
    (2, "the cat sat on the mat and the dog ran away", "en", "a"),     # repeated row
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n", "en", None),
    (6, "12345 !!!", "en", "b"),                                       # no letter
    (None, "a row without an id", "en", "b"),
    (None, None, None, None),
    (8, LONG, "de", "c"),
    (9, LONG + " ende", "de", "c"),
    (10, "x" * 5000, "en", "c"),
    (11, "THE  CAT\tsat on the mat\nand the dog ran away", "en", "b"),
    (12, "one", "en", "b"),
    (13, "nul \x00 byte and \U0001F600 emoji é", "fr", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, blank and long texts, copies, repeated rows and clashing extra columns."""
    rows = [(*r, len(r[1] or ""), *([7] * len(EXTRA))) for r in EDGE]
    rows = [tuple(str(v) if i >= 5 and list(EXTRA.values())[i - 5] == "string" else v for i, v in enumerate(r)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {v}" for k, v in EXTRA.items())
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def sf():
    import os
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver test data not present")
    return path


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
