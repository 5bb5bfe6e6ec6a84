import pytest

LONG = "The quick fox, jumps over it. " * 9000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns whose names operators use."""
    rows = [(1, "One two three four five six. " * 12, "en", "s", 10), (1, "One two three four five six. " * 12, "en", "s", 10),
            (1, "other text of the same id " * 3, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "  \n\t ", "en", "s", 0),
            (None, "no id here at all, but words", "en", "s", 5), (None, None, None, None, None), (5, LONG, "en", "s", len(LONG)),
            (6, "x" * 1_000_000, "en", "s", -5), (7, "under the MIT License cc by-nc", "en", "s", None), (8, "short", "en", "s", 5), (9, "short", "en", "s", 5)]
    extra = ["doc", "score", "node", "items", "_label", "_id", "ids", "kept", "id", "place"]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["e"] * len(extra)) for r in rows], ddl)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, int(k in (1, 5))) for k in range(1, 10)] + [(1, 1, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "four five six one two three four five six one two"), (2, "Short"), (2, "short"), (3, None), (None, "quick fox"), (4, "")],
                                 "item_id bigint, text string")
