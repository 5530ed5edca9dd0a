import pytest

LONG = " ".join(f"w{k % 997}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and extra columns whose
    names the operators use themselves."""
    rows = [
        (1, "one two three four five six seven eight nine ten.\nShared line here", "en", "a", 10, "x"), (1, "one two three four five six seven eight nine ten.\nShared line here", "en", "a", 10, "x"),
        (2, None, None, None, None, None), (3, "", "en", "b", 0, "y"), (4, "   \n\t ", "de", "b", 5, "y"), (5, LONG, "en", "a", len(LONG), "z"), (None, "a text without an id", "fr", None, 20, "x"), (6, "é" * 50, None, "ü", 50, None),
        (1, "another text under the same id", "en", "a", 30, "x"),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    df = spark.createDataFrame(rows, cols)
    for name in ("shard", "h", "n", "score", "base", "rep", "size", "component_id", "n_sentences"):
        df = df.withColumn(name, df["n_chars"])
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
