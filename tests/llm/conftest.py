"""Rows that every operator must bear, and the words of the contracts."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "b", 4),
        (4, "one two three four five six", "en", None, 27), (5, LONG, "en", "a", len(LONG)),
        (6, LONG + " tail", "en", "b", len(LONG) + 5), (None, "no id at all here", "de", "b", 17),
        (None, None, None, None, None), (7, "same text twice in one row", "fr", "c", 26),
        (7, "same text twice in one row", "fr", "c", 26), (7, "same id other text", "fr", "c", 18),
        (8, "same text twice in one row", "fr", "a", 26), (9, "日本\u00a0語 \U0001f600 ###", "en", "c", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows with further columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("odd"))
    extra = "key long, order long, words long, `from` int, size int, n_tokens int, node long"
    rows = [(*r, 1, 2, 3, 4, 5, 6, 7) for r in odd_rows()]
    spark.createDataFrame(rows, f"{DOCS}, {extra}").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    def frame(rows, schema=DOCS, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return frame


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
