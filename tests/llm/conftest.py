import pytest
from pyspark.sql import functions as F

#: Rows that every operator over documents has to take: nulls, empty and very
#: long texts, repeated rows.
AWKWARD = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, None, None, None),
    (None, "token = abcdefgh12345678 and more", "en", None),
    (3, "", "de", "b"),
    (4, " \t\n ", "de", "b"),
    (5, "wörter ohne ende " * 20_000, "de", "b"),
    (6, "x" * 300_000, "de", "c"),
    (7, "one two three four five six seven", "en", "c"),
    (8, "İstanbul Kſ \U0001f600 é <|endoftext|> it's 3²", "tr", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture
def folder_of(tmp_path):
    """Write tables to a folder, so that a query can read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
