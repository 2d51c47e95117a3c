import pytest

#: Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names.
ROWS = [
    (1, "The same text stands here twice, word for word, and it is long enough to be kept.", "en", "a", 1, "x"),
    (1, "The same text stands here twice, word for word, and it is long enough to be kept.", "en", "a", 1, "x"),
    (2, "The same text stands here twice, word for word, and it is long enough to be kept.", "en", "b", 1, None),
    (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "y"),
    (5, " \n\t\n", "en", None, 0, "y"),
    (None, "no id but a text", "en", "c", 5, "z"),
    (6, "é ß 日本 \U0001f600 ▁ á \x00 ퟿", "de", "b", 5, "z"),
    (7, "one\ntwo\none\n" * 3, "en", "b", 5, "z"),
    (8, "a long text " * 20_000, "fr", "c", 5, "z"),
    (9, "you idiot", "en", "c", 5, "z"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("key", "k1").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
