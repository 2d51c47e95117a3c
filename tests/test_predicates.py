import pytest
from pyspark.sql import functions as F

from tessera.functions.predicates import name_match, text_match

CASES = [
    ("name", "set", "lemma_set_contains", True), ("name", "set", "multiset", False), ("name", "set", "set", True), ("name", "set", "sets", False),
    ("name", "_", "anything", True), ("name", "Set", "LEMMA_SET", True), ("name", "lemma_.*_len", "lemma_seq_len", True), ("name", "lemma_.*_len", "lemma_x_len_y", True),
    ("name", "lemma_.*_len", "a_lemma_x_len", False), ("name", ".*len", "x_len_y", True), ("name", "\\(seq\\|set\\)", "lemma_set_x", True), ("name", "\\(seq\\&len\\)", "seq_len", True),
    ("name", "\\(seq\\&len\\)", "seq_add", False), ("name", "\\(a\\|seq\\&len\\)", "x_a", True), ("name", "\\(sub.*seq\\|q\\)", "subxseq", True), ("name", "a+b", "x a+b", True),
    ("text", "set", "multiset", True), ("text", "set!", "multiset", False), ("text", "set!", "a set b", True), ("text", "_", "", True), ("text", "a.*b", "a x b", True), ("text", "a.*b", "x a b", False),
    ("text", "\\(a!\\&b\\)", "a bc", True), ("text", "\\(a!\\&b\\)", "xa bc", False), ("text", "\\(x.*y\\)", "x.*y", True), ("text", "\\(x.*y\\)", "x1y", False), ("text", "é!", "café é", True), ("text", "é!", "café", False),
]


@pytest.mark.parametrize(("kind", "pattern", "value", "expected"), CASES)
def test_matchers(spark, kind, pattern, value, expected):
    match = {"name": name_match, "text": text_match}[kind]
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(match(F.col("v"), pattern)).head()[0] is expected
