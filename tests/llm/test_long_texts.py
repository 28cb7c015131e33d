"""Personal data in texts of a megabyte that are made to fail late: time must grow as the text does."""

import time

import pytest
from pyspark.sql import functions as F

from cellarium.llm import pii

MB = 1_000_000
#: What each pattern swallows and then can't end with, repeated or as one run.
HARD = {
    "spaced digits": "1 " * (MB // 2) + "1x",
    "numbers before a unit": "12 " * (MB // 3) + "12kg",
    "numbers with a unit each": "1 2 3 4 5 6 7 8kg " * (MB // 18),
    "dotted digits": "1." * (MB // 2) + "x",
    "brackets": "(1)" * (MB // 3) + "x",
    "digits": "9" * MB + "x",
    "short runs": "1 2 3 4 5 6 x " * (MB // 14),
    "plus signs": "+1 " * (MB // 3),
    "plus and spaces": "+1" + " " * MB + "x",
    "mail without an end": "a@" + "b" * MB,
    "mails without an end": "a@b " * (MB // 4),
    "spelled mail": "a at " * (MB // 5),
    "name without a domain": "a.b-c_" * (MB // 6),
    "addresses of numbers": "1.1.1." * (MB // 6),
    "long parts": ("9" * 50_000 + ".") * 20,
    "account heads": "AB12 " * (MB // 5),
    "accounts": "AB12 CDEF 3456 7890 1 " * (MB // 22),
    "dashes": "-" * MB + " ",
    "short secrets": "abc-def-1 " * (MB // 10),
    "keys": "token=" * (MB // 6),
    "switches": "1a" * (MB // 2),
}


@pytest.fixture(scope="module")
def model(spark):
    return pii.train_pii(spark)


def test_patterns_take_time_as_texts_grow(spark):
    patterns = pii.BASE_PATTERNS | pii.GENERATORS
    took = []
    for part in (8, 8, 1):  # the first run also plans and compiles
        rows = [(k, HARD[name][-(len(HARD[name]) // part) :]) for k, name in enumerate(sorted(HARD))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        sizes = docs.select("doc_id", *[F.size(pii.matches(F.col("text"), p)).alias(k) for k, p in patterns.items()]).collect()
        took.append(time.perf_counter() - began)
        assert len(sizes) == len(HARD)
    assert took[2] < 5 + 16 * took[1], took  # eight times the texts; quadratic work would take 64 times


@pytest.mark.parametrize("name", ["spaced digits", "numbers before a unit", "plus and spaces"])
def test_a_megabyte_without_candidates(spark, model, name):
    docs = spark.createDataFrame([(1, HARD[name])], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.redact(pii.find_pii(docs, model)).select("text", "n_spans").first()
    assert (row.text, row.n_spans) == (HARD[name], 0)
    assert time.perf_counter() - began < 60  # nearly all of it planning


def test_numbers_before_letters_are_no_candidates(spark):
    texts = ["call 555-123-4567 now", "call 555-123-4567x now", "12345678kg or 555-123-4567", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    number = pii.GENERATOR_NAMES.index("number")
    found = docs.select("text", F.filter(pii.candidates(F.col("text")), lambda c: c["generator"] == number).alias("c"))
    got = {r.text: [r.text[c.start : c.end] for c in r.c] for r in found.collect()}
    assert [got[t] for t in texts] == [["555-123-4567"], [], ["555-123-4567"], ["1 2 3 4 5 6 7 8"], []]
