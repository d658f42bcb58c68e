import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, keep_id int, component_id string, part string, key string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    r = random.Random(3)
    words = ["the", "of", "alpha", "beta", "Gamma", "delta,", "Éé", "zü", "x1", "-", "'s", "日本", "end."]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(200), text(60)
    near = base.split()
    texts = [base, base, base.replace(" ", "\n\t", 30), " ".join([*near[:100], "new", *near[101:]]), " ".join([*near[:199], "other"]), passage + " " + text(30), text(40) + " " + passage, text(5000), "", None, " ", "\n\n", "a", "ab", "idiot", "Released under the MIT License.", "x" * 300, "x" * 300 + "y", "<|endoftext|> a", "\x00\x01 b"]
    rows = [(i * 7 % 41, t, *r.choice([("en", "a"), ("de", "b"), (None, None)]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100, text(80), "en", "a", 1)] * 2 + [(101, "same id, one", "en", "a", 2), (101, "same id, two", "fr", "c", None), (None, base, "en", "a", 3), (None, "no id at all", None, "a", 3), (None, None, None, None, None)]
    return [(*row, "x", 1, "y", "p", None) for row in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
