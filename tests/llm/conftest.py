import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice(["an", "be", "ti", "on", "sh", "re", "é", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and long texts, copies, near copies and repeated rows."""
    r = random.Random(11)
    texts = [words(r, r.randint(1, 120)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "s0", None) for i in range(6)]
    rows += [(110 + i, texts[1] + f" tail{i}", None, "s1", 1) for i in range(4)]
    rows += [(120, "", "en", "s0", 0), (121, None, "en", None, None), (122, " \n\t ", "fr", "s2", 4), (None, texts[2], "en", "s0", 5), (None, None, None, None, None)]
    rows += [(130, words(r, 20_000), "en", "s1", 1), (131, "x" * 50_000, "en", "s1", 2), (3, texts[3], "en", "s0", len(texts[3])), (3, texts[3], "en", "s0", len(texts[3]))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
