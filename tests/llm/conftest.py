import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns of clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "délta", "it's", "x1", "...", " ", "omega-3", "ÉTÉ", "日本", "😀"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S", None])) for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, "long " * 40_000, "en", "s2"), (103, " \n\t ", "fr", "s1"), rows[0], rows[0], (None, "no id here at all", "en", "s1")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, size string, n int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
