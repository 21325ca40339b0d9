"""Small tables that hold what real ones hold now and then."""

import random

import pytest

from invented import prose


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, copies, repeated rows and odd spaces."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(3, 60)) for _ in range(40)]
    base = prose(rng, 80)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["Changed"] + words[k + 1 :]) for k in (5, 40, 70)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, t, "en", "hot", 1) for k, t in enumerate([base, *near, base, base.upper()])]
    rows += [(200, "", "en", "s1", 0), (201, None, None, None, None), (202, " \n\t ", "en", None, 3), (203, "one", "", "", 3)]
    rows += [(204, "one two three café 中文 \U0001f600", "xx", "\U0001f600", 9), (205, "ONE", "en", "s1", 3)]
    rows += [(206, prose(rng, 30_000), "en", "long", 1), (207, "same " * 5_000, "en", "s2", 1)]
    rows += [(None, base, "en", "s1", 1), (None, None, None, None, None)]
    rows += [(3, texts[3], "en", "s3", len(texts[3]))] * 2  # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With extra columns that are named like columns inside the operators."""
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "node", "component", "key", "mark", "start", "target", "place", "turn", "chunk", "bucket", "h", "shard", "score", "words", "row_id", "x"):
        docs = docs.selectExpr("*", f"'{name}' as `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
