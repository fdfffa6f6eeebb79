import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, shard int, shingles long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """Nulls, empty and blank texts, ties, repeats, non-ASCII, special strings and a very long text."""
    rng = random.Random(6)
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        None, "", "   \n\t ", "one", "one two", "One  TWO", "a b c", "a b c", "<|endoftext|> <s>", "naïve Éa ＡＢ 中文 123 it's", "x" * 20_000, long, long,
        "the quick brown fox. " * 40, "...!!!", "12 34", "\x00\x1c", "Tokens, tokens; tokens: \"quoted\" (and) so-on",
    ]


@pytest.fixture
def odd(spark, odd_texts):
    """The odd texts with null and repeated keys and columns whose names clash with results."""
    rows = [(None if i == 3 else 7 if i in (6, 7) else i, t, "en" if i % 2 else None, None, None, "m", 1, 2) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
