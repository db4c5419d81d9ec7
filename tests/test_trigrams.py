"""Trigrams as numbers, and white space collapsed by the narrower pattern."""

import random
from zlib import crc32

from pyspark.sql import functions as F

from bylines.operators.stance import collapsed, trigram_bucket, trigrams


def test_trigrams_are_those_of_the_text():
    for text in ("", "a", "ab", "abc", "aé\U0001F600bc日本"):
        grams = [text[i : i + 3] for i in range(len(text) - 2)]
        assert trigrams(text).tolist() == [ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams]
        assert [trigram_bucket(g, 512) for g in trigrams(text).tolist()] == [crc32(g.encode()) % 512 for g in grams]


def test_white_space_collapses_as_before(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("A \t\n\x0b\f\r\x1c b") for _ in range(20)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(collapsed("t") != F.trim(F.regexp_replace(F.lower("t"), r"\s+", " "))).count() == 0
