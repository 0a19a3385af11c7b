"""What the third round of findings was about."""

import pandas as pd
from pyspark.sql import functions as F

from tidegrid.operators import features, joins, lsa, ridge, segments
from tidegrid.plans import catalog

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0].count("Exchange hash")


def test_containment_stays_within_a_row(spark):
    assert exchanges(catalog.char_token_containment(spark, SF)) <= 1
    words = spark.createDataFrame([("a", "w", 0, 2), ("a", "v", 4, 6), (None, "w", 0, 2), ("b", "u", 1, 3), ("c", "x", 0, 1)], "story string, word string, char_start int, char_end int")
    tokens = spark.createDataFrame([("a", 0, "abcdefg"), ("a", 1, "b"), ("a", 5, "cc"), ("a", 5, ""), ("a", None, "d"), (None, 0, "abc"), ("b", 3, "e")], "story string, idx int, text string")
    got = joins.char_to_token(words, tokens)
    assert sorted((r.story, r.word, r.token) for r in got.collect()) == [("a", "v", "abcdefg"), ("a", "v", "cc"), ("a", "w", "abcdefg"), ("a", "w", "b")]
    at = spark.createDataFrame([(["ab", "ñ😀", "c"],), ([],), (["x"],)], "w array<string>").select(segments.starts("w").alias("at"))
    assert [r["at"] for r in at.collect()] == [[0, 3, 6], [], [0]]


def test_depths_stay_within_a_row(spark):
    assert exchanges(catalog.syntactic_features(spark, SF)) <= 1
    chain = [("b", i, max(0, i - 1)) for i in range(150)] + [("c", 0, 1), ("c", 1, 2), ("c", 2, 0), ("c", 3, 3), ("c", 4, 99), ("c", None, 3), ("c", 5, None), ("c", 6, 5), (None, 0, 0)]
    df = spark.createDataFrame([(*r, "x") for r in chain], "story string, i int, head_i int, text string")
    got = {(r.story, r.i): (r.syntactic_depth, r.text) for r in features.syntactic(df).collect()}
    assert all(got["b", i] == (i, "x") for i in range(150)) and len(got) == len(chain)
    assert [got["c", i][0] for i in (0, 1, 2, 3, 4, None, 5, 6)] == [None, None, None, 0, None, None, 0, 1] and got[None, 0][0] is None
