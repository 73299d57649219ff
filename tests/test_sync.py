"""Keys joined with patterns against the nested loop, and regrounding done twice."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.operators import sync


def like(key, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i].lower())
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c.lower()))
        i += 1
    return re.fullmatch(out, key.lower(), re.S) is not None


def test_matches_equal_the_nested_loop(spark):
    keys = ["a/Activation_ID55_x.csv", "a/activationid5.csv", "a/activation-id555/b", "x", "", "100% wool", "a_b", "aXb", "ÄB/long-literal-here", None, "a/activation_id55_x.csv"]
    patterns = ["%activation_id55%", "%activationid5%", "%ACTIVATION-ID5%", "%", "x", "", "a_b", r"a\_b", r"%\%%", "%literal%here", "%ab%cd%", "_", "%id5%", None, "%äb%"]
    df, table = spark.createDataFrame([(k,) for k in keys], "object_key string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = sync.matches(df, table)
    assert {tuple(r) for r in found.collect()} == {(k, p) for k in keys for p in patterns if k is not None and p is not None and like(k, p)}
    # Keys and patterns meet by equal parts; the only other join is with the one row of sizes.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (gram" in plan and plan.count("Join Cross") + plan.count("Join Inner\n") <= 1
    assert sync.matches(df.limit(0), table).count() == 0 and sync.matches(df, table.limit(0)).count() == 0


def test_regrounding_swaps_whole_sets(spark):
    sources = spark.createDataFrame([(1, "one", "http://a"), (2, "two", " https://b"), (3, "three", "file://c"), (4, "two", "http://d"), (5, None, "http://e")], "source_id long, name string, url string")
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (1, 12, 0.01, 3), (2, 10, 0.01, 1), (3, 10, 0.9, 1)], "query_id long, neighbour_id long, similarity double, rank int")
    tags = spark.createDataFrame([(1, 7, 0.4), (1, 10, 0.1), (2, 7, 0.4), (3, 8, 0.3)], "source_id long, node_id long, weight double")
    queue = spark.createDataFrame([], "symbol string, source_id long, reason string")
    for _ in range(2):
        tags, queue = sync.regrounded(sources, near, tags, queue)
        assert {tuple(r) for r in tags.collect()} == {(1, 10, 0.9), (1, 11, 0.2), (2, 7, 0.4), (3, 8, 0.3)} and tags.count() == 4
        assert [tuple(r) for r in queue.select("symbol", F.col("source_id")).collect()] == [("two", 2)]
