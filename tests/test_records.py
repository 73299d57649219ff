"""Records of any shape, canonical JSON and seals, on literals."""

from __future__ import annotations

import hashlib
import hmac
import json
import math

from pyspark.sql import functions as F

from tessella.functions import sealed
from tessella.operators import cohorts, records
from tessella.operators.records import AXES


def test_signals_of_records_of_any_shape(spark):
    deep = {"a": {"b": {"genre": "Drama"}, "genre": "Film"}, "x": {"y": {"z": {"genre": "too deep"}}}}
    rows = [
        ("list", json.dumps([{"genre": "News | Talk,news", "n": 1}, "no record", {"Genre": ["Sport", "news"]}])),
        ("rows", json.dumps({"data": {"rows": [{"appName": "Radio"}], "total": 3}})), ("one", json.dumps(deep)), ("null data", json.dumps({"data": None, "city": "Rome"})),
        ("long", json.dumps({"brand": "b" * 49, "chain": ";".join("abcdefghij")})), ("bad", "{"), ("none", None), ("scalar", "7"), ("audience", json.dumps({"audience": "Family"})),
    ]
    df = spark.createDataFrame(rows, "id string, payload string")
    found = {}
    for r in records.signals(df, "id").collect():
        found.setdefault(r.id, set()).add((r.kind, r.label, r.n))
    assert found == {
        "list": {("genre", "News", 3), ("genre", "Talk", 1), ("genre", "Sport", 1)}, "rows": {("app", "Radio", 1)}, "one": {("genre", "Drama", 1), ("genre", "Film", 1)},
        "null data": {("geo", "Rome", 1)}, "long": {("brand", c, 1) for c in "abcdefgh"}, "audience": {("audience", "Family", 1)},
    }
    told = {r.id: r for r in records.insights(df, "id").collect()}
    assert len(told) == 9 and (told["bad"].records, told["none"].records, told["list"].records, told["bad"].social) == (0, 0, 2, 50.0)
    # News weighs 1 + log10(4), Talk and Sport 1 + log10(2); three signals fit, so half of three divides.
    news, other = 1 + math.log10(4), 1 + math.log10(2)
    assert told["list"].communication_tilt == round(10 * (news + other) / 1.5, 1) and told["list"].social == math.floor(50 + 8 * other / 1.5 + 0.5)
    assert told["null data"].unmapped == 1 and told["null data"].matched == 0 and told["audience"].unmapped == 0 and told["audience"].social == 58.0


def test_seals(spark):
    """Test cases 1, 2 and 6 of RFC 4231."""
    cases = [
        (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    ]
    one = spark.range(1)
    for secret, message, expected in cases:
        assert one.select(sealed.hmac_sha256(F.lit(message), secret)).first()[0] == expected
    texts = ['{"b": [1, {"z": 2, "a": "x\\"y"}], "a": null, "ä": true}', '{"a":null,"ä":true,"b":[1,{"a":"x\\"y","z":2}]}', "[]", "{", None, '"é\\n"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in df.select("i", sealed.canonical_json("t").alias("c")).orderBy("i").collect()]
    assert got[0] == got[1] == json.dumps(json.loads(texts[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and got[2:] == ["[]", None, None, '"é\\n"']
    seals = [r.s for r in df.select("i", sealed.seal("t", b"k").alias("s")).orderBy("i").collect()]
    assert seals[0] == seals[1] and seals[0].signature == hmac.new(b"k", got[0].encode(), hashlib.sha256).hexdigest() and seals[0].subject == hashlib.sha256(got[0].encode()).hexdigest()[:32]
    checks = df.select(sealed.is_sealed("t", F.lit(seals[0].signature), b"k").alias("ok")).collect()
    assert [r.ok for r in checks] == [True, True, False, False, False, False]


def test_points_without_scores_are_least_sure(spark):
    """Confidence of facet-only points: 0.15 of the neutral base, times 0.75 with a tilt and 0.4 without."""
    score = ", ".join(f"{a}: double" for a in AXES) + ", confidence: double"
    rows = [(1, ["music"], None, None), (2, ["none"], None, None), (3, ["music"], (50.0,) * 6 + (None,), None), (4, ["music"], None, (50.0,) * 6 + (0.8,))]
    df = spark.createDataFrame(rows, f"id int, labels array<string>, own struct<{score}>, inherited struct<{score}>")
    found = {r.id: (r.basis, round(r.confidence, 6)) for r in cohorts.signal_points(df, (("music", {"artistic": 8}),)).collect()}
    assert found == {1: ("facet-only", 0.1125), 2: ("facet-only", 0.06), 3: ("scored", 0.6), 4: ("inherited", 0.6)}


def test_thirty_cohorts_have_thirty_names(spark):
    rows = spark.range(300).select("id", (F.col("id") % 30).cast("int").alias("cohort"))
    found = {r.cohort: r.slug for r in cohorts.cohort_members(rows).select("cohort", "slug").distinct().collect()}
    assert len(set(found.values())) == 30 and (found[0], found[25], found[26], found[29]) == ("cohort-a", "cohort-z", "cohort-27", "cohort-30")
