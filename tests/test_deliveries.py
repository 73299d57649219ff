"""Deliveries: routing, mappers, merging, contracts and exports on literal rows."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import export
from tessella.sources import delivery, normalise, quality

CTV = dict(primary_identifier="abc", ip="1.2.3.4", ctv_taxonomy="x", contenttype="Series", contentgenre="Drama", channelname="Acme TV", iab_cats="IAB1|IAB3", country="US", provider="p", date_utc="2024-08-28")
WEB = dict(primary_identifier="abc", domain="example.com", page="https://example.com/sports/football-news", ref="https://www.search.org/q", useragent="ua", country="US", iab_codes="IAB17", signals="12", day="2024-08-28", provider="p")
PEOPLE = dict(EID="abc123", Gender="F", MaritalStatus="Married", AnnualIncome="100000-149999", Age="35-44", Visits="4")


def frame(spark, *rows: dict):
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def codes(row) -> list[str]:
    return [t.code for t in row.tags]


def test_ctv_rows_meet_every_group(spark):
    assert normalise.alias_coverage(list(CTV), "ctv")[1] == [] and not normalise.is_web_shaped(list(CTV))
    row = normalise.normalise_rows(frame(spark, CTV), "ctv").first()
    assert codes(row) == ["ctv.genre.drama", "ctv.type.series", "ctv.channel.acme-tv", "iab.iab1", "iab.iab3"]
    assert (row.label, row.confidence) == ("Acme TV · Drama · Series", 0.7)


def test_web_rows_are_web_shaped(spark):
    assert normalise.is_web_shaped(list(WEB)) and normalise.alias_coverage(list(WEB), "web") == (list(normalise.ALIASES["web"]), [], [])
    assert normalise.alias_coverage(list(WEB), "ctv")[1]
    row = normalise.normalise_rows(frame(spark, WEB), "ctv").first()
    assert codes(row) == ["ctv.channel.example-com", "iab.iab17", "web.topic.sports", "web.topic.football-news", "web.referrer.search-org"]
    assert row.confidence == 0.778


def test_people_gaps(spark):
    met, missing, unknown = normalise.alias_coverage(list(PEOPLE), "demographics")
    assert "income band" in missing and sorted(unknown) == ["AnnualIncome", "Gender", "MaritalStatus"]
    assert codes(normalise.normalise_rows(frame(spark, PEOPLE), "demographics").first()) == ["demo.age.35-44"]


KEYS = [
    ("20240828_demographics_acme_ctv_audio_signals_5580.parquet", "demographics"),
    ("20240828_apps_report_acme_ctv_audio_signals_5580.parquet", "apps"),
    ("20240828_visitation_acme_ctv_audio_signals_5580.parquet", "visitation"),
    ("20240828_origin_acme_ctv_audio_signals_5580.parquet", "origin"),
    ("20240828_ctv_report_acme_ctv_audio_signals_5580.parquet", "ctv"),
    ("20240828_web_report_acme_ctv_audio_signals_5580.parquet", "ctv"),
    ("demographics/20240828_ctv_x.parquet", "demographics"),
    ("x/y.parquet", None),
]


@pytest.mark.parametrize(("key", "kind"), KEYS)
def test_report_type(spark, key, kind):
    assert spark.range(1).select(delivery.report_type(F.lit(key)).alias("x")).first().x == kind


def test_signals_have_all_fields_of_their_kind(spark):
    """Names and order of the fields, texts of missing values, and numbers, as literals."""
    import json

    web = json.loads(normalise.normalise_rows(frame(spark, WEB), "web").first().signals)
    assert list(web.items()) == [
        ("contentgenre", ""), ("contenttype", ""), ("channelname", "example.com"), ("iab_cats", ["IAB17"]), ("web_topics", ["sports", "football-news"]), ("referrer_host", "search.org"), ("signals", 12.0),
        ("meta", {"device_id": "", "useragent": "ua", "page": "https://example.com/sports/football-news"}),
    ]
    one = lambda kind, **row: json.loads(normalise.normalise_rows(frame(spark, dict(eid="e", **row)), kind).first().signals)
    assert one("apps", CategoryName="Games", Signals="0") == {"CategoryName": "Games", "TaxonomyName": "", "Signals": None, "meta": {"bundle_id": "", "platform": ""}}
    assert one("visitation", brandName="B", distance="30.5", poi_id="p") == {"brandName": "B", "visited_at": "", "daypart": "", "distance": 30.5, "meta": {"poi_id": "p"}}
    assert one("demographics", age="18-24", segments="a|b") == {"age_band": "18-24", "income_band": "", "household": "", "meta": {"segment_codes": ["a", "b"]}}
    assert one("origin", state="X", country="US") == {"origin_class": "", "region": "X", "travel": "", "meta": {"country": "US", "provider": ""}}


def test_identifiers_merge(spark):
    rows = [dict(WEB, signals="1", n="1"), dict(WEB, page="https://example.com/music", signals="900", n="2"), dict(WEB, primary_identifier=" ", n="3"), dict(WEB, primary_identifier="NaN", n="4")]
    found = normalise.merge_by_identifier(normalise.normalise_rows(frame(spark, *rows), "web", keep=("n",)), "n").collect()
    assert len(found) == 1 and found[0].confidence == 1.0 and len(found[0].signals) == 2
    assert codes(found[0])[-1] == "web.topic.music" and len(codes(found[0])) == len(set(codes(found[0]))) == 6


def test_clean_rows(spark):
    tags = [(" a ", "l" * 400, None, 0), ("", "x", None, 1), (None, "x", None, 1)]
    rows = spark.createDataFrame([(" id ", "l", tags, ["{}"], 7.0), ("", "l", tags, [], 0.5), ("x" * 513, "l", tags, [], 0.5), ("b", None, None, None, None)], f"identifier string, label string, tags array<{normalise._TAG}>, signals array<string>, confidence double")
    found = {r.identifier: r for r in normalise.clean_rows(rows).collect()}
    assert set(found) == {"id", "b"} and found["id"].confidence == 1.0 and found["b"].confidence == 0.5 and found["b"].tags == []
    assert [(t.code, len(t.label), t.weight) for t in found["id"].tags] == [("a", 300, 1)]


def test_rosters_and_summaries(spark):
    rows = frame(spark, dict(eid="a", category="", genre=""), dict(eid="", category="x", genre=""), dict(eid="a", category="", genre="g"))
    found = rows.select(normalise.is_roster_row(rows).alias("r"), normalise.is_summary_row(rows).alias("s")).collect()
    assert [(r.r, r.s) for r in found] == [(True, False), (False, True), (False, False)]


def test_quoted_csv_and_json_arrays(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,said\n1,"one ""two""\nthree"\n2,plain\n')
    assert [r.said for r in delivery.read_delivery(spark, str(tmp_path / "a.csv"), "csv").orderBy("id").collect()] == ['one "two"\nthree', "plain"]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    with gzip.open(tmp_path / "array" / "b.json.gz", "wt") as out:
        json.dump({"rows": [{"id": 3}]}, out)
    found = delivery.read_delivery(spark, str(tmp_path / "array"), "json_array", "id int")
    assert sorted(r.id for r in found.collect()) == [1, 2, 3]
    listed = delivery.list_objects(spark, str(tmp_path), ("array",))
    assert [r.object_key for r in listed.collect()] == ["array/a.json", "array/b.json.gz"]
    assert delivery.list_objects(spark, str(tmp_path), most=1).count() == 1


def test_probe_grades_a_delivery(spark):
    found = {r.check: r.status for r in quality.probe(frame(spark, WEB, dict(WEB, primary_identifier="")), "ctv").collect()}
    assert found == {"groups": "pass", "unknown columns": "pass", "identifiers": "warn", "yield": "warn"}
    old = spark.createDataFrame([("groups", "fail"), ("other", "pass")], "check string, status string")
    new = spark.createDataFrame([("groups", "pass")], "check string, status string")
    assert {(r.check, r.status) for r in quality.merged_report(old, new).collect()} == {("groups", "pass"), ("other", "pass")}


def test_contract_of_customers(spark):
    rows = frame(spark, {"external_user_id": "u_10021", "Source Name": "Midnight City", "emotional_score": "172", "kpi_ctr": "$1,000.5%", "attr_market": "US-NY", "odd": "1"}, {"external_user_id": "", "Source Name": "x", "emotional_score": "", "kpi_ctr": "n/a", "attr_market": "", "odd": ""})
    first, second = quality.contract_rows(rows).collect()
    assert (first.external_user_id, first.source_name, first.emotional, first.kpi_ctr, first.market, first.complete) == ("u_10021", "Midnight City", 100.0, 1000.5, "US-NY", False)
    assert second.external_user_id is None and second.emotional is None and second.kpi_ctr is None and second.market is None
    assert quality.unknown_columns(rows) == ["odd"]


def members(spark, n: int, holdout: int = 0):
    return spark.createDataFrame([(f"device-{i}", i < holdout) for i in range(n)], "subject_key string, holdout boolean")


def test_activation_file(spark, tmp_path):
    assert export.activation_rows(members(spark, 30, 8)).count() == 22
    twice = members(spark, 10).unionByName(members(spark, 10))
    ids = [r.eid for r in export.activation_rows(twice).collect()]
    assert len(ids) == 10 and ids == sorted(ids) and all(len(i) == 32 for i in ids)
    odd = spark.createDataFrame([("", False), ("   ", None), ("device-1", False)], "subject_key string, holdout boolean")
    row = export.activation_counts(odd).first()
    assert (row.held_out, row.skipped, row.eids) == (0, 2, 1)
    path = Path(export.write_activation(twice, str(tmp_path), "spring", "2024-08-28"))
    assert path.relative_to(tmp_path).as_posix() == "outbound/activation/dt=2024-08-28/cohort=spring"
    lines = [line for part in sorted(path.glob("part-*.gz")) for line in gzip.open(part, "rt").read().split()]
    assert lines == ids


def test_refusals(spark):
    rows = spark.createDataFrame([("a", 999, True), ("b", 1000, True), ("c", 5000, False), ("d", 5000, None)], "slug string, members int, export_eligible boolean")
    assert [r.slug for r in rows.where(export.refusal(rows).isNull()).collect()] == ["b"]
