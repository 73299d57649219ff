"""Scalar functions on literal inputs."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def fnv(text: str) -> int:
    h = 2166136261
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("text", ["", "a", "spring:17", "naïve", "😀 smile"])
def test_fnv1a(spark, text):
    assert value(spark, S.fnv1a(F.lit(text))) == fnv(text)


def test_slug_and_values(spark):
    assert value(spark, S.slug(F.lit("  Hello, World -- 2024! "))) == "hello-world-2024"
    assert value(spark, S.multi_values(F.lit("a| b ,;c;;"))) == ["a", "b", "c"]


def test_urls(spark):
    url = F.lit("https://WWW.Example.com/News/2024/best-home-studio-mics-ever.html?x=1#top")
    assert value(spark, S.host_of(url)) == "example.com"
    assert value(spark, S.path_topics(url)) == ["best-home-studio-mics"]
    assert value(spark, S.host_of(F.lit("www.Example.com:80/x"))) == "example.com:80"
    assert value(spark, S.host_of(F.lit(""))) == ""
    assert value(spark, S.path_topics(F.lit("http://h/tv/a-b/some.page.php/Us/live.tar.gz/third"))) == ["a-b", "some.page"]


@pytest.mark.parametrize(("text", "band"), [("2024-03-05T23:10:00Z", "latenight"), ("2024-03-05T01:00:00-18:00", "primetime"), ("2024-03-05 11:59:59", "morning"), ("soon", ""), ("", "")])
def test_dayparts(spark, text, band):
    assert value(spark, S.daypart_of_text(F.lit(text))) == band


def test_pseudonym_ends_with_the_least_digit(spark):
    h, digits = fnv("device-1"), ""
    for _ in range(6):
        digits, h = S.BASE32[h % 32] + digits, h // 32
    assert value(spark, S.pseudonym(F.lit("device-1"))) == f"SIG-{digits}"


def test_normal_cdf(spark):
    for z in (-3.0, -1.0, 0.0, 0.5, 2.0):
        assert value(spark, S.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)


@pytest.mark.parametrize(
    ("raw", "id_"),
    [("0123456789abcdef0123456789ABCDEF", "0123456789ABCDEF0123456789ABCDEF"), ("01234567-89ab-cdef-0123-456789abcdef", "0123456789ABCDEF0123456789ABCDEF"), ("activation:9", None), ("", None), ("AAECAwQFBgcICQoLDA0ODw==", "000102030405060708090A0B0C0D0E0F"), ("AAECAwQFBgcICQoLDA0ODxAR", "000102030405060708090A0B0C0D0E0F"), ("0123-456789abcdef0123456789abcdef", hashlib.sha256(b"0123-456789abcdef0123456789abcdef").hexdigest()[:32].upper())],
)
def test_export_id(spark, raw, id_):
    assert value(spark, S.export_id(F.lit(raw))) == id_


def test_logistic_percentile(spark):
    assert value(spark, S.logistic_percentile(F.lit(5.0), F.lit(5.0), F.lit(2.0))) == 50.0
    assert value(spark, S.logistic_percentile(F.lit(9.0), F.lit(5.0), F.lit(0.001))) == 50.0


def test_delivery_keys(spark):
    from tessella.sources import delivery as D

    key = F.lit("ctv/dt=2024-03-05/activation_id77-2023-01-01.parquet")
    assert str(value(spark, D.partition_date(key))) == "2024-03-05"
    assert value(spark, D.activation_id(key)) == "77"
    assert value(spark, D.partition_date(F.lit("ctv/x.parquet"))) is None
    df = spark.createDataFrame([("nan", " x ")], "Domain string, HOST string")
    assert df.select(D.pick(df, "domain", "host").alias("x")).first().x == "x"


def test_readers_round_trip(spark, tmp_path):
    from tessella.sources.delivery import read_delivery

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for kind in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / kind)
        writer = df.write.option("header", "true") if kind == "csv" else df.write
        writer.format(kind).save(path)
        found = read_delivery(spark, path, kind, "id int, name string")
        assert sorted((r.id, r.name) for r in found.collect()) == [(1, "a"), (2, None)]
        assert "object_key" in found.columns
