"""Columns of JSON text: vectors, guarded arrays, numeric pairs, and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_vector(c: Column | str) -> Column:
    """Numbers of ``[1, 2.5]``; null for other text and for arrays that hold no number or something else."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.from_json(text, "array<double>")
    return F.when(text.rlike(r"^\s*\[[\s\S]*\]\s*$") & (F.size(parts) > 0) & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x)), parts)


def elements(c: Column | str) -> Column:
    """The elements of a JSON array, each as JSON text; an empty array for anything else."""
    text = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def tag_text(element: Column) -> Column:
    """The label, else the code, of an object; a scalar itself."""
    return F.when(element.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(element, "$.label"), F.get_json_object(element, "$.code"))).otherwise(element)


def numeric_pairs(df: DataFrame, c: str, *keep: str) -> DataFrame:
    """``keep..., key, number`` of the pairs of a JSON object whose value is a plain number."""
    pairs = df.select(*keep, F.explode(F.from_json(c, "map<string,string>")).alias("key", "text"))
    return pairs.where(F.col("text").rlike(r"^-?[0-9]+(\.[0-9]+)?$")).select(*keep, "key", F.col("text").cast("double").alias("number"))


def assembled(df: DataFrame, keys: list[str], name: str, order: list[Column], fields: list[str], where: Column | None = None) -> DataFrame:
    """``keys`` and a JSON array, under ``name``, of their rows' ``fields`` in ``order``."""
    rank = [o.alias(f"o{i}") for i, o in enumerate(order)]
    one = F.struct(*rank, F.struct(*fields).alias("row"))
    picked = F.collect_list(one if where is None else F.when(where, one))
    return df.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(picked), lambda x: x["row"])).alias(name))


def keyed(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row with a JSON object of all keys, in their order; of equal keys the largest value."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("v"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), "v"))))).alias(name))
