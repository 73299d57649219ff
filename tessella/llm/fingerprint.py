"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame operations only.

The sketch of a text is the ascending array of the ``k`` least hashes of its distinct
shingles. Sketches of parts merge into the sketch of the whole, and from two of them follow
estimates of resemblance and containment; one tells the number of distinct shingles. Sets
of up to ``k`` shingles are held whole, so their estimates are exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NULL_ID, ascii_lower, id_key, materialise, partitions, replacing, unused

K = 256
SHINGLE = 5
#: Buckets of consecutive ids, at most: their ends go through the driver.
MAX_BUCKETS = 1 << 14
#: Parts that rows equal in all columns can be dealt to.
SALTS = 64


def with_sketch(df: DataFrame, name: str, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of the column ``text``.

    A-Z are lower-cased and words end at ASCII whitespace. Fewer words than ``shingle`` make
    one shingle; null and empty texts have none and an empty sketch.
    """
    w, grams_ = unused(df, "__w", "__s")
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \x09-\x0D]+"), "")
    hashed = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size(w)
    whole = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    grams = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
    hashed = hashed.withColumn(grams_, F.when(n < shingle, whole).otherwise(grams))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(grams_)), 1, k)).drop(w, grams_)


def merge(*sketches: Column | str, k: int = K) -> Column:
    """The sketch of the union of the sets."""
    return F.slice(F.sort_array(reduce(F.array_union, sketches)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for the rows of each key, merged in two steps: by key and a salt, then by
    key, so that no task holds the sketches of a hot key's rows, just ``k`` hashes at a time."""
    hashes = df.select(*keys, F.explode(sketch).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__h"))
    least = hashes.withColumn("__salt", F.pmod(F.xxhash64("__h"), F.lit(64))).withColumn("__r", rank).where(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("__h")), 1, k).alias(sketch))


def distinct_shingles(sketch: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else ``(k - 1) / u`` where
    ``u`` is the k-th least hash as a number from 0 to 1."""
    unit = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / unit)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sets, 0 if just one is empty."""
    least = merge(a, b, k=k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) == 0, 1.0).otherwise(both / F.size(least))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none."""
    least = merge(a, b, k=k)
    shared = resemblance(a, b, k) * distinct_shingles(least, k)
    return F.when(F.size(F.col(a) if isinstance(a, str) else a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(sketch: Column | str) -> Column:
    """The sketch as a string, 16 hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``sketch``, ``fingerprint`` and ``n_shingles``, the estimate of distinct
    shingles.

    Null and empty texts have an empty sketch and fingerprint; equal texts have equal ones.
    Repeated rows are treated alike; other columns pass through, those named like the new
    ones are replaced; nothing is shuffled.
    """
    out = with_sketch(replacing(docs, "sketch", "fingerprint", "n_shingles"), "sketch", k=k, shingle=shingle)
    return out.withColumn("fingerprint", fingerprint("sketch")).withColumn("n_shingles", distinct_shingles("sketch", k))


def _bucket(place: Column, cuts: list[tuple]) -> Column:
    """Number of ``cuts`` that are at most ``place``, found in two steps of about their root."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    # One literal, however many cuts: constant folding reads it once.
    literal = lambda xs: F.from_json(F.lit(json.dumps([dict(zip("kts", x)) for x in xs])), "array<struct<k:bigint,t:bigint,s:int>>")
    at_most = lambda a: F.size(F.filter(a, lambda x: x <= place))
    begin = at_most(literal(cuts[step - 1 :: step])) * step
    return begin + at_most(F.slice(literal(cuts), begin + 1, step))


def with_next(rows: DataFrame, key: str, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row that follows by descending ``key`` (a long
    without nulls); after the last comes the first. Ties follow a hash of all columns; equal
    rows follow each other in any order. ``prepare`` adds columns to the rows before they
    are dealt out.

    Rows are cut into buckets of about equal numbers by (key, hash, salt), so that a key, or
    a row, that repeats spreads over buckets as well. Windows work on the buckets; each also
    gets the first row of the bucket after it. Per bucket the driver sees its ends.
    """
    spark = rows.sparkSession
    tie, salt, bucket, end, at, k, t = unused(rows, "__tie", "__salt", "__b", "__end", "__at", "__k", "__t")
    count = min(MAX_BUCKETS, 4 * partitions(spark))
    base = rows.withColumn(tie, F.xxhash64(*rows.columns)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    place = F.struct(F.col(key).alias("k"), F.col(tie).alias("t"), F.col(salt).alias("s"))
    places = materialise(base.select(place.alias("place")), "places")
    dealt = places.repartitionByRange(count, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("low"), F.max("place").alias("high"))
    ends = sorted((tuple(r.low), tuple(r.high)) for r in dealt.collect())
    base = base.withColumn(bucket, _bucket(place, [low for low, _ in ends[1:]]).cast("int"))
    down = range(len(ends) - 1, -1, -1)
    follows = [(before, *ends[after][1][:2]) for before, after in zip(down, [*down[1:], *down[:1]])]
    links = spark.createDataFrame(follows, f"{at} int, {k} long, {t} long")
    # One first row for each bucket; those that meet here are equal.
    first = base.join(F.broadcast(links), (F.col(key) == F.col(k)) & (F.col(tie) == F.col(t))).groupBy(at).agg(F.first(F.struct(*base.columns)).alias("row"))
    first = first.select(*[F.col(at).alias(c) if c == bucket else F.col("row")[c].alias(c) for c in base.columns])
    both = prepare(base.withColumn(end, F.lit(0)).unionByName(first.withColumn(end, F.lit(1))))
    w = Window.partitionBy(bucket).orderBy(end, F.desc(key), F.desc(tie), F.desc(salt))
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(F.col(end) == 0).drop(bucket, tie, salt, end)


def compare_with_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``: how the
    sketch takes an edit, and how near the next document by descending doc_id is.

    In ``edited`` the last third of the text (rounded down) is replaced by the first as many
    characters of the next text, or all it has; after the last document comes the first. A
    null text is empty, a null doc_id counts as the largest; rows that repeat a doc_id follow
    each other by a hash; an empty table gives an empty result.
    """
    base = docs.select(id_key("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, "key", ["text", "sketch"], lambda df: with_sketch(df, "sketch", k=k, shingle=shingle))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited_sketch", "edited", k, shingle)
    return rows.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_chars", "edited", "sketch", "edited_sketch",
        resemblance("sketch", "edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
    )


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    found = compare_with_edited(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next",
    )
