"""Workspace sync: object keys joined with a table of patterns, and what that gives a workspace;
and regrounding of sources by their nearest nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

AXES = list(S.AXES)
#: Characters of the part of a pattern that keys are looked up by, at most.
GRAM = 8
#: How keys carry an activation, ``_`` being any character.
KEY_PATTERNS = ("%activation_id{}%", "%activationid{}%", "%activation-id{}%")


def _grams(text: Column, size: Column) -> Column:
    """The distinct parts of ``size`` characters; the empty one for size 0."""
    last = F.char_length(text) - size + 1
    parts = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(size == 0, F.array(F.lit(""))).when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def pattern_anchors(patterns: DataFrame) -> DataFrame:
    """``pattern, size, gram``: of each distinct pattern a literal part by which its keys are found,
    up to ``GRAM`` characters of its longest literal; of these the one that fewest patterns share."""
    literals = F.filter(F.split(F.lower("pattern"), r"\\.|[%_]"), lambda x: x != "")
    own = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct().withColumn("literals", literals)
    size = F.least(F.lit(GRAM), F.coalesce(F.array_max(F.transform("literals", lambda x: F.char_length(x))), F.lit(0)))
    own = own.withColumn("size", size)
    of = F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform("literals", lambda x: _grams(x, F.col("size"))))))
    rows = own.select("pattern", "size", F.explode(of).alias("gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("n"))
    return rows.join(shared, "gram").groupBy("pattern").agg(F.min_by(F.struct("size", "gram"), F.struct("n", "gram")).alias("a")).select("pattern", "a.*")


def matches(keys: DataFrame, patterns: DataFrame, key: str = "object_key") -> DataFrame:
    """Distinct ``key, pattern`` of the keys that are like a pattern, whatever the case: ``%`` stands
    for any text and ``_`` for any character.

    Keys and patterns meet by a literal part, in an equi-join, and ``LIKE`` confirms; a key is
    cut into parts of those sizes only that patterns have. A pattern without a literal meets
    every key.
    """
    anchors = pattern_anchors(patterns)
    sizes = anchors.agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # one row, GRAM + 1 sizes at most
    own = keys.select(key).where(F.col(key).isNotNull()).distinct().crossJoin(F.broadcast(sizes))
    parts = F.flatten(F.transform("sizes", lambda n: _grams(F.lower(key), n)))
    found = own.select(key, F.explode(parts).alias("gram")).join(anchors, "gram")
    return found.where(F.expr(f"lower({key}) LIKE lower(pattern)")).select(key, "pattern").distinct()


def synced(grants: DataFrame, sources: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of the workspaces' active grants, and a row for each grant.

    ``grants``: ``organization_id, activation_id, label, is_active``; ``sources``: ``source_id, name,
    object_key, identifier, report_type``; ``analyses``: ``source_id, created_at, confidence``, axes. A source belongs to an
    activation that its object key carries. Records have its newest analysis, ``scored`` or
    ``pending``; datasets ``status`` (``done`` or ``empty``), counts, ``coverage_pct`` and the mean axes of
    scored records. Equal inputs give equal results: a sync replaces what the last one gave.
    """
    live = grants.where("is_active").select("organization_id", F.col("activation_id").cast("string").alias("activation_id"), "label")
    patterns = live.select("activation_id").distinct().select("activation_id", F.explode(F.array(*[F.concat(F.lit(p.split("{}")[0]), "activation_id", F.lit(p.split("{}")[1])) for p in KEY_PATTERNS])).alias("pattern"))
    found = matches(sources, patterns).join(patterns, "pattern").select("object_key", "activation_id").distinct()
    newest = analyses.groupBy("source_id").agg(F.max_by(F.struct(F.lit(True).alias("scored"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *[F.coalesce(a, F.lit(0.0)).alias(a) for a in AXES]), "created_at").alias("a"))
    belonging = sources.join(found, "object_key").join(newest, "source_id", "left")
    name = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Activation "), "activation_id"))
    records = live.join(belonging, "activation_id").select(
        "organization_id", "activation_id", name.alias("dataset"), "source_id", F.substring("identifier", 1, 200).alias("external_user_id"), F.substring(F.coalesce("name", F.lit("Profile")), 1, 300).alias("source_name"),
        F.when(F.col("a.scored"), "scored").otherwise("pending").alias("status"), F.col("a.confidence").alias("confidence"), *[F.col(f"a.{a}").alias(a) for a in AXES],
    )
    counts = records.groupBy("organization_id", "activation_id").agg(F.count("*").alias("row_count"), F.count_if(F.col("status") == "scored").alias("scored_count"), *[F.avg(a).alias(a) for a in AXES])
    rows = live.join(counts, ["organization_id", "activation_id"], "left")
    n = F.coalesce("row_count", F.lit(0))
    datasets = rows.select(
        "organization_id", "activation_id", name.alias("dataset"), F.when(n > 0, "done").otherwise("empty").alias("status"), n.alias("row_count"), F.coalesce("scored_count", F.lit(0)).alias("scored_count"),
        F.when(n > 0, F.round(F.col("scored_count") / F.col("row_count") * 100, 2)).otherwise(0.0).alias("coverage_pct"), *AXES,
    )
    return records, datasets


def regrounded(sources: DataFrame, neighbours: DataFrame, tags: DataFrame, queue: DataFrame, least: float = 0.05, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The tags (``source_id, node_id, weight``) and the queue (``symbol, source_id, reason``) after
    ``sources`` (``source_id, name, url``) were listened to.

    ``neighbours`` (``query_id, neighbour_id, similarity, rank``) are the nodes nearest to each source:
    the first ``most`` of at least ``least`` similarity become its tags, all of them in place of all
    it had. A source without any keeps what it had and is queued by its name, unless it is
    already. Sources without a web address are left alone. Done twice, it changes nothing more.
    """
    heard = sources.where(F.trim("url").rlike("(?i)^https?://")).select("source_id", "name").dropDuplicates(["source_id"])
    near = neighbours.where((F.col("rank") <= most) & (F.col("similarity") >= least)).join(heard, F.col("query_id") == F.col("source_id"), "left_semi")
    new = near.select(F.col("query_id").alias("source_id"), F.col("neighbour_id").alias("node_id"), S.half_up("similarity", 3).alias("weight"))
    kept = tags.join(new.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "node_id", "weight")
    missed = heard.join(new, "source_id", "left_anti").where(F.col("name").isNotNull()).groupBy(F.col("name").alias("symbol")).agg(F.min("source_id").alias("source_id"))
    fresh = missed.join(queue.select("symbol"), "symbol", "left_anti").select("symbol", "source_id", F.lit("no match").alias("reason"))
    return kept.unionByName(new), queue.select("symbol", "source_id", "reason").unionByName(fresh)
