"""Coverage, gaps, signal values and catalogue rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.storage import ranked_counts


def coverage(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """``branch, nodes, grounded, weight, share``: of ``nodes`` (``code, grounded``) with the
    ``weight`` of their codes, per branch (the code up to its first dot)."""
    joined = nodes.join(weights.groupBy("code").agg(F.sum("weight").alias("weight")), "code", "left")
    per = joined.groupBy(F.split_part("code", F.lit("."), F.lit(1)).alias("branch")).agg(
        F.count("*").alias("nodes"), F.count_if("grounded").alias("grounded"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")
    )
    return per.withColumn("share", F.col("grounded") / F.nullif(F.col("nodes"), F.lit(0)))


def gaps(nodes: DataFrame, known: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """``code, weight``: the heaviest codes of ``nodes`` that are not ``known``."""
    open_nodes = nodes.join(known.select("code").distinct(), "code", "left_anti")
    per = weights.join(open_nodes.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.sum("weight").alias("weight"))
    return per.orderBy(F.desc("weight"), "code").limit(most)


def signal_values(signals: DataFrame, most: int | None = None) -> DataFrame:
    """``family, value, devices, share``: of ``device, label`` rows whose label reads
    ``Family: value``, distinct devices per value and their share of the family's devices."""
    at = F.locate(": ", F.col("label"))
    parts = signals.where(at > 0).select("device", F.expr("substr(label, 1, locate(': ', label) - 1)").alias("family"), F.expr("substr(label, locate(': ', label) + 2)").alias("value"))
    per = parts.groupBy("family", "value").agg(F.countDistinct("device").alias("devices"))
    whole = parts.groupBy("family").agg(F.countDistinct("device").alias("all_devices"))
    out = per.join(whole, "family").select("family", "value", "devices", (F.col("devices") / F.col("all_devices")).alias("share"))
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("devices"), "value"))
    return out.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


#: Letters with marks, and the letters that searches take them for.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiilnnoorsstuuuzzz"


def folded(c: Column) -> Column:
    """Lower case, marks off, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN), r"[\u0300-\u036f]", "")).alias("folded")


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which every word of ``text`` occurs in some of the columns, in any case and with
    or without marks on its letters."""
    out = df
    for term in text.lower().translate(str.maketrans(MARKED, PLAIN)).split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(folded(F.col(c)), F.lit(term))
        out = out.where(hit)
    return out


def catalogue_rollup(regions: DataFrame, nations: DataFrame, customers: DataFrame) -> DataFrame:
    """``level, name, members, score``: mean balance at each nation, and at each region the
    mean of its nations weighted by their customers; levels without customers are left out."""
    leaves = customers.groupBy("c_nationkey").agg(F.count("*").alias("members"), F.avg("c_acctbal").alias("score"))
    named = leaves.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    tops = named.groupBy("n_regionkey").agg((F.sum(F.col("score") * F.col("members")) / F.sum("members")).alias("score"), F.sum("members").alias("members"))
    tops = tops.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    low = named.select(F.lit("nation").alias("level"), F.col("n_name").alias("name"), "members", "score")
    return low.unionByName(tops.select(F.lit("region").alias("level"), F.col("r_name").alias("name"), "members", "score"))


def percentile_row(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, as ``p50, p95...``, and ``top``.

    Equal values are counted first; ranks come from running counts of the distinct values, which
    spread over tasks however many a key has.
    """
    placed = ranked_counts(df, key, value)
    at = lambda q, f: f(F.lit(q) * (F.col("__all") - 1))
    pick = lambda q, f: F.min(F.when(F.col("__run") > at(q, f), F.col(value)))
    out: list[Column] = []
    for q in shares:
        low, high, place = pick(q, F.floor), pick(q, F.ceil), F.lit(q) * (F.max("__all") - 1)
        out.append((low + (high - low) * (place - F.floor(place))).alias(f"p{round(100 * q)}"))
    return placed.groupBy(key).agg(*out, F.max(value).alias("top"))


def nearest_in_time(points: DataFrame, trail: DataFrame, key: str, tolerance_s: int) -> DataFrame:
    """``points`` (``key, point_id, ts``) with ``at``, the nearest ``ts`` of the key's ``trail``
    within the tolerance; null if there is none, the earlier of two as near.

    Times are cut into cells as wide as the tolerance, so a point meets the three around it
    only, not the whole trail of its key.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda: F.floor(micros("ts") / (tolerance_s * 1_000_000))
    left = points.select(key, "point_id", "ts", F.explode(F.array(cell() - 1, cell(), cell() + 1)).alias("__c"))
    right = trail.select(F.col(key).alias("__k"), F.col("ts").alias("__t"), cell().alias("__d")).distinct()
    gap = F.abs(micros("ts") - micros("__t"))
    near = left.join(right, (F.col(key) == F.col("__k")) & (F.col("__c") == F.col("__d"))).where(gap <= tolerance_s * 1_000_000)
    best = near.groupBy("point_id").agg(F.min(F.struct(gap.alias("gap"), F.col("__t").alias("t")))["t"].alias("at"))
    return points.join(best, "point_id", "left")


def grounding_gaps(nodes: DataFrame, tags: DataFrame, queue: DataFrame, assets: DataFrame, most: int = 40, branch: str | None = None) -> DataFrame:
    """``code, label, branch, observed_sources, observed_weight, queued``: the nodes with most weight in
    ``tags`` (``source_id, code, weight``) that nothing grounds, of one branch or all; ties by code.

    ``nodes`` have ``code, label, suppressed, grounding_count``; ``assets`` ``code, status``, of which active ones
    ground a node; ``queue`` ``code, status``, in which pending and proposed codes wait already.
    From 1 to 200 rows.
    """
    root = F.split_part("code", F.lit("."), F.lit(1))
    own = nodes.where(~F.coalesce("suppressed", F.lit(False)) & (F.coalesce("grounding_count", F.lit(0)) == 0))
    own = own if branch is None else own.where(root == branch)
    own = own.join(assets.where("status = 'active'").select("code").distinct(), "code", "left_anti")
    # Per source first, so that a node with very many tags counts its sources over many tasks.
    per = tags.groupBy("code", "source_id").agg(F.sum("weight").alias("w")).groupBy("code").agg(F.count("source_id").alias("observed_sources"), F.round(F.sum("w"), 3).alias("observed_weight"))
    waits = queue.where("status IN ('pending', 'proposed')").select("code").distinct().withColumn("queued", F.lit(True))
    out = own.join(per, "code").join(waits, "code", "left")
    out = out.select("code", "label", root.alias("branch"), "observed_sources", "observed_weight", F.coalesce("queued", F.lit(False)).alias("queued"))
    return out.orderBy(F.desc("observed_weight"), "code").limit(min(max(most, 1), 200))


#: Families of tags, the first whose beginning fits, and the rest.
FAMILIES = (("demo.age.", "age"), ("demo.", "other demographics"), ("ctv.genre.", "viewing genre"), ("ctv.channel.", "channel"), ("iab", "interest category"))
OTHER_FAMILY = "other signals"


def tag_insights(profiles: DataFrame, axes: list[str], most: int = 12) -> DataFrame:
    """``family, family_tags, family_mentions, code, n, share, confidence, rank`` and the mean axes: the
    ``most`` (3 to 30) commonest tags of each family, their share of all profiles that have tags
    in percent, and what profiles with the tag score. ``profiles`` have ``codes``, axes and
    ``confidence``; missing scores count as 0. All profiles count, not a sample of them."""
    tagged = profiles.where(F.size("codes") > 0)
    family = F.coalesce(*[F.when(F.startswith("code", F.lit(p)), f) for p, f in FAMILIES], F.lit(OTHER_FAMILY))
    rows = tagged.select(F.explode("codes").alias("code"), *axes, "confidence").withColumn("family", family)
    per = rows.groupBy("family", "code").agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(a, F.lit(0.0))), 1).alias(a) for a in axes], F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("confidence"))
    w = Window.partitionBy("family")
    ranked = per.withColumns({"family_tags": F.count("*").over(w), "family_mentions": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "code"))})
    total = tagged.agg(F.count("*").alias("total"))  # one row
    out = ranked.where(F.col("rank") <= min(max(most, 3), 30)).crossJoin(F.broadcast(total))
    return out.withColumn("share", F.round(F.col("n") / F.col("total") * 100, 1)).drop("total")
