"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

Each document starts with the fractional number of copies that its source's target asks
for: whole copies are taken at once, the fraction is rounded. Rounding pairs two fractions
of a source and moves words (probability times size) from one to the other, in a random
direction whose odds keep both expectations, until one of the two is 0 or 1. The words of
the pair do not change, so a source misses its target by less than its last document.
Blocks of a few documents are folded by themselves, each leaves one fraction at most, and
those meet in the next level: a reduction tree of depth log(n) to the base of the block
size, with no group that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, replacing, running_totals, unused

#: Documents in a block of the reduction tree, on average.
BLOCK = 24
#: Decisions, at most, that are sent to all tasks (about 64 bytes each); more are joined by shuffle.
BROADCAST_DECISIONS = 1_000_000
#: Parts that the rows of one repeated document are dealt to.
SALTS = 64
#: What the sources weigh, in code point order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def text_size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share``
    times all words. A target stops at ``most`` times its source's size; what is left is
    shared by weight among the others until none is above. Sources reach their ceilings in
    the order of ceiling over weight: running totals in that order tell at which of them
    the level stands. Only sums come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = running_totals(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank").cast("long") - 1) % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("ceiling", F.lit(most) * F.col("source_size"))
    filled = running_totals(totals, [F.col("ceiling") / F.col("weight"), F.col("rank")], {"held": F.col("ceiling"), "full": F.col("weight")}, "ceilings")
    words, weighed = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return filled.select("source", "source_size", F.lit(0.0).alias("target"))
    # The level if the sources so far were full and no other; it holds below the next ceiling.
    before = {"held": F.col("held") - F.col("ceiling"), "full": F.col("full") - F.col("weight")}
    level = (F.lit(share * words) - before["held"]) / (F.lit(weighed) - before["full"])
    reached = filled.where(level * F.col("weight") < F.col("ceiling")).agg(F.min_by(level, F.struct(F.col("ceiling") / F.col("weight"), "rank"))).first()[0]
    target = F.col("ceiling") if reached is None else F.least(F.lit(max(0.0, reached)) * F.col("weight"), F.col("ceiling"))
    return filled.select("source", "source_size", target.alias("target"))


def _unit(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on its arguments only."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, level: int) -> Column:
    """Round a block: ``open`` is the fraction left over (or null), ``done`` the settled units."""

    def settle(unit: Column, p: Column) -> Column:
        return unit.withField("p", p)

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        has_a, has_b = a["p"] * a["size"], b["p"] * b["size"]
        up, down = F.least(room_a, has_b), F.least(has_a, room_b)
        go_up = _unit(a["key"], b["key"], seed, level) * (up + down) < down
        # One of the two becomes exactly 0 or 1.
        a_up = F.when(room_a <= has_b, 1.0).otherwise(a["p"] + up / a["size"])
        b_up = F.when(has_b <= room_a, 0.0).otherwise(b["p"] - up / b["size"])
        a_down = F.when(has_a <= room_b, 0.0).otherwise(a["p"] - down / a["size"])
        b_down = F.when(room_b <= has_a, 1.0).otherwise(b["p"] + down / b["size"])
        new_a = settle(a, F.when(go_up, a_up).otherwise(a_down))
        new_b = settle(b, F.when(go_up, b_up).otherwise(b_down))
        is_open = lambda u: (u["p"] > 0) & (u["p"] < 1)
        nothing = F.lit(None).cast(unit_type)
        left = F.when(is_open(new_a), new_a).otherwise(F.when(is_open(new_b), new_b).otherwise(nothing))
        done = F.concat(state["done"], F.filter(F.array(new_a, new_b), lambda u: ~is_open(u)))
        both = F.struct(left.alias("open"), done.alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(both)

    unit_type = "struct<key:bigint,id:bigint,size:bigint,p:double>"
    empty = F.struct(F.lit(None).cast(unit_type).alias("open"), F.array().cast(f"array<{unit_type}>").alias("done"))
    return F.aggregate(units, empty, step)


def round_fractions(units: DataFrame, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """Round ``group, key, id, size, p`` (0 < p < 1, size > 0) to ``key, id, taken`` (0 or 1)."""
    spark, done, level, open_units = units.sparkSession, [], 0, units
    counts = open_units.groupBy("group").agg(F.count("*").alias("n"))
    n = counts.agg(F.max("n")).first()[0] or 0
    while n:
        blocks = max(1, -(-n // block))
        # Every group has at most n units; a group with fewer leaves some blocks empty, so
        # all its units fall together once n is below the block size.
        at = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.lit(blocks)) if blocks > 1 else F.lit(0)
        gathered = open_units.groupBy("group", at.alias("at")).agg(F.array_sort(F.collect_list(F.struct("key", "id", "size", "p"))).alias("units"))
        folded = materialise(gathered.select("group", _fold(F.col("units"), seed, level).alias("s")), f"level{level}")
        done.append(folded.select(F.explode("s.done").alias("u")).select("u.key", "u.id", F.col("u.p").cast("long").alias("taken")))
        left = folded.where("s.open is not null").select("group", "s.open.*")
        if blocks == 1:
            last = (_unit("key", seed, -1) < F.col("p")).cast("long")
            done.append(left.select("key", "id", last.alias("taken")))
            break
        open_units, level = left, level + 1
        n = left.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if not done:
        return spark.createDataFrame([], "key long, id long, taken long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _keys(source: str, size: str) -> tuple[Column, Column]:
    """Two hashes that tell documents apart, null values and equal ids included."""
    parts = [F.isnull("doc_id"), "doc_id", F.isnull(source), source, F.isnull("text"), "text", size]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` (copies times size).

    A document gets the whole copies of target / source_size, and one more by dependent
    rounding of the fraction; never more than ``ceil(most)``. Null and empty texts have
    size 0 and no copies; a null source is a source of its own, last in order. Rows that
    repeat a document (doc_id, source and text; nulls are equal) share their fractions: the
    whole part of the sum goes to so many of the rows, what is left is rounded like any
    fraction. An empty table gives an empty result. Other columns pass through, those named
    like the new ones are replaced. Reruns give the same copies.
    """
    docs = replacing(docs, "size", "source_size", "target", "copies", "taken")
    k1, k2, src, ratio, rows, extra, salt, nth, before = unused(docs, "__k1", "__k2", "__src", "__ratio", "__rows", "__extra", "__salt", "__nth", "__before")
    sized = docs.withColumn("size", text_size(F.col("text")))
    key, other = _keys("source", "size")
    sized = sized.withColumn(k1, key).withColumn(k2, other)
    small = materialise(sized.select("source", "size", F.col(k1).alias("key"), F.col(k2).alias("id")), "sizes")
    targets = materialise(source_targets(small, weights, share, most), "targets")
    per_source = F.broadcast(targets) if targets.count() <= 100_000 else targets
    copies_each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = per_source.select(F.col("source").alias(src), "source_size", "target", copies_each.alias(ratio))
    open_rows = small.where("size > 0").join(per_source, F.col("source").eqNullSafe(F.col(src)))
    fraction = F.col(ratio) - F.floor(ratio)
    units = open_rows.where(fraction > 0).groupBy(F.col("source").alias("group"), "key", "id", "size").agg(F.count("*").alias("m"), F.max(fraction).alias("f"))
    # Rows of one document that take a copy for sure, and the fraction that is left of it.
    units = materialise(units.withColumn("sure", F.floor(F.col("m") * F.col("f") + 1e-9)), "units")
    units = units.withColumn("p", F.greatest(F.lit(0.0), F.col("m") * F.col("f") - F.col("sure")))
    rounded = round_fractions(units.where("p > 1e-9").select("group", "key", "id", "size", "p"), seed=seed)
    decided = units.where("sure > 0 or m > 1").select("key", "id", "m", "sure").unionByName(rounded.select("key", "id", F.lit(0).cast("long").alias("m"), F.col("taken").alias("sure")))
    decided = decided.groupBy("key", "id").agg(F.greatest(F.lit(1), F.max("m")).alias("m"), F.sum("sure").alias("n")).where("n > 0")
    decided = materialise(decided.select(F.col("key").alias(k1), F.col("id").alias(k2), F.col("m").alias(rows), F.col("n").alias(extra)), "decided")
    # Texts stay where they are as long as the decisions fit into each task.
    sent = F.broadcast(decided) if decided.count() <= BROADCAST_DECISIONS else decided
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col(src))).join(sent, [k1, k2], "left")
    split = (F.col(extra) < F.col(rows)) & F.col(extra).isNotNull()
    if not decided.where(split).isEmpty():
        # Of the rows of a repeated document some take a copy: they are numbered in parts.
        mixed = materialise(joined.where(split).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mixed")
        parts = mixed.groupBy(k1, k2, salt).agg(F.count("*").alias(nth))
        parts = parts.withColumn(before, F.sum(nth).over(Window.partitionBy(k1, k2).orderBy(salt)) - F.col(nth)).drop(nth)
        number = F.row_number().over(Window.partitionBy(k1, k2, salt).orderBy(F.lit(0)))
        mixed = mixed.withColumn(nth, number).join(materialise(parts, "parts"), [k1, k2, salt])
        mixed = mixed.withColumn(extra, (F.col(nth) + F.col(before) <= F.col(extra)).cast("long")).select(*joined.columns)
        whole = joined.where(~F.coalesce(split, F.lit(False))).withColumn(extra, F.when(F.col(extra).isNotNull(), F.lit(1)).cast("long"))
        joined = whole.select(*mixed.columns).unionByName(mixed)
    else:
        joined = joined.withColumn(extra, F.when(F.col(extra).isNotNull(), F.lit(1)).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(ratio) + F.coalesce(extra, F.lit(0))).otherwise(0).cast("long")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def mixing_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``."""
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "copies", "taken")
