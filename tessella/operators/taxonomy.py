"""Taxonomies: codes and families, suppression, ontologies, trees and crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.storage import written

#: Beginnings of the codes of places, and what of them is sensitive.
PLACE_PREFIXES = ("visit.", "poi.", "place.", "geo.", "brand.visit.")
SENSITIVE = (
    r"(?i)\b(health|healthcare|hospital|clinic|medical|medicine|physician|doctor|dentist|urgent[\s_-]?care|oncology|dialysis|therapy|therapist|psychiatr|mental[\s_-]?health|pharmac|drugstore|lab[\s_-]?test|blood[\s_-]?donation|hospice|nursing[\s_-]?home|disabilit|hiv|std|cancer)\b",
    r"(?i)\b(planned[\s_-]?parenthood|abortion|fertility|prenatal|obgyn|rehab|rehabilitation[\s_-]?cent|addiction|methadone|substance[\s_-]?abuse|alcoholics[\s_-]?anonymous|narcotics[\s_-]?anonymous)\b",
    r"(?i)\b(worship|church|chapel|cathedral|mosque|masjid|synagog|temple|shrine|gurdwara|monaster|religio|faith|parish|ministry)\b",
    r"(?i)\b(shelter|homeless|food[\s_-]?bank|soup[\s_-]?kitchen|refugee|asylum|domestic[\s_-]?violence|crisis[\s_-]?cent|halfway[\s_-]?house|welfare)\b",
    r"(?i)\b(prison|jail|correctional|probation|immigration[\s_-]?cent|political[\s_-]?part|campaign[\s_-]?office|labor[\s_-]?union|lgbt|gay[\s_-]?bar|adult[\s_-]?entertainment|strip[\s_-]?club)\b",
)


def has_prefix(code: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(code, F.lit(p))
    return out


def is_sensitive(code: Column, label: Column) -> Column:
    """Whether the tag of a place tells what must not be known of a person; tags of other kinds
    never do."""
    said = F.translate(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(label, F.lit(""))), "._", "  ")
    hit = F.lit(False)
    for pattern in SENSITIVE:
        hit = hit | said.rlike(pattern)
    return has_prefix(F.lower(F.coalesce(code, F.lit(""))), PLACE_PREFIXES) & hit


def family_key(code: Column) -> Column:
    """``iab.iab17`` of ``iab.iab17-2``, else the code without its last part if it has over two;
    null for codes without a family."""
    iab = F.lower(F.regexp_extract(code, r"(?i)^iab\.(iab[0-9]+)", 1))
    parts = F.split(code, r"\.")
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))
    return F.when(iab != "", F.concat(F.lit("iab."), iab)).otherwise(rest)


def named(nodes: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (``code, label``) of known nodes that are not suppressed, and the new nodes of those
    whose code no node has, each once with its least label."""
    known = nodes.select("code", F.coalesce("suppressed", F.lit(False)).alias("__off"))
    joined = tags.join(known, "code", "left")
    fresh = joined.where(F.col("__off").isNull() & F.col("code").isNotNull())
    return joined.where(~F.coalesce("__off", F.lit(True))).drop("__off"), fresh.groupBy("code").agg(F.min("label").alias("label"))


def grounding_counts(nodes: DataFrame, tags: DataFrame, sources: DataFrame) -> DataFrame:
    """``code, grounding_count`` of the nodes whose stored count is no longer the number of
    complete sources with a vector that carry them."""
    whole = sources.where("complete and embedded").select("source_id").distinct()
    per = tags.join(whole, "source_id", "left_semi").groupBy("code").agg(F.countDistinct("source_id").alias("now"))
    joined = nodes.join(per, "code", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return joined.where(~F.col("now").eqNullSafe(F.col("grounding_count"))).select("code", F.col("now").alias("grounding_count"))


def slug_code(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore; ``unnamed`` for none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(plain == "", "unnamed").otherwise(plain)


def ontology_tree(entries: DataFrame, prefix: str = "aset.") -> DataFrame:
    """``id, code, label, parent_code, depth`` of ``id, name, child_ids``: each entry under the
    shallowest of its parents, of those the one of the least id; entries of cycles hang at depth
    1 without a parent.

    One join a level, each written to the shared folder. Codes are unique: of entries of one
    name, by depth and then id, the second gets ``__2`` and so on.
    """
    base = written(entries.groupBy("id").agg(F.min_by(F.struct("name", "child_ids"), F.to_json(F.struct("name", "child_ids"))).alias("e")).select("id", "e.*"), "entries")
    edges = base.select(F.col("id").alias("parent"), F.explode("child_ids").alias("id")).where("parent <> id").join(base.select("id"), "id", "left_semi").distinct()
    edges = written(edges, "edges")
    level = written(base.select("id").join(edges.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")), "level")
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = edges.join(level.select(F.col("id").alias("parent")), "parent").groupBy("id").agg(F.min("parent").alias("parent"))
        level = written(below.join(found.select("id"), "id", "left_anti").select("id", "parent", F.lit(depth).alias("depth")), "level")
        found = found.unionByName(level)
    rest = base.select("id").join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("depth"))
    rows = written(found.unionByName(rest).join(base.select("id", "name"), "id"), "placed")
    nth = F.row_number().over(Window.partitionBy(slug_code(F.col("name"))).orderBy("depth", "id"))
    coded = rows.withColumn("code", F.concat(F.lit(prefix), slug_code(F.col("name")), F.when(nth > 1, F.concat(F.lit("__"), nth.cast("string"))).otherwise("")))
    coded = written(coded, "coded")
    return coded.join(coded.select(F.col("id").alias("parent"), F.col("code").alias("parent_code")), "parent", "left").select("id", "code", F.col("name").alias("label"), "parent_code", "depth")


def path_nodes(paths: DataFrame, path: str = "path") -> DataFrame:
    """``id, label, parent_id`` of the nodes and ancestors that paths like ``A > B > C`` name."""
    parts = F.transform(F.split(path, ">"), lambda x: F.trim(x))
    rows = paths.select(F.filter(parts, lambda x: x != "").alias("p")).where(F.size("p") > 0)
    each = rows.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    id_ = lambda n: F.array_join(F.slice("p", F.lit(1), n), " > ")
    return each.select(id_(F.col("n")).alias("id"), F.element_at("p", F.col("n")).alias("label"), F.when(F.col("n") > 1, id_(F.col("n") - 1)).alias("parent_id")).distinct()


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``id, label, parent_id``) and a node for each parent that is missing."""
    missing = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.withColumn("synthesised", F.lit(False)).unionByName(missing.select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("synthesised")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``id, ancestor, steps``: each node with itself and all above it; loops end where they meet.

    One join a level, each written to the shared folder.
    """
    up = written(nodes.where("parent_id is not null and parent_id <> id").select("id", "parent_id").distinct(), "parents")
    found = written(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")).distinct(), "closure")
    last, steps = found, 0
    while True:
        steps += 1
        step = last.join(up.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("above")), "ancestor").select("id", F.col("above").alias("ancestor"), F.lit(steps).alias("steps")).distinct()
        last = written(step.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "closure")
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def filtered_tree(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes whose id or label has ``text``, in any case, and all above them."""
    low = text.strip().lower()
    hit = nodes.where(F.contains(F.lower("label"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low))).select("id")
    kept = ancestors(nodes).join(hit, "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return nodes.join(kept, "id", "left_semi")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """``id, nodes``: how many nodes a subtree has, its root included."""
    return ancestors(nodes).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("nodes"))


def propose_matches(neighbours: DataFrame, decided: DataFrame, most: int = 5) -> DataFrame:
    """``code, target, similarity, approved, rejected``: the nearest targets of each code, other
    than itself, with the decisions that were made before."""
    near = neighbours.where("code <> target")
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("similarity"), "target"))
    top = near.withColumn("__r", rank).where(F.col("__r") <= most).select("code", "target", F.round("similarity", 4).alias("similarity"))
    return top.join(decided.select("code", "target", "approved", "rejected"), ["code", "target"], "left").fillna(False, subset=["approved", "rejected"])


def auto_approved(matches: DataFrame, least: float, most: int = 1) -> DataFrame:
    """``code, target``: of codes without an approved match the best ones of ``least`` or more that
    nobody rejected."""
    done = matches.where("approved").select("code").distinct()
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("similarity"), "target"))
    rows = matches.where(~F.col("rejected") & (F.col("similarity") >= least)).join(done, "code", "left_anti")
    return rows.withColumn("__r", rank).where(F.col("__r") <= max(1, most)).select("code", "target")


def crosswalk_coverage(codes: DataFrame, matches: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """``prefix, total, proposed, approved, complete`` of the codes that begin with each prefix."""
    per = matches.groupBy("code").agg(F.bool_or("approved").alias("approved"))
    first = F.coalesce(*[F.when(F.startswith(F.col("code"), F.lit(p)), p) for p in prefixes])
    rows = codes.select("code", first.alias("prefix")).where("prefix is not null").join(per, "code", "left")
    out = rows.groupBy("prefix").agg(F.count("*").alias("total"), F.count("approved").alias("proposed"), F.count_if("approved").alias("approved"))
    return out.withColumn("complete", F.col("approved") == F.col("total"))
