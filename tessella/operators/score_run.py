"""Staged scoring of queued identifiers, with sinks that a ledger commits together.

A run goes through lookup, source, tags, cache, scorer, normalisation, calibration and persistence.
Each sink writes its rows to a folder of the run, and the ledger's entry, made last, commits
them all: readers heed only runs that are in the ledger. So a run that broke off anywhere has
changed nothing; run again, it replaces what it left behind, and a run that has been committed
is not done again. Nothing is drawn at random or taken from the clock, so replays are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import profiles
from tessella.operators.scoring import known_codes
from tessella.operators.taxonomy import is_sensitive

AXES = list(S.AXES)
_AXES = ", ".join(f"{a} double" for a in AXES)
#: The sinks in the order in which they are written, with their keys and columns.
TABLES = {
    "source_tags": (("source_id", "code"), "source_id string, code string, weight double"),
    "calibration": (("code", "category"), "code string, category string, n long, mean double, m2 double"),
    "cache": (("signature",), f"signature string, report_type string, codes array<string>, {_AXES}, grounding_level string, confidence double"),
    "analyses": (("task_id",), f"task_id long, source_id string, name string, confidence double, grounding_level string, from_cache boolean, {_AXES}"),
    "identifiers": (("identifier",), f"identifier string, source_id string, codes array<string>, observations long, last_seen timestamp, confidence double, {_AXES}"),
    "outcomes": (("task_id",), "task_id long, identifier string, status string, source_id string, from_cache boolean, suppressed int"),
}


class ScoreStore:
    """The tables under ``root``, as the runs in its ledger left them. One run writes at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        """The runs in the order of their commits."""
        fs, ledger = self._fs(f"{self.root}/ledger")
        names = sorted(f.getPath().getName() for f in fs.listStatus(ledger)) if fs.exists(ledger) else []
        return [n.split("-", 1)[1] for n in names]

    def commit(self, run: str) -> None:
        """Enter a run into the ledger: one file made, or not."""
        fs, entry = self._fs(f"{self.root}/ledger/{len(self.committed()):08d}-{run}")
        if not fs.createNewFile(entry):
            raise RuntimeError(f"another run was committed: {run} must be run again")

    def path(self, run: str, table: str) -> str:
        return f"{self.root}/runs/{run}/{table}"

    def write(self, run: str, table: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(run, table))
        return self.spark.read.schema(rows.schema).parquet(self.path(run, table))

    def of_run(self, run: str, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table][1]).parquet(self.path(run, table))

    def read(self, table: str) -> DataFrame:
        """The last row of each key, by the order of the runs that wrote it."""
        keys, kind = TABLES[table]
        runs = self.committed()
        runs = runs[max((i for i, r in enumerate(runs) if r.startswith("base-")), default=0) :]
        rows = self.spark.createDataFrame([], kind).withColumn("__run", F.lit(0))
        for i, run in enumerate(runs):
            rows = rows.unionByName(self.of_run(run, table).withColumn("__run", F.lit(i)))
        values = [c for c in rows.columns if c not in (*keys, "__run")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__run").alias("__v")).select(*keys, "__v.*")

    def compact(self) -> None:
        """Make one run of all: later reads begin there."""
        run = f"base-{len(self.committed())}"
        for table in TABLES:
            self.write(run, table, self.read(table))
        self.commit(run)


def _lookup(store: ScoreStore, tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tasks with what is known of their identifier, their ``status`` so far, and their tags
    that may be kept."""
    first = tasks.groupBy("identifier").agg(F.min("task_id").alias("first_task"))
    known = store.read("identifiers").select("identifier", F.col("source_id").alias("old_source"), F.col("codes").alias("old_codes"), F.col("observations").alias("old_observations"))
    rows = tasks.join(first, "identifier").join(known, "identifier", "left")
    status = F.when(F.col("task_id") != F.col("first_task"), "deferred").when(known_codes(F.col("codes"), F.col("old_codes")), "unchanged").otherwise("scored")
    source = F.coalesce("old_source", F.sha2(F.concat(F.lit("source:"), "identifier").cast("binary"), 256))
    rows = rows.withColumns({"status": status, "source_id": source, "signature": S.tag_signature("report_type", "codes")})
    off = nodes.where(F.coalesce("suppressed", F.lit(False)) | is_sensitive(F.col("code"), F.col("label"))).select("code").distinct()
    tags = rows.where("status = 'scored'").select("task_id", F.explode(F.array_distinct("codes")).alias("code"))
    bad = tags.join(off, "code").groupBy("task_id").agg(F.collect_set("code").alias("off"))
    rows = rows.join(bad, "task_id", "left").withColumn("off", F.coalesce("off", F.array().cast("array<string>")))
    return rows.withColumn("kept", F.array_except(F.array_distinct("codes"), "off"))


def _scores(store: ScoreStore, rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], normalise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``signature, first_scored, from_store``, axes and ``grounding_level`` of all signatures to score:
    cached ones as they are, others by the scorer, once each, and normalised.

    The scorer gets ``signature, report_type, codes`` and ``prior_<axis>``, the mean of the codes'
    calibration weighted by n, null where nothing is known.
    """
    per = rows.groupBy("signature").agg(F.min("task_id").alias("first_scored"), F.min_by(F.struct("report_type", "codes", "kept"), "task_id").alias("t"))
    cached = store.read("cache").select("signature", *AXES, "grounding_level")
    hits = per.select("signature", "first_scored").join(cached, "signature").withColumn("from_store", F.lit(True))
    todo = per.join(cached, "signature", "left_anti").select("signature", "first_scored", "t.report_type", "t.codes", F.col("t.kept").alias("kept"))
    value = lambda a: F.when(F.col("category") == a, F.col("mean"))
    weighted = lambda a: F.sum(value(a) * F.col("n")) / F.nullif(F.sum(F.when(F.col("category") == a, F.col("n"))), F.lit(0))
    priors = todo.select("signature", F.explode("kept").alias("code")).join(store.read("calibration"), "code").groupBy("signature").agg(*[weighted(a).alias(f"prior_{a}") for a in AXES])
    asked = todo.join(priors, "signature", "left").select("signature", "report_type", "codes", *[f"prior_{a}" for a in AXES])
    scored = normalise(scorer(asked))
    level = "grounding_level" if "grounding_level" in scored.columns else F.lit("text-only")
    scored = todo.select("signature", "first_scored").join(scored.select("signature", *AXES, F.coalesce(level, F.lit("text-only")).alias("grounding_level")), "signature").withColumn("from_store", F.lit(False))
    return hits.select(scored.columns).unionByName(scored)


def _calibration(store: ScoreStore, learned: DataFrame) -> DataFrame:
    """The calibration of the codes of newly scored tasks, with their scores."""
    long = learned.select(F.explode("kept").alias("code"), F.explode(F.array(*[F.struct(F.lit(a).alias("category"), F.col(a).alias("score")) for a in AXES])).alias("s")).select("code", "s.*")
    new = profiles.moments(long, ["code", "category"], "score")
    old = store.read("calibration").join(new.select("code", "category"), ["code", "category"], "left_semi")
    merged = profiles.merged_moments(old.unionByName(new.select(old.columns)), ["code", "category"])
    return merged.select("code", "category", F.col("n").cast("long").alias("n"), "mean", "m2")


def run_scores(store: ScoreStore, run: str, tasks: DataFrame, nodes: DataFrame, scorer: Callable[[DataFrame], DataFrame], normalise: Callable[[DataFrame], DataFrame] = lambda df: df, after: Callable[[str], None] = lambda table: None) -> DataFrame:
    """Score ``tasks`` (``task_id, identifier, report_type, codes, confidence, signals, label, seen_at``) and
    return their ``outcomes``; ``run`` names the run, and a committed one changes nothing.

    Of the tasks of one identifier a run takes the one of least id; the others are ``deferred``
    to a later run. A task whose codes its identifier has already is ``unchanged``. The rest is
    ``scored``: its tags are kept but for those of suppressed or sensitive ``nodes`` (``code, label,
    suppressed``), and its scores come from the cache or, once for each signature, from the
    scorer. ``after`` is called when a sink has been written. Task ids are distinct; null codes,
    labels and identifiers' earlier rows count as empty, a null confidence as one half.
    """
    if run in store.committed():
        return store.of_run(run, "outcomes")
    clean = tasks.where(F.col("identifier").isNotNull()).withColumns({
        "identifier": F.col("identifier").cast("string"), "codes": F.coalesce("codes", F.array().cast("array<string>")), "confidence": F.coalesce("confidence", F.lit(0.5)),
        "signals": F.coalesce("signals", F.lit(0)), "label": F.coalesce("label", F.concat(F.col("report_type"), F.lit(": "), F.substring(F.col("identifier").cast("string"), 1, 12))),
    })
    rows = store.write(run, "stage-lookup", _lookup(store, clean, nodes))
    todo = rows.where("status = 'scored'")
    scores = store.write(run, "stage-scores", _scores(store, todo, scorer, normalise))
    done = store.write(run, "stage-scored", todo.join(scores, "signature").withColumn("from_cache", F.col("from_store") | (F.col("task_id") != F.col("first_scored"))))
    fresh = done.where("NOT from_cache")
    merged = F.array_union(F.coalesce("old_codes", F.array().cast("array<string>")), F.col("codes"))
    flags = done.select("task_id", "from_cache")
    sinks = {
        "source_tags": done.select("source_id", F.explode("kept").alias("code"), F.col("confidence").alias("weight")),
        "calibration": _calibration(store, fresh),
        "cache": fresh.select("signature", "report_type", "codes", *AXES, "grounding_level", "confidence"),
        "analyses": done.select("task_id", "source_id", F.col("label").alias("name"), "confidence", "grounding_level", "from_cache", *[S.half_up(a).alias(a) for a in AXES]),
        "identifiers": done.select("identifier", "source_id", merged.alias("codes"), (F.coalesce("old_observations", F.lit(0)) + F.col("signals")).cast("long").alias("observations"), F.col("seen_at").cast("timestamp").alias("last_seen"), "confidence", *AXES),
        "outcomes": rows.join(flags, "task_id", "left").select("task_id", "identifier", "status", F.when(F.col("status") != "deferred", F.col("source_id")).alias("source_id"), "from_cache", F.size("off").alias("suppressed")),
    }
    for table, out in sinks.items():
        store.write(run, table, out)
        after(table)
    store.commit(run)
    return store.of_run(run, "outcomes")
