"""A toxicity classifier with counterfactual regularisation.

A logistic model over the words and word beginnings of a text. Features are chosen by how
far their share of toxic documents lies from the overall share; identity terms are features
always. Each sentence of a labelled text that mentions identity groups has counterfactual
sentences: every mention swapped for another group of the same list, and for a word that
names no group. The fit penalises the squared change of the log odds, so that naming a
group neither raises nor lowers a score by itself, and neutral mentions aren't rejected.

The fit sees a sample of labelled rows of bounded size (``Settings.sample``); scoring reads
every text in place and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_sample, materialise, replacing, slices

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")

#: Terms that name groups, by language; a term is swapped inside its list.
IDENTITIES = (
    "christian christians muslim muslims jew jews jewish hindu hindus buddhist buddhists atheist atheists".split(),
    "black white asian latino hispanic arab african european american mexican chinese indian".split(),
    "woman women man men girl girls boy boys female male".split(),
    "gay lesbian bisexual transgender queer straight heterosexual homosexual".split(),
    "immigrant immigrants refugee refugees foreigner foreigners citizen citizens".split(),
    "deaf blind disabled autistic old young elderly".split(),
    "christen muslime juden hindus buddhisten atheisten".split(),
    "frauen männer mädchen jungen ausländer deutsche türken flüchtlinge".split(),
    "chrétiens musulmans juifs hindous bouddhistes athées".split(),
    "femmes hommes filles garçons étrangers réfugiés noirs blancs arabes".split(),
    "cristianos musulmanes judíos hindúes budistas ateos".split(),
    "mujeres hombres niñas niños extranjeros refugiados negros blancos árabes".split(),
)
#: Fixed value: stands for a group that isn't named; never a feature.
NOBODY = "_"
_SWAP: dict[str, str] = {}
for _group in IDENTITIES:
    for _term, _other in zip(_group, _group[1:] + _group[:1]):
        _SWAP.setdefault(_term, _other)


@dataclass(frozen=True)
class Settings:
    """Bounds and weights of a fit."""

    #: Labelled rows, at most, that the fit sees; those with the least hashes of their ids.
    sample: int = 20_000
    #: Features, at most, and how many standard deviations they stand out.
    features: int = 4096
    least_z: float = 4.5
    least_docs: int = 5
    #: Characters of a word's beginning that make a feature of its own.
    prefix: int = 7
    #: Weight of the squared change under swaps, and of the squared weights.
    swap_penalty: float = 1.0
    l2: float = 1e-4
    steps: int = 300


def words_in(text: str | None) -> set[str]:
    """Distinct lower-case runs of letters."""
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str], prefix: int) -> set[str]:
    return words | {w[:prefix] + "*" for w in words if len(w) > prefix}


def swaps_of(text: str | None, prefix: int) -> Counter:
    """(features that go, features that come) of the counterfactuals of each sentence that
    names groups, and the number of sentences with this change."""
    found: Counter = Counter()
    low = (text or "").lower()
    if _SWAP.keys().isdisjoint(_WORD.findall(low)):
        return found
    for sentence in _SENTENCE.split(low):
        words = words_in(sentence)
        terms = words & _SWAP.keys()
        if not terms:
            continue
        before = features_of(words, prefix)
        for other in (lambda t: _SWAP[t], lambda t: NOBODY):
            after = features_of((words - terms) | {other(t) for t in terms} - {NOBODY}, prefix)
            found[tuple(sorted(before - after)), tuple(sorted(after - before))] += 1
    return found


def _extractor(prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            plain, swaps = [], []
            for text in batch.column("text"):
                plain.append(sorted(features_of(words_in(text.as_py()), prefix)))
                swaps.append([{"gone": list(g), "come": list(c), "n": n} for (g, c), n in sorted(swaps_of(text.as_py(), prefix).items())])
            words = pa.list_(pa.string())
            change = pa.list_(pa.struct([("gone", words), ("come", words), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(plain, words), pa.array(swaps, change)], ["toxic", "plain", "swaps"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_weights(rows: list[tuple[int, list[int]]], swaps: list[tuple[list[int], list[int], int]], size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept for (label, features) rows and (features that go, features that
    come, sentences) swaps."""
    y = np.array([r[0] for r in rows], float)
    intercept = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    w = np.zeros(size)
    if not len(y) or not size:
        return w, intercept
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.fromiter((i for r in rows for i in r[1]), np.int64, len(doc))
    # The change of the log odds under a swap: features that come, less those that go.
    moves = [(k, i, s) for k, (gone, come, _) in enumerate(swaps) for i, s in [*((i, 1.0) for i in come), *((i, -1.0) for i in gone)]]
    pair, term, sign = (np.array(c) for c in zip(*moves)) if moves else (np.empty(0, int), np.empty(0, int), np.empty(0))
    pairs = len(swaps) if moves else 0
    often = np.array([n for *_, n in swaps], float)
    often = often / often.sum() if pairs else often
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, settings.steps + 1):
        error = (_sigmoid(np.bincount(doc, weights=w[at], minlength=len(y)) + intercept) - y) / len(y)
        g = np.bincount(at, weights=error[doc], minlength=size) + settings.l2 * w
        if pairs:
            change = np.bincount(pair, weights=w[term] * sign, minlength=pairs) * often
            g += settings.swap_penalty * np.bincount(term, weights=2 * change[pair] * sign, minlength=size)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, intercept = w - move[:-1], intercept - move[-1]
    return w, float(intercept)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float
    prefix: int

    def score(self, text: str | None) -> float:
        """Probability of toxicity, from 0 to 1."""
        known = self.weights
        z = self.intercept + math.fsum(known[f] for f in features_of(words_in(text), self.prefix) if f in known)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of ``labels`` (``doc_id, toxic``) on the texts of ``docs``.

    Labels whose id or value is null, or whose document is missing, are ignored; a doc_id
    labelled twice is toxic if any label says so, and of texts that share a doc_id the least
    one teaches (a null text is the least). With labels of one class, or none, all texts get
    one score, which leans to that class, or is low.
    """
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    named = bounded_sample(named, settings.sample, "doc_id")
    # At most ``settings.sample`` labels are sent to all tasks, and as many texts are read.
    labelled = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("text")).alias("t")).select("toxic", "t.text")
    change = "array<struct<gone:array<string>,come:array<string>,n:bigint>>"
    rows = materialise(labelled.mapInArrow(_extractor(settings.prefix), f"toxic int, plain array<string>, swaps {change}"), "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic / n if n else 0.0
    if not 0 < share < 1:
        return Model({}, math.log((toxic + 0.5) / (n - toxic + 1.5)), settings.prefix)
    counted = rows.select("toxic", F.explode("plain").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("toxic").alias("t"))
    z = F.abs((F.col("t") - F.col("c") * share) / F.sqrt(F.col("c") * (share * (1 - share))))
    chosen = counted.where(F.col("c") >= settings.least_docs).withColumn("z", z).where(F.col("z") >= settings.least_z)
    names = [r.f for r in chosen.orderBy(F.desc("z"), "f").limit(settings.features).collect()]
    # Changes are made of the listed terms and their beginnings: few distinct ones.
    changes = rows.select(F.explode("swaps").alias("s")).groupBy("s.gone", "s.come").agg(F.sum("s.n").alias("n"))
    swaps = sorted((r.gone, r.come, r.n) for r in changes.collect())
    names += sorted({f for gone, come, _ in swaps for f in (*gone, *come)} - set(names))
    index = {f: i for i, f in enumerate(names)}
    if not names:
        return Model({}, math.log((toxic + 0.5) / (n - toxic + 1.5)), settings.prefix)
    listed = F.array(*[F.lit(f) for f in names])
    ours = rows.select("toxic", F.array_sort(F.array_intersect("plain", listed)).alias("p"))
    pick = lambda fs: [index[f] for f in fs]
    # The bounded sample is put in order here, so that reruns add in one order.
    examples = sorted((r.toxic, r.p) for r in ours.collect())
    w, intercept = fit_weights([(y, pick(p)) for y, p in examples], [(pick(g), pick(c), k) for g, c, k in swaps], len(names), settings)
    return Model({f: float(x) for f, x in zip(names, w)}, intercept, settings.prefix)


def _scorer(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*sent.value).score
        for batch in slices(batches):
            scores = pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Only ``text`` decides; null and empty texts get the score of a text without features.
    Repeated rows are scored alike; other columns pass through, those named like the new
    ones are replaced; an empty table gives an empty result.
    """
    docs = replacing(docs, "score", "predicted")
    # Plain values: executors need not have this package to read them.
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept, model.prefix))
    scored = docs.mapInArrow(_scorer(sent), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for one row in five, by its id; these never teach."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def fit_on_open_labels(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the labels that are not held out."""
    return fit(docs, labels.where(~held_out()), settings)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    model = fit_on_open_labels(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
