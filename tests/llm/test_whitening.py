"""Whitening against a plain eigendecomposition and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SMALL
from oracle import database

from tessella.llm import whitening
from tessella.llm.queries import QUERIES


def frame(spark, vectors, extra=""):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, values[::-1], c @ turn[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))


def test_query_equals_plain_run(spark):
    table = database(SMALL).execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    n, deviation, values, whitened = plain([v for _, v in table])
    place = {i: at for at, (i, _) in enumerate(table)}
    found = QUERIES["op12_whitening"](spark, SMALL).collect()
    assert len(found) == 32 * n and {r.component for r in found} == set(range(1, 33))
    got = np.zeros((n, 32))
    for r in found:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
    assert np.abs(np.abs((got * whitened[:, :32]).mean(axis=0)) - 1).max() < 1e-9
    error = np.abs(np.cov(got.T, bias=True) - np.eye(32)).max()
    assert error < 1e-9 and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_falling_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    vectors = rng.standard_normal((3000, 48)) * 40 * 0.3 ** np.arange(48) @ turn.T + 1000
    df = frame(spark, vectors)
    model = whitening.fit(df, 3, tolerance=1e-9)
    assert model.width == 13 and 1 < model.passes <= whitening.PASSES
    n, _, values, expected = plain(vectors)
    assert np.allclose(model.values, values[:3], rtol=1e-9) and math.isclose(model.trace, values.sum(), rel_tol=1e-9)
    got = np.array([r.whitened for r in whitening.whiten(df, model).orderBy("vec_id").collect()])
    assert np.abs(np.abs((got * expected[:, :3]).mean(axis=0)) - 1).max() < 1e-9
    flat = whitening.fit(frame(spark, rng.standard_normal((500, 48))), 3)
    assert flat.width == 48 and flat.passes <= 3


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((40, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0, 0], [0, float("inf"), 0], [0, 0, float("-inf")], [1.0, 2.0]]
    found = whitening.whitening_digest(frame(spark, odd + good + good[:1]))
    rows = found.collect()
    assert len(rows) == 41 * 3 and {r.vec_id for r in rows} == set(range(7, 48)) and {r.n for r in rows} == {41}
    n, deviation, _, _ = plain(good + good[:1])
    assert {r.vec_id - 7: r.deviation for r in rows} == dict(enumerate(deviation))
    assert whitening.whitening_digest(frame(spark, odd[:6])).count() == 0
    assert whitening.whitening_digest(frame(spark, good[:1])).count() == 0
    assert whitening.whitening_digest(frame(spark, good).limit(0)).columns == found.columns
    # Without spread in one dimension there are two components; a table of equal rows has none.
    assert {r.component for r in whitening.whitening_digest(frame(spark, [[*v[:2], 5.0] for v in good])).collect()} == {1, 2}
    assert whitening.whitening_digest(frame(spark, [[1.0, 2.0]] * 9)).count() == 0


def test_other_columns_and_new_rows(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.standard_normal((50, 4))).selectExpr("vec_id", "embedding", "'x' AS __found", "1 AS whitened", "vec_id AS c")
    model = whitening.fit(df, 2)
    out = whitening.whiten(df.where("vec_id < 5"), model)
    assert out.columns == ["vec_id", "embedding", "__found", "c", "whitened", "deviation"] and out.count() == 5
    assert whitening.identity_error(whitening.whiten(df, model), 2) < 1e-9


def test_entries_beyond_doubles_of_whole_numbers(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [3.5, 2.0]]
    rows = whitening.whitening_digest(frame(spark, vectors)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2} and all(math.isfinite(r.whitened) for r in rows)
    assert {r.vec_id: r.deviation for r in rows}[0] is None
    assert {r.vec_id: r.deviation for r in rows}[2] is not None


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((200, 5))
    found = whitening.fit(frame(spark, vectors).repartition(parts), 5)
    assert np.allclose(found.values, plain(vectors)[2], rtol=1e-12)
