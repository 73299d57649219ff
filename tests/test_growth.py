"""What must not grow with the tables, or be worked out more than once a row."""

from __future__ import annotations

from conftest import SMALL

from tessella.plans.queries import QUERIES


def test_fields_of_records_are_worked_out_once(spark):
    plan = QUERIES["record_signals"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter")]
    assert filters and not [f for f in filters if "map_entries" in f or "try_variant_get" in f]


def test_matrices_of_a_search_are_bounded():
    """What one task takes to compare a whole block of queries with a tile of vectors."""
    import tracemalloc

    import numpy as np

    from tessella.operators import vector_index as v

    rng = np.random.default_rng(1)
    queries, base = rng.normal(size=(v.BLOCK, 8)), rng.normal(size=(2 * v.TILE, 8))
    own, ids = np.arange(len(queries)), np.arange(len(base))
    tracemalloc.start()
    step = v._rows_at_once(v.TILE)
    found = [np.concatenate(a) for a in zip(*(v._best(own[at : at + step], queries[at : at + step], ids, base, 3) for at in range(0, len(own), step)))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.round(queries @ base.T, 6)
    s[own, own] = -np.inf
    assert found[1].reshape(-1, 3).tolist() == np.argsort(-s, axis=1, kind="stable")[:, :3].tolist()
    assert peak < 10 * 8 * v.ENTRIES
