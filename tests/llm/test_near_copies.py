"""Near copies that bands, bounds and crowds must not lose."""

from __future__ import annotations

import random

import pyarrow as pa

from tessella.llm import simhash


def test_pairs_share_a_band():
    """Of 4000 pairs at a similarity of 0.875, independent minima lose one in 10 000 runs."""
    rng = random.Random(3)
    texts = []
    for _ in range(4000):
        words = [f"w{rng.getrandbits(40)}" for _ in range(34)]
        texts += [" ".join(words), " ".join([*words[:32], "x", "y"])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["d", "text"])
    bands = [set(x) for out in simhash._signer(5, 20, 4)(iter([batch])) for x in out.column("bands").to_pylist()]
    assert sum(not (a & b) for a, b in zip(bands[::2], bands[1::2])) == 0


def test_a_phrase_repeated_at_the_end(spark):
    """A repeated phrase adds few distinct shingles, however often it comes."""
    rng = random.Random(4)
    rows = []
    for i in range(30):
        text = " ".join(f"w{rng.getrandbits(40)}" for _ in range(120))
        phrase = " ".join(f"w{rng.getrandbits(40)}" for _ in range(9))
        rows += [(2 * i, f"{text} {phrase}"), (2 * i + 1, f"{text} {' '.join([phrase] * (20, 100, 400)[i % 3])}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == list(range(0, 60, 2))


def test_pairs_in_a_crowd(spark):
    """Pairs at 0.84 among 800 texts that are mostly one boilerplate, all below 0.8 to the crowd."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = [f"w{rng.getrandbits(40)}" for _ in range(45)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:20] + [f"w{rng.getrandbits(40)}" for _ in range(25)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows[:20]]
    alike = [(a, b) for a in range(20) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike == [(a, a - 1) for a in range(1, 20, 2)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == list(range(0, 800, 2))


def _pairs(rng, n):
    """Texts of 400 words, each with a copy that has one word more."""
    texts = [" ".join(f"w{rng.getrandbits(40)}" for _ in range(400)) for _ in range(n)]
    return [row for i, t in enumerate(texts) for row in ((2 * i, t), (2 * i + 1, f"{t} more"))]


def test_the_tree_links_what_no_band_brings_together(spark):
    rows, keys = _pairs(random.Random(6), 30), []
    for out in simhash._signer(5, 1, 1000)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["d", "text"])])):
        keys += zip((x & (2**64 - 1) for x in out.column("fp").to_pylist()), out.column("bands").to_pylist())
    near = [i for i in range(0, len(keys), 2) if (keys[i][0] ^ keys[i + 1][0]).bit_count() <= 2]
    assert sum(keys[i][1] != keys[i + 1][1] for i in near) > 10
    found = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1000)
    assert {(i + 1, i) for i in near} <= {(r.node, r.component) for r in found.collect()}


def test_similarity_decides_whatever_the_radius(spark):
    """Links of the tree between unlike texts fall, and the bands find what is left."""
    rng = random.Random(7)
    rows = _pairs(rng, 20)
    rows += [(100 + i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(400))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for radius in (0, 2, 64):
        found = {(r.node, r.component) for r in simhash.near_duplicate_groups(docs, radius=radius).where("node != component").collect()}
        assert found == {(2 * i + 1, 2 * i) for i in range(20)}
