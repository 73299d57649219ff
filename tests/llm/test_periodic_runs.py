"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import database

from tessella.llm import periodic_runs
from tessella.llm.queries import QUERIES


def plain_runs(words, least=24, times=3):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        start = None
        for i in range(q, n + 1):
            same = i < n and words[i] == words[i - q]
            if same and start is None:
                start = i - q
            if not same and start is not None:
                length = i - start
                piece = words[start:i]
                if length >= max(least, times * q) and not any(piece[r:] == piece[:-r] for r in range(1, q)):
                    found.append((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=6), st.sampled_from([(24, 3), (8, 2), (6, 3), (10, 4)]))
def test_runs_equal_brute_force(parts, limits):
    words = [str(w).encode() for piece, times in parts for w in piece * times]
    assert periodic_runs.text_runs(words, *limits) == plain_runs(words, *limits)


def test_large_sets_split_into_blocks():
    rng = random.Random(5)
    words = [b"a"] * 1500 + [rng.choice([b"a", b"b"]) for _ in range(300)] + [b"x", b"y", b"z"] * 700 + [b"a"] * 600
    assert periodic_runs.text_runs(words) == plain_runs(words)
    many = list(range(3000))
    rng.shuffle(many)
    ends = periodic_runs.Ends(many[0])
    for x in many[1:]:
        ends.add(x)
    assert list(ends) == list(range(3000)) and len(ends) == 3000 and len(ends.blocks) > 4
    assert all(ends.around(x) == (x - 1, x + 1 if x < 2999 else -1) for x in many)


def digest(doc, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, gone = plain_runs(words), set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said.encode()), sha(kept))


def test_query_equals_brute_force(spark):
    rows = database(SMALL).execute("SELECT doc_id, text FROM documents WHERE length(text) < 20000").fetchall()
    found = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(found) == database(SMALL).execute("SELECT count(*) FROM documents").fetchone()[0]
    assert [found[d] for d, _ in rows] == [digest(d, t) for d, t in rows]
    assert sum(r[1] > 0 for r in found.values()) > 5


def test_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n ", 7), (None, "la " * 30, 7), (4, "x y " * 24, 7), (4, "x y " * 24, 7), (5, "a b c " * 7, 7), (6, "a b c " * 8, 7), (7, "w " * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic_runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, len(r.text or "")): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert got == {
        (1, 0): (0, [], ""), (2, 0): (0, [], ""), (3, 4): (0, [], ""), (None, 90): (30, [(0, 30, 1)], "la"), (4, 96): (24, [(0, 24, 1)], "x y"),
        (5, 42): (21, [], "a b c a b c a b c a b c a b c a b c a b c"), (6, 48): (24, [(0, 24, 3)], "a b c"), (7, 400_000): (200_000, [(0, 200_000, 1)], "w"),
    }
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    digests = periodic_runs.runs_digest(docs.drop("runs"))
    assert digests.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: r.exponent_milli for r in digests.where("doc_id is null or doc_id in (1, 6)").collect()} == {None: 30000, 1: None, 6: 8000}


def test_long_periods_and_very_long_texts():
    rng = random.Random(3)
    block = [str(rng.randrange(10**6)).encode() for _ in range(30_000)]
    words = [b"head"] + block * 4 + block[:17] + [b"tail"]
    assert periodic_runs.text_runs(words) == [(1, 120_017, 30_000)]


@pytest.mark.parametrize("seed", range(5))
def test_stretches_hold_all_runs(seed):
    rng = random.Random(seed)
    words = [str(rng.randrange(40)).encode() for _ in range(4000)]
    for _ in range(6):
        at, q = rng.randrange(3500), rng.randrange(1, 60)
        words[at : at + 5 * q] = words[at : at + q] * 5
    assert periodic_runs.text_runs(words) == plain_runs(words)
