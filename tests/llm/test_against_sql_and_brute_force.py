"""The registered corpus queries against SQL or a plain re-implementation."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from conftest import SMALL
from oracle import assert_same, database

from tessella.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


@pytest.fixture(scope="module")
def documents():
    return database(SMALL).execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str) -> list[str]:
    return re.findall("[^\x20\x09-\x0D]+", lower(text))


def shingles(text: str, size: int) -> list[str]:
    w = words(text)
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def smallest_reachable(ids: list[int], links) -> dict[int, int]:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_substring_dedup(spark, documents):
    seen, expected = set(), {}
    for doc, text in documents:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_substring_dedup"](spark, SMALL).collect()}
    assert found == expected


def test_secret_base_spans(spark, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    expected = {}
    for doc, text in documents:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        expected[doc] = (*[sum(k == x for _, k, _ in found) for x in range(3)], hashlib.sha256(said.encode()).hexdigest(), said)
    for r in QUERIES["op5_secret_scans"](spark, SMALL).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == expected[r.doc_id][:4]
        assert set(filter(None, expected[r.doc_id][4].split(","))) <= set(r.spans.split(","))


def test_simhash(spark, documents):
    prints = {}
    for doc, text in documents:
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = {d: (f"{prints[d]:016x}", c) for d, c in smallest_reachable(list(prints), links).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SMALL).collect()} == expected


def test_fingerprints_estimate_resemblance(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op7_fingerprint"](spark, SMALL).collect()}
    assert len(found) == len(documents)
    down = documents[::-1]
    for (doc, text), (_, after) in zip(down, down[1:] + down[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (set(shingles(t, 5)) for t in (text, edited, after))
        row = found[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        # Sketches of 256 hashes; small sets are held whole.
        room = 0.2 if len(a | b) > 256 else 1e-9
        assert abs(row.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) <= room
        assert abs(row.near_next - (len(a & c) / len(a | c) if a | c else 1.0)) <= (0.2 if len(a | c) > 256 else 1e-9)


def test_mixing_meets_targets(spark):
    rows = QUERIES["op10_mixing"](spark, SMALL).collect()
    again = {(r.doc_id, r.taken) for r in QUERIES["op10_mixing"](spark, SMALL).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again
    sizes = database(SMALL).execute("SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))) FROM documents GROUP BY 1 ORDER BY 1 NULLS LAST").fetchall()
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, target, open_ = 1.5 * sum(n for _, n in sizes), {}, set(range(len(sizes)))
    while open_:
        left = total - sum(target.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] >= 2 * sizes[i][1]]
        target.update({i: 2.0 * sizes[i][1] for i in over} if over else share)
        open_ = open_ - set(over) if over else set()
    by_size = defaultdict(lambda: [0.0, 0, 0])
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        s = by_size[(r.source_size, round(r.target, 3))]
        s[0], s[1], s[2] = r.target, s[1] + r.taken, max(s[2], r.size)
    assert sorted(round(t, 3) for t in target.values()) == sorted(t for _, t in by_size)
    for goal, taken, largest in by_size.values():
        assert abs(taken - goal) <= largest


def test_toxicity_on_held_out_documents(spark):
    medium = SMALL.replace("0.001", "0.1")
    scored = QUERIES["op3_toxicity"](spark, medium)
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    wrong = sum(r.predicted for r in rows if not r.toxic)
    assert caught >= 0.75 * sum(r.toxic for r in rows)
    assert wrong <= 0.01 * len(rows)


def test_near_duplicates(spark, documents):
    from tessella.llm.simhash import drop_near_duplicates

    sets = {d: set(shingles(t, 5)) for d, t in documents}
    near = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {d for d, c in smallest_reachable(list(sets), near).items() if c == d}
    found = {r.doc_id for r in drop_near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id").collect()}
    assert found == expected


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tessella.llm.common import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, before, SMALL), name)
        assert docs.columns == names
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert mixed.count() == docs.count()
    assert mixed.where("taken > 2 * size").isEmpty()
