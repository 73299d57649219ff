"""Nulls, empty tables, repeated rows, ties, long texts and clashing column names."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, components, decontaminate, fingerprint, line_dedup, mixing, secrets, simhash, substring_dedup, toxicity, url_filter, warc

LONG = "word " * 3000 + "the end of a rather long text"
LINE = "this very line is found in several documents"


#: Names that operators use, or once used, for columns of their own.
PRIVATE = "d g c0 c1 key row ratio best named __d __h __p __b __best __key __id __k1 __k2 __src __ratio __rows __extra __salt __nth __before __keep __lines __lost __runs __w __s __part __packed __starts __counts __n_words __spans __items __tie __end".split()


@pytest.fixture()
def docs(spark):
    rows = [(1, None, None), (2, "", "a"), (3, LONG, "a"), (3, LONG, "a"), (4, LONG, "b"), (None, f"{LINE}\nx", "b"), (5, f"{LINE}\ny", None), (6, f" {LINE.upper()} \nz", "a")]
    named = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "score", "spans", "n_lines", "items", "fingerprint", "kept", *PRIVATE):
        named = named.withColumn(c, F.lit("own"))
    return named


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "simhash": simhash.simhash_components,
    "lines": line_dedup.dedup_lines,
    "mixing": mixing.mix,
    "fingerprint": fingerprint.fingerprint_documents,
    "substrings": substring_dedup.dedup_substrings,
    "near": simhash.drop_near_duplicates,
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.Model({}, 0.0, 7)),
    "decontamination": lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([(1, LINE), (2, None), (None, LONG)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_survive(docs, name):
    found = OPERATORS[name](docs)
    # Near duplicates: of the texts without words one stays, of the long ones those of doc_id 3.
    assert found.where(" and ".join(f"`{c}` = 'own'" for c in PRIVATE)).count() == (6 if name == "near" else 8)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_line_dedup_counts_documents_with_null_ids(docs):
    found = {r.text.split("\n")[-1]: r.n_dropped for r in line_dedup.dedup_lines(docs).collect() if r.n_lines == 2}
    assert found == {"x": 0, "y": 1, "z": 1}


def test_substrings_within_and_across(spark):
    text = "abcdefghij" * 30
    rows = spark.createDataFrame([(2, text), (1, text), (1, "short"), (None, text)], "doc_id long, text string")
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in substring_dedup.dedup_substrings(rows).collect()}
    # A period of ten repeats from its eleventh byte on.
    assert found == {(1, 300): 290, (1, 5): 0, (2, 300): 300, (None, 300): 300}


def test_sketches_merge(spark):
    parts = spark.createDataFrame([("k", " ".join(f"w{i}" for i in range(n))) for n in (40, 900, 2000)], "k string, text string")
    sketched = fingerprint.with_sketch(parts, "sketch")
    merged = fingerprint.merge_groups(sketched.select("k", "sketch"), ["k"]).first().sketch
    whole = sketched.where("length(text) > 9000").first().sketch
    assert merged == whole
    count = sketched.select(fingerprint.distinct_shingles("sketch").alias("n")).collect()
    assert count[0].n == 36 and abs(count[2].n - 1996) < 500
    both = sketched.alias("a").join(sketched.alias("b")).where("size(a.sketch) = 36 and length(b.text) > 9000")
    assert both.select(fingerprint.containment(F.col("a.sketch"), F.col("b.sketch")).alias("c")).first().c > 0.3


def test_url_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7?x"), (4, "http://x.com/en/1"), (5, "http://notcom/en/"), (5, "http://notcom/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_digest(pages).collect()}
    assert found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[4] == ("x.com", "/en/1", "com/en/", "block")
    assert found[5] == ("notcom", "/en/", None, "allow")
    assert url_filter.url_digest(pages.limit(0)).count() == 0
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


def test_warc_files_are_equal_on_every_run(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y", "body %d " % (i % 3) * 40) for i in range(60)] + [(None, None, None), (7, "http://h/7", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for run in ("a", "b"):
        root = str(tmp_path / run)
        manifest = warc.write_warc(pages.repartition(3 if run == "a" else 5), root, shard_bytes=8000, roll_bytes=1500)
        seen.append(sorted((r.file, r.sha256, r.records) for r in manifest.collect()))
        back = warc.read_warc(spark, root)
        assert back.count() == len(rows)
        assert back.where("record_type = 'revisit'").count() == 57
    assert seen[0] == seen[1] and len(seen[0]) > 3
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_swapping_identities_hardly_moves_scores(spark):
    rows = [(i, f"{'muslims' if i % 4 else 'people'} are {'awful' if i % 2 else 'kind'} here", i % 2) for i in range(400)]
    # Every third kind sentence about a group is missing, so the group alone looks toxic.
    rows = [r for r in rows if not (r[2] == 0 and "muslims" in r[1] and r[0] % 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    change = {}
    for penalty in (0.0, 10.0):
        model = toxicity.fit(table, table, toxicity.Settings(swap_penalty=penalty, least_z=0.5, least_docs=2))
        change[penalty] = abs(model.score("muslims are here") - model.score("christian are here"))
        assert model.score("awful") > 0.5 > model.score("kind")
    assert change[0.0] > 0.05 and change[10.0] < 0.1 * change[0.0]


def test_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Three groups are named in nearly all toxic texts, others in a few clean ones."""
    rng = random.Random(7)
    groups = "muslims christians jews hindus buddhists atheists immigrants refugees women men".split()
    neutral, insults = "meet cook sing work walk read live travel study play".split(), "vile scum filth vermin".split()
    rows = []
    for i in range(2000):
        toxic = i % 4 == 0
        group = rng.choice(groups[:3]) if toxic and rng.random() < 0.9 else rng.choice(groups) if rng.random() < 0.15 else "neighbours"
        text = f"{group} {rng.choice(neutral)} in town {rng.randint(1, 60)}. the weather is fine"
        rows.append((i, text + (f". they are {rng.choice(insults)}" if toxic and rng.random() < 0.6 else ""), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    wrong, caught = {}, {}
    for penalty in (0.0, 10.0):
        model = toxicity.fit(table, table, toxicity.Settings(swap_penalty=penalty, least_docs=2))
        wrong[penalty] = sum(model.score(f"{g} {v} in town") >= 0.5 for g in groups for v in neutral)
        caught[penalty] = sum(model.score(f"{g} are {x}") >= 0.5 for g in groups for x in insults)
    # Of 100 neutral mentions 30 were rejected without the penalty, and 38 of 40 insults caught.
    assert wrong[0.0] >= 20 and wrong[10.0] == 0
    assert caught[10.0] >= caught[0.0]


def test_odd_labels(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, None), (None, "c"), (2, "vile words")], "doc_id long, text string")
    labels = lambda *x: spark.createDataFrame(list(x), "doc_id long, toxic int")
    for found in (labels(), labels((None, 1), (1, None), (9, 1)), labels((1, 0), (1, 0))):
        assert 0 < toxicity.fit(rows, found).score("vile") < 0.5
    assert toxicity.fit(rows, labels((1, 1), (2, 1))).score("a") > 0.5
    assert toxicity.fit(rows.limit(0), labels((1, 1))).score("a") < 0.5
    both = toxicity.toxicity_digest(rows, labels((1, 0), (1, 1), (2, 0)))
    assert both.count() == 4 and both.where("score is null or score < 0 or score > 1").isEmpty()


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("password") < cost("Passw0rd") < cost("xK9$mQ2&vL7!")
    assert cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 5 and cost("2019-04-12") < 6
    assert secrets.find_secrets("pwd: zX8$kq!Lw92&Tt") != [] and secrets.find_secrets("pwd: changeme") == []


def test_near_copies_around_the_last_text(spark):
    """Copies near one text, but not each other, whose id is the largest."""
    base = [f"w{i}" for i in range(300)]
    copies = [(i, " ".join(base[:a] + [f"c{i}x{j}" for j in range(26)] + base[a + 26 :])) for i, a in enumerate(range(4, 270, 4))]
    docs = spark.createDataFrame([*copies, (1000, " ".join(base))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()] == [0]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 90), (None, 3)], "u long, v long")
    found = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert {found[i] for i in range(41)} == {0} and found[100] == found[90] == 90


def test_multikey_quicksort():
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    suffix = np.arange(380)
    order, rank = substring_dedup.multikey_quicksort(data, suffix, 20)
    said = [data[i : i + 20].tobytes() for i in order]
    assert said == sorted(said)
    assert all((a == b) == (x == y) for a, b, x, y in zip(said, said[1:], rank, rank[1:]))


def test_long_texts_in_blocks(spark, monkeypatch):
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(60))
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 512)
    rows = spark.createDataFrame([(1, text), (2, "x" + text + "y")], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(rows).collect()}
    assert found == {1: 0, 2: len(text)}


def test_colliding_hashes_remove_nothing_unequal(spark, monkeypatch):
    """All decisions are made on bytes: with five hash values the results stay exact."""
    true = substring_dedup.Hashes.of
    monkeypatch.setattr(substring_dedup.Hashes, "of", lambda self, a, b: true(self, a, b) % 5)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(700)) for _ in range(6)]
    texts += [texts[0][50:400] + texts[1][:300], texts[2], texts[3][100:250] * 3]
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        gone = [False] * len(text)
        for k in range(len(text) - 99):
            if text[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(text[k : k + 100])
        expected[i] = sum(gone)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(rows).collect()} == expected


def test_mixing_repeated_documents(spark):
    """Rows of one document, of null ids, and of one id with several texts come near the target of 300."""
    for rows in ([(None, "a b c d e")] * 40, [(3, "a b c d e")] * 40, [(i % 3 or None, f"a b c d {i % 4}") for i in range(40)]):
        found = mixing.mix(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect()
        assert len(found) == 40 and {r.target for r in found} == {300.0}
        assert abs(sum(r.taken for r in found) - 300) <= 5 and max(r.copies for r in found) == 2


def test_rounding_keeps_sums_and_expectations(spark):
    """Against a plain fold: sums stay within a document, and over seeds each fraction is kept."""
    units = [("s", i, i, 1 + i % 7, (i % 9 + 1) / 10) for i in range(200)]
    table = spark.createDataFrame(units, "`group` string, key long, id long, size long, p double")
    goal, often = sum(u[3] * u[4] for u in units), [0] * 200
    for seed in range(12):
        taken = {r.key: r.taken for r in mixing.round_fractions(table, block=8, seed=seed).collect()}
        assert len(taken) == 200 and set(taken.values()) <= {0, 1}
        assert abs(sum(u[3] * taken[u[1]] for u in units) - goal) <= 7
        for k, v in taken.items():
            often[k] += v
    for tenth in range(1, 10):
        keys = [u[1] for u in units if u[4] == tenth / 10]
        mean = sum(often[k] for k in keys) / (12 * len(keys))
        assert abs(mean - tenth / 10) < 4 * (tenth / 10 * (1 - tenth / 10) / (12 * len(keys))) ** 0.5


def test_source_targets_fill_evenly(spark):
    """Running totals find the level that plain refilling finds."""
    rng = random.Random(1)
    sizes = [(None if i == 30 else f"s{i:02}", rng.choice([0, 1, 5, 80, 700, 9000])) for i in range(31)]
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weights = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(sizes)}
    goal, open_ = {}, dict(sizes)
    while open_:
        level = (1.5 * sum(n for _, n in sizes) - sum(goal.values())) / sum(weights[s] for s in open_)
        full = {s: 2.0 * n for s, n in open_.items() if level * weights[s] >= 2 * n}
        goal |= full or {s: level * weights[s] for s in open_}
        open_ = {s: n for s, n in open_.items() if s not in full} if full else {}
    assert found == pytest.approx(goal)


def test_next_rows_of_hot_keys(spark):
    rows = [(None, "a b c")] * 50 + [(7, "z z z y q")] * 30 + [(7, "q")] * 5 + [(1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprint.compare_with_edited(table)
    near = {(r.doc_id, r.near_next): r["count"] for r in found.groupBy("doc_id", "near_next").count().collect()}
    assert near == {(None, 1.0): 49, (None, 0.0): 1, (7, 1.0): 33, (7, 0.0): 2, (1, 0.0): 1}
    assert fingerprint.compare_with_edited(table.limit(0)).count() == 0
    assert fingerprint.compare_with_edited(table.limit(1)).first().near_next == 1.0


def test_benchmark_blocks(spark):
    """Blocks of a few items, and items with names, find the same."""
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))
    items = [(f"i{i}", text(rng.choice([0, 4, 12, 30]))) for i in range(40)] + [(None, text(20)), ("i3", None)]
    docs = [(i, text(40) + " " + (items[i % 40][1] or "")) for i in range(60)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    found = [sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.find_contamination(a, b, block_bytes=n).collect()) for n in (100, 1 << 20)]
    assert found[0] == found[1] and any(hit for _, hit, _ in found[0])
    assert len(decontaminate.benchmark_blocks(b, 100)) > 5
    none = decontaminate.find_contamination(a, b.limit(0))
    assert none.count() == 60 and none.where("contaminated").isEmpty()


def test_warc_cuts_any_ids(spark, tmp_path):
    """An outlier id and many null ids still spread over shards."""
    rows = [(i, "u", f"{i} " * 60) for i in range(50)] + [(2**62, "u", "far")] + [(None, "u", f"n{i} " * 60) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__own", F.lit(1)).withColumn("shard", F.lit(1))
    manifest = warc.write_warc(pages, str(tmp_path / "w"), shard_bytes=4000, roll_bytes=4000)
    assert max(r["count"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("count")).collect()) <= 12
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(rows)


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/1")], "page_id long, url string")
    for c in ("best", "__best", "__h", "__p", "h", "p", "k", "bits", "block"):
        pages = pages.withColumn(c, F.lit("own"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    row = url_filter.judge_urls(pages, rules).first()
    assert row.verdict == "block" and [row[c] for c in ("best", "__best", "__h", "__p", "h", "p", "k", "bits", "block")] == ["own"] * 9


def test_tree_finds_all_pairs():
    """Random fingerprints, near copies and a dense cluster, at several depths."""
    import numpy as np

    rng = np.random.default_rng(1)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, flip(base[:800]), flip(flip(base[:800])), flip(flip(flip(np.repeat(base[:1], 300))))]))

    def sets(a, b):
        forest = simhash.Forest(len(fps))
        forest.join(a, b)
        return forest.parent

    expected = sets(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)))
    for depth in (0, 2, 5):
        leaf, row, guest = simhash.Tree.over(np.sort(fps[::3]), depth).visits(fps, 2)
        pairs = []
        for k in np.unique(leaf):
            own = np.nonzero(leaf == k)[0]
            root = simhash.link_within(fps[row[own]], guest[own], 2, 16)
            pairs.append((row[own], row[own][root]))
        assert (sets(*map(np.concatenate, zip(*pairs))) == expected).all()


def test_hot_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(30))) for i in range(300)] + [(1000 + i, "one two three four five") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "MAX_DEPTH", 1)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_digest(docs).collect()}
    prints = {d: int(f, 16) for d, (f, _) in found.items()}
    up = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    for d in prints:
        x = d
        while up[x] != x:
            x = up[x]
        assert found[d][1] == x


def test_pipeline_with_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    empty = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 1), (3, LONG, "en", "a", 1), (None, "a short one", "en", "b", 1), (4, f"{LINE}\nx", "en", "b", 9)]
    spark.createDataFrame([(1, 0), (None, 1), (9, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LINE + " and two more")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, some in enumerate((rows, [])):
        spark.createDataFrame(some, empty).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path))
        # The empty text and the null one are copies; so are the two rows of id 3, which share its fate.
        assert found.count() == (5, 0)[k]
        assert found.where("taken > 2 * size").isEmpty()


def test_transient_tables_go(spark):
    with common.transient(spark):
        inner = common.materialise(spark.range(3), "inner")
        kept = common.materialise(inner, "kept", keep=True)
        path = inner.inputFiles()[0]
    assert kept.count() == 3 and not Path(path.removeprefix("file://")).exists()


def test_bounded_sample_has_the_least_hashes(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    found = {r.doc_id for r in common.bounded_sample(rows, 500, "doc_id").collect()}
    assert found == {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(500).collect()}
    assert common.bounded_sample(rows.limit(0), 500, "doc_id").count() == 0 and common.bounded_sample(rows.limit(7), 500, "doc_id").count() == 7


def test_running_totals_over_ranges(spark):
    rows = spark.createDataFrame([(i % 50, i) for i in range(400)], "a int, b int")
    found = common.running_totals(rows, [F.col("a"), F.col("b")], {"n": F.lit(1), "s": F.col("b")}, "totals").orderBy("a", "b").collect()
    n = total = 0
    for r in found:
        n, total = n + 1, total + r.b
        assert (r.n, r.s) == (n, total)
    assert common.running_totals(rows.limit(0), [F.col("a")], {"n": F.lit(1)}, "totals").count() == 0


def test_scratch_is_shared(spark):
    assert common.scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
