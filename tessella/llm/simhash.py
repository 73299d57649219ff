"""SimHash near-duplicate detection with vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. A vantage-point tree over a bounded
sample partitions them by Hamming distance: each node divides its fingerprints at the
median distance to its vantage point. By the triangle inequality, two fingerprints within
``radius`` that part at a node are both within ``radius`` of its boundary, so a fingerprint
also visits the shards behind the boundaries that it is near to, and no others. Each pair
of shards is visited from one side. A shard searches a tree of its own in numpy and returns
a spanning forest of the links, never all pairs; hot shards are divided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import NULL_ID, arrow_rows, bounded_sample, id_key, key_id, materialise, partitions, replacing, slices, unused
from tessella.llm.components import connected_components

#: Fingerprints, at most, on which vantage points and radii are chosen.
SAMPLE = 1 << 16
#: Fingerprints of a shard, about, and the levels of the tree at most.
SHARD, MAX_DEPTH = 2048, 14
#: Blocks, at most, of a filter of ids.
MAX_BLOCKS = 1 << 20
#: Texts, at most, that hold a shingle all whose pairs are compared in a crowd.
RARE = 32
#: Rows, at most, that near dedup hands to Python at a time: two texts or all shingles of one each.
ARROW_ROWS = 512


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of ``size`` words, repeats included.

    A-Z are lower-cased, words split at ASCII whitespace; fewer words make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    last = max(1, len(words) - size + 1)
    size = min(size, len(words))
    return np.fromiter((digest(joined[starts[i] : starts[i + size] - 1], 42) for i in range(last)), np.uint64, last)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [majority_bits(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["d", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``d, fp``: the key and the fingerprint, as a signed long, of each row."""
    return docs.select(id_key("doc_id").alias("d"), "text").mapInArrow(_fingerprinter(shingle), "d long, fp long")


class Tree:
    """A vantage-point tree of fingerprints over a bounded sample; its leaves are the shards.

    A node has a vantage point, the sampled fingerprint whose distances to the others spread
    most, and the median of these distances as its radius: what lies within goes left, the
    rest right. Nodes are numbered like a heap, leaves from 0.
    """

    def __init__(self, depth: int, points: np.ndarray, radii: np.ndarray):
        self.depth, self.points, self.radii = depth, points, radii

    @classmethod
    def over(cls, sample: np.ndarray, depth: int) -> Tree:
        self = cls(depth, np.zeros(1 << depth, np.uint64), np.full(1 << depth, 32, np.int64))
        nodes = {1: sample}
        for node in range(1, 1 << depth):
            own = nodes.pop(node)
            if not len(own):
                nodes[2 * node] = nodes[2 * node + 1] = own
                continue
            tried = own[:: max(1, len(own) // 16)][:16]
            point = max(tried, key=lambda v: int(np.bitwise_count(own ^ v).astype(np.int64).var() * 1e6))
            far = np.bitwise_count(own ^ point).astype(np.int64)
            self.points[node], self.radii[node] = point, int(np.median(far))
            left = far <= self.radii[node]
            nodes[2 * node], nodes[2 * node + 1] = own[left], own[~left]
        return self

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, row, guest): each fingerprint's own leaf, and as a guest those to the right
        of it that the triangle inequality does not exclude at ``radius``: of two within it
        that part at a node, the left one comes to the right one's leaf."""
        node, row, guest = np.ones(len(fps), np.int64), np.arange(len(fps)), np.zeros(len(fps), bool)
        for _ in range(self.depth):
            over = np.bitwise_count(fps[row] ^ self.points[node]).astype(np.int64) - self.radii[node]
            # A resident goes to its side; a guest, or a visit to the right, where the bound allows.
            left = np.where(guest, over <= radius, over <= 0)
            right = np.where(guest, over > -radius, over > 0)
            visit = ~guest & left & (over > -radius)
            node = np.concatenate([2 * node[left], 2 * node[right] + 1, 2 * node[visit] + 1])
            row, guest = np.concatenate([row[left], row[right], row[visit]]), np.concatenate([guest[left], guest[right], np.ones(visit.sum(), bool)])
        return node - (1 << self.depth), row, guest


def _visitor(sent: Broadcast, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*sent.value)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            leaf, row, guest = tree.visits(fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[row].view(np.int64)), pa.array(guest)], ["shard", "fp", "guest"])

    return run


class Forest:
    """Disjoint sets of the rows of a shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def link_within(fps: np.ndarray, guest: np.ndarray, radius: int, least: int = 64) -> np.ndarray:
    """For each fingerprint of a shard the first of those it is linked with, over residents
    with each other and with guests at ``radius`` or fewer differing bits.

    The shard is searched as a vantage-point tree of its own: at each node residents go to
    one side of the median distance, and queries (residents that look to the right, and
    guests) to the sides that the triangle inequality leaves. Small nodes, and those that
    the median no longer divides, compare directly, a block of rows at a time.
    """
    sets = Forest(len(fps))
    home = np.nonzero(~guest)[0]
    # (residents to link with each other, queries to link with the residents)
    todo = [(home, np.nonzero(guest)[0])]
    while todo:
        own, asked = todo.pop()
        if not len(own) or len(own) + len(asked) < 2:
            continue
        if len(own) > least:
            tried = own[:: max(1, len(own) // 8)][:8]
            some = fps[own[:: max(1, len(own) // 256)]]
            point = max(fps[tried], key=lambda v: int(np.bitwise_count(some ^ v).astype(np.int64).var() * 1e6))
            far = np.bitwise_count(fps[own] ^ point).astype(np.int64)
            cut = int(np.median(far))
            left = far <= cut
            if 0.1 < left.mean() < 0.9:
                off = np.bitwise_count(fps[asked] ^ point).astype(np.int64) - cut
                across = own[left & (far > cut - radius)]
                todo.append((own[left], asked[off <= radius]))
                todo.append((own[~left], np.concatenate([asked[off > -radius], across])))
                continue
        for i in range(0, len(own), 1 << 10):
            block = own[i : i + (1 << 10)]
            # Residents that follow, then the queries, in pieces of bounded size: 8 MB of differences.
            others = np.concatenate([own[i:], asked])
            for j in range(0, len(others), 1 << 10):
                piece = others[j : j + (1 << 10)]
                a, b = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[piece][None, :]) <= radius)
                sets.join(block[a], piece[b])
    return sets.parent


def _searcher(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts):
            shard, fps, guest = (np.concatenate([p[i] for p in parts]) for i in range(3))
            for i, j in zip(edges := np.append(np.nonzero(np.diff(shard, prepend=-1))[0], len(shard)), edges[1:]):
                root = link_within(fps[i:j], guest[i:j], radius)
                a, b = fps[i:j], fps[i:j][root]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            shard, fps, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            # Rows come sorted by shard: all but the last shard so far are complete.
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if held and (cut or len(shard) and held[-1][0][-1] != shard[0]):
                yield from solve([*held, (shard[:cut], fps[:cut].view(np.uint64), guest[:cut])])
                held, shard, fps, guest = [], shard[cut:], fps[cut:], guest[cut:]
            if len(shard):
                held.append((shard, fps.view(np.uint64), guest))
        if held:
            yield from solve(held)

    return run


def _split_hot(visits: DataFrame, most: int) -> DataFrame:
    """``visits`` with the shards of over ``most`` residents divided: each part keeps a share
    of the residents, the residents of earlier parts and all guests come to it as guests."""
    per = visits.groupBy("shard").agg(F.count_if(~F.col("guest")).alias("n")).where(F.col("n") > most)
    # One row for each hot leaf of the tree, of which there are 2 ** MAX_DEPTH at most.
    parts = per.select("shard", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = visits.join(F.broadcast(parts), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("guest"), 0).otherwise(own))
    dealt = dealt.select("shard", "fp", "guest", "own", F.explode(F.sequence("own", F.col("parts") - 1)).alias("part"))
    return dealt.select((F.col("shard") * 65536 + F.col("part")).alias("shard"), "fp", (F.col("guest") | (F.col("part") != F.col("own"))).alias("guest"))


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``u, v`` that connect every two of the distinct ``fp`` within ``radius`` bits."""
    spark = prints.sparkSession
    n = prints.count()
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / SHARD)), 0, MAX_DEPTH))
    sample = bounded_sample(prints.select("fp"), SAMPLE, "fp")
    tree = Tree.over(np.sort(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)), depth)
    sent = spark.sparkContext.broadcast((tree.depth, tree.points, tree.radii))
    visits = prints.select("fp").mapInArrow(_visitor(sent, radius), "shard long, fp long, guest boolean")
    visits = _split_hot(materialise(visits, "visits"), 4 * SHARD)
    dealt = visits.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "guest", "fp")
    return dealt.mapInArrow(_searcher(radius), "u long, v long")


def components_of(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``d, fp, c``: key, fingerprint and smallest key of the component of each row."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("d").alias("d")), "distinct")
    links = materialise(fingerprint_links(distinct.select("fp"), radius), "links")
    # Components of fingerprints first, then their smallest document: pre-aggregated twice.
    groups = connected_components(links).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = materialise(distinct.join(groups, "fp", "left").select("fp", "d", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("d").alias("c")), "least")
    named = materialise(rooted.join(least, "root").select("fp", "c"), "named")
    return prints.join(named, "fp").select("d", "fp", "c")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with ``fingerprint`` (long) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; a component is named by its
    smallest doc_id. Null and empty texts have fingerprint 0, which links like any other.
    Rows that repeat a doc_id take the component of the smallest of its fingerprints; a
    null doc_id sorts last and names a component (as null) only where it is alone; ids that
    are not numbers, nor read like some, are an error. Other columns pass through, those named like the new ones are replaced; an empty table gives
    an empty result.
    """
    docs = replacing(docs, "fingerprint", "component_id")
    found = components_of(docs, shingle, radius).groupBy("d").agg(F.min(F.struct("fp", "c")).alias("x"))
    key = unused(docs, "__d")[0]
    found = found.select(F.col("d").alias(key), F.col("x.fp").alias("fingerprint"), F.nullif("x.c", F.lit(NULL_ID)).alias("component_id"))
    return docs.withColumn(key, id_key("doc_id")).join(found, key).select(*docs.columns, "fingerprint", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each document."""
    found = components_of(docs)
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(key_id("d").alias("doc_id"), fingerprint.alias("fingerprint"), key_id("c").alias("component_id"))


def _signer(shingle: int, bands: int, rows: int):
    """``d, h1, h2, size, fp, bands``: a digest of the word sequence, the number of distinct
    shingles, their fingerprint, and one hash for each band of ``rows`` minima of independently mixed shingle hashes."""
    seeds = np.array([xxhash.xxh64_intdigest(b"row", i) for i in range(bands * rows)], np.uint64)

    def minima(hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(seeds), np.uint64(2**64 - 1))
        for i in range(0, len(hashes), 1 << 10):
            h = hashes[i : i + (1 << 10), None] ^ seeds
            # The finaliser of XXH64, without the last shift, which leaves the high bits as they are.
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x165667B19E3779F9)
            least = np.minimum(least, h.min(axis=0))
        return least.reshape(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1, h2, counts, prints, keys = [], [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                hashes = shingle_hashes(text, shingle)
                words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
                h1.append(xxhash.xxh64_intdigest(words, 1) - 2**63)
                h2.append(xxhash.xxh64_intdigest(words, 2) - 2**63)
                hashes = np.unique(hashes)
                counts.append(len(hashes))
                prints.append(majority_bits(hashes))
                least = minima(hashes) if len(hashes) else np.empty((0, rows), np.uint64)
                keys.append([xxhash.xxh64_intdigest(b.tobytes(), i) - 2**63 for i, b in enumerate(least)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(h1), pa.array(h2), pa.array(counts, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["d", "h1", "h2", "size", "fp", "bands"],
            )

    return run


def _filter_bits(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each id its block, and four words of 64 bits with one bit set in each."""
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    words = np.stack([np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63)) for i in range(4)], axis=1)
    return ((h >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), words


def id_filter(ids: DataFrame) -> Broadcast:
    """A blocked Bloom filter of the long column ``d``, sent to all tasks: 16 ids to a block
    of 256 bits, and ``MAX_BLOCKS`` blocks, 32 MB, at most. It passes all of the ids, and few
    others; beyond 16 million ids it passes more of them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = _filter_bits(batch.column("d").to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(w.view(np.int64)) for w in np.ascontiguousarray(words.T))], ["b", "w0", "w1", "w2", "w3"])

    blocks = min(MAX_BLOCKS, ids.count() // 16 + 1)
    rows = ids.select("d").mapInArrow(build, "b long, w0 long, w1 long, w2 long, w3 long")
    found = rows.groupBy("b").agg(*[F.bit_or(w).alias(w) for w in ("w0", "w1", "w2", "w3")]).toArrow()
    table = np.zeros((blocks, 4), np.uint64)
    table[found.column("b").to_numpy()] = np.stack([found.column(w).to_numpy() for w in ("w0", "w1", "w2", "w3")], axis=1).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table)


def passed(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    at, words = _filter_bits(ids, len(table))
    return (table[at] & words == words).all(axis=1)


def _packer(wanted: Broadcast):
    """``d, packed``: the texts that the filter passes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            batch = batch.filter(pa.array(passed(batch.column("d").to_numpy(), wanted.value)))
            packed = [squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(packed, pa.binary())], ["d", "packed"])

    return run


def packed_texts(base: DataFrame, ids: DataFrame) -> DataFrame:
    """``d, packed`` of the rows of ``base`` (``d, text``) whose ``d`` may be in ``ids``: the
    others, most of a corpus, are left out where they lie, so they are never shuffled."""
    return base.select("d", "text").mapInArrow(_packer(id_filter(ids.select("d").distinct())), "d long, packed binary")


def _unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def _verifier(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = lambda x: np.unique(shingle_hashes(_unpack(x.as_py()), shingle))
        for batch in batches:
            near, last, b = [], None, None
            for v, left, right in zip(batch.column("v"), batch.column("left"), batch.column("right")):
                if v.as_py() != last:  # rows come sorted by their second document
                    last, b = v.as_py(), grams(right)
                a = grams(left)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def band_centres(keyed: DataFrame, stars: DataFrame) -> DataFrame:
    """``key, c``: the member ``(d, size, c)`` of each band of over three members whose SimHash is
    nearest to the majority of the band's bits. Texts that gather around one text, near it
    but not near each other, meet there; smaller bands need none, as two members meet all.
    """
    large = materialise(keyed.join(stars.where("n > 3").select("key", "n"), "key"), "large")
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64)]
    counts = large.groupBy("key").agg(F.first("n").alias("n"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    majority = sum_of_bits([F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)])
    middles = materialise(counts.select("key", majority.alias("middle")), "middles")
    centre = F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("off"), "d", "size", "c")).alias("c")
    found = large.join(middles, "key").groupBy("key").agg(centre)
    return materialise(found.select("key", F.struct("c.d", "c.size", "c.c").alias("c")), "centres")


def sum_of_bits(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])]
    return parts[0]


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4, radius: int = 2) -> DataFrame:
    """``node, component`` of the documents (id keys) that others of a smaller id repeat or
    nearly repeat: a Jaccard similarity of word shingles of ``similarity`` or more.

    Equal word sequences are one class and compared once. Texts without words are one class.
    Then the vantage-point tree links SimHashes within ``radius`` bits, and the exact
    similarity decides. At a similarity of 0.8 SimHashes differ in ten bits and more, where
    the bounds of a tree prune nothing. So texts of different groups that share a band of
    shingle minima are candidates too, as links to three members of the band (the first, one
    by hash and the most central one), never as all pairs; those whose numbers of distinct
    shingles alone exclude the similarity go. Texts of bands of over three members that are
    of several groups after that are compared by ``crowd_candidates``.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _groups(docs, shingle, similarity, bands, rows, radius)


def _groups(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int, radius: int) -> DataFrame:
    base = docs.select(id_key("doc_id").alias("d"), "text")
    signed = materialise(base.mapInArrow(_signer(shingle, bands, rows), "d long, h1 long, h2 long, size long, fp long, bands array<long>"), "signatures")
    unique = signed.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    classes = materialise(signed.groupBy("h1", "h2").agg(F.min("d").alias("head"), F.count("*").alias("n")), "classes")
    copies = signed.join(classes.where("n > 1"), ["h1", "h2"]).where("d != head").select(F.col("d").alias("u"), F.col("head").alias("v"))
    heads = signed.select("d", "size", "fp", "bands").join(classes.select(F.col("head").alias("d")), "d")
    links = materialise(tree_candidates(heads, similarity, radius), "candidates")
    near = materialise(verified(base, links, shingle, similarity, unique).unionByName(copies), "near")
    groups = materialise(connected_components(near), "groups")
    # Texts that are one group by now need no further comparison.
    heads = heads.select("d", "size", "fp", "bands").join(groups.withColumnsRenamed({"node": "d", "component": "c"}), "d", "left")
    keyed = materialise(heads.select("d", F.coalesce("c", "d").alias("c"), "size", "fp", F.explode("bands").alias("key")).distinct(), "bands")
    first = F.min(F.struct("d", "size", "c")).alias("a")
    other = F.min(F.struct(F.xxhash64("d", "key").alias("h"), "d", "size", "c")).alias("b")
    pairs = materialise(keyed.groupBy("key").agg(first, other, F.count("*").alias("n")).where("n > 1").select("key", "n", "a", F.struct("b.d", "b.size", "b.c").alias("b")), "stars")
    stars = materialise(pairs.join(band_centres(keyed, pairs), "key", "left").select("key", F.array_compact(F.array("a", "b", "c")).alias("s")), "centred")
    links = keyed.join(stars, "key").select("d", "size", "c", F.explode("s").alias("s")).where("c != s.c")
    links = links.where(F.least("size", "s.size") >= F.lit(similarity) * F.greatest("size", "s.size"))
    links = materialise(links.select(F.least("d", "s.d").alias("u"), F.greatest("d", "s.d").alias("v")).distinct(), "candidates")
    groups = _merged(groups, materialise(verified(base, links, shingle, similarity, unique), "near"))
    # Bands whose members are one group by now hold no more links between groups.
    large = keyed.drop("c").join(pairs.where("n > 3").select("key"), "key").join(groups.withColumnsRenamed({"node": "d", "component": "c"}), "d", "left")
    large = materialise(large.select("key", "d", F.coalesce("c", "d").alias("c")), "large")
    apart = large.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    crowd = materialise(large.join(apart, "key").select("d", "c").distinct(), "crowd")
    if crowd.isEmpty():
        return groups
    links = materialise(crowd_candidates(packed_texts(base, crowd).join(crowd, "d"), shingle, similarity), "candidates")
    return _merged(groups, materialise(verified(base, links, shingle, similarity, unique), "more"))


def tree_candidates(heads: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``u, v`` (u < v): texts (``d, size, fp``) that connect all whose fingerprints lie within
    ``radius`` bits, without those whose sizes alone exclude the similarity. Texts of one
    fingerprint are linked to the first of them."""
    anchors = materialise(heads.groupBy("fp").agg(F.min(F.struct("d", "size")).alias("a")), "anchors")
    links = materialise(fingerprint_links(anchors.select("fp"), radius), "links")
    for end in ("u", "v"):
        links = links.join(anchors.select(F.col("fp").alias(end), F.col("a").alias(f"{end}_a")), end)
    equal = heads.select("fp", F.struct("d", "size").alias("u_a")).join(anchors.withColumnRenamed("a", "v_a"), "fp").where("u_a.d != v_a.d")
    both = links.select("u_a", "v_a").unionByName(equal.select("u_a", "v_a"))
    both = both.where(F.least("u_a.size", "v_a.size") >= F.lit(similarity) * F.greatest("u_a.size", "v_a.size"))
    return both.where("u_a.d != v_a.d").select(F.least("u_a.d", "v_a.d").alias("u"), F.greatest("u_a.d", "v_a.d").alias("v")).distinct()


def _merged(groups: DataFrame, more: DataFrame) -> DataFrame:
    """``groups`` (``node, component``) joined further by the links ``more`` (``u, v``)."""
    if more.isEmpty():
        return groups
    # The groups so far are the nodes of what is left to connect.
    for end in ("u", "v"):
        named = groups.select(F.col("node").alias(end), F.col("component").alias("named"))
        more = more.join(materialise(named, "named"), end, "left").withColumn(end, F.coalesce("named", end)).drop("named")
    merged = materialise(connected_components(materialise(more, "more")).toDF("component", "lowest"), "merged")
    named = groups.join(merged, "component", "left").select("node", F.coalesce("lowest", "component").alias("component"))
    alone = merged.select(F.col("component").alias("node"), F.col("lowest").alias("component"))
    return materialise(named.unionByName(alone).distinct(), "groups")


def verified(base: DataFrame, links: DataFrame, shingle: int, similarity: float, unique: bool) -> DataFrame:
    """Those of the links ``u, v`` (u < v) whose texts are similar enough.

    One text joins after the other, so a link is one row all the time; adaptive execution can
    split the links of a popular text in either join. Of rows that share a ``d``, where it is
    not ``unique``, the text that packs to the least bytes counts.
    """
    packed = packed_texts(base, links.select(F.explode(F.array("u", "v")).alias("d")))
    packed = packed if unique else packed.groupBy("d").agg(F.min("packed").alias("packed"))
    left = links.select("u", "v").join(packed.toDF("u", "left"), "u")
    texts = left.join(packed.toDF("v", "right"), "v").select("u", "v", "left", "right")
    return texts.sortWithinPartitions("v", "u").mapInArrow(_verifier(shingle, similarity), "u long, v long")


def _grams(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "t", "c", "size", "g"]
        for batch in slices(batches):
            for d, t, c, packed in zip(*(batch.column(k).to_pylist() for k in ("d", "t", "c", "packed"))):
                g = np.unique(shingle_hashes(_unpack(packed), shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(g), x, np.int64)) for x in (d, t, c, len(g))), pa.array(g)], names)

    return run


def _prefixer(similarity: float):
    """The first of the sorted shingles ``s`` of each text, so many that a text of the
    similarity shares one; the number ``hot`` of frequent shingles and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, c, size, found in zip(*(batch.column(k).to_pylist() for k in ("d", "c", "size", "s"))):
                found = sorted((x["f"], x["g"]) for x in found)
                often = np.array([g for f, g in found if f > RARE], np.int64)
                digest = xxhash.xxh64_intdigest(often.tobytes()) - 2**63
                # Shingles that no other group holds come first and need no rows.
                first = found[: max(0, size - math.ceil(similarity * size - 1e-9) + 1 - (size - len(found)))]
                columns = [*(np.full(len(first), x, np.int64) for x in (d, c, size, len(often), digest)), np.array(first, np.int64).reshape(-1, 2)[:, 0], np.array(first, np.int64).reshape(-1, 2)[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d", "c", "size", "hot", "h", "f", "g"])

    return run


def crowd_candidates(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``u, v``: candidates that connect all similar texts of different groups ``c`` in
    ``docs`` (``d, packed, c``).

    Sorted by frequency, similar texts share one of their first shingles. Where one is held
    by ``RARE`` texts or fewer, all pairs that hold it are candidates. Other similar pairs
    share frequent shingles only, so nearly all of the smaller text (2s / (1 + s)) and most
    of the larger one (s) are frequent. Of the texts of the former kind with the same
    frequent shingles, the one with the fewest others is similar to all and to whatever one
    of them is similar to: it stands for them. What is left are pairs of different groups
    that share a frequent shingle among their first; one text of each is outside of the
    shingle's largest group.
    """
    grams = materialise(docs.select("d", F.xxhash64("packed").alias("t"), "c", "packed").distinct().mapInArrow(_grams(shingle), "d long, t long, c long, size long, g long"), "grams")
    held = grams.groupBy("g").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g", "f")
    shared = grams.join(materialise(held, "held"), "g").groupBy("d", "t").agg(F.first("c").alias("c"), F.first("size").alias("size"), F.collect_list(F.struct("f", "g")).alias("s"))
    first = materialise(shared.mapInArrow(_prefixer(similarity), "d long, c long, size long, hot long, h long, f long, g long"), "prefixes")
    s, slack = similarity, 1e-6
    rare = first.where(F.col("f") <= RARE).select("d", "c", "size", "g")
    some = rare.select("g", *[F.col(x).alias(f"{x}2") for x in ("d", "c", "size")])
    alike = rare.join(some, "g").where("c < c2").where(F.least("size", "size2") >= s * F.greatest("size", "size2") - slack)
    links = alike.select(F.least("d", "d2").alias("u"), F.greatest("d", "d2").alias("v")).distinct()

    most = first.where((F.col("f") > RARE) & (F.col("hot") >= s * F.col("size") - slack))
    most = most.withColumn("dense", F.col("hot") >= 2 * s / (1 + s) * F.col("size") - slack)
    dense = most.where("dense").select("d", "c", "size", "h").distinct()
    least = materialise(dense.groupBy("h").agg(F.min(F.struct("size", "d", "c")).alias("x")).select("h", F.col("x.d").alias("d2"), F.col("x.c").alias("c2")), "least")
    named = dense.join(least, "h").where("c != c2").select(F.least("d", "d2").alias("u"), F.greatest("d", "d2").alias("v"))
    most = materialise(most.join(least.select(F.col("d2").alias("d"), F.lit(True).alias("stands")).distinct(), "d", "left").where("not dense or stands").select("g", "d", "c", "size", "hot", "dense", "h"), "most")
    # A pair that shares several of these shingles comes out of the join once, at the least one.
    whole = most.groupBy("d", "h", "size", "hot").agg(F.collect_set("g").alias("gs"))
    most = materialise(most.join(whole, ["d", "h", "size", "hot"]).drop("h"), "sets")
    groups = most.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("n"))
    outside = materialise(most.join(groups.where("n > 1").select("g", "main"), "g").where("c != main").drop("main"), "outside")
    outside = outside.select("g", *[F.col(x).alias(f"{x}2") for x in ("d", "c", "size", "hot", "dense", "gs")])
    small = F.when(F.col("size") < F.col("size2"), F.col("dense")).when(F.col("size") > F.col("size2"), F.col("dense2")).otherwise(F.col("dense") | F.col("dense2"))
    enough = F.least("hot", "hot2") >= s / (1 + s) * (F.col("size") + F.col("size2")) - slack
    first_shared = F.array_min(F.array_intersect("gs", "gs2")) == F.col("g")
    rest = most.join(outside, "g").where("c != c2").where(small & enough & first_shared)
    rest = rest.select(F.least("d", "d2").alias("u"), F.greatest("d", "d2").alias("v")).distinct()
    return links.unionByName(named).unionByName(rest).distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those that belong to a group of near duplicates, but for the one of
    the smallest doc_id.

    Groups are closed under similarity. Rows that share a doc_id share its fate, as those
    with a null one do; texts without words are copies of each other; an empty table gives
    an empty result; other columns pass through.
    """
    groups = near_duplicate_groups(docs, shingle, similarity)
    key = unused(docs, "__d")[0]
    lost = materialise(groups.where("node != component").select(F.col("node").alias(key)), "lost")
    return docs.withColumn(key, id_key("doc_id")).join(lost, key, "left_anti").select(*docs.columns)
