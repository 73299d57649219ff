"""Exact substring deduplication with a sparse, distributed suffix array.

Every string of ``length`` bytes holds one anchor: its leftmost ``GRAM``-byte substring with
the least hash. Equal strings have equal anchors at equal offsets, so suffixes need to be
sorted around anchors only; an anchor stands for the run of strings that chose it.

1. Runs are range-partitioned by the hash of their anchor's leading bytes and sorted. Those
   whose anchor occurs once are unique and need no more work. A hash tells no more than
   this: whatever is removed has been compared byte by byte.
2. The bytes of the other runs are range-partitioned by anchor and sorted. Of equal runs all
   but the earliest are repeats as a whole. Anchors of several different runs leave the
   earliest of each.
3. Those are cut into pieces of ``PIECE`` strings at most, which have most of their bytes in
   common. Those common bytes lead: sampled splitters range-partition the pieces by them,
   and a bucket sorts the strings of pieces that share them by multikey quicksort, eight
   bytes a character; equal neighbours are repeats but for the earliest.
4. A lead that may go on in the next bucket, as a hot one does, has its earliest strings
   compared across boundaries: a second aggregate over these strings.

What returns to a document are start, length pairs of its repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, forget, id_key, materialise, partitions, replacing, scratch_dir

#: Bytes of an anchor; at most the length of the strings.
GRAM = 32
#: Strings of a piece, at most; never more than half their length.
PIECE = 12
#: Bytes of text hashed at once, so that memory does not grow with a batch or a text.
BLOCK_BYTES = 1 << 20
_RUNS = "g long, d long, at long, n long, off long"
#: Texts of rows that repeat a doc_id count as parts of one document, this far apart.
PART = 1 << 40

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers over each other."""
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD
    h = h ^ (h >> np.uint64(29))
    h = h * _BASES[0]
    return h ^ (h >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Hashes:
    """Polynomial hashes, modulo 2^64, of any substring of ``data``, from prefix sums."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(data)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)
        self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start])


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each window of ``width`` values."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, count, anchor, gram hash) of the runs of strings of one text block."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    gram = min(GRAM, length)
    first = np.arange(len(data) - gram + 1)
    grams = Hashes(data, _BASES[0]).of(first, first + gram)
    anchors = window_argmin(grams, length - gram + 1)
    start = np.concatenate([[0], np.nonzero(anchors[1:] != anchors[:-1])[0] + 1])
    anchor = anchors[start]
    return start, np.diff(np.append(start, n)), anchor, grams[anchor]


def merged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (start, count) ranges with those that touch or overlap joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + count)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.empty(0, bool)
    last = np.append(np.nonzero(new)[0][1:] - 1, len(start) - 1) if len(start) else np.empty(0, np.int64)
    return start[new], end[last] - start[new]


def _anchorer(length: int):
    """Runs of each text; those whose bytes repeat an earlier run of the same text are
    settled, which an anchor's offset ``off`` of -1 tells."""

    def of_text(data: np.ndarray):
        parts = []
        for at in range(0, max(1, len(data) - length + 1), BLOCK_BYTES):
            start, count, anchor, gram = runs_of(data[at : at + BLOCK_BYTES + length - 1], length)
            parts.append((start + at, count, anchor - start, gram))
        start, count, offset, gram = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(gram, kind="stable")
        tied = np.zeros(len(order), bool)
        same = gram[order[1:]] == gram[order[:-1]]
        tied[1:] |= same
        tied[:-1] |= same
        again = np.zeros(len(order), bool)
        if tied.any():
            raw, seen = data.tobytes(), set()
            for i in np.sort(order[tied]).tolist():
                piece = raw[start[i] : start[i] + count[i] + length - 1]
                again[i] = piece in seen
                seen.add(piece)
        if not again.any():
            return start, count, offset, gram
        s, c = merged(start[again], count[again])
        # A settled range goes anywhere in the partitioning; its hash deals it out.
        spread = mixed(s.astype(np.uint64) + gram[0])
        fresh = ~again
        settled = (s, c, np.full(len(s), -1), spread)
        return tuple(np.concatenate([x[fresh], y]) for x, y in zip((start, count, offset, gram), settled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for d, part, text in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.empty(0, np.uint8)
                start, count, offset, gram = of_text(data)
                if len(start):
                    held.append((gram.view(np.int64), np.full(len(start), d.as_py()), start + part.as_py() * PART, count, offset))
                    size += len(start)
                if size > 1 << 16:
                    yield _batch(held, ["g", "d", "at", "n", "off"])
                    held, size = [], 0
            if held:
                yield _batch(held, ["g", "d", "at", "n", "off"])

    return run


def _batch(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column, and in the first row."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], bool, bool]]:
    """(columns, is first, is last): rows sorted by their first column, cut where it changes,
    in blocks of bounded bytes as far as one key's rows allow."""
    held: list[pa.RecordBatch] = []
    size, first = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= 2 * BLOCK_BYTES:
            same = pc.equal(batch.column(0), held[-1].column(0)[-1])
            cut = pc.index(same, False).as_py()
            if cut >= 0:
                yield _joined([*held, batch.slice(0, cut)]), first, False
                held, size, first, batch = [], 0, False, batch.slice(cut)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield _joined(held), first, True


def _ints(columns: list) -> list[np.ndarray]:
    return [c.to_numpy() for c in columns]


def _sifter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs without those whose anchor is theirs alone."""
    for columns, first, last in _by_key(batches):
        g, d, at, n, off = _ints(columns)
        group = np.cumsum(_changes(g)) - 1
        shared = np.bincount(group) > 1
        shared[0] |= first
        shared[-1] |= last
        keep = (off < 0) | shared[group]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (g, d, at, n, off)], ["g", "d", "at", "n", "off"])


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the text, becomes ``__packed``, its compressed UTF-8 bytes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [squeeze(t.as_buffer() or b"") if t.is_valid else None for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "__packed"])


def _extractor(length: int):
    """``__packed`` and the lists ``g, at, n, off`` of a text to the bytes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names, kinds = ["g", "run", "d", "at", "n", "off"], [pa.int64(), pa.binary(), *[pa.int64()] * 4]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            rows, size = [], 0
            for d, part, packed, *runs in zip(*(batch.column(i) for i in range(7))):
                data, base, d = unpack(packed.as_py()), part.as_py() * PART, d.as_py()
                for g, at, n, off in zip(*(x.values.to_pylist() for x in runs)):
                    rows.append((g, data[at - base : at - base + n + length - 1], d, at, n, off))
                    size += n + length
                    if size > BLOCK_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
            if rows:
                yield pack(rows)

    return run


def _run_sorter(length: int):
    """Runs sorted by ``g, run, d, at``: those that repeat the one before them as a whole, and
    of anchors with several different runs, or that another bucket may have too, the pieces
    of the earliest of each: the bytes that all strings of a full piece have, and those to
    the left and right of them."""

    cell = min(PIECE, length // 2)
    names, kinds = ["lead", "d", "at", "n", "left", "right"], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def pieces(data: bytes, d: int, at: int, n: int, off: int) -> Iterator[tuple]:
        # Strings with anchors at offsets of the same cell make a piece.
        first = 0
        while n:
            k = min(n, off % cell + 1)
            a = first + off % cell
            b = a + length - cell + 1
            yield data[a:b], d, at + first, k, data[first:a], data[b : first + k - 1 + length]
            first, n, off = first + k, n - k, off - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first, last in _by_key(batches):
            g, runs, (d, at, n, off) = columns[0].to_numpy(), columns[1], _ints(columns[2:])
            group = np.cumsum(new := _changes(g)) - 1
            fresh = np.ones(len(g), bool)
            fresh[1:] = new[1:] | pc.not_equal(runs.slice(1), runs.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
            open_ = np.bincount(group, weights=fresh) > 1
            open_[0] |= first
            open_[-1] |= last
            gone = np.nonzero(~fresh)[0]
            none = pa.nulls(len(gone), pa.binary())
            yield pa.RecordBatch.from_arrays([none, *(pa.array(x[gone]) for x in (d, at, n)), none, none], names)
            rest, size = [], 0
            for i in np.nonzero(fresh & open_[group])[0]:
                rest += pieces(runs[i].as_py(), int(d[i]), int(at[i]), int(n[i]), int(off[i]))
                size += 4 * length
                if size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rest), kinds)], names)
                    rest, size = [], 0
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rest), kinds)], names)

    return run


def multikey_quicksort(data: np.ndarray, suffix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes of ``data`` sorted by their first ``length`` bytes; those with
    equal bytes have one class. A character is eight bytes; after each, only suffixes that
    still tie are looked at."""
    order, rank = np.arange(len(suffix)), np.zeros(len(suffix), np.int64)
    if length < 8:
        raise ValueError("strings have at least 8 bytes")
    words = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), 0, (1,))
    ties = order.copy()
    for depth in sorted({*range(0, length - 7, 8), length - 8}):
        if not len(ties):
            break
        rows, group = order[ties], rank[ties]
        word = words[suffix[rows] + depth].astype(np.uint64)
        by = np.lexsort((word, group))
        rows, word = rows[by], word[by]
        order[ties] = rows
        new = _changes(group, word)
        # A class is named by the place of its first member.
        rank[ties] = np.maximum.accumulate(np.where(new, ties, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        ties = ties[tied]
    return order, rank


def _bucket_sorter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first, last in _by_key(batches):
            keys = columns[0].to_pylist()
            edge = [first and k == keys[0] or last and k == keys[-1] for k in keys]
            again = [a == b for a, b in zip(keys[1:], keys)]
            keep = np.nonzero(np.array(edge) | np.array([*again, False]) | np.array([False, *again]))[0]
            if not len(keep):
                continue
            keys, edge = [keys[i] for i in keep], np.array(edge)[keep]
            d, at, n = (c.to_numpy()[keep] for c in columns[1:4])
            left, right = (c.take(pa.array(keep)).to_pylist() for c in columns[4:])
            data = np.frombuffer(b"".join([x for row in zip(left, keys, right) for x in row]), np.uint8)
            sizes = n + length - 1
            offsets = np.cumsum(sizes) - sizes
            # One suffix for each string of each run.
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            suffix = offsets[row] + inside
            order, rank = multikey_quicksort(data, suffix, length)
            sorted_d, sorted_at = d[row[order]], at[row[order]] + inside[order]
            by = np.lexsort((sorted_at, sorted_d, rank))
            order, sorted_d, sorted_at = order[by], sorted_d[by], sorted_at[by]
            fresh = _changes(rank)
            edge = edge[row[order]]
            # Repeats, as ranges of starts.
            rd, ra = sorted_d[~fresh], sorted_at[~fresh]
            by = np.lexsort((ra, rd))
            rd, ra = rd[by], ra[by]
            new = np.ones(len(rd), bool)
            new[1:] = (rd[1:] != rd[:-1]) | (ra[1:] > ra[:-1] + 1)
            begin = np.nonzero(new)[0]
            count = ra[np.append(begin[1:], len(ra)) - 1] - ra[begin] + 1 if len(ra) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (rd[begin], ra[begin], count)), pa.nulls(len(begin), pa.binary())], ["d", "at", "n", "s"])
            ask = np.nonzero(fresh & edge)[0]
            for i in range(0, len(ask), 1 << 13):
                some, raw = ask[i : i + (1 << 13)], memoryview(data)
                strings = pa.array([raw[x : x + length].tobytes() for x in suffix[order][some].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sorted_d[some]), pa.array(sorted_at[some]), pa.array(np.zeros(len(some), np.int64)), strings], ["d", "at", "n", "s"])

    return run


def positioned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__d``, the id key, and ``__part``, the place among the texts that share
    it (0 if it is the only one) in the order of a hash; equal texts share a place."""
    base = docs.withColumn("__d", id_key("doc_id"))
    shared = materialise(base.groupBy("__d").agg(F.count("*").alias("c")).where("c > 1").select("__d"), "shared")
    if shared.isEmpty():
        return base.withColumn("__part", F.lit(0).cast("long"))
    hashed = base.withColumn("__h", F.xxhash64("text"))
    places = hashed.join(shared, "__d").select("__d", "__h").distinct()
    places = places.withColumn("__part", (F.row_number().over(Window.partitionBy("__d").orderBy("__h")) - 1).cast("long"))
    joined = hashed.join(materialise(places, "places"), ["__d", "__h"], "left")
    return joined.select(*docs.columns, "__d", F.coalesce("__part", F.lit(0)).cast("long").alias("__part"))


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """``d, at, n``: strings of ``length`` bytes at ``at, at + 1, ... at + n - 1`` that occur
    earlier. ``texts`` has the id key, part and text of ``positioned``; ``at`` counts ``PART`` for each part."""
    spark = texts.sparkSession
    deal = partitions(spark)
    texts = texts.toDF("d", "part", "text")
    # What is range-partitioned comes from files, as its keys are sampled first.
    scratch = scratch_dir(spark, "runs")
    texts.mapInArrow(_anchorer(length), _RUNS).write.parquet(scratch)
    runs = spark.read.schema(_RUNS).parquet(scratch)
    runs = runs.repartitionByRange(deal, "g", "d", "at").sortWithinPartitions("g", "d", "at")
    sifted = materialise(runs.mapInArrow(_sifter, _RUNS), "sifted")
    discard(spark, scratch)
    asked = sifted.where("off >= 0").withColumn("part", F.floor(F.col("at") / F.lit(PART)))
    asked = asked.groupBy("d", "part").agg(*[F.collect_list(c).alias(c) for c in ("g", "at", "n", "off")])
    packed = texts.mapInArrow(_packer, "d long, part long, __packed binary")
    bytes_of = packed.join(asked, ["d", "part"]).select("d", "part", "__packed", "g", "at", "n", "off")
    bytes_of = bytes_of.mapInArrow(_extractor(length), "g long, run binary, d long, at long, n long, off long")
    order = ["g", "run", "d", "at"]
    sorted_runs = bytes_of.repartitionByRange(deal, *order).sortWithinPartitions(*order)
    settled = materialise(sorted_runs.mapInArrow(_run_sorter(length), "lead binary, d long, at long, n long, left binary, right binary"), "pieces")
    buckets = settled.where("lead is not null").repartitionByRange(deal, "lead", "d", "at").sortWithinPartitions("lead", "d", "at")
    compared = materialise(buckets.mapInArrow(_bucket_sorter(length), "d long, at long, n long, s binary"), "buckets")
    edges = compared.where("s is not null")
    heads = edges.groupBy("s").agg(F.min(F.struct("d", "at")).alias("head"), F.count("*").alias("c")).where("c > 1").select("s", "head")
    # Both sides come from files, so adaptive execution can split a hot string's rows.
    across = edges.join(materialise(heads, "heads"), "s").where(F.struct("d", "at") != F.col("head")).select("d", "at", F.lit(1).cast("long").alias("n"))
    whole = sifted.where("off < 0").select("d", "at", "n").unionByName(settled.where("lead is null").select("d", "at", "n"))
    found = materialise(whole.unionByName(compared.where("s is null").select("d", "at", "n")).unionByName(across), "ranges")
    forget(sifted, settled, compared)
    return found


_NEW = ("n_bytes", "n_removed", "spans", "kept_sha256", "kept")


def _cutter(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            names = [c for c in batch.schema.names if not c.startswith("__")]
            rows = []
            for part, packed, starts, counts in zip(*(batch.column(c) for c in ("__part", "__packed", "__starts", "__counts"))):
                data = unpack(packed.as_py()) if packed.is_valid else b""
                kept, spans = data, []
                if starts.is_valid:
                    start, count = merged(starts.values.to_numpy() - part.as_py() * PART, counts.values.to_numpy() + length - 1)
                    spans = np.stack([start, start + count], axis=1).reshape(-1).tolist()
                    edges = [0, *spans, len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                text = data.decode("utf-8", "surrogatepass") if with_text and packed.is_valid else None
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None, text))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *_NEW, "text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 100, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, spans, kept_sha256`` and ``kept``: the text's bytes
    without those that a string of ``length`` bytes covers which also starts earlier, in a
    smaller doc_id or before in the same document.

    ``spans`` holds the maximal removed byte ranges as start, end, start, end...; ``kept``
    may end inside a character. Without ``with_text``, ``kept`` and ``text`` are null.
    Strings are judged on the input, overlapping ones count and none crosses documents. Null
    and empty texts, and those shorter than ``length``, lose nothing. A null doc_id sorts
    last. Different texts that share a doc_id follow each other in the order of a hash; rows
    that repeat doc_id and text are one document and get equal results. Other columns pass
    through, those named like the new ones are replaced; an empty table gives an empty
    result. ``length`` is 8 or more.
    """
    docs = replacing(docs, *_NEW)
    # Inside, other columns have names that no private one has.
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    placed = positioned(docs.toDF(*inner))
    ranges = repeated_ranges(placed.select("__d", "__part", "text"), length)
    found = ranges.groupBy(F.col("d").alias("__d"), F.floor(F.col("at") / F.lit(PART)).alias("__part"))
    found = found.agg(F.collect_list("at").alias("__starts"), F.collect_list("n").alias("__counts"))
    rest = [f for f in placed.schema.fields if f.name in inner and f.name != "text"]
    keys = [T.StructField("__d", T.LongType()), T.StructField("__part", T.LongType())]
    packed = placed.select(*[f.name for f in rest], "__d", "__part", "text").mapInArrow(_packer, T.StructType([*rest, *keys, T.StructField("__packed", T.BinaryType())]))
    joined = packed.join(found, ["__d", "__part"], "left").select(*[f.name for f in rest], "__part", "__packed", "__starts", "__counts")
    longs = [T.StructField(c, T.LongType()) for c in _NEW[:2]]
    new = [*longs, T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType())]
    cut = joined.mapInArrow(_cutter(length, with_text), T.StructType([*rest, *new]))
    return cut.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)], *_NEW)


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    out = dedup_substrings(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(spans) / 2 as long)").alias("n_spans"), "kept_sha256")
