"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. Patterns of one length share a matcher:
a shift table over blocks of two words says how far the scan may jump, a block with shift
zero leads to the bucket of the patterns that end with it, their first two words choose
among these, and a direct comparison of the words confirms an occurrence. Items lie in the
shared folder in blocks of bounded size, which the tasks read there; documents are scanned
in place and are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import open_fs, replacing, running_totals, scratch_dir, slices, unused

#: Everything but letters, digits and non-ASCII bytes becomes a space, and A-Z lower case.
_WORDS = bytes(32 if b < 0x80 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 0x80 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Matcher:
    """Wu-Manber tables for patterns (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: Last block of words, then first one, to the patterns.
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
            self.bucket.setdefault(words[-self.block :], {}).setdefault(words[: self.block], []).append((words, items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of each pattern occurrence."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift.get
        end, n = length, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift(key, jump)
            if step:
                end += step
                continue
            start = end - length
            likely = self.bucket[key].get(tuple(words[start : start + block]))
            if likely:
                here = tuple(words[start:end])
                for pattern, items in likely:
                    if pattern == here:
                        yield start, items
            end += 1


def matchers(items: list[tuple[object, str | None]], window: int) -> list[Matcher]:
    """One matcher for each pattern length; an item of fewer words than ``window`` is one pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for pattern in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else ():
            by_length.setdefault(size, {}).setdefault(pattern, []).append(item)
    return [Matcher(patterns) for _, patterns in sorted(by_length.items())]


def scan(words: list[bytes], tables: list[Matcher]) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges [start, end), merged, and the items that occur."""
    spans, items = [], set()
    for table in tables:
        for start, which in table.occurrences(words):
            spans.append((start, start + table.length))
            items.update(which)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Folders, in the shared one, with the ``item_id, text`` of blocks of about
    ``block_bytes`` of text each; a larger item is in one block. The driver sees their numbers only."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = F.octet_length("text").cast("long")
    placed = running_totals(items, [F.col("item_id")], {"end": size}, "benchmark").withColumn("block", F.floor((F.col("end") - size) / block_bytes))
    root = scratch_dir(spark, "blocks")
    numbers = sorted(r.block for r in placed.select("block").distinct().collect())
    placed.select("block", "item_id", "text").repartition("block").write.partitionBy("block").parquet(root)
    return [f"{root}/block={k}" for k in numbers]


def _scanner(block: str | None, window: int, item_type: pa.DataType, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[Matcher] = []
        if block is not None:
            fs, path = open_fs(block)
            read = pq.read_table(path, filesystem=fs, partitioning=None)
            tables = matchers(list(zip(read.column("item_id").to_pylist(), read.column("text").to_pylist())), window)
        for batch in slices(batches):
            n_words, spans, items = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hit, which = scan(words, tables)
                n_words.append(len(words))
                spans.append([x for span in hit for x in span])
                items.append(sorted(which))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(item_type))],
                [*batch.schema.names, *names],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans``, ``items`` and ``contaminated``.

    ``hit_spans`` holds the merged ranges of hit words as start, end, start, end...;
    ``items`` the item_ids, of any type that sorts, with an occurring window, ascending.

    The tasks read benchmark texts from the shared folder in blocks of about ``block_bytes``;
    each block scans all documents in place, and what the blocks found is merged row by row.
    Null and empty texts have no words and no hits; items without words, or with a null
    item_id, never match; repeated rows and items give repeated rows and one item; empty
    tables give no rows, or no hits. Other columns pass through; those named like the new
    ones are replaced.
    """
    out = replacing(docs, "n_words", "n_hit", "hit_spans", "items", "contaminated")
    kept = out.columns
    names = unused(out, "__n_words", "__spans", "__items")
    kind = benchmark.schema["item_id"].dataType
    new = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(kind)))]
    for k, block in enumerate(benchmark_blocks(benchmark, block_bytes) or [None]):
        found = _scanner(block, window, to_arrow_type(kind), names)
        out = out.mapInArrow(found, T.StructType([*out.schema.fields, *new]))
        if k:
            out = out.withColumn("hit_spans", _merged("hit_spans", names[1])).withColumn("items", F.array_sort(F.array_union("items", names[2])))
        else:
            out = out.withColumns({"n_words": F.col(names[0]), "hit_spans": F.col(names[1]), "items": F.col(names[2])})
        out = out.drop(*names)
    n_hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*kept, "n_words", "n_hit", "hit_spans", "items", "contaminated")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _merge_spans(a, b):
    import pandas as pd

    def merge(x, y):
        spans = sorted((*zip(x[::2], x[1::2]), *zip(y[::2], y[1::2])))
        out: list[int] = []
        for start, end in spans:
            if out and start <= out[-1]:
                out[-1] = max(out[-1], end)
            else:
                out += [start, end]
        return out

    return pd.Series([merge(list(x), list(y)) for x, y in zip(a, b)])


def _merged(a: str, b: str):
    return _merge_spans(F.col(a), F.col(b))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a benchmark window."""
    found = find_contamination(docs, benchmark, window)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
