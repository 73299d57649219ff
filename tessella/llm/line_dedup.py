"""Line deduplication across documents, in DataFrame operations only.

Line hashes are range-partitioned by (hash, document), so a line that a third of all
documents hold spreads over many tasks, with a secondary sort by document and position. A
sort aggregate streams each range once: first occurrences per (line, document), then a
partial count and the largest document per line; the partial rows of a line, one for each
range that it touches, meet in a small final aggregate. What comes back per document is a
compressed bitmap of the lines to keep: 64-bit words, only those that lose a line; texts
are joined with it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, ascii_lower, id_key, key_id, materialise, partitions, replacing, unused


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``d, pos, h1, h2`` of each line whose key has ``min_chars`` code points or more."""
    lines = docs.select(id_key("doc_id").alias("d"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("d", "pos", ascii_lower(F.trim("line", F.lit(SPACES))).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("d", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``d, keep``: for each document that loses lines its words ``(word, bits)`` of the keep
    bitmap: bit i of word w is line 64 w + i; words that are not listed keep all lines.

    A key in ``min_docs`` or more documents keeps its lines only in the largest doc_id.
    """
    # Read from files: the ranges are sampled first, and each line is split and hashed once.
    lines = materialise(line_keys(docs, min_chars), "lines")
    ranged = lines.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "d").sortWithinPartitions("h1", "h2", "d", "pos")
    # Structs make these sort aggregates, which stream the sorted range.
    firsts = ranged.groupBy("h1", "h2", "d").agg(F.min(F.struct("pos")).alias("first"))
    per_line = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(F.struct("d", "first")).alias("kept"))
    frequent = materialise(per_line.where(F.col("n_docs") >= min_docs).select("h1", "h2", F.col("kept.d").alias("keeper")), "frequent")
    # Both sides come from files, so adaptive execution can split a hot line's rows.
    lost = lines.join(frequent, ["h1", "h2"]).where("d != keeper")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))
    words = lost.groupBy("d", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _dropped_lines(keep: Column) -> Column:
    """The numbers of the lines that a bitmap drops, in ascending order."""
    inside = F.sequence(F.lit(0), F.lit(63))
    is_lost = lambda w, i: F.call_function("shiftright", w["bits"], i).bitwiseAND(F.lit(1)) == 0
    of_word = lambda w: F.transform(F.filter(inside, lambda i: is_lost(w, i)), lambda i: w["word"] * 64 + i)
    return F.flatten(F.transform(F.coalesce(keep, F.array().cast("array<struct<word:int,bits:bigint>>")), of_word))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and ``n_lines``, ``n_dropped``.

    Lines end at ``\\n``; a null or empty text is one empty line and becomes an empty text.
    A line's key is the line without ASCII whitespace at both ends and with A-Z lower-cased.
    Rows that repeat a doc_id count as one document; a null doc_id is one document that
    sorts last. A key repeated inside its largest document stays there each time. Other
    columns pass through, those named like the new ones are replaced; an empty table gives
    an empty result.
    """
    docs = replacing(docs, "n_lines", "n_dropped")
    d, keep, lines, lost = unused(docs, "__d", "__keep", "__lines", "__lost")
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).toDF(d, keep)
    split = docs.withColumn(d, id_key("doc_id")).join(bitmaps, d, "left").withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n"))
    split = split.withColumn(lost, F.filter(_dropped_lines(F.col(keep)), lambda i: i < F.size(lines)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.size(lost) > 0, text).otherwise(F.coalesce("text", F.lit("")))
    out = split.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.size(lost).cast("long")).withColumn("text", text)
    return out.select(*docs.columns, "n_lines", "n_dropped")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(key_id("doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> keeper AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
