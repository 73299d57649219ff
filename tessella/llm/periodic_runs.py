"""Periodic runs of words inside a text, and texts with each run collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
long enough and repeated often enough, that neither neighbour extends. Each text is taken
whole, inside the task that reads it; nothing is shuffled.

Every stretch of words that may lie in a run goes through a suffix automaton. Going up its
suffix links, the ordered sets of end positions merge, the smaller into the larger. Two ends
that become neighbours in a state at a distance q of at most the state's length mark a square
of period q; the state's length is then all that the words before the two ends have in common,
so it gives where the run starts. Each word of a run from its second period on marks a square;
the one at the run's last word gives the whole run, so the others are passed over.

Stretches are found first: in a run of length L >= e q, a gram of up to L - 2 q + 1 words has a
copy q words before or after it, so words outside repeated grams of that many words lie in none.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import SPACES, replacing, slices, unused

#: A run has this many words at least, and this many times its period.
MIN_WORDS, EXPONENT = 24, 3
#: Positions of a block of an ordered set, at most.
BLOCK = 512
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Ends:
    """An ascending set of positions in blocks, so that a new one moves few others."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        i = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[i]
        insort(block, x)
        self.lows[i], self.size = block[0], self.size + 1
        if len(block) > BLOCK:
            self.blocks[i : i + 1] = block[: BLOCK // 2], block[BLOCK // 2 :]
            self.lows[i : i + 1] = block[0], block[BLOCK // 2]

    def around(self, x: int) -> tuple[int, int]:
        """The positions before and after ``x``, which is in the set; -1 where there is none."""
        i = bisect_right(self.lows, x) - 1
        block = self.blocks[i]
        j = bisect_left(block, x)
        before = block[j - 1] if j else self.blocks[i - 1][-1] if i else -1
        after = block[j + 1] if j + 1 < len(block) else self.lows[i + 1] if i + 1 < len(self.lows) else -1
        return before, after


class SuffixAutomaton:
    """The suffix automaton of a sequence of numbers from 0: ``length``, ``link`` and ``end`` of
    each state, where ``end`` is the last position of the prefix it stands for, -1 for a clone.

    Most states have one transition, kept in two arrays; further ones are in ``more``.
    """

    def __init__(self, words: list[int]):
        length, link, end, sym, to = array("q", [0]), array("q", [-1]), array("q", [-1]), array("q", [-1]), array("q", [0])
        more: dict[int, dict[int, int]] = {}
        last = 0
        for at, w in enumerate(words):
            new = len(length)
            for column, value in ((length, at + 1), (link, 0), (end, at), (sym, -1), (to, 0)):
                column.append(value)
            p, target = last, -1
            while p >= 0:
                if sym[p] == w:
                    target = to[p]
                    break
                others = more.get(p)
                if others is not None and w in others:
                    target = others[w]
                    break
                if sym[p] < 0:
                    sym[p], to[p] = w, new
                elif others is None:
                    more[p] = {w: new}
                else:
                    others[w] = new
                p = link[p]
            if target >= 0 and length[target] == length[p] + 1:
                link[new] = target
            elif target >= 0:
                clone = len(length)
                for column, value in ((length, length[p] + 1), (link, link[target]), (end, -1), (sym, sym[target]), (to, to[target])):
                    column.append(value)
                if target in more:
                    more[clone] = dict(more[target])
                while p >= 0:
                    if sym[p] == w and to[p] == target:
                        to[p] = clone
                    elif p in more and more[p].get(w) == target:
                        more[p][w] = clone
                    else:
                        break
                    p = link[p]
                link[target] = link[new] = clone
            last = new
        self.length, self.link, self.end = length, link, end


def runs_of(words: list[int], min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence of numbers from 0."""
    n, found = len(words), set()
    sam = SuffixAutomaton(words)
    length, link, end = sam.length, sam.link, sam.end
    # The state that shows a whole run is a period shorter than the run.
    least = -(-min_words * (exponent - 1) // exponent)
    sets: dict[int, Ends] = {}

    def join(large: Ends, small: Ends | tuple[int], common: int) -> None:
        for x in small:
            large.add(x)
        for x in small:
            before, after = large.around(x)
            for one, two in ((before, x), (x, after)):
                q = two - one
                if one < 0 or two < 0 or common + q < min_words or common + q < exponent * q:
                    continue
                start = one - common + 1
                if (two + 1 == n or words[two + 1] != words[one + 1]) and (start == 0 or words[start - 1] != words[start - 1 + q]):
                    found.add((start, common + q, q))

    for state in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        if length[state] < least:
            break
        ends, own, parent = sets.pop(state, None), end[state], link[state]
        if ends is None:
            ends = Ends(own)
        elif own >= 0:
            join(ends, (own,), length[state])
        if length[parent] < least:
            continue
        other = sets.get(parent)
        if other is None:
            sets[parent] = ends
        else:
            large, small = (ends, other) if len(ends) > len(other) else (other, ends)
            join(large, small, length[parent])
            sets[parent] = large
    return found


def stretches(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """``(begin, end)`` of the maximal stretches covered by repeated grams. Grams are compared by
    hash: a collision adds words to a stretch and takes none away."""
    starts = len(words) - gram + 1
    if starts < 2:
        return []
    mix = np.random.default_rng(11).integers(1 << 62, size=gram, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.zeros(starts, np.uint64)
    for i in range(gram):
        hashes += words[i : i + starts].astype(np.uint64) * mix[i]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.isin(hashes, twice).astype(np.int8), [0]])))
    return [(int(a), int(b) + gram - 1) for a, b in zip(edges[::2], edges[1::2])]


def text_runs(words: list[bytes], min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a text's words, by start, then period."""
    if len(words) < min_words:
        return []
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    found = []
    for begin, end in stretches(ids, min_words * (exponent - 2) // exponent + 1):
        if end - begin >= min_words:
            found += [(begin + s, n, q) for s, n, q in runs_of(ids[begin:end].tolist(), min_words, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (of ``start, length, period`` in words, by start, then
    period) and ``collapsed``, the words of the text joined by one space without those that a
    run has after its first ``period`` words.

    Words end at ASCII whitespace; a run has ``min_words`` words and ``exponent`` (2 or more)
    periods at least. A null or empty text has no words, no runs and an empty ``collapsed``.
    Rows are judged one by one, so repeated rows give equal results and order does not matter;
    an empty table gives an empty one. Other columns pass through, those named like the new
    ones are replaced. A task holds one text's automaton at a time, of about 80 bytes a word
    of the stretches that may hold runs.
    """
    docs = replacing(docs, "n_words", "runs", "collapsed")
    (data,) = unused(docs, "__data")
    rows = docs.withColumn(data, F.coalesce("text", F.lit("")).cast("binary"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            n, runs, texts = [], [], []
            for text in batch.column(data):
                # Words of bytes end at ASCII whitespace, just as wanted.
                words = text.as_py().split()
                found = text_runs(words, min_words, exponent)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(collapsed(words, found))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())], names)

    added = StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed binary")
    names = [*docs.columns, *added.names]
    out = rows.mapInArrow(judge, StructType([*docs.schema.fields, *added.fields]))
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every tenth document, by the crc32 h of its decimal id, made periodic:
    with n words, g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), each
    word i >= a becomes word a + (i - a) % p. A null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.trim("text", F.lit(SPACES)), r"[ \x09-\x0D]+"), "")
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        moved = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(F.size(w) > 0, F.array_join(moved, " ")).otherwise("")

    # The words as a lambda's variable: split once, not once for each word.
    changed = F.get(F.transform(F.array(words), periodic), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent (ties: least start, then period), and the
    digests of all runs and of the collapsed text."""
    found = find_runs(with_planted_periods(docs))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start, then period: the first of equal exponent stays.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
