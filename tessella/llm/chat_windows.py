"""Chat formatting: conversations as training texts of bounded length.

Turns are marked by a template and cut into windows of whole turns. Prefix sums of turn sizes
deal each conversation into blocks, so the turns of a very long one spread over tasks; inside a
block, running sums of turn tokens fill one window after the other up to a budget. Each window
retains the conversation's system turn and repeats a limited number of tokens of what went
before; the loss mask covers assistant texts, but not repeated ones, so each is a target once.

Control strings of the template inside a text get a backslash after their first character, and
those that have backslashes there already one more, which is taken away on reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, partitions, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a window, and of the earlier turns that it repeats.
BUDGET, HISTORY = 2048, 256
#: Bytes of a block; longer conversations are dealt to several tasks.
BLOCK_BYTES = 1 << 20
#: Characters that are tokenised at once.
PIECE = 20_000
#: Parts that rows equal in all columns can be dealt to.
SALTS = 64

#: What stands before and after the text of a turn.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
#: The same for other roles, with the role between the first two.
OTHER = ("[ROLE] ", " [TURN] ", " [/TURN]")
_CONTROL = r"(?=<SYS>>|</SYS>>|/?s>|/?INST\]|ROLE\]|/?TURN\])"
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*){_CONTROL}"), re.compile(rf"([<\[])\\(\\*){_CONTROL}")
WINDOWS = "conv_id {kind}, block bigint, number bigint, formatted string, n_tokens bigint, n_turns bigint, repeated bigint, loss array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    text = escape(text)
    return before + text + after, len(before), len(before) + len(text)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted text. No text holds a control string, so the
    first closing mark ends a turn."""
    at, marks = 0, [(before, role, after) for role, (before, after) in MARKS.items()]
    while at < len(formatted):
        for before, role, after in marks:
            if formatted.startswith(before, at):
                at += len(before)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn at {at}")
            begin, at = at + len(OTHER[0]), formatted.index(OTHER[1], at)
            role, after = unescape(formatted[begin:at]), OTHER[2]
            at += len(OTHER[1])
        end = formatted.index(after, at)
        yield role, unescape(formatted[at:end])
        at = end + len(after)


def _encoding(ranks: bytes):
    """The encoding of a file of ranks; a worker makes it once."""
    import tiktoken
    from tiktoken.registry import ENCODINGS

    name = hashlib.sha256(ranks).hexdigest()
    if name not in ENCODINGS:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return ENCODINGS[name]


class _Windows:
    """The windows of one block, turn by turn; holds a window and its history at a time."""

    def __init__(self, budget: int, history: int):
        self.budget, self.limit = budget, history
        self.system, self.fresh, self.recent, self.sum = None, True, deque(), 0
        self.turns: list[tuple] = []
        self.size = 0

    def remember(self, turn: tuple) -> None:
        """A turn that has gone before: the latest ones within the limit stay."""
        self.recent.append(turn)
        self.sum += turn[1]
        while self.sum > self.limit:
            self.sum -= self.recent.popleft()[1]

    def fixed(self) -> int:
        return self.system[1] if self.system else 0

    def add(self, turn: tuple) -> dict | None:
        """Take a turn; returns the window that it no longer fits in."""
        done = None
        opened = self.fresh and len(self.turns) == 1 and self.turns[0][2] == "system"
        if self.turns and not opened and self.size + turn[1] > self.budget:
            done = self.close()
        if not self.turns:
            self.before = list(self.recent)
            while self.before and self.fixed() + sum(t[1] for t in self.before) + turn[1] > self.budget:
                self.before.pop(0)
            self.size = self.fixed() + sum(t[1] for t in self.before)
        self.turns.append(turn)
        self.size += turn[1]
        return done

    def start(self, turn: tuple) -> None:
        """The conversation's system turn, new in its first window."""
        self.turns, self.before, self.size = [turn], [], turn[1]

    def close(self) -> dict | None:
        if not self.turns:
            return None
        repeated = [*([self.system] if self.system else []), *self.before]
        text, at, loss = [], 0, []
        for i, ((said, start, end), _, role) in enumerate([*repeated, *self.turns]):
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + start, "end": at + end})
            text.append(said)
            at += len(said)
        out = {"formatted": "".join(text), "n_tokens": self.size, "n_turns": len(self.turns), "repeated": len(repeated), "loss": loss}
        for i, turn in enumerate(self.turns):
            if self.fresh and i == 0 and turn[2] == "system":
                self.system = turn
            else:
                self.remember(turn)
        self.turns, self.fresh = [], False
        return out


def _turns(df: DataFrame) -> DataFrame:
    """``c, turn, tie, salt, role, text``: rows in the order of the last four before ``text``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select("c", "turn", F.xxhash64("role", "text").alias("tie"), F.lit(0).alias("salt"), "role", "text")


def _size() -> Column:
    """Bytes of a formatted turn, marks counted as 32; no turn has more tokens than that."""
    return (F.octet_length("role") + F.octet_length("text") + 32).cast("long")


def _blocks(rows: DataFrame, reach: int, block_bytes: int) -> DataFrame:
    """The turns of long conversations with ``block`` and ``kind``: 0 in the block that a turn
    starts in; -1 for a copy in a later block that may repeat it, as it ends within ``reach``
    bytes before that block's turns; -2 for the copies of a first system turn.

    Rows are range-partitioned, so a conversation may span tasks. Of each range the driver sees
    the first and last conversation, and how large its part of them is.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    dealt = dealt.repartitionByRange(partitions(spark), "c", "turn", "tie", "salt").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt.withColumn("size", _size()), "long-turns")
    ends = dealt.groupBy(F.col("part").alias("p")).agg(F.min(F.struct("c")).alias("low"), F.max(F.struct("c")).alias("high"))
    edge = ends.select("p", F.explode(F.array_distinct(F.array("low.c", "high.c"))).alias("e"))
    match = (F.col("part") == F.col("p")) & F.col("c").eqNullSafe(F.col("e"))
    sums = dealt.select("part", "c", "size").join(edge, match).groupBy("p", "e").agg(F.sum("size").alias("s")).collect()
    before, total = [], {}
    for r in sorted(sums, key=lambda r: r.p):
        before.append((r.p, r.e, total.get(r.e, 0)))
        total[r.e] = total.get(r.e, 0) + r.s
    offsets = spark.createDataFrame(before, f"p int, e {rows.schema['c'].dataType.simpleString()}, before long")
    w = Window.partitionBy("part", "c").orderBy("turn", "tie", "salt").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("end", F.sum("size").over(w))
    # At most two rows for each range.
    run = run.join(F.broadcast(offsets), (F.col("part") == F.col("p")) & F.col("c").eqNullSafe(F.col("e")), "left")
    end = F.col("end") + F.coalesce("before", F.lit(0))
    run = run.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    run = materialise(run.withColumn("block", F.floor(F.col("start") / block_bytes)).select("c", "turn", "tie", "salt", "role", "text", "start", "end", "block"), "long-blocks")
    last = run.groupBy(F.col("c").alias("e")).agg(F.max("block").alias("last"))
    own = F.array(F.struct("block", F.lit(0).alias("kind")))
    near = F.sequence(F.floor(F.col("end") / block_bytes), F.floor((F.col("end") + reach) / block_bytes))
    copies = F.transform(F.filter(near, lambda b: b > F.col("block")), lambda b: F.struct(b.alias("block"), F.lit(-1).alias("kind")))
    placed = run.select("c", "turn", "tie", "salt", "role", "text", F.inline(F.concat(own, F.when(~_first(), copies).otherwise(F.slice(own, 1, 0)))))
    system = run.where(_first()).join(last, F.col("c").eqNullSafe(F.col("e"))).where("last > 0")
    system = system.select("c", "turn", "tie", "salt", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("block"), F.lit(-2).alias("kind"))
    return placed.unionByName(system)


def _first() -> Column:
    """Whether a row is the system turn that opens its conversation."""
    return (F.col("start") == 0) & (F.col("role") == "system")


def _parts(conversations: DataFrame, budget: int, history: int, tokenizer: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The windows of conversations of one block, in order inside partitions, and of longer ones."""
    spark = conversations.sparkSession
    with open(tokenizer, "rb") as file:
        ranks = file.read()
    longest = max(len(base64.b64decode(line.split()[0])) for line in ranks.splitlines() if line)
    shared = spark.sparkContext.broadcast(ranks)
    rows = _turns(conversations)
    sizes = rows.groupBy(F.col("c").alias("e")).agg(F.sum(_size()).alias("s"))
    long = materialise(sizes.where(F.col("s") > block_bytes).select("e"), "long")
    same = F.col("c").eqNullSafe(F.col("e"))
    short = rows.join(long, same, "left_anti").select("*", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"))
    far = _blocks(rows.join(long, same, "left_semi"), history * longest, block_bytes) if not long.isEmpty() else short.limit(0)

    def windows(placed: DataFrame) -> DataFrame:
        dealt = placed.repartition("c", "block").sortWithinPartitions("c", "block", "kind", "turn", "tie", "salt")
        return dealt.select("c", "block", "kind", "role", "text").mapInArrow(run, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        key, state, number = None, None, 0
        out: list[dict] = []

        def keep(window: dict | None) -> None:
            nonlocal number
            if window:
                out.append({"conv_id": key[0], "block": key[1], "number": number, **window})
                number += 1

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return done

        for batch in slices(batches, 256):
            schema = pa.schema([pa.field("conv_id", batch.schema.field("c").type), *fields])
            for c, block, place, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (c, block):
                    if state:
                        keep(state.close())
                    key, state, number = (c, block), _Windows(budget, history), 0
                    state.fresh = block == 0
                said = format_turn(role, text)
                tokens = sum(len(encode(said[0][i : i + PIECE])) for i in range(0, len(said[0]), PIECE))
                turn = (said, tokens, role)
                if place == -2:
                    state.system = turn
                elif place == -1:
                    state.remember(turn)
                elif state.fresh and not state.turns and role == "system":
                    state.start(turn)
                else:
                    keep(state.add(turn))
            if len(out) >= 256:
                yield batch_of()
        if state:
            keep(state.close())
        if out:
            yield batch_of()

    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [pa.field(*f) for f in (("block", pa.int64()), ("number", pa.int64()), ("formatted", pa.string()), ("n_tokens", pa.int64()), ("n_turns", pa.int64()), ("repeated", pa.int64()), ("loss", loss))]
    kind = WINDOWS.format(kind=rows.schema["c"].dataType.simpleString())
    return windows(short), windows(far)


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``conv_id, block, number, formatted, n_tokens, n_turns, repeated, loss``: the windows of all
    conversations, in the order of ``block`` and ``number``.

    A window holds ``n_turns`` new turns after ``repeated`` earlier ones: the system turn, if the
    conversation begins with one, and the latest turns of up to ``history`` tokens. It has
    ``budget`` tokens at most, unless its system turn and a single new turn have more; then it
    holds these two. ``loss`` are the spans, in characters of ``formatted``, of the new assistant
    texts. A turn's tokens are those of its formatted text, tokenised by itself in pieces of
    ``PIECE`` characters with the vocabulary of ``tokenizer``, which the driver reads.

    Turns go by ``turn``, nulls first; equal ones by a hash of role and text. A null role is
    empty, a null text too; null conversation ids make one conversation. Repeated rows are turns
    each. Windows start anew with each ``block_bytes`` of a conversation, whatever the number of
    tasks. Other columns are left out; an empty table gives an empty result.
    """
    short, far = _parts(conversations, budget, history, tokenizer, block_bytes)
    return short.unionByName(far)


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` out of windows
    that lie in order, a conversation's one after the other in its partition. They stream by:
    no task holds a conversation."""
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[dict] = []

        def done() -> None:
            turns, loss = state.pop("turns"), state.pop("loss")
            out.append({"conv_id": key[0], **state, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

        for batch in slices(batches, 256):
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *fields])
            for row in batch.to_pylist():
                if key != (row["conv_id"],):
                    if key:
                        done()
                    key = (row["conv_id"],)
                    state = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                text = row["formatted"]
                for i, (role, said) in enumerate(read_turns(text)):
                    if i >= row["repeated"]:
                        state["n_turns"] += 1
                        state["turns"].update(f"{role}\n{said}\n".encode())
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode())
                state["formatted_chars"] += len(text)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if key:
            done()
            yield pa.RecordBatch.from_pylist(out, schema)

    fields = [pa.field("n_turns", pa.int64()), pa.field("turns_sha256", pa.string()), pa.field("loss_chars", pa.int64()), pa.field("loss_sha256", pa.string()), pa.field("formatted_chars", pa.int64())]
    return windows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_control_texts(conversations: DataFrame) -> DataFrame:
    """The conversations and one of id -1, whose two texts are made of control strings."""
    spark: SparkSession = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(added)


def chat_digest(conversations: DataFrame, **limits) -> DataFrame:
    """What reading the windows of ``with_control_texts`` back gives, for each conversation. The
    windows of a long conversation are brought into order first, and its digest, which can't be
    split, streams through one task."""
    settings = {"budget": BUDGET, "history": HISTORY, "tokenizer": TOKENIZER, "block_bytes": BLOCK_BYTES, **limits}
    short, far = _parts(with_control_texts(conversations), **settings)
    return read_back(short).unionByName(read_back(far.repartition("conv_id").sortWithinPartitions("conv_id", "block", "number")))
