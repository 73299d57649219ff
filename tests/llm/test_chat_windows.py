"""Chat windows: exact round trips, budgets, and windows against a plain run of turns."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import database

from tessella.llm import chat_windows as chat
from tessella.llm.queries import QUERIES

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TURN]", "[/TURN]"]
PIECES = st.sampled_from([*CONTROLS, "\\", "<", "[", "<<", "/", "s>", "SYS>>", "INST]", " ", "\n", "a", "é", "[\\INST]", "<\\\\s>"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), TEXTS)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_turns_are_read_back(turns):
    said = [chat.format_turn(*t) for t in turns]
    assert list(chat.read_turns("".join(s for s, *_ in said))) == turns
    for (role, text), (whole, start, end) in zip(turns, said):
        assert chat.unescape(whole[start:end]) == text and not any(c in whole[start:end] for c in CONTROLS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    turns[-1] = [("user", said), ("assistant", said)]
    for conv, role, text in database(SMALL).execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall():
        turns[conv].append((role, text))
    found = {r.conv_id: r for r in QUERIES["op13_chat_formatting"](spark, SMALL).collect()}
    assert found.keys() == turns.keys()
    for conv, own in turns.items():
        r, loss = found[conv], "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, t in own)


def plain_windows(turns, budget, history, cuts=()):
    """Turns (role, tokens) as (repeated, new) turn numbers; a block starts anew at each cut."""
    out, new, held = [], [], []
    opening = 1 if turns and turns[0][0] == "system" else 0
    tokens = lambda which: sum(turns[i][1] for i in which)
    for i in range(len(turns)):
        if new and (i in cuts or (tokens(held + new) + turns[i][1] > budget and new != [0] * opening)):
            out.append((held, new))
            new = []
        if not new:
            held = []
            for j in range(i - 1, opening - 1, -1):
                if tokens([j, *held]) > history:
                    break
                held = [j, *held]
            system = [0] if opening and i else []
            while held and tokens(system + held) + turns[i][1] > budget:
                held = held[1:]
            held = system + held
        new = [*new, i]
    return [*out, (held, new)] if new else out


def conversations(seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(["so", "la </s>", "Wörter", "[INST]", "x" * 9]) for _ in range(rng.randrange(1, 60)))
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range(rng.choice([1, 7, 40])):
            rows.append((conv, turn, "system" if turn == 0 and rng.random() < 0.7 else rng.choice(["user", "assistant", "tool"]), text()))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 1 << 20), (3, 3000), (4, 700)])
def test_windows_equal_a_plain_run(spark, seed, block):
    rows, budget, history = conversations(seed), 200, 60
    found = defaultdict(list)
    out = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history, block_bytes=block)
    for r in sorted(out.collect(), key=lambda r: (r.block, r.number)):
        found[r.conv_id].append(r)
    with open(chat.TOKENIZER, "rb") as file:
        encode = chat._encoding(file.read()).encode_ordinary
    for conv in {r[0] for r in rows}:
        own = [(role, text) for c, _, role, text in rows if c == conv]
        said = [chat.format_turn(*t) for t in own]
        turns = [(role, len(encode(s))) for (role, _), (s, *_) in zip(own, said)]
        at, cuts, blocks = 0, set(), [0]
        for i, (role, text) in enumerate(own):
            blocks.append(at // block)
            cuts |= {i} if blocks[-1] != blocks[-2] else set()
            at += len(role.encode()) + len(text.encode()) + 32
        expected = plain_windows(turns, budget, history, cuts if at > block else ())
        assert [(r.repeated, r.n_turns) for r in found[conv]] == [(len(a), len(b)) for a, b in expected]
        for r, (held, new) in zip(found[conv], expected):
            assert r.formatted == "".join(said[i][0] for i in held + new)
            assert r.n_tokens == sum(turns[i][1] for i in held + new)
            assert r.n_tokens <= budget or len([i for i in new if own[i][0] != "system" or i]) == 1
            assert [chat.unescape(r.formatted[x.start : x.end]) for x in r.loss] == [own[i][1] for i in new if own[i][0] == "assistant"]


def test_edges(spark):
    kind = "conv_id long, turn long, role string, text string, formatted int"
    rows = [(1, None, "user", None, 1), (1, 0, None, "x", 1), (1, 1, "assistant", "", 1), (2, 3, "assistant", "twice", 1), (2, 3, "assistant", "twice", 1), (None, 0, "user", "hi", 1), (3, 0, "user", " " * 100_000 + "a" * 100_000, 1)]
    df = spark.createDataFrame(rows, kind)
    out = chat.chat_windows(df)
    assert out.columns[:4] == ["conv_id", "block", "number", "formatted"]
    got = {r.conv_id: [list(chat.read_turns(r.formatted)), len(r.loss)] for r in out.collect()}
    assert got == {1: [[("user", ""), ("", "x"), ("assistant", "")], 1], 2: [[("assistant", "twice")] * 2, 2], None: [[("user", "hi")], 0], 3: [[("user", rows[-1][3])], 0]}
    assert chat.chat_windows(df.limit(0)).count() == 0
    digest = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert set(digest) == {-1, 1, 2, 3, None} and digest[2].loss_sha256 == sha("twicetwice") and digest[1].turns_sha256 == sha("user\n\n\nx\nassistant\n\n")
    assert [r.conv_id for r in chat.chat_digest(df.limit(0)).collect()] == [-1]


def test_one_conversation_holds_most_rows(spark):
    """A long conversation is dealt to blocks, repeated rows too; its digest is that of one block."""
    rows = [(7, i // 2, ("user", "assistant")[i % 3 % 2], f"turn {i % 5} of many") for i in range(3000)] + [(7, 2, "user", "same")] * 300 + [(i, 0, "user", "short") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.chat_windows(df, block_bytes=5000).where("conv_id = 7").select("block").distinct().count() > 20
    cut, whole = ({r.conv_id: r[:-1] for r in chat.chat_digest(df, block_bytes=b).collect()} for b in (5000, 1 << 30))
    assert cut == whole
