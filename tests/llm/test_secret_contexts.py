"""Credential contexts in which the guess-cost program must see the value."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from tessella.llm import secrets

VALUE = "zX8$kq!Lw92&Tt"
TEXTS = [
    ('password: "{}"', "X9#kL2$vQ!mT"),
    ("password={}", "p@ssK9$mQ2&vL7!"),
    ("secret = {}", "#kL2$vQ!mT8"),
    ('"api_key": "{}"', VALUE),
    ("the token is {} now", VALUE),
    ("DB_PWD={}", VALUE),
    ("user_passphrase: {}", VALUE),
    ("auth: bearer {}", VALUE),
    ("auth: basic {}", VALUE),
    ("credentials: password={}", VALUE),
    ("login {}", VALUE),
    ("auth: token is {}", VALUE),
]


@pytest.mark.parametrize("text, value", TEXTS)
def test_value_is_found(text, value):
    at = text.index("{}")
    assert secrets.find_secrets(text.format(value)) == [(at, 3, at + len(value))]


@pytest.mark.parametrize("text", ["passcode: changeme", "pwd=qwerty", "auth: bearer", "password is 123456"])
def test_cheap_values_are_not(text):
    assert secrets.find_secrets(text) == []


@pytest.mark.parametrize("text", ["pwd: {}", "password is {}", "secret={}", "passphrase = '{}'"])
def test_letters_only(text):
    """Cost alone decides; base patterns take what they know."""
    at = text.index("{}")
    found = secrets.find_secrets(text.format("xkqjzvwpmbtrhg"))
    assert found == [(0, 0, at + 14)] if text.startswith("secret") else found == [(at, 3, at + 14)]


def test_letters_after_a_blank():
    assert secrets.find_secrets("login information") == secrets.find_secrets("the login procedure") == []
    assert secrets.find_secrets("bearer xkQjzvWpmBtrhgLs") == [(7, 3, 23)]
    assert secrets.find_secrets("password is incorrect") == secrets.find_secrets("login: please enter") == []


def test_cost_is_the_least_over_all_segmentations():
    """Against all ways to cut short values."""
    ranks = secrets.word_ranks(["cat", "dog", "tree"])

    def segment(value, i, j):
        low = value.lower()
        costs = [secrets.pool_cost(value) * (j - i), secrets.word_cost(value[i:j], ranks) if j - i >= 3 else math.inf]
        costs += [cost for date, cost in ((secrets._YEAR, secrets.YEAR), (secrets._DATE, secrets.DAY)) if date.fullmatch(value[i:j])]
        if j - i >= 3 and all(pair in secrets._NEXT for pair in zip(low[i:j], low[i + 1 : j])):
            costs.append(secrets.WALK + secrets.STEP * (j - i - 1))
        if any(low[i:j] == low[i - p : j - p] for p in range(1, i + 1)):
            costs.append(math.log10(secrets.PERIODS) + secrets.AGAIN * (j - i))
        return min(costs) + secrets.SEGMENT

    rng = random.Random(2)
    for _ in range(120):
        value = "".join(rng.choice(["a", "cat", "D0g", "qwe", "12", "2019", "x!", "ab", "zz", "asd"]) for _ in range(rng.randint(1, 4)))[:10]
        least = math.inf
        for cuts in itertools.product((0, 1), repeat=len(value) - 1):
            ends = [0, *[k + 1 for k, cut in enumerate(cuts) if cut], len(value)]
            least = min(least, sum(segment(value, a, b) for a, b in zip(ends, ends[1:])))
        assert abs(secrets.guess_cost(value, ranks) - least) < 1e-9, value


def test_words_of_the_corpus_join_the_dictionary(spark):
    rows = [(i, f"correct horses like staples number {i}") for i in range(9)] + [(i, "password: xkqjzvwpmbtrhg") for i in range(20)] + [(0, None), (0, "")]
    words = secrets.corpus_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(words) >= {"correct", "horses", "like", "staples", "number"} and "xkqjzvwpmbtrhg" not in words
    # Six words are in nine documents each: ties go by the words, up to the bound.
    assert secrets.corpus_words(spark.createDataFrame(rows, "doc_id long, text string"), 3) == ["correct", "horses", "like"]
    assert secrets.corpus_words(spark.createDataFrame(rows, "doc_id long, text string"), 0) == []
    assert secrets.corpus_words(spark.createDataFrame(rows, "doc_id long, text string").limit(0)) == []
    ranks = secrets.word_ranks(words)
    assert secrets.guess_cost("correcthorsesstaples", ranks) < 10 < secrets.guess_cost("correcthorsesstaples")


def test_costs_are_found_without_reading_all():
    import random

    rng = random.Random(6)
    for _ in range(300):
        value = "".join(rng.choice(["a", "cat", "D0g", "qwe", "12", "2019", "x!", "ab" * 9, "zzzz", "password"]) for _ in range(rng.randint(1, 90)))
        whole = secrets.guess_cost(value)
        for least in (8.0, 25.0, 60.0):
            assert (secrets.guess_cost(value, enough=least) >= least) == (whole >= least)


def test_work_grows_with_the_text():
    """Half a million contexts in ten million characters: apart, in one run, and in one run that
    base spans overlap."""
    import time

    for piece, kinds in (("password=abcdefgh1 ", {0}), ("login=$a#login=$", {3}), ("pwd=aaaaa ", set()), ("secret=abcdefgh1$login=$x?", {0})):
        text, began = piece * (10_000_000 // len(piece)), time.time()
        found = secrets.find_secrets(text)
        assert {k for _, k, _ in found} == kinds and time.time() - began < 60, piece


def test_redaction_cuts_what_the_scan_lists(spark):
    text = "pwd: correcthorsesstaples and passphrase = X9#kL2$vQ!mT"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for words in (None, ["correct", "horses", "staples"]):
        spans = secrets.scan_secrets(df, words=words).where("doc_id = 1").first().spans.split(",")
        left, at = [], 0
        for _, start, end in (s.split(":") for s in spans):
            left += [text[at : int(start)], "[secret]"]
            at = int(end)
        assert [r.text for r in secrets.redact(df, words=words).orderBy("doc_id").collect()] == ["".join([*left, text[at:]]), None]
