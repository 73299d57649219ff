"""Secret scans: base patterns and a password guess-cost dynamic program.

Values in a credential context (``pwd=``, ``passphrase is``, ``auth: bearer``) are segmented
at minimum cost into words, dates, repeats, keyboard walks and brute-force spans; the cost
is the decimal logarithm of the guesses an informed attacker needs. Values that cost enough
are secrets, placeholders like ``changeme`` are not. The attacker's dictionary is data: a
short list of passwords, then the words of the corpus by the documents that hold them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import materialise, replacing, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs shorter than 32 would be dropped, so they need not match.
HEX = re.compile(r"[0-9a-f]{32,}")
#: What comes before a value in a credential context; the group is a blank and no more.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|secret|token|api_?key)["']?(?:\x20*[:=]+>?\x20*|\x20+is\x20+)|(?<![^\W_])(?:pwd|passphrase|passcode|credentials?|auth|bearer|private_?key|access_?key|login)["']?(?:\x20*[:=]+>?\x20*|\x20+is\x20+|(\x20+)))(?:["']?(?:basic|digest|token)\x20+(?!is\x20|[:=]))?""",
    re.I | re.A,
)
#: Values are runs of these characters, of ``SHORTEST`` or more, maybe behind a quote.
VALUE, SHORTEST = re.compile(r"""[^\s"'<>,;]*"""), 6
#: One of these is in every match of ``ASSIGN`` or ``CONTEXT``, in lower case.
_HINTS = ("passw", "secret", "token", "apikey", "api_key", "pwd", "passphrase", "passcode", "credential", "auth", "bearer", "privatekey", "private_key", "accesskey", "access_key", "login")
KINDS = ("assign", "access", "hex", "guess")
#: Values that cost this many decimal digits of guesses or more are secrets.
MIN_COST = 8.0
#: The same for values of letters only after a blank, as in "login information": most are prose.
BARE_COST = 25.0

#: Common passwords and words, most common first.
WORDS = """password 123456 qwerty admin welcome letmein login secret dragon monkey football baseball master
shadow sunshine princess iloveyou trustno1 superman batman hello freedom whatever charlie jordan michael
changeme default example test testing user guest root token key pass word demo sample placeholder
summer winter spring autumn love money house computer internet server database access system company
your my the api insert here value string none null true false
please enter required invalid incorrect expired missing optional protected encrypted stored correct
change changed needed disabled enabled unknown hidden bearer undefined information""".split()
#: Words of the corpus, at most, that join the dictionary: the most common ones.
DICTIONARY = 20_000
#: Letters of a word of the dictionary: words shorter or longer are brute force.
WORD_LETTERS = (3, 20)
_LEET = str.maketrans("013457$@", "oieastsa")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"(?:19|20)\d\d([-./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-./])(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")


def _next_keys() -> set[tuple[str, str]]:
    at = {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


_NEXT = _next_keys()


def word_ranks(words: Iterable[str] = ()) -> dict[str, int]:
    """The rank of each word: ``WORDS`` first, then ``words`` in their order."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


def corpus_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The words of ``text`` by the number of documents that hold them, ``most`` at most.

    Runs of a-z, lower-cased, of ``WORD_LETTERS`` letters; values in credential contexts are
    left out, so that a secret does not teach the dictionary itself. Counted over all rows,
    partial counts first; words about as common as one another come in together or not at all,
    in the order of their counts, then of themselves. Null and empty texts have none.
    """
    low, high = WORD_LETTERS
    shown = F.regexp_replace("text", F.lit(f"(?i)(?:{ASSIGN.pattern.split('([A-Za-z')[0]}|{CONTEXT.pattern})" + r"[\"']?[^\s\"'<>,;]+"), F.lit(" "))
    found = docs.select(F.explode(F.array_distinct(F.split(F.lower(shown), "[^a-z]+"))).alias("w")).where(F.length("w").between(low, high))
    counts = materialise(found.groupBy("w").agg(F.count("*").alias("n")), "words")
    # A histogram of the counts, some thousand steps at most, tells how common a word must be;
    # so no task sends words that do not count. Of the last step, which may hold more words than
    # are left, the most common ones are taken by an ordered limit.
    step = F.floor(F.log2("n") * 64)
    left, least = most, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        least = row.step
        if row.words >= left:
            break
        left -= row.words
    if least is None or most < 1:
        return []
    common = counts.where(step > least).unionByName(counts.where(step == least).orderBy(F.desc("n"), "w").limit(left))
    return [r.w for r in sorted(common.collect(), key=lambda r: (-r.n, r.w))]


#: Costs, in decimal digits: any segment; a walk's first key and each further one; a repeat's
#: start (one of ``PERIODS`` distances) and each of its characters; a year and a date.
SEGMENT, WALK, STEP, PERIODS, AGAIN, YEAR, DAY = 0.3, math.log10(47), 0.3, 16, 0.05, math.log10(120), math.log10(43_800)


def word_cost(value: str, ranks: dict[str, int]) -> float:
    """Cost of a word of the dictionary, leet spelling and upper case included; else infinity."""
    low = value.lower()
    rank = ranks.get(low) or ranks.get(low.translate(_LEET))
    if not rank:
        return math.inf
    return max(SEGMENT, math.log10(rank + 1) + 0.5 * (low not in ranks) + 0.5 * (low != value))


def pool_cost(value: str) -> float:
    """Cost of a character by brute force: the sizes of the kinds of characters there are."""
    size = sum(n for n, kind in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(kind, value)))
    return math.log10(size + 33 * (not value.isalnum()) or 1)


def guess_cost(value: str, ranks: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """Decimal logarithm of the guesses for ``value`` at its cheapest segmentation; of a value that
    costs ``enough`` or more, maybe just that it does, found without reading all of it.

    The least over all segmentations: states for a running brute-force span, walk, and
    repeat of each distance make the work grow with the length alone. A repeat is a span
    equal to the one ``PERIODS`` characters or less before it.
    """
    ranks = _COMMON if ranks is None else ranks
    low, n, pool = value.lower(), len(value), pool_cost(value)
    best = [0.0] + [math.inf] * n
    brute = one = two = walk = math.inf
    repeat = [math.inf] * (PERIODS + 1)
    for i in range(n):
        here = best[i] + SEGMENT
        for end in range(i + WORD_LETTERS[0], min(n, i + WORD_LETTERS[1]) + 1):
            best[end] = min(best[end], here + word_cost(value[i:end], ranks))
        if value[i].isdigit():
            for date, cost in ((_YEAR, YEAR), (_DATE, DAY)):
                if m := date.match(value, i):
                    best[m.end()] = min(best[m.end()], here + cost)
        brute = min(brute, here) + pool
        near = i > 0 and (low[i - 1], low[i]) in _NEXT
        walk = min(two, walk) + STEP if near else math.inf  # of three keys or more
        two = one + STEP if near else math.inf
        one = here + WALK
        for p in range(1, min(PERIODS, i) + 1):
            repeat[p] = min(repeat[p], here + math.log10(PERIODS)) + AGAIN if low[i] == low[i - p] else math.inf
        best[i + 1] = min(best[i + 1], brute, walk, *repeat)
        # Costs only grow: what all that is under way costs by now, the whole does.
        if i % 64 == 63 and (least := min(brute, one, two, walk, *repeat, *best[i + 1 : i + 2 + WORD_LETTERS[1]])) >= enough:
            return least
    return best[n]


_COMMON = word_ranks()


def find_secrets(text: str | None, min_cost: float = MIN_COST, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order; kind indexes ``KINDS``."""
    text = text or ""
    spans = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        base: list[list[int]] = []
        for start, _, end in sorted(spans):
            if base and start <= base[-1][1]:
                base[-1][1] = max(end, base[-1][1])
            else:
                base.append([start, end])
        contexts = list(CONTEXT.finditer(text))
        # Contexts come in order, and so do their values: the base spans are passed once, and a run of
        # characters that holds the values of several contexts is read once.
        starts, last, run, near = {m.start() for m in contexts}, 0, 0, 0
        for context in contexts:
            start = context.end() + (text[context.end() : context.end() + 1] in ('"', "'"))
            # In "auth: bearer x" the value starts a context of its own.
            if start in starts or start < last:
                continue
            if start >= run:
                run = VALUE.match(text, start).end()
            if run - start < SHORTEST:
                continue
            while near < len(base) and base[near][1] <= start:
                near += 1
            if near < len(base) and base[near][0] < run:
                continue
            value = text[start:run]
            least = max(min_cost, BARE_COST) if context[1] and value.isalpha() else min_cost
            if guess_cost(value, ranks, least) >= least:
                spans.append((start, 3, run))
                last = run
    return sorted(spans)


def _spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _scanner(min_cost: float, ranks: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if ranks is None else ranks.value
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                found = find_secrets(text.as_py(), min_cost, known)
                count = [sum(k == kind for _, k, _ in found) for kind in range(len(KINDS))]
                base = _spans([x for x in found if x[1] < 3])
                rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), _spans(found)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            rest = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, t) for c, t in zip(columns, kinds))], [*batch.schema.names, *_NEW])

    return run


_NEW = ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")


def scan_secrets(docs: DataFrame, min_cost: float = MIN_COST, words: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, n_guess, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` of every finding in ``text``, in code points, by
    start and then kind; ``base_sha256`` digests those of the base patterns alone. Guess
    spans hold the value only and never overlap a base span; values of letters only after a
    blank, without : or = or "is", must cost ``BARE_COST``. ``words`` are ranked words for
    the dictionary behind the fixed ones, as from ``corpus_words``. Null and empty texts have
    no findings; repeated rows are scanned alike; other columns pass through, those named
    like the new ones are replaced; an empty table gives an empty result. No text is shuffled.
    """
    docs = replacing(docs, *_NEW)
    new = [T.StructField(c, T.LongType() if c.startswith("n_") else T.StringType()) for c in _NEW]
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(words)) if words else None
    return docs.mapInArrow(_scanner(min_cost, ranks), T.StructType([*docs.schema.fields, *new]))


def secrets_digest(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs.select("doc_id", "text"), words=corpus_words(docs)).drop("text")


def redact(docs: DataFrame, mask: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; null stays null. With the
    ``words`` that ``scan_secrets`` got, these are the spans that it lists."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(words)) if words else None

    @F.pandas_udf("string")
    def cut(texts):
        known = None if ranks is None else ranks.value

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end in find_secrets(text, ranks=known):
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", cut("text"))
