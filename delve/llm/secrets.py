"""Secret scan: fixed patterns, and a guess-cost dynamic program for values that stand where credentials stand.

Base spans are the matches of three patterns.  The method looks at values in a credential's context (`pwd: …`, `passphrase is …`,
`login with …`), and finds for each the cheapest way to guess it: the value is cut into dictionary words, dates, repeats, keyboard walks and
brute-force spans so that the product of the parts' guesses is least.  A value no cheap way leads to is a secret.  Values of base spans
keep their span; those that a cheap way leads to are counted as weak.

The dictionary is a short list of common passwords, then the whole words of a public tokenizer's vocabulary file, which stand
in the order of their frequency; the file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import table, texts
from delve.llm.tokens import default_file

#: (kind, pattern, least length of the match or of the value); ASCII letters of the context are matched in either case.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
#: A run is matched whole, so a least length inside the pattern drops the same runs as a test of each match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "guess")

#: Contexts the method looks at beyond the base pattern.
_NAMED = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_ -]?key|private[_ -]?key|auth(?:orization)?)"
#: Group 1: an explicit sign (`:`, `=`) or `is`, group 2: where the value begins; RUN leads to its end.
CONTEXT = re.compile(_NAMED + r"[\"']?(?:(\x20{0,4}[:=]{1,2}>?\x20{0,4}|\x20is\x20)|\x20{1,4})[\"']?([!-~]{8})", re.I | re.A)
CREDENTIAL = re.compile(_NAMED, re.I | re.A)
RUN = re.compile(r"[!-~]*")
#: A lower-cased text without any of these has no credential context.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
#: Guesses (as a power of ten) from which a value is a secret, and how many of them must come from letters and digits that no word, date, repeat or
#: walk explains: prose and code stand in a credential's context too (`the token counter/limit`, `auth: middleware.configure()`).
THRESHOLD, UNEXPLAINED = 10.0, 6.0
#: And the share of what all its letters and digits would cost that must be unexplained.
EXPLAINED_LESS = 0.5
#: Bounds of the parts, in characters and units: a longer repeat is several, so the program is linear in the value's length.
LONGEST_WORD, LONGEST_REPEAT = 16, 64
#: No part is longer, in characters.
LONGEST_PART = 4 * LONGEST_REPEAT
#: Values up to this length are remembered by a worker.
REMEMBERED = 64

# Common passwords, most common first; the dictionary goes on with the tokenizer's words.
WORDS = """
password pass secret token admin root user login welcome qwerty letmein dragon monkey master shadow sunshine princess football baseball
superman batman iloveyou trustno test testing guest default changeme example sample dummy placeholder private public hello world love
money freedom whatever michael jordan hunter harley ranger buster thomas tiger robert soccer killer george charlie andrew michelle jessica
pepper daniel access joshua maggie starwars silver william dallas yankees ashley amanda orange summer winter spring autumn flower cookie
the and for you with that this from have not are your all can was but one our out day get has him his how man new now old see two way who
key value none null true false your_key here my data system server client database mysql oracle secure security account service
""".split()
# Rows of keys, left to right.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "9876543210", "0147258369")
# Letters often written as other characters.
LEET = str.maketrans("@4301!$57", "aaeoiisst")


@cache
def ranks(file: str | None = None) -> dict[str, int]:
    """The rank of each word of the dictionary: WORDS, then the words of three letters or more of the vocabulary file."""
    words = list(WORDS)
    if file:
        with open(file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        whole = (x.removesuffix("</w>") for x in sorted(vocabulary, key=vocabulary.get) if x.endswith("</w>"))
        words += [x for x in whole if len(x) >= 3 and x.isascii() and x.isalpha()]
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


#: Neighbouring keys, and which way along their row.
_NEXT: dict[tuple[str, str], int] = {}
for _row in ROWS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT.setdefault((_a, _b), 1)
        _NEXT.setdefault((_b, _a), -1)
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)", re.A)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def guess_cost(value: str, file: str | None = None, enough: float = math.inf) -> tuple[float, float, float]:
    """log10 of the guesses of the cheapest segmentation of value, how much of it letters and digits in brute-force spans make, and what all
    letters and digits would make.

    A part costs log10 of its own guesses, and log10(2) for the cut before it, unless it is the first: a word its rank, twice that if it is
    not in lower case, and twice if it is spelt with other characters; a date 365 days times the years; a repeat its unit's cost and the
    count; a keyboard walk its start, length and turns; a brute-force span each character's alphabet.  An empty value costs 0.  The whole
    value is read.  Only where `enough` is given, to learn whether the cost is at least that, does the search end at a place that every way
    passes at such a cost: the rest can but add to it, and the three numbers are those of that place.
    """
    return _remembered(value, file, enough) if len(value) <= REMEMBERED else _segmented(value, file, enough)


def _parts(value: str, low: str, plain: str, i: int, rank_of: dict[str, int]) -> Iterator[tuple[int, float]]:
    """(end, cost) of the parts from i on that are not brute-force spans."""
    n = len(value)
    for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
        for spelt, times in ((low[i:j], 1), (plain[i:j], 2)):
            if rank := rank_of.get(spelt):
                yield j, math.log10(rank * times * (1 if value[i:j].islower() else 2))
    if value[i].isdigit() and (m := _DATE.match(value, i)):
        yield m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)
        if _DATE.fullmatch(value, i, min(n, i + 4)):
            yield i + 4, math.log10(120)
    for size in (1, 2, 3, 4):
        j = i + size
        while j < i + LONGEST_REPEAT * size and value.startswith(value[i : i + size], j):
            j += size
        if (times := (j - i) // size) >= 2 + (size == 1):
            unit = sum(math.log10(_alphabet(c)) for c in value[i : i + size])
            if word := rank_of.get(low[i : i + size]):
                unit = min(unit, math.log10(word))
            for k in range(2, times + 1) if times <= 8 else (times,):
                yield i + k * size, unit + math.log10(k)
    turns, way, j = 0, 0, i + 1
    while j < n and j - i < 64 and (step := _NEXT.get((low[j - 1], low[j]))):
        turns += way not in (0, step)
        way, j = step, j + 1
        if j - i >= 4:
            yield j, math.log10(47 * (j - i) * 2 ** (turns + 1))


def _segmented(value: str, file: str | None, enough: float) -> tuple[float, float, float]:
    n, low, rank_of = len(value), value.lower(), ranks(file)
    plain = low.translate(LEET)
    no, cut = (math.inf, 0.0), math.log10(2)
    # the least (cost, of it unexplained) of value[:j] whose last part is a brute-force span, and whose last part is another
    brute, other = [no] * (n + 1), [(0.0, 0.0)] + [no] * n
    passed, alone = 0, 0.0  # places in a row that cost enough; what letters and digits cost if no part explains them
    for i in range(n):
        best = min(brute[i], other[i])
        passed = passed + 1 if best[0] >= enough else 0
        if passed > LONGEST_PART:
            return *best, alone
        before = cut if i else 0.0
        letter = math.log10(_alphabet(value[i]))
        own = letter if value[i].isalnum() else 0.0
        alone += own
        going, fresh = brute[i], other[i]
        brute[i + 1] = min((going[0] + letter, going[1] + own), (fresh[0] + before + letter, fresh[1] + own))
        for j, cost in _parts(value, low, plain, i, rank_of):
            other[j] = min(other[j], (best[0] + before + cost, best[1]))
    return *min(brute[n], other[n]), alone


_remembered = lru_cache(maxsize=20_000)(_segmented)


def hinted(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in HINTS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end, kind) of the base matches, in order: the match's own span, in code points."""
    found = []
    if hinted(text):
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def weak(value: str, file: str | None, threshold: float = THRESHOLD) -> bool:
    return guess_cost(value, file, threshold)[0] < threshold


def guess_spans(text: str, base: list, file: str | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, str]]:
    """Spans the method adds: values in a credential's context that overlap no base span and cost at least threshold.

    UNEXPLAINED holds as well, and more than half of the letters and digits are such that no part explains them: names, calls, URLs and headers cost
    much by their number of parts and separators, but words explain most of them.
    Letters alone are no value after a bare space.  A value that is not
    reported may be the word of the next context (`auth password: ...`), so the search goes on at its start; after a reported one, at its end, which
    need not be its run's: `pwd=...&token=...` holds two.
    """
    if not hinted(text):
        return []
    out, starts, ends = [], [], []
    for s, e in sorted((s, e) for s, _, e, _ in base):  # as disjoint spans
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    at = end = 0  # end: of the run that was seen last, so that no run is walked twice
    while m := CONTEXT.search(text, at):
        at = a = m.start(2)
        if a >= end:
            end = RUN.match(text, a).end()
        inner = CONTEXT.search(text, a, end)  # a value ends where the next context begins, so that no part of a run is priced twice
        b = inner.start() if inner else end
        while b > a and text[b - 1] in ".,;:!?)]}>\"'":
            b -= 1
        value, k = text[a:b], bisect_right(ends, a)
        if b - a < 8 or (m[1] is None and value.isalpha()) or CREDENTIAL.fullmatch(value.rstrip("=:>\"'")) or (k < len(starts) and starts[k] < b):
            continue
        cost, unexplained, alone = guess_cost(value, file)  # of the whole value: its end may explain or bear as much as its beginning
        if cost >= threshold and unexplained >= max(UNEXPLAINED, EXPLAINED_LESS * alone):
            out.append((a, 3, b, "guess"))
            at = b
    return out


def all_spans(text: str, file: str | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, str]]:
    base = base_spans(text)
    return sorted(base + guess_spans(text, base, file, threshold))


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


FIELDS = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, n_weak long"


def scan(docs: DataFrame, file: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, the counts of each kind, base_sha256, spans, and n_weak: assigned values of a cost under threshold.

    file: the vocabulary whose words follow WORDS in the dictionary.  Null and empty texts have no span, and the hash of the empty
    string.  Repeated rows: a row each.  Other columns are left out.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _NAMES]
            for text in texts(batch.column("text")):
                base = base_spans(text)
                spans = sorted(base + guess_spans(text, base, file, threshold))
                kinds = [k for *_, k in spans]
                n_weak = sum(weak(ASSIGN.fullmatch(text, a, b)[2], file, threshold) for a, _, b, k in base if k == "assign")
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n_weak]
                for x, v in zip(rows, row, strict=True):
                    x.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(look, f"doc_id long, {FIELDS}")


_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def mask(text: str, spans: list, sign: str = "[SECRET]") -> str:
    """text with each maximal run of overlapping spans replaced by sign."""
    out, at = [], 0
    for a, _, b, _ in spans:
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, file: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of text masked; rows without text stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                spans = all_spans(text or "", file, threshold)
                out.append(mask(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), default_file())
