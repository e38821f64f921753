"""Secret scan: fixed patterns, and the guess cost of values that stand where credentials stand."""
from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetide.llm.common import small_batches

# Base patterns, and least characters of the match (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

# Where credentials stand: wider than assign in words, separators and characters of the value; a quoted value goes to the closing quote on its line.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|passwort|kennwort|contrase(?:ñ|n)a|mot\x20de\x20passe|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth|credentials?|login)["']?[\x20\t]{0,4}(?:=>|:=|[:=])[\x20\t]{0,4}(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|["'`]?([^\s"'`<>(){}\[\],;]+))""",
    re.I,
)
HINTS = ("pass", "pwd", "kennwort", "contrase", "secret", "token", "key", "auth", "credential", "login")
SECRET_LOG10 = 8.0  # values that take at least so many guesses (log10) are secrets
LONGEST_WORD = 24
STEPS = 64

# Keys by row, and words that passwords begin with.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
COMMON = "password admin root user guest test login welcome master secret changeme default example dragon monkey letmein football baseball shadow sunshine princess iloveyou hello freedom whatever trustno batman superman pass".split()
SPOKEN = str.maketrans("4@8301!57$", "aabeoiists")


@lru_cache(1)
def _neighbours() -> dict[str, frozenset[str]]:
    at = {c: (i + r / 2, r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {c: frozenset(d for d, (y, s) in at.items() if d != c and abs(r - s) <= 1 and abs(x - y) <= 1) for c, (x, r) in at.items()}


@lru_cache(2)
def dictionary(path: str) -> dict[str, float]:
    """log10 of each word's place: common password words, then the letters-only pieces of a public vocabulary in its order."""
    words = list(COMMON)
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
            if 3 <= len(piece) <= LONGEST_WORD and piece.isalpha():
                words.append(piece)
    return {w: math.log10(i + 1) for i, w in enumerate(dict.fromkeys(words))}


def _per_character(value: str) -> float:
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: not c.isalnum(), 33), (lambda c: ord(c) > 127, 100))
    return math.log10(sum(n for test, n in kinds if any(map(test, value))) or 10)


_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _walks(value: str) -> tuple[list[int], list[int]]:
    """End of the longest walk over neighbouring keys from each place, and the changes of direction before each place."""
    near, n = _neighbours(), len(value)
    ends, changes = list(range(1, n + 1)), [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        if value[i + 1] in near.get(value[i], ()):
            ends[i] = ends[i + 1]
    for i in range(2, n):
        changes[i] = changes[i - 1] + (ord(value[i]) - ord(value[i - 1]) != ord(value[i - 1]) - ord(value[i - 2]))
    return ends, changes


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the fewest guesses that find value: least sum over its segmentations into words, dates, repeats, keyboard walks and brute force.

    Costs add along a path, so the best cost of each prefix is enough. A repeat costs its unit and the number of repeats;
    units are at most 8 characters long. Walks and repeats may end at each of their first STEPS places or at their last one,
    so that the work grows with the length of the value only.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters grow when made small
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    runs = [[0] * (n + 1) for _ in range(9)]  # characters from a place on that equal the one a unit later
    for unit in range(1, min(8, n // 2) + 1):
        for i in range(n - unit - 1, -1, -1):
            runs[unit][i] = runs[unit][i + 1] + 1 if value[i] == value[i + unit] else 0
    ends, changes = _walks(low)
    units: dict[str, float] = {}

    def unit_cost(unit: str) -> float:
        if unit not in units:
            units[unit] = guess_cost(unit, words)
        return units[unit]

    spoken, single = low.translate(SPOKEN), _per_character(value)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + single)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low, 0.0), (spoken, 0.5)):
                rank = words.get(text[i:j])
                if rank is not None:
                    upper = sum(map(str.isupper, value[i:j]))
                    cost = rank + extra + (0.0 if not upper else 0.3 if upper in (1, j - i) else math.log10(math.comb(j - i, upper) + 1))
                    best[j] = min(best[j], here + cost)
        if (date := _DATE.match(value, i)):
            best[date.end()] = min(best[date.end()], here + math.log10(365 * 60 if date.end() - i > 4 else 120))
        end = ends[i]
        for j in {*range(i + 3, min(end, i + STEPS) + 1), end} if end >= i + 3 else ():
            best[j] = min(best[j], here + math.log10(47 * (j - i)) + (1 + changes[j - 1] - changes[i + 1]) * math.log10(4))
        for unit in range(1, min(8, (n - i) // 2) + 1):
            times = 1 + runs[unit][i] // unit
            if times * unit >= 3 and times > 1:
                cost = single if unit == 1 else unit_cost(value[i:i + unit])
                for k in {*range(2, min(times, STEPS) + 1), times}:
                    if k * unit >= 3:
                        best[i + k * unit] = min(best[i + k * unit], here + cost + math.log10(k))
    return best[n]


def find_secrets(text: str, words: dict[str, float]) -> tuple[list[tuple[int, int, int]], float | None]:
    """(kind, start, end) spans, kind a place in KINDS, sorted by start and kind; the highest guess cost of a credential value, if there is one."""
    spans, highest, low = [], None, text.lower()
    assigned = [m for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if any(h in low for h in ("passw", "secret", "token", "api")) else []
    spans += [(0, m.start(), m.end()) for m in assigned]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    values = {m.span(2) for m in assigned}
    if any(h in low for h in HINTS):
        values |= {m.span(m.lastindex) if m.lastindex < 4 else (m.start(4), m.start(4) + len(m[4].rstrip(".!?:"))) for m in CONTEXT.finditer(text)}
    ends = []  # base spans, to leave out values that one of them holds
    base = sorted((s, e) for _, s, e in spans)
    reach = 0
    for s, e in base:
        reach = max(reach, e)
        ends.append(reach)
    k = 0
    for start, end in sorted(values):
        if end <= start:
            continue
        cost = guess_cost(text[start:end], words)
        highest = cost if highest is None else max(highest, cost)
        while k < len(base) and base[k][0] <= start:
            k += 1
        if cost >= SECRET_LOG10 and not (k and ends[k - 1] >= end):
            spans.append((3, start, end))
    return sorted(spans, key=lambda s: (s[1], s[0], s[2])), highest


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, guess_log10 double"


def _scan(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans, cost = find_secrets(text or "", words)
                base = [s for s in spans if s[0] < 3]
                counts = [sum(s[0] == k for s in spans) for k in range(4)]
                rows.append((*counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), counts[3], cost))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in SCHEMA.split(", ")])
    return run


def _hide(vocabulary: str, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for batch in batches:
            texts = [None if t is None else hide(t, find_secrets(t, words)[0]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
    return run


def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans replaced by a mark that names the first one's kind."""
    out, at = [], 0
    for k, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Spans of secrets in each row of docs (doc_id, text), and the highest guess cost of a credential value in it.

    Base spans come from fixed patterns. A value in credential context is one more span, kind guess, if the cheapest way to
    guess it takes 10^SECRET_LOG10 guesses and no base span holds it. Null and empty texts have no span. Repeated rows are
    scanned alike, a null doc_id stays null, other columns are not read, an empty table gives an empty one. One pass, no
    shuffle. vocabulary: path of a rank file on the executors.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(_path(vocabulary)), SCHEMA)


def redact_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs (text and any other columns) with a mark in the place of each secret; null texts stay null."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_hide(_path(vocabulary), docs.columns.index("text")), docs.schema)


def _path(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
