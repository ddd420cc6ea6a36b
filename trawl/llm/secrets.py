"""Secret scans: fixed key patterns and a randomness test battery.

Three base patterns find assignments, access keys and hexadecimal digests. The
battery looks at the other long tokens: it infers the smallest encoding whose
alphabet holds all characters and asks whether chi-squared uniformity, runs and
serial correlation of the symbols are those of random draws. What passes is a
discovery against the hypothesis "written by people": its p-value is the
inverse likelihood ratio of random draws over a model of names and words, which
by Markov's inequality bounds the chance of so large a ratio at any length, so
short tokens need clearer evidence. Benjamini and Hochberg's step-up over the
tokens of a text holds the false discovery rate.

Work is per text: one map stage, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawl.llm.common import in_batches

KINDS = ("assign", "access", "hex", "random")
#: False discovery rate among the tokens of a text, and the level at which randomness is refused.
FDR, REFUSE = 1e-3, 1e-3
MIN_TOKEN = 20
#: How many times stronger the evidence must be for a token without a digit. Digits alone are never found: numbers of all kinds look random.
LETTERS_ONLY = 1000
REDACTED = "[secret]"


def _either(word: str) -> str:
    """The word in either case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile("[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
UUID = re.compile("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A text that this doesn't match has no span of any kind (RE2 syntax).
MAY_HOLD = "(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{%d}" % MIN_TOKEN

_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("digits", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UP + "234567"),
    ("letters", _LOW), ("LETTERS", _UP), ("Letters", _UP + _LOW), ("base36", _DIGITS + _LOW), ("BASE36", _DIGITS + _UP), ("base62", _DIGITS + _UP + _LOW),
    ("base64", _UP + _LOW + _DIGITS + "+/"), ("base64url", _UP + _LOW + _DIGITS + "-_"), ("any", _UP + _LOW + _DIGITS + "+/-_"),
)
_SETS = [(n, a, frozenset(a)) for n, a in ENCODINGS]
#: Relative frequencies of a-z in European prose, in thousandths.
LETTERS = dict(zip(_LOW, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
_TOTAL = sum(LETTERS.values())
#: log P of the next character's class in names and words: the same, or another of the three others.
STAY, LEAVE = math.log(0.9), math.log(0.1 / 3)


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3


_PROSE = {c: math.log((LETTERS[c.lower()] / _TOTAL) if c.isalpha() else 0.1 if c.isdigit() else 0.25) for c in _UP + _LOW + _DIGITS + "+/-_"}
_CLASS = {c: _class(c) for c in _PROSE}


def battery(symbols: list[int], size: int) -> float:
    """Bonferroni's p-value of three tests that the symbols are uniform, independent draws from ``size``."""
    n = len(symbols)
    counts = [0] * size
    for s in symbols:
        counts[s] += 1
    chi = sum(c * c for c in counts) * size / n - n
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = [2 * s >= size for s in symbols]
    p = (size - (size + 1) // 2) / size
    changes = sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * p * (1 - p)
    runs = math.erfc(abs(changes - (n - 1) * expected) / math.sqrt(2 * (n - 1) * expected * (1 - expected)))
    mean = sum(symbols) / n
    spread = sum((s - mean) ** 2 for s in symbols)
    serial = 0.0
    if spread:
        r = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:], strict=False)) / spread
        serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return min(1.0, 3 * min(uniform, runs, serial))


def evidence(token: str) -> float:
    """Upper bound of the chance that words or names look this random; 1 when the battery refuses randomness."""
    body = token.rstrip("=")
    held = set(body)
    name, alphabet, _ = next(x for x in _SETS if held <= x[2])
    if name == "digits" or UUID.fullmatch(body):
        return 1.0
    at = {c: i for i, c in enumerate(alphabet)}
    if battery([at[c] for c in body], len(alphabet)) < REFUSE:
        return 1.0
    prose = _PROSE[body[0]]
    for a, b in zip(body, body[1:], strict=False):
        prose += _PROSE[b] + (STAY if _CLASS[a] == _CLASS[b] else LEAVE)
    # Words of a language that the model doesn't know are letters, so letters alone need more.
    more = 0.0 if held & set(_DIGITS) else math.log(LETTERS_ONLY)
    return math.exp(min(0.0, prose + len(body) * math.log(len(alphabet)) + more))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans and, where none of them lies, the tokens that the battery discovers."""
    out = base_spans(text)
    tested = []
    for m in TOKEN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b, _ in out):
            tested.append((evidence(m.group()), m.start(), m.end()))
    tested.sort()
    found = max((i for i, (p, _, _) in enumerate(tested, 1) if p <= FDR * i / len(tested)), default=0)
    out += [(a, b, "random") for _, a, b in tested[:found]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by one mark."""
    parts, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            parts += [text[at:a], REDACTED] if a >= at else []
            at = end = b
        else:
            at = end = max(end, b)
    return "".join([*parts, text[at:]])


FOUND = T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("n_random", "long").add("base_sha256", "string").add("spans", "string")


def scan(df: DataFrame, text_col: str = "text", keep_text: bool = False, redacted: bool = False) -> DataFrame:
    """``df`` (without its text unless asked for) with the counts by kind, base_sha256 and spans of each whole text.

    ``redacted`` replaces the text's spans by marks. Null texts count as empty
    and stay null. Offsets are code points, ends exclusive. New columns replace
    columns of the same name; repeated rows each get a row.
    """
    taken = {f.name for f in FOUND.fields}
    others = [c for c in df.columns if c.lower() not in taken and (keep_text or c != text_col)]
    schema = T.StructType([*df.select(*others).schema.fields, *FOUND.fields])
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            rows = [(0, 0, 0, 0, empty, "")] * batch.num_rows
            changed = {}
            may = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), MAY_HOLD), False)
            for i in pc.indices_nonzero(may).to_pylist():
                text = texts[i].as_py()
                spans = find_spans(text)
                kinds = [k for _, _, k in spans]
                base = joined([s for s in spans if s[2] != "random"])
                rows[i] = (*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans))
                if redacted and spans:
                    changed[i] = redact(text, spans)
            columns = []
            for c in others:
                column = batch.column(c)
                if c == text_col and changed:
                    mask = [i in changed for i in range(batch.num_rows)]
                    column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(dict(sorted(changed.items())).values()), column.type))
                columns.append(column)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            found = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            columns += [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return in_batches(df.select(*dict.fromkeys([*others, text_col])), run, schema)
