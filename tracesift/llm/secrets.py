"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

The fixed kinds are a keyword with an assigned value, access keys of one vendor's form and long hex
strings. The entropy kind slides a window over every candidate, a run of key characters; the window's
counts are kept up to date character by character, and its Shannon entropy follows from one running sum
of c * log2(c). A candidate's class, hexadecimal or mixed, sets the entropy that its windows need.
Candidates on the allow list are left alone. A placeholder clears only its piece between / and =, and what stands before and
after is scanned apart. In words without a digit and in slugs, windows lie within one unbroken segment.

Spans count code points, ends are exclusive. Defined cases: a null or empty text has no spans; other
columns pass through; repeated rows are scanned alike; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy of a window, in bits, by class of candidate. 20 different characters would have 4.32.
LEAST_BITS = {"hex": 3.1, "mixed": 3.9}

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F-]+\Z")
_ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),  # UUIDs
    re.compile(r"[-_=/+0-9]+\Z"),  # rules and plain numbers
)
_PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|xxxx|0{8}|1234567890|abcdefghij", re.I | re.A)
_SEGMENTED = (
    re.compile(r"[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*\Z"),  # words without a digit
    re.compile(r"([a-z0-9]+[/_-]){2,}[a-z0-9]*\Z"),  # paths and slugs in lower case
)
_PIECE, _SEGMENT = re.compile(r"[^/=]+"), re.compile(r"[A-Za-z0-9]+")
_TERM = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def entropy_span(text: str) -> tuple[int, int] | None:
    """From the start of the first window that is random enough to the end of the last, or None."""
    need = LEAST_BITS["hex" if _HEX_ONLY.match(text) else "mixed"]
    most = WINDOW * (log2(WINDOW) - need)  # of the sum of c * log2(c)
    counts: dict[str, int] = {}
    total, first, last = 0.0, -1, -1
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += _TERM[c + 1] - _TERM[c]
        if i >= WINDOW:
            gone = text[i - WINDOW]
            c = counts[gone]
            counts[gone] = c - 1
            total += _TERM[c - 1] - _TERM[c]
        if i >= WINDOW - 1 and total <= most:
            if first < 0:
                first = i - WINDOW + 1
            last = i + 1
    return (first, last) if last >= 0 else None


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """The spans of a candidate that are random enough and not on the allow list."""
    parts = [(0, len(text))]
    if _PLACEHOLDER.search(text):
        held = [(m.start(), m.end()) for m in _PIECE.finditer(text) if _PLACEHOLDER.search(m[0])]
        parts = list(zip([0, *(end for _, end in held)], [*(start for start, _ in held), len(text)], strict=True))
        parts = [(b - len(text[a:b].lstrip("/=")), a + len(text[a:b].rstrip("/="))) for a, b in parts]
    found = []
    for a, b in parts:
        part = text[a:b]
        if len(part) < WINDOW or any(allowed.match(part) for allowed in _ALLOWED):
            continue
        runs = [(m.start(), m[0]) for m in _SEGMENT.finditer(part) if not m[0].isdigit()] if any(s.match(part) for s in _SEGMENTED) else [(0, part)]
        found += [(a + at + span[0], a + at + span[1]) for at, run in runs if (span := entropy_span(run))]
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then in the order of KINDS."""
    found = []
    if _KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        found += [("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m[0])]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def secret_spans(df: DataFrame, text_col: str = "text", out_col: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Adds out_col, the spans as structs of kind, start and end. keep: the columns that stay, all unless given."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py() or "")] for t in texts], kind)]

    return add_columns(df, text_col, [(out_col, T.ArrayType(span))], make, keep)
