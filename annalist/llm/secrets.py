"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings with an allow-list.

A candidate is a maximal run of [A-Za-z0-9+/_=-]. A window of WINDOW characters slides over it; the counts of its
characters change by one in and one out, and with them the sum of n*log2(n), from which the window's Shannon entropy
follows, and the numbers of its characters in each class. The threshold depends on the character class of the window: digits and hexadecimal letters, letters and
digits of one case, or mixed case. Windows above it merge into one span. Windows without both a letter and a digit,
and what the allow-list knows, are suppressed: whole runs (UUIDs, paths of words), windows that touch a part between
separators which holds a placeholder's name, and windows that touch a sequence or a run of one character.

Positions are found in UTF-8 bytes and reported in code points, end exclusive.

Rows: a null or empty text has no spans. Very long texts are scanned whole. Repeated rows give repeated results, an
empty table none. Other columns of the input are ignored.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, arrow_map, pieces, text_buffers

# Fixed values of the contract: the three base kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # over lower-cased bytes
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")

WINDOW = 20
#: Least entropy, in bits a character, of a window of 20 by its class.
THRESHOLDS = {"hex": 3.0, "single": 3.5, "mixed": 3.75}
#: Of a whole run; names that no window may touch the part of; and what no window may touch.
ALLOWED = (
    re.compile(rb"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    re.compile(rb"^[A-Za-z]*([-_/=+][A-Za-z]*|[-_/=+][0-9]{1,4})*$"),
)
NAMES = re.compile(rb"(?i)example|sample|dummy|placeholder")
SEQUENCES = re.compile(rb"(?i)x{6,}|0{8,}|0123456789|abcdefghij")
_PART = re.compile(rb"[A-Za-z0-9]+")

_HEX = tuple(b for b in range(256) if b not in b"0123456789abcdef")
_CANDIDATE = tuple(b for b in range(256) if b not in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_LOG = [0.0, *(n * math.log2(n) for n in range(1, 257))]


#: Character classes as bits: digits, lower and upper case letters, hexadecimal letters, anything else.
DIGIT, LOWER, UPPER, HEX, OTHER = 1, 2, 4, 8, 16
_CLASSES = [
    sum(bit for bit, some in ((DIGIT, b"0123456789"), (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (HEX, b"abcdefABCDEF")) if c in some) or OTHER
    for c in range(256)
]


def windows(s: bytes, width: int = WINDOW):
    """(entropy, class or None) of every window, by counts that change by one character in and one out."""
    counts, total, out = [0] * 256, 0.0, []
    digits = lower = upper = hexa = 0
    bits, most = _CLASSES, math.log2(width)
    for i, c in enumerate(s):
        n = counts[c]
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        k = bits[c]
        digits += k & 1
        lower += k >> 1 & 1
        upper += k >> 2 & 1
        hexa += k >> 3 & 1
        if i >= width:
            c = s[i - width]
            n = counts[c]
            counts[c] = n - 1
            total -= _LOG[n] - _LOG[n - 1]
            k = bits[c]
            digits -= k & 1
            lower -= k >> 1 & 1
            upper -= k >> 2 & 1
            hexa -= k >> 3 & 1
        if i >= width - 1:
            kind = None
            if digits and lower + upper:
                kind = "hex" if digits + hexa == width else "mixed" if upper and lower else "single"
            out.append((most - total / width, kind))
    return out


def entropy_spans(s: bytes, width: int = WINDOW, thresholds=None, allowed=ALLOWED) -> list[tuple[int, int]]:
    """Merged spans of the windows of a candidate string above their class's threshold."""
    thresholds = thresholds or THRESHOLDS
    if len(s) < width or any(a.search(s) for a in allowed):
        return []
    touched = np.zeros(len(s) + 1, bool)
    for m in (*(p for p in _PART.finditer(s) if NAMES.search(p[0])), *SEQUENCES.finditer(s)):
        touched[max(0, m.start() - width + 1) : m.end()] = True
    spans: list[tuple[int, int]] = []
    touched = touched.tolist()
    for i, (h, kind) in enumerate(windows(s, width)):
        if kind and h >= thresholds[kind] and not touched[i]:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + width)
            else:
                spans.append((i, i + width))
    return spans


def _docs_with(raw: bytes, needle: bytes, offsets: np.ndarray) -> set[int]:
    """The documents of a piece in which the bytes occur (a hit across a border is sorted out by the patterns)."""
    found, at = set(), raw.find(needle)
    while at >= 0:
        d = int(np.searchsorted(offsets, at, side="right")) - 1
        found.add(d)
        at = raw.find(needle, max(at + 1, int(offsets[d + 1])))
    return found


def code_points(data: np.ndarray) -> np.ndarray:
    """Continuation bytes before each position; a byte position less these is a code point position."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) == 0x80, out=c[1:])
    return c


def piece_spans(data: np.ndarray, offsets: np.ndarray, thresholds=None, allowed=ALLOWED) -> dict[int, list[tuple[int, int, int]]]:
    """By document of a piece: (kind number, byte start, byte end) within the piece; kind 3 is the entropy scan's."""
    raw = data.tobytes()
    low, out = raw.lower(), {}
    put = lambda d, k, a, b: out.setdefault(d, []).append((k, a, b))
    for d in set().union(*(_docs_with(low, k, offsets) for k in KEYWORDS)):
        for m in ASSIGN.finditer(low, int(offsets[d]), int(offsets[d + 1])):
            if m.end(2) - m.start(2) >= 6:
                put(d, 0, m.start(), m.end())
    for d in _docs_with(raw, b"AKIA", offsets):
        for m in ACCESS.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if m.end() - m.start() >= 20:
                put(d, 1, m.start(), m.end())
    runs = Words(data, offsets, _HEX)
    for i in np.flatnonzero(runs.end - runs.start >= 24):
        put(int(np.searchsorted(offsets, runs.start[i], side="right")) - 1, 2, int(runs.start[i]), int(runs.end[i]))
    runs = Words(data, offsets, _CANDIDATE)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data < 58), out=digits[1:])
    for i in np.flatnonzero((runs.end - runs.start >= WINDOW) & (digits[runs.end] > digits[runs.start])):
        a, b = int(runs.start[i]), int(runs.end[i])
        for s, e in entropy_spans(raw[a:b], thresholds=thresholds, allowed=allowed):
            put(int(np.searchsorted(offsets, a, side="right")) - 1, 3, a + s, a + e)
    return out


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", thresholds=None, allowed=ALLOWED) -> DataFrame:
    """doc_id, base and found: arrays of (kind, start, end) in code points, ordered by start and kind."""
    names = (*KINDS, "entropy")

    def scan(batches):
        for p in pieces(batches, 1):
            data, offsets = text_buffers(p.column(1))
            cont, spans = code_points(data), piece_spans(data, offsets, thresholds, allowed)
            base, found = [], []
            for d in range(p.num_rows):
                at = int(offsets[d])
                mine = sorted((int(a - at - cont[a] + cont[at]), k, int(b - at - cont[b] + cont[at])) for k, a, b in spans.get(d, ()))
                base.append([{"kind": names[k], "start": a, "end": b} for a, k, b in mine if k < 3])
                found.append([{"kind": names[k], "start": a, "end": b} for a, k, b in mine if k == 3])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(base, kind), pa.array(found, kind)], names=["doc_id", "base", "found"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), scan, f"doc_id {dict(docs.dtypes)[id_col]}, base {spans}, found {spans}")


def digest(spans: str):
    """kind:start:end, comma-joined, of an array of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every document."""
    s = scan_secrets(docs, id_col, text_col)
    count = lambda of, k: F.size(F.filter(of, lambda x: x["kind"] == k)).cast("long")
    order = F.array_sort(F.transform(F.concat("base", "found"), lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "entropy"))), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return s.select("doc_id", *(count("base", k).alias(f"n_{k}") for k in KINDS), F.size("found").cast("long").alias("n_entropy"), F.sha2(digest("base"), 256).alias("base_sha256"), digest(order).alias("spans"))
