"""PII: bootstrapped contextual extraction.

Entities of four fixed shapes are the seeds. The two words before an identifier-like run, and the two words after it,
are its lexical patterns; a run is one word or neighbouring words with digits, separated by single blanks. Patterns and
instances form a graph, counted in Spark over all documents. Rounds score it: a pattern is worth the share of its
distinct instances that are known, an instance the chance that one of its patterns is right. Patterns with enough known
instances and a high share then discover identifiers that no fixed shape has.

Positions are found in UTF-8 bytes and reported in code points, end exclusive.

Rows: a null or empty text has no spans. Very long texts are read whole; digit runs of any length take time in
proportion. An instance without two words on a side has no pattern there, and none if without on both. Rows of one id and equal texts share their
found spans; rows of one id and other texts don't. Null ids are kept. An empty table gives no rows; other columns are
ignored (redaction keeps them).
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, arrow_map, materialize, pieces, row_key, text_buffers
from .secrets import code_points, digest

# Fixed values of the contract: kinds and shapes of the seeds.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(rb"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # possessive: a dot never is a digit, so nothing is lost
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_RUN = re.compile(rb"[0-9]+")

#: A token with so many digits, or with an @, is identifier-like.
DIGITS = 4
ROUNDS, LEAST_KNOWN, PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE = 3, 3, 0.6, 0.7
#: Found spans of at most so many documents are broadcast for redaction, more are shuffled.
BROADCAST_ROWS = 200_000
_TRIM = b".,;:!?\"'()[]{}<>|*#%&$"
#: Words of patterns, and instances, of more bytes stand as their digests.
LONG_WORD = 64
LONG_INSTANCE = 256
#: What may be on either side of the blank inside a run.
_INNER = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz()+-/"))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def ips(raw: bytes, start: int, end: int):
    """Leftmost non-overlapping matches of IP, tried only where a run of digits starts: within a run they'd fail as well."""
    at = start
    while m := DIGIT_RUN.search(raw, at, end):
        if hit := IP.match(raw, m.start(), end):
            yield hit
            at = hit.end()
        else:
            at = m.end()


def octet(digits: bytes) -> bool:
    digits = digits.lstrip(b"0")
    return len(digits) < 3 or len(digits) == 3 and digits <= b"255"


def seeds(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed shapes in raw[start:end]."""
    out, last, at = [], start, raw.find(b"@", start, end)
    while at >= 0:
        # No @ is in a local part, so the leftmost match that holds this @ starts where the run before it does.
        m = DOMAIN.match(raw, at + 1, end)
        if m and at > last:
            a = at
            while a > last and raw[a - 1] in LOCAL:
                a -= 1
            if a < at:
                out.append((0, a, m.end()))
                last = m.end()
        at = raw.find(b"@", max(at + 1, last), end)
    for m in ips(raw, start, end):
        if all(map(octet, m[0].split(b"."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(raw, start, end):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(raw, start, end):
        if 8 <= sum(48 <= c < 58 for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _masked(word: bytes) -> bytes:
    """A word of a pattern: lower-cased, digits as 0, without punctuation; a long word by its digest."""
    word = re.sub(rb"[0-9]", b"0", word.strip(_TRIM).lower())
    return word if len(word) <= LONG_WORD else hashlib.sha256(word).hexdigest().encode()


def patterns_of(words: Words, raw: bytes, doc: int, start: int, end: int) -> list[str]:
    """The lexical patterns of an instance at raw[start:end]: the two words before it (<) and the two after it (>)."""
    first, last = int(words.of[doc]), int(words.of[doc + 1])
    i, j = np.searchsorted(words.start, [start, end])  # words that start before the instance, and before its end
    before = [(int(words.start[k]), min(int(words.end[k]), start)) for k in range(max(first, int(i) - 2), int(i))]
    after = [(int(words.start[k]), int(words.end[k])) for k in range(int(j), min(last, int(j) + 2))]
    text = lambda spans: b" ".join(_masked(raw[a:b]) for a, b in spans).decode(errors="replace")
    out = [("<" + text(before)) if len(before) == 2 else "", (">" + text(after)) if len(after) == 2 else ""]
    return [p for p in out if len(p) > 2]


def _identifiers(words: Words, raw: bytes, found: dict[int, list]) -> dict[int, list[tuple[int, int]]]:
    """Identifier-like runs, by document of a piece, outside the seeds.

    Neighbouring words with digits, one blank apart and without other punctuation at that blank, are one run. A run has
    DIGITS digits at least, or an @.
    """
    data = words.data
    marks = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum((data >= 48) & (data < 58), out=marks[0, 1:])
    np.cumsum(data == 64, out=marks[1, 1:])
    n = marks[:, words.end] - marks[:, words.start]
    some = np.flatnonzero(n.any(0))
    if not len(some):
        return {}
    doc = np.searchsorted(words.of, some, side="right") - 1
    # A run goes on where the next word of the document has digits too and a lone space is between digits or closing signs.
    a, b = some[:-1], some[1:]
    joined = (b == a + 1) & (doc[:-1] == doc[1:]) & (n[0, a] > 0) & (n[0, b] > 0) & (n[1, a] + n[1, b] == 0)
    joined &= (words.start[b] == words.end[a] + 1) & (data[np.minimum(words.end[a], len(data) - 1)] == 32)
    joined &= _INNER[data[words.end[a] - 1]] & _INNER[data[words.start[b]]]
    new = np.flatnonzero(np.append(True, ~joined))
    until = np.append(new[1:], len(some)) - 1
    total = np.add.reduceat(n[:, some], new, axis=1)
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero((total[0] >= DIGITS) | (total[1] > 0)).tolist():
        d, a, b = int(doc[new[k]]), int(words.start[some[new[k]]]), int(words.end[some[until[k]]])
        run = raw[a:b]
        a, b = a + len(run) - len(run.lstrip(_TRIM)), b - len(run) + len(run.rstrip(_TRIM))
        if a < b and not any(s < b and a < e for _, s, e in found.get(d, ())):
            out.setdefault(d, []).append((a, b))
    return out


def occurrences(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, key, base (seeds: kind, start, end) and seen (identifier-like: pattern, instance, kind or null, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seen = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for p in pieces(batches, 2):
            data, offsets = text_buffers(p.column(2))
            raw, cont = data.tobytes(), code_points(data)
            off = offsets.tolist()
            own = {d: s for d in range(p.num_rows) if (s := seeds(raw, off[d], off[d + 1]))}
            words = Words(data, offsets)
            other = _identifiers(words, raw, own)
            base, all_seen = [[] for _ in range(p.num_rows)], [[] for _ in range(p.num_rows)]
            for d in own.keys() | other.keys():
                at = off[d]
                point = lambda x: int(x - at - cont[x] + cont[at])  # noqa: B023, E731
                for k, a, b in sorted(own.get(d, ())):
                    base[d].append({"kind": KINDS[k], "start": point(a), "end": point(b)})
                for k, a, b in [*own.get(d, ()), *((None, a, b) for a, b in other.get(d, ()))]:
                    instance = raw[a:b].decode() if b - a <= LONG_INSTANCE else hashlib.sha256(raw[a:b]).hexdigest()
                    all_seen[d] += [{"pattern": x, "instance": instance, "kind": None if k is None else KINDS[k], "start": point(a), "end": point(b)} for x in patterns_of(words, raw, d, a, b)]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(base, span), pa.array(all_seen, seen)], names=["doc_id", "key", "base", "seen"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, key long, base array<struct<kind:string,start:long,end:long>>, seen array<struct<pattern:string,instance:string,kind:string,start:long,end:long>>"
    return arrow_map(docs.select(F.col(id_col), row_key(id_col, text_col), F.col(text_col)), run, schema)


def bootstrap(seen: DataFrame, rounds=ROUNDS, least_known=LEAST_KNOWN, pattern_confidence=PATTERN_CONFIDENCE, instance_confidence=INSTANCE_CONFIDENCE) -> DataFrame:
    """High-confidence patterns (pattern, kind, confidence) from the graph of seen rows (pattern, instance, kind).

    An instance of several kinds counts for each of them.
    """
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.collect_set("kind").alias("seeds")), "graph")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    known = edges.select("instance", F.explode("seeds").alias("kind"), F.lit(1.0).alias("worth")).distinct()
    seeds_ = known
    patterns = None
    for i in range(rounds):
        votes = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("worth").alias("known"))
        patterns = votes.join(size, "pattern").withColumn("confidence", F.col("known") / F.col("size")).where((F.col("known") >= least_known) & (F.col("confidence") >= pattern_confidence)).select("pattern", "kind", "confidence")
        patterns = materialize(patterns, "patterns")
        if i + 1 < rounds:
            wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
            new = edges.where("size(seeds) = 0").join(patterns, "pattern").groupBy("instance", "kind").agg((1 - wrong).alias("worth")).where(F.col("worth") >= instance_confidence)
            known = materialize(seeds_.unionByName(new), "known")
    return patterns


def found_spans(rows: DataFrame) -> DataFrame:
    """key and found (kind, start, end): the identifiers that high-confidence patterns discover in occurrences."""
    seen = rows.select("key", F.explode("seen").alias("s")).select("key", "s.*")
    patterns = bootstrap(seen.select("pattern", "instance", "kind"))
    hits = seen.where("kind is null").join(patterns.withColumnRenamed("kind", "found"), "pattern")
    best = hits.groupBy("key", "start", "end").agg(F.max(F.struct("confidence", "found"))["found"].alias("kind"))
    return best.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))


def extract_pii(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, base and found spans (kind, start, end) of every document."""
    rows = materialize(occurrences(docs, id_col, text_col), "occurrences")
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return rows.select("doc_id", "key", "base").join(found_spans(rows), "key", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def pii_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans."""
    s = extract_pii(docs, id_col, text_col)
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    order = F.array_sort(F.transform(F.concat("base", "found"), lambda x: F.struct(place(x).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *map(count, KINDS), F.size("found").cast("long").alias("n_found"), F.sha2(digest("base"), 256).alias("base_sha256"), digest(order).alias("spans"))


def redact(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """All columns of docs; in the text, every span is replaced by its kind in brackets."""
    rows = materialize(occurrences(docs, id_col, text_col), "occurrences")
    found = materialize(found_spans(rows), "found")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("shuffle_hash")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(text_col).alias("__text"), row_key(id_col, text_col).alias("key"))
    both = whole.join(found, "key", "left").select("__doc", "__text", "found")

    def run(batches):
        for p in pieces(batches, 1):
            data, offsets = text_buffers(p.column(1))
            raw, off = data.tobytes(), offsets.tolist()
            out = []
            for d, (text, found) in enumerate(zip(p.column(1).to_pylist(), p.column(2).to_pylist())):
                own = seeds(raw, off[d], off[d + 1])
                if text is None or not (own or found):
                    out.append(text)
                    continue
                cont = code_points(data[off[d] : off[d + 1]])
                spans = [(a - off[d] - int(cont[a - off[d]]), b - off[d] - int(cont[b - off[d]]), KINDS[k]) for k, a, b in own]
                spans += [(s["start"], s["end"], s["kind"]) for s in found or ()]
                parts, at = [], 0
                for a, b, kind in sorted(spans):
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(out, pa.string())], names=["__doc", "__new"])

    made = arrow_map(both, run, f"__doc {whole.schema['__doc'].dataType.simpleString()}, __new string")
    return made.select(*(F.col("__new").alias(c) if c == text_col else F.col(f"__doc.`{c}`") for c in docs.columns))
