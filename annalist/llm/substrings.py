"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark, merged into maximal intervals.

A word goes if some window over it also starts earlier (smaller id, or same id and smaller position). Every window of
every document is hashed. A task first settles the windows that repeat among its own documents: all but the earliest
occurrence go, straight to the shard of their document, and only the earliest is sent to a hash bucket, so a passage
that a third of all documents share costs a bucket one entry a block. Buckets compare what blocks sent; the positions
that go follow to the shards of documents, where overlapping windows merge into maximal intervals. Entries travel
packed, about ten bytes each.

Windows are compared by 64-bit hashes within buckets chosen by a second, independent hash, and above WIDE_BYTES of
input by 32 more bits of that.

Rows: a null or empty text has no words; its digest is that of the empty string. Ids are integers; a null id comes
after all others. Rows of one id are one document's: equal rows don't remove one another, and rows of one id and
different texts are ordered by position alone. An empty table gives no rows. Other columns are ignored. Very long texts
are blocks of their own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Entries, Words, arrow_map, block_size, materialize, mix, n_buckets, pack, pieces, plan_bytes, rolling, text_buffers, unpack, whole

WINDOW = 20  # fixed value of the contract
#: Windows that a task gathers at least before it settles and sends them (about 60 MB).
BLOCK = 1 << 20
WIDE_BYTES = 1 << 40
LAST = (1 << 63) - 1  # stands for a null id


def later(h: np.ndarray, h2: np.ndarray | None, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries have an earlier one, by id and start, of the same hash."""
    out = np.zeros(len(h), bool)
    if len(h) < 2:
        return out
    order = np.argsort(h) if h2 is None else np.lexsort((h2, h))
    same = h[order[1:]] == h[order[:-1]]
    if h2 is not None:
        same &= h2[order[1:]] == h2[order[:-1]]
    dup = np.zeros(len(h), bool)
    dup[1:] |= same
    dup[:-1] |= same
    i = order[dup]
    if not len(i):
        return out
    keys = (starts[i], ids[i], h[i]) if h2 is None else (starts[i], ids[i], h2[i], h[i])
    i = i[np.lexsort(keys)]
    new = np.ones(len(i), bool)
    new[1:] = h[i[1:]] != h[i[:-1]]
    if h2 is not None:
        new[1:] |= h2[i[1:]] != h2[i[:-1]]
    first = i[new][np.cumsum(new) - 1]
    out[i[(ids[i] != ids[first]) | (starts[i] != starts[first])]] = True
    return out


def _by_shard(ids, tags, doc, starts, shards: int) -> list[tuple]:
    """(shard, packed positions) of positions that go, by shard of documents."""
    shard = (mix(ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)[doc]
    order = np.lexsort((starts, doc, shard))
    doc, starts, shard = doc[order], starts[order], shard[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[a]), *Entries.packed(ids, tags, doc[a:b], starts[a:b])) for a, b in zip(edges, np.append(edges[1:], len(shard)))]


def _sent(buckets: int, wide: bool, width: int):
    """The map side: blocks of windows; rows with the entries to compare, by bucket, and rows with what goes, by shard.

    Both travel in one exchange: the part of a shard is its number behind those of the buckets.
    """
    bits = np.uint64(64 - (buckets - 1).bit_length())
    names = ["part", "hashes", "check", *Entries.NAMES]

    def flush(parts):
        ids, tags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
        doc = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        start, h, g = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        gone = later(h, g if wide else None, ids[doc], start)
        rows = [(buckets + shard, None, None, *packed) for shard, *packed in _by_shard(ids, tags, doc[gone], start[gone], buckets)]
        keep = np.flatnonzero(~gone)
        bucket = (g[keep] >> bits).astype(np.int64) if buckets > 1 else np.zeros(len(keep), np.int64)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            mine = keep[order[edges[b] : edges[b + 1]]]
            check = pack(g[mine].astype(np.uint32), compress=False) if wide else b""
            rows.append((b, pack(h[mine], compress=False), check, *Entries.packed(ids, tags, doc[mine], start[mine])))
        kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches):
        parts, held = [], 0
        for p in pieces(batches, 2):
            words = Words(*text_buffers(p.column(2)))
            values = words.hashes()
            ok = np.flatnonzero(whole(words.of[:-1], width, len(values)))
            if not len(ok):
                continue
            doc = words.doc()[ok]
            ids = p.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = p.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            h, g = rolling(values, width)[ok], mix(rolling(values, width, base=0x27BB2EE687B0B0FD)[ok])
            parts.append((ids, tags, doc, ok - words.of[doc], h, g))
            held += len(ok)
            if held >= block_size(BLOCK, buckets):
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run, "part int, " + ", ".join(f"{n} binary" for n in names[1:])


def _rows(table: pa.Table):
    """All entries of packed rows: ids and tags of documents, the document of each entry, starts."""
    got = [Entries.unpacked(*x) for x in zip(*(table.column(n).to_pylist() for n in Entries.NAMES))]
    ids, tags, n, starts = (np.concatenate([g[k] for g in got]) for k in range(4))
    return ids, tags, np.repeat(np.arange(len(ids)), n), starts


def _compared(wide: bool, shards: int):
    """The reduce side of one bucket: the positions that go, packed by shard of documents. A shard's part goes on as it is."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= shards:
            return pa.Table.from_arrays([pa.array([part - shards] * table.num_rows, pa.int32()), *(table.column(n) for n in Entries.NAMES)], names=["shard", *Entries.NAMES])
        ids, tags, doc, starts = _rows(table)
        h = np.concatenate([unpack(x) for x in table.column("hashes").to_pylist()])
        g = np.concatenate([unpack(x) for x in table.column("check").to_pylist()]) if wide else None
        gone = later(h, g, ids[doc], starts)
        out = _by_shard(ids, tags, doc[gone], starts[gone], shards)
        kinds = [pa.int32()] + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["shard", *Entries.NAMES])

    return run, "shard int, " + ", ".join(f"{n} binary" for n in Entries.NAMES)


def _merged(width: int):
    """One shard of documents: the maximal intervals of words that go."""

    def run(table: pa.Table) -> pa.Table:
        ids, tags, doc, starts = _rows(table)
        ids, tags = ids[doc], tags[doc].astype(np.int64)
        order = np.lexsort((starts, tags, ids))
        ids, tags, starts = ids[order], tags[order], starts[order]
        new = np.ones(len(ids), bool)
        other = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
        new[1:] = other | (starts[1:] > starts[:-1] + width)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(ids)) - 1
        begin, end = starts[at], starts[last] + width
        owner = np.flatnonzero(np.append(True, other)) if len(ids) else at
        of = np.append(np.searchsorted(at, owner), len(at)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(x, pa.int32())) for x in (begin, end)]
        return pa.Table.from_arrays([pa.array(ids[owner], pa.int64()), pa.array(tags[owner], pa.int64()), *lists], names=["id", "tag", "begins", "ends"])

    return run, "id long, tag long, begins array<int>, ends array<int>"


def _key(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def _tag(text_col: str):
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF))


def removal_intervals(docs: DataFrame, window=WINDOW, id_col="doc_id", text_col="text") -> DataFrame:
    """id (a null one as 2**63-1), tag, and the begins and ends of the maximal intervals of words to remove; documents without any have no row."""
    buckets = n_buckets(docs)
    wide = plan_bytes(docs) > WIDE_BYTES
    run, schema = _sent(buckets, wide, window)
    sent = arrow_map(docs.select(_key(id_col), _tag(text_col), F.col(text_col)), run, schema)
    gone = sent.groupBy("part").applyInArrow(*_compared(wide, buckets))
    return gone.groupBy("shard").applyInArrow(*_merged(window))


def dedup_substrings(docs: DataFrame, window=WINDOW, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words, joined by one space) of every document."""
    spans = materialize(removal_intervals(docs, window, id_col, text_col), "spans")

    def cut(batches):
        for p in pieces(batches, 1):
            raw, off = text_buffers(p.column(1))
            raw, off = raw.tobytes(), off.tolist()
            n, gone, kept = [], [], []
            for d, (begins, ends) in enumerate(zip(p.column(2).to_pylist(), p.column(3).to_pylist())):
                words = raw[off[d] : off[d + 1]].split()
                n.append(len(words))
                if begins:
                    left, at = [], 0
                    for a, b in zip(begins, ends):
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    left = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _key(id_col).alias("id"), _tag(text_col).alias("tag"))
    both = left.join(spans.hint("shuffle_hash"), ["id", "tag"], "left").select("doc_id", "text", "begins", "ends")
    return arrow_map(both, cut, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_text string")


def substring_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs, id_col=id_col, text_col=text_col).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
