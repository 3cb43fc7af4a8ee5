"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays.

Counting takes two passes over the training rows. The first counts words: blocks send their distinct words' hashes,
hash shards add up and write sorted arrays (hash, count); a word's id is its place in the order of all hashes. The
second counts trigrams of ids the same way, dealt to buckets by the middle word. So a bucket has all that it takes to
write three tables of its words: counts of trigrams, statistics of their contexts, and for each pair of neighbours its
number of different words before it. A middle word that holds more than a bucket's share of all tokens is spread over
several buckets by the whole trigram; these send their part sums of contexts and pairs on, dealt by the other word of
the pair, and those who add them up write the tables. Statistics of pairs go to the shards of the words, which write
them as arrays by id.

Scoring is one pass: workers memory-map the arrays from the shared folder and look their pieces' distinct words, pairs
and trigrams up by binary search. No model data goes through the driver but a few numbers for each shard and bucket.

The order is 3, or 2 as a parameter. A text's first word follows a start mark, and the pairs of that count as often as
they occur, for nothing comes before it; with order 2 all pairs do. Trigrams and pairs are told apart by hashes of
64 bits while they are counted, and by about 32 bits and the logarithm of a bucket's trigrams when looked up (tables.py).

Rows: a null or empty text has only the end token. Ids may be null (then a row is for training) or repeated (each row
counts). Without training rows N and V are 0: the base score of a text is 0 for each token and the model is uniform
over one word. An empty table gives no rows. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, tables
from .blocks import BATCH_BYTES, PIECE_BYTES, Words, arrow_map, block_size, int_array, materialize, mix, n_buckets, pack, pieces, shared_path, text_buffers, unpack

#: The model's order.
ORDER = 3
#: Tokens that a map task gathers at least before it sends their counts.
BLOCK = 1 << 20
END = mix(np.array([0x656E64], np.uint64))[0]  # the hash of the end token


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    """Rows that are never learned from: crc32 of the id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def token_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, of): each text's lower-cased words and its end."""
    words = Words(*text_buffers(column))
    n = len(words.of) - 1
    of = words.of + np.arange(n + 1)
    out = np.empty(of[-1], np.uint64)
    inner = np.ones(of[-1], bool)
    inner[of[1:] - 1] = False
    out[inner] = words.hashes(lower=True)
    out[~inner] = END
    return out, of


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts[order], at)


def _least(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned integers that hold the values."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, sorted, the place of one of each, the place of every value among them)."""
    order = np.argsort(h)
    new = np.append(True, np.diff(h[order]) != 0) if len(h) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    at = order[new]
    return h[at], at, back


def _packed_by(bucket: np.ndarray, columns: list[np.ndarray], raw: tuple[int, ...] = ()) -> list[tuple]:
    """(bucket, packed columns) for rows that are in order of their buckets."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[a]), *(pack(c[a:b], compress=k not in raw) for k, c in enumerate(columns))) for a, b in zip(at, np.append(at[1:], len(bucket)))]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


# --- words -----------------------------------------------------------------------------------------------------


def _word_blocks(shards: int):
    bits = np.uint64(64 - (shards - 1).bit_length())
    names = ["shard", "hashes", "counts"]

    def flush(parts):
        h, c = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return _batch(_packed_by(h >> bits, [h, c], raw=(0,)), names)

    def run(batches):
        parts, held = [], 0
        for p in pieces(batches, 0):
            parts.append(_summed(token_hashes(p.column(0))[0]))
            held += len(parts[-1][0])
            if held >= block_size(BLOCK, shards):
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run, "shard int, hashes binary, counts binary"


def _word_shard(folder: str, hot_share: int):
    """Adds up a shard's words and writes them; returns its size and the words that may be hot."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h = np.concatenate([unpack(x) for x in table.column("hashes").to_pylist()])
        c = np.concatenate([unpack(x).astype(np.int64) for x in table.column("counts").to_pylist()])
        h, c = _summed(h, c)
        arrays.save(folder, f"word-hash-{shard}", h)
        arrays.save(folder, f"word-count-{shard}", _least(c))
        hot = np.argsort(-c, kind="stable")[:hot_share]
        return pa.Table.from_arrays([pa.array([shard], pa.int32()), int_array([len(h)]), int_array([c.sum()]), pa.array([hot.tolist()], pa.list_(pa.int64())), pa.array([c[hot].tolist()], pa.list_(pa.int64()))], names=["shard", "types", "tokens", "hot", "hot_counts"])

    return run, "shard int, types long, tokens long, hot array<long>, hot_counts array<long>"


class Lookup:
    """Ids and counts of words, by the shards' sorted arrays."""

    def __init__(self, folder: str, shards: int, offsets: list[int]):
        self.folder, self.bits = folder, np.uint64(64 - (shards - 1).bit_length())
        self.offsets = np.asarray(offsets, np.int64)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of sorted distinct hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = (h >> self.bits).astype(np.int64)
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(h) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(h))):
            s = int(shard[a])
            if self.offsets[s + 1] == self.offsets[s]:
                continue
            have = arrays.mapped(self.folder, f"word-hash-{s}")
            place = np.minimum(np.searchsorted(have, h[a:b]), len(have) - 1)
            found = have[place] == h[a:b]
            ids[a:b][found] = place[found] + self.offsets[s]
            counts[a:b][found] = arrays.mapped(self.folder, f"word-count-{s}")[place[found]]
        return ids, counts


# --- n-grams ---------------------------------------------------------------------------------------------------

#: What most rows of a table say: a trigram or pair counted once, a context of one trigram seen once.
ONCE, ONE_TYPE = (1,), (1, 1, 0, 0)


def gram_hash(*ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-grams, given as columns of ids."""
    h = mix(ids[0].astype(np.uint64))
    for i in ids[1:]:
        h = mix(h + i.astype(np.uint64))
    return h


class Deal:
    """Which bucket an n-gram belongs to, by one word; hot words have buckets of their own, several if they hold that much."""

    def __init__(self, n_ids: int, buckets: int, hot: dict[int, int]):
        self.n_ids, self.buckets = n_ids, buckets
        self.hot = np.array(sorted(hot), np.int64)
        self.parts = np.array([hot[x] for x in self.hot.tolist()], np.int64)
        self.first = buckets + np.cumsum(self.parts) - self.parts

    def __call__(self, word: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Buckets by word; the salt spreads those of hot words."""
        bucket = word * self.buckets // self.n_ids
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == word)
            at = at[own]
            bucket[own] = self.first[at] + (salt[own] % self.parts[at].astype(np.uint64)).astype(np.int64)
        return bucket

    def word(self, bucket: int) -> int:
        """The hot word that a bucket belongs to, or -1."""
        return -1 if bucket < self.buckets else int(self.hot[np.searchsorted(self.first, bucket, side="right") - 1])


def _grams(h: np.ndarray, of: np.ndarray, lookup: Lookup, start: int, order: int):
    """(ids, counts, y, x) of tokens, y and x the ids before: start before a text's first token, start + 1 for none."""
    distinct, _, back = _distinct(h)
    ids, counts = lookup(distinct)
    ids, counts = ids[back], counts[back]
    y, x = np.empty_like(ids), np.full(len(ids), start + 1, np.int64)
    y[1:] = ids[:-1]
    y[of[:-1]] = start
    if order > 2:
        x[1:] = y[:-1]
        x[of[:-1]] = start + 1
    return ids, counts, y, x


def _sums(h: np.ndarray, same: list[np.ndarray], counts: list[np.ndarray]) -> tuple:
    """(distinct hashes, sorted, the values of same for each, the sums of counts)."""
    if not len(h):
        return h, same, counts
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    first = order[at]
    return h[at], [v[first] for v in same], [np.add.reduceat(c[order], at) for c in counts]


def _gram_blocks(lookup: Lookup, deal: Deal, start: int, order: int):
    def flush(parts):
        h, (x, y, z), (c,) = _sums(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][k] for p in parts]) for k in range(3)], [np.concatenate([p[2][0] for p in parts])])
        bucket = _least(deal(y, h))
        by = np.argsort(y.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)) if start + 1 < 1 << 32 else np.lexsort((x, y))
        by = by[np.argsort(bucket[by], kind="stable")]
        x, y, z, c, bucket = x[by], y[by], z[by], c[by], bucket[by]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = []
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            own, step = y[a:b], np.diff(x[a:b], prepend=0)
            new = np.append(True, own[1:] != own[:-1])
            step[new] = x[a:b][new]
            rows.append((int(bucket[a]), pack(np.diff(own, prepend=0)), pack(step), pack(z[a:b]), pack(c[a:b])))
        return _batch(rows, ["bucket", "middles", "firsts", "lasts", "counts"])

    def run(batches):
        parts, held = [], 0
        for p in pieces(batches, 0):
            z, _, y, x = _grams(*token_hashes(p.column(0)), lookup, start, order)
            parts.append(_sums(gram_hash(x, y, z), [x, y, z], [np.ones(len(z), np.int64)]))
            held += len(parts[-1][0])
            if held >= block_size(BLOCK, deal.buckets):
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run, "bucket int, middles binary, firsts binary, lasts binary, counts binary"


def _unpacked_grams(row: dict) -> list[np.ndarray]:
    """(x, y, z, counts) of a packed row."""
    y, step = np.cumsum(unpack(row["middles"]).astype(np.int64)), unpack(row["firsts"]).astype(np.int64)
    at = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    sums = np.cumsum(step)
    base = np.where(at > 0, sums[at - 1], 0)
    return [sums - np.repeat(base, np.diff(np.append(at, len(y)))), y, unpack(row["lasts"]).astype(np.int64), unpack(row["counts"]).astype(np.int64)]


GRAM_ROWS = "to int, kind int, ids binary, total binary, n1 binary, n2 binary, n3 binary, of array<long>"
# kinds, the first two to shards of words, the others to buckets: a word as context, the words before a word, contexts, pairs
# of: a bucket, which tables it wrote, its numbers of trigrams and of pairs counted 1 to 4 times


def _gram_rows(rows: list[tuple], of: list[int]) -> pa.Table:
    rows = [(to, kind, *columns, *[b""] * (5 - len(columns))) for to, kind, *columns in rows] or [(-1, -1, *[b""] * 5)]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    ofs = pa.array([of] + [None] * (len(rows) - 1), pa.list_(pa.int64()))
    return pa.Table.from_arrays([*(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)), ofs], names=[f.split()[0] for f in GRAM_ROWS.split(", ")])


def _once_to_four(c: np.ndarray) -> list[int]:
    return [int((c == j).sum()) for j in (1, 2, 3, 4)]


def _by_counts(c: np.ndarray) -> list[np.ndarray]:
    return [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]


def _save_pairs(folder: str, bucket: int, offsets: np.ndarray, contexts: tuple, pairs: tuple) -> tuple[list[tuple], list[int]]:
    """Writes whole sums of contexts and pairs; returns what the shards of words need, and numbers of pairs by count."""
    h, _, columns = contexts
    tables.save(folder, f"context-{bucket}", h, columns, ONE_TYPE)
    h, (y, z), (n,) = pairs
    tables.save(folder, f"pair-{bucket}", h, [n], ONCE)
    if not len(h):  # a hot word's bucket may hold contexts alone
        return [], [0] * 4
    shard = lambda ids: np.searchsorted(offsets, ids, side="right") - 1
    order = np.argsort(y, kind="stable")
    y, by = y[order], n[order]
    at = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    rows = [(s, 0, *p) for s, *p in _packed_by(shard(y[at]), [y[at], *(np.add.reduceat(v, at) for v in _by_counts(by))])]
    last, types = np.unique(z, return_counts=True)
    return rows + [(s, 1, *p) for s, *p in _packed_by(shard(last), [last, types])], _once_to_four(n)


def _gram_bucket(folder: str, offsets: np.ndarray, deal: Deal, none: int):
    """Adds up a bucket's trigrams and writes them, and the pairs within; a hot word's bucket sends part sums of pairs on."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        x, y, z, c = (np.concatenate(v) for v in zip(*map(_unpacked_grams, table.drop_columns("bucket").to_pylist())))
        h, (x, y, z), (c,) = _sums(gram_hash(x, y, z), [x, y, z], [c])
        some = x != none
        tables.save(folder, f"gram-{bucket}", h[some], [c[some]], ONCE)
        del h
        seen = _once_to_four(c[some])
        contexts = _sums(gram_hash(x[some], y[some]), [x[some]], _by_counts(c[some]))
        pairs = _sums(gram_hash(y, z), [y, z], [np.where(some, 1, c)])
        if (hot := deal.word(bucket)) < 0:
            rows, of = _save_pairs(folder, bucket, offsets, contexts, pairs)
            return _gram_rows(rows, [bucket, 2, *seen, *of])
        rows = []
        for kind, (ids, counts) in ((2, (contexts[1][0], contexts[2])), (3, (pairs[1][1], pairs[2]))):
            to = deal(np.full(len(ids), hot), gram_hash(ids))
            order = np.lexsort((ids, to))
            ids, to, counts = ids[order], to[order], [n[order] for n in counts]
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
            rows += [(int(to[a]), kind, pack(np.diff(ids[a:b], prepend=0)), *(pack(n[a:b]) for n in counts)) for a, b in zip(at, np.append(at[1:], len(to)))]
        return _gram_rows(rows, [bucket, 0, *seen, 0, 0, 0, 0])

    return run, GRAM_ROWS


def _hot_bucket(folder: str, offsets: np.ndarray, deal: Deal):
    """Adds up the part sums of a hot word's contexts and pairs and writes them."""

    def run(table: pa.Table) -> pa.Table:
        bucket, found, none = table.column("to")[0].as_py(), {2: [], 3: []}, np.zeros(0, np.int64)
        for r in table.to_pylist():
            found[r["kind"]].append([np.cumsum(unpack(r["ids"]).astype(np.int64)), *(unpack(r[k]).astype(np.int64) for k in ("total", "n1", "n2", "n3")[: 4 if r["kind"] == 2 else 1])])
        x, *counts = [np.concatenate(v) for v in zip(*found[2])] or [none] * 5
        z, n = [np.concatenate(v) for v in zip(*found[3])] or [none] * 2
        hot = np.int64(deal.word(bucket))
        contexts = _sums(gram_hash(x, np.full(len(x), hot)), [x], counts)
        y = np.full(len(z), hot)
        rows, of = _save_pairs(folder, bucket, offsets, contexts, _sums(gram_hash(y, z), [y, z], [n]))
        return _gram_rows(rows, [bucket, 1, 0, 0, 0, 0, *of])

    return run, GRAM_ROWS


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _context_shard(folder: str, offsets: np.ndarray, d: list[float]):
    """Writes the arrays by id of one shard of words: context totals, interpolation weights, continuation counts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("to")[0].as_py()
        base = int(offsets[shard])
        n = int(offsets[shard + 1]) - base if shard + 1 < len(offsets) else 1
        total, spare, types = np.zeros(n, np.int64), np.zeros(n, np.float64), np.zeros(n, np.int64)
        for r in table.to_pylist():
            at = unpack(r["ids"]).astype(np.int64) - base
            if r["kind"] == 0:
                np.add.at(total, at, unpack(r["total"]).astype(np.int64))
                np.add.at(spare, at, sum(d[j] * unpack(r[k]).astype(np.float64) for j, k in enumerate(("n1", "n2", "n3"))))
            else:
                np.add.at(types, at, unpack(r["total"]).astype(np.int64))
        arrays.save(folder, f"context-total-{shard}", _least(total))
        arrays.save(folder, f"context-weight-{shard}", np.where(total > 0, spare / np.maximum(total, 1), 1.0).astype(np.float32))
        arrays.save(folder, f"word-types-{shard}", _least(types))
        of = [int((types == j).sum()) for j in (1, 2, 3, 4)] + [int((types > 2).sum()), int(types.sum())]
        return pa.Table.from_arrays([pa.array([of], pa.list_(pa.int64()))], names=["of"])

    return run, "of array<long>"


# --- the model -------------------------------------------------------------------------------------------------


class Model:
    """What every worker needs besides the mapped arrays; it grows with the number of shards and hot words only."""

    def __init__(self, folder, shards, offsets, tokens, types, deal, order, d, lower, filled, grams, pairs):
        self.folder, self.offsets = folder, np.asarray(offsets, np.int64)
        self.lookup, self.deal = Lookup(folder, shards, offsets), deal
        self.tokens, self.types, self.order = tokens, types, order
        self.d, self.lower = d, lower  # discounts of trigrams and pairs; of words, with their sum and what it leaves
        self.filled, self.grams, self.pairs = filled, grams, pairs  # shards, buckets of trigrams and of pairs that have files

    def _by_id(self, name: str, ids: np.ndarray, default) -> np.ndarray:
        """Values of an array by id for sorted ids; those below 0, or of shards without it, have the default."""
        out = np.full(len(ids), default, np.float64)
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(ids) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(ids))):
            s = int(shard[a])
            if s in self.filled:
                out[a:b] = arrays.mapped(self.folder, f"{name}-{s}")[ids[a:b] - self.offsets[s]]
        return out

    def _counts(self, name: str, usual: tuple[int, ...], word: np.ndarray, salt: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of counts of distinct n-grams, from the tables of a name."""
        out, full = np.zeros((len(usual), len(h)), np.int64), self.grams if name == "gram" else self.pairs
        bucket = _least(self.deal(word, salt))
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(h) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(h))):
            k = int(own[a])
            i = int(np.searchsorted(full, k))
            if i < len(full) and full[i] == k:
                out[:, order[a:b]] = tables.table(self.folder, f"{name}-{k}", usual).values(h[order[a:b]])
        return out

    def _cut(self, c: np.ndarray, d: list[float]) -> np.ndarray:
        return c - np.select([c >= 3, c >= 2, c >= 1], [d[2], d[1], d[0]], 0.0)

    def log_probabilities(self, h: np.ndarray, of: np.ndarray):
        """For each token: (count in training, log10 of its probability after those before it)."""
        ids, counts, y, x = _grams(h, of, self.lookup, self.types, self.order)
        words, back = np.unique(ids, return_inverse=True)
        types = self._by_id("word-types", words, 0.0)
        d, all_types, spare = self.lower
        p = (self._cut(types, d) / max(all_types, 1) + spare / (self.types + 1))[back]
        contexts, back = np.unique(y, return_inverse=True)
        total, weight = self._by_id("context-total", contexts, 0.0)[back], self._by_id("context-weight", contexts, 1.0)[back]
        known = np.flatnonzero((ids >= 0) & (y >= 0) & (total > 0))
        pair, at, back = _distinct(gram_hash(y[known], ids[known]))
        own = known[at]
        (c,) = self._counts("pair", ONCE, y[own], gram_hash(ids[own]), pair)
        p *= weight
        p[known] += self._cut(c, self.d[1])[back] / total[known]
        if self.order > 2:
            known = np.flatnonzero((x >= 0) & (y >= 0) & (x <= self.types))
            pair, at, back = _distinct(gram_hash(x[known], y[known]))
            own = known[at]
            total, *n = self._counts("context", ONE_TYPE, y[own], gram_hash(x[own]), pair)
            weight = sum(d * c for d, c in zip(self.d[0], n)) / np.maximum(total, 1)
            seen = total[back] > 0
            known, total, weight = known[seen], total[back][seen], weight[back][seen]
            p[known] *= weight
            some = ids[known] >= 0
            known, total = known[some], total[some]
            gram, at, back = _distinct(gram_hash(x[known], y[known], ids[known]))
            (c,) = self._counts("gram", ONCE, y[known[at]], gram, gram)
            p[known] += self._cut(c, self.d[0])[back] / total
        return counts, np.log10(p)


def train(docs: DataFrame, text_col="text", order: int = ORDER) -> Model:
    """Counts the model over all rows of docs; its arrays stay in the shared folder until the application ends."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    buckets = n_buckets(docs)
    shards = max(16, buckets // 8)
    text = docs.select(F.col(text_col))
    run, schema = _word_blocks(shards)
    words = arrow_map(text, run, schema).groupBy("shard").applyInArrow(*_word_shard(folder, 4 * buckets // shards)).collect()
    sizes = {r.shard: r for r in words}
    offsets = np.concatenate([[0], np.cumsum([sizes[s].types if s in sizes else 0 for s in range(shards)])]).tolist()
    types, tokens = offsets[-1], sum(r.tokens for r in words)
    if not types:
        return Model(folder, shards, offsets, 0, 0, Deal(2, 1, {}), order, [[0.5] * 3] * 2, ([0.5] * 3, 0, 1.0), set(), *[np.zeros(0, np.int64)] * 2)
    share = max(1, tokens // buckets)
    hot = {offsets[r.shard] + i: -(-c // share) for r in words for i, c in zip(r.hot, r.hot_counts) if c > share}
    n_docs = int(Lookup(folder, shards, offsets)(np.array([END]))[1][0])
    hot[types] = -(-n_docs // share)
    deal = Deal(types + 2, buckets, hot)
    lookup, at = Lookup(folder, shards, offsets), np.asarray(offsets, np.int64)
    run, schema = _gram_blocks(lookup, deal, types, order)
    grams = materialize(arrow_map(text, run, schema).groupBy("bucket").applyInArrow(*_gram_bucket(folder, at, deal, types + 1)), "grams")
    pairs = materialize(grams.where("kind > 1").groupBy("to").applyInArrow(*_hot_bucket(folder, at, deal)), "pairs")
    both = grams.unionByName(pairs)
    of = np.array([r.of for r in both.where("of is not null").select("of").collect()], np.int64)  # one row a bucket and stage
    d = [discounts(of[:, 2:6].sum(0).tolist()), discounts(of[:, 6:].sum(0).tolist())]
    own = both.where("kind in (0, 1)").drop("of")
    done = own.groupBy("to").applyInArrow(*_context_shard(folder, at, d[1])).collect()
    n = np.array([r.of for r in done], np.int64).sum(0)
    lower = discounts(n[:4].tolist())
    spare = (lower[0] * n[0] + lower[1] * n[1] + lower[2] * n[4]) / max(n[5], 1)
    filled = {r.to for r in own.select("to").distinct().collect()}
    return Model(folder, shards, offsets, tokens, types, deal, order, d, (lower, int(n[5]), float(spare)), filled, np.unique(of[of[:, 1] != 1, 0]), np.unique(of[of[:, 1] > 0, 0]))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probability) and perplexity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for p in pieces(batches, 1, min(BATCH_BYTES, max(PIECE_BYTES, m.deal.buckets << 10))):  # many tables, longer pieces
            h, of = token_hashes(p.column(1))
            counts, logs = m.log_probabilities(h, of)
            base = np.log10((counts + 1.0) / (m.tokens + m.types + 1.0))
            n = np.diff(of)
            sums = [np.add.reduceat(v, of[:-1]) for v in ((counts > 0).astype(np.int64), base, logs)]
            yield pa.RecordBatch.from_arrays([p.column(0), int_array(n), int_array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** np.minimum(-sums[2] / n, 300.0))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def lm_report(docs: DataFrame, id_col="doc_id", text_col="text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model = train(docs.where(~held_out(id_col)), text_col, order)
    s = score(docs, model, id_col, text_col)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
