"""N-gram Jaccard join with a token-group matrix.

A document is the set of hashes of its `width`-word shingles; equal sets are one node. The join is exact (up to 64-bit
hashes), and goes in three steps:

1. Similar documents are partitioned into families. All tokens have one order: those of one set come first, then those
   of several, the most common last. They are counted by hash buckets, and marked in a bit map that workers memory-map;
   its size is bounded, and beyond it only the more common are marked, which changes no result. Two sets of a and b tokens that link share at least t/(1+t)*(a+b), so they share one of each other's
   first tokens, with that many tokens from there on in both. Every set sends its first tokens, their places and its
   size to hash buckets; sets that agree in a token so are in one family. A set so small that linking means equality
   sends none. Tokens of very many sets are not gathered in a bucket: their sets are tied to a node of token and size.
2. A family is cut into blocks of bounded size, each a task of its own. Some sets of a large family, its leaders, go to
   all of its blocks, so that what is alike is tied together at once. Whatever a large family's greatest component then
   lacks is compared, in chunks, with all blocks: no link is lost, and no pairs within the component are compared twice.
3. In a task, sets join groups one by one. A group keeps the union of its tokens as a row of a matrix; a set's overlap
   with each row bounds its overlap with every member. Only groups whose bound reaches the threshold are opened, and
   members compared exactly until one links. A task returns a spanning forest, never all pairs.

Rows: null or empty texts, and those without words, have no shingles and link with nothing, not even each other.
Texts of fewer words than a shingle are one token. Ids may be null (never the name of a component unless alone) or
repeated: rows are linked by their texts. An empty table gives no rows. Other columns are ignored.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .blocks import Words, arrow_map, block_size, int_array, materialize, mix, n_buckets, pack, pieces, rolling, row_key, shared_path, text_buffers, unpack, whole
from .components import components, stars

WIDTH, NUMERATOR, DENOMINATOR = 3, 90, 100  # fixed values of op10's contract
SIMILARITY = (NUMERATOR, DENOMINATOR)  # of a similarity (n, d), sets link at n/d
#: A block of a family has about so many sets and tokens at most (or one set); a family of several has so many leaders.
BLOCK_SETS, BLOCK_TOKENS, LEADERS = 128, 1 << 19, 8
#: Tokens that a map task gathers at least before it sends them or their first ones.
GATHERED = 1 << 20
#: Common tokens whose counts are told to all tasks, and the least count of such a token.
COMMON_TOKENS, COMMON_LEAST = 1 << 20, 8
#: Bits that mark a bucket's repeated tokens, and all of them at most.
BUCKET_BITS, ALL_BITS = 1 << 21, 1 << 33
#: Bytes of a file of marks.
FILE_BYTES = 1 << 22
#: A common token of more sets than this is a node of its own; a bucket's list of more sets than that is read as a chain.
HOT_SETS, LONG_LIST = 1 << 16, 2048
#: A table of families of at most so many rows (under 50 bytes each) is broadcast, a larger one shuffled.
BROADCAST_ROWS = 200_000


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of): tokens[of[d]:of[d+1]] are the distinct shingle hashes of document d, sorted."""
    values = words.hashes(lower=True)
    counts = words.counts()
    full = np.flatnonzero(whole(words.of[:-1], width, len(values)))
    h, doc = rolling(values, width)[full], words.doc()[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence is one token
        own = [mix(np.bitwise_xor.reduce(mix(values[words.of[d] : words.of[d + 1]] + _places(counts[d]))) + np.array([counts[d]], np.uint64)) for d in short]
        h, doc = np.append(h, np.concatenate(own)), np.append(doc, short)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(counts) <= 1 << 16 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def size_class(n: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """Classes whose upper ends grow by 1/t: sets that link are in one class or in neighbouring ones."""
    return np.searchsorted(class_ends(similarity), n, side="left")


@lru_cache
def class_ends(similarity=SIMILARITY, most: int = 1 << 40) -> np.ndarray:
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * similarity[1] // similarity[0]))
    return np.array(ends, np.int64)


def needed(total, similarity=SIMILARITY):
    """The least overlap of two sets of together total tokens that link."""
    return -(-similarity[0] * total // (similarity[0] + similarity[1]))


def spread_of(tokens: np.ndarray) -> np.ndarray:
    """The place of tokens among all, and their buckets, by hash."""
    return mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def prefixes(tokens: np.ndarray, of: np.ndarray, similarity, ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, set, place, rank): the first tokens of every set that can link with another, by another hash.

    ranks gives ranks by spread. A piece's sets have at most 2**20 documents: one 64-bit key orders them all; tokens that
    tie in it stay in their own order.
    """
    numerator, denominator = similarity
    n = np.diff(of)
    doc = np.repeat(np.arange(len(n)), n)
    spread = spread_of(tokens)
    rank = ranks(spread)
    level = np.minimum(2 * np.log2(rank + 1.0), 63).astype(np.uint64)
    order = np.argsort(doc.astype(np.uint64) << np.uint64(44) | level << np.uint64(38) | spread >> np.uint64(26), kind="stable")
    first = n - -(-numerator * n // denominator) + 1
    first[n * (denominator - numerator) < numerator] = 0  # linking means equality
    place = np.arange(len(tokens)) - of[:-1][doc]  # order keeps the documents' places
    keep = place < first[doc]
    return mix(spread[order[keep]]), doc[keep], place[keep], rank[order[keep]]


class Ranks:
    """How common tokens are: 0 for those of one set, 1 for marked ones, and the counts of the most common."""

    def __init__(self, folder: str, buckets: int, top: np.ndarray, counts: np.ndarray):
        self.folder, self.bits, self.marks = folder, (buckets - 1).bit_length(), marks_of(buckets)
        self.per_file = min(buckets, max(1, 8 * FILE_BYTES // self.marks))
        self.files, self.top, self.counts = buckets // self.per_file, top, counts

    def __call__(self, spread: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(spread), np.int64)
        bit = (spread >> np.uint64(64 - self.bits - (self.marks - 1).bit_length())).astype(np.int64)
        file = bit // (self.marks * self.per_file)
        order = np.argsort(file.astype(np.uint16), kind="stable")
        edges = np.searchsorted(file[order], np.arange(self.files + 1))
        for f in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            own = order[edges[f] : edges[f + 1]]
            at = bit[own] - f * self.marks * self.per_file
            rank[own] = arrays.mapped(self.folder, f"marks-{f}")[at >> 3] >> (at & 7).astype(np.uint8) & 1
        if len(self.top):
            key = spread >> np.uint64(32 - self.bits)
            at = np.minimum(np.searchsorted(self.top, key), len(self.top) - 1)
            rank = np.where(self.top[at] == key, self.counts[at], rank)
        return rank


def marks_of(buckets: int) -> int:
    return max(8, min(BUCKET_BITS, ALL_BITS // buckets))


def _token_blocks(width: int, buckets: int):
    """The distinct tokens of blocks, and in how many of a block's sets they are, by bucket; 32 bits behind a bucket's."""
    bits = (buckets - 1).bit_length()

    def flush(parts):
        value, count = np.unique(np.concatenate(parts) >> np.uint64(32 - bits), return_counts=True)
        bucket, low = (value >> np.uint64(32)).astype(np.int64), (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, pack(np.diff(low[edges[b] : edges[b + 1]], prepend=0)), pack(count[edges[b] : edges[b + 1]])) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "counts"])

    def run(batches):
        parts, held = [], 0
        for p in pieces(batches, 0):
            tokens, of = shingle_sets(Words(*text_buffers(p.column(0))), width)
            _, first = np.unique(set_ids(tokens, of), return_index=True)
            once = np.zeros(p.num_rows, bool)
            once[first] = True
            parts.append(spread_of(tokens[np.repeat(once, np.diff(of))]))
            held += len(parts[-1])
            if held >= block_size(GATHERED, buckets):
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run, "bucket int, tokens binary, counts binary"


def _token_bucket(buckets: int):
    """Counts a bucket's tokens: the marks of those that repeat, and the most common with their counts."""
    marks, most = marks_of(buckets), max(16, COMMON_TOKENS // buckets)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        low = np.concatenate([np.cumsum(unpack(x).astype(np.int64)) for x in table.column("tokens").to_pylist()])
        count = np.concatenate([unpack(x).astype(np.int64) for x in table.column("counts").to_pylist()])
        order = np.argsort(low, kind="stable")
        low = low[order]
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        low, count = low[at], np.add.reduceat(count[order], at)
        low, count = low[count > 1], count[count > 1]
        if len(low) > max(most, marks // 8):  # the more common ones
            top = np.argsort(-count, kind="stable")[: max(most, marks // 8)]
            low, count = low[top], count[top]
        bit = low >> (33 - marks.bit_length())
        out = np.zeros(marks // 8, np.uint8)
        np.bitwise_or.at(out, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        top = np.flatnonzero(count >= COMMON_LEAST)
        top = top[np.argsort(-count[top], kind="stable")[:most]]
        key = (bucket << 32) + low[top]
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays([pa.array([bucket], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([key.tolist()], longs), pa.array([count[top].tolist()], longs)], names=["bucket", "marks", "top", "counts"])

    return run, "bucket int, marks binary, top array<long>, counts array<long>"


def token_ranks(texts: DataFrame, width: int, buckets: int) -> Ranks:
    """Counts the tokens of all texts; their marks are in the shared folder until the application ends."""
    spark = texts.sparkSession
    counted = arrow_map(texts, *_token_blocks(width, buckets)).groupBy("bucket").applyInArrow(*_token_bucket(buckets))
    counted = materialize(counted, "counted")
    top = counted.select(F.explode(F.arrays_zip("top", "counts")).alias("t")).select("t.*").toArrow()
    key, count = top.column("top").to_numpy().view(np.uint64), top.column("counts").to_numpy()
    order = np.argsort(key)
    ranks = Ranks(shared_path(spark, "marks"), buckets, key[order], count[order])
    folder, per_file, size = ranks.folder, ranks.per_file, ranks.marks // 8

    def write(table: pa.Table) -> pa.Table:
        file = table.column("file")[0].as_py()
        out = np.zeros(per_file * size, np.uint8)
        for bucket, raw in zip(table.column("bucket").to_pylist(), table.column("marks").to_pylist()):
            if raw is not None:
                at = (bucket - file * per_file) * size
                out[at : at + size] = np.frombuffer(raw, np.uint8)
        arrays.save(folder, f"marks-{file}", out)
        return pa.Table.from_arrays([pa.array([file], pa.int32())], names=["file"])

    file = lambda bucket: F.floor(F.col(bucket) / per_file).cast("int").alias("file")
    every = spark.range(ranks.files).select(F.col("id").cast("int").alias("file"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("marks"))
    done = counted.select(file("bucket"), "bucket", "marks").unionByName(every).groupBy("file").applyInArrow(write, "file int").count()
    if done != ranks.files:
        raise RuntimeError(f"{done} of {ranks.files} files of marks written")
    return ranks


def set_ids(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
    return mix(sums[of[1:]] - sums[of[:-1]] + np.diff(of).astype(np.uint64)).view(np.int64)


# --- step 1: documents, and families of similar sets -----------------------------------------------------------

_FIRST = ("sets", "sizes", "counts", "tokens", "places")  # of a bucket's row: its sets, and their first tokens there


def _sets_and_prefixes(width: int, buckets: int, similarity, ranks):
    """Rows of two kinds: one of each document (bucket null), and the first tokens of the sets of a block by bucket.

    ranks is a broadcast of Ranks. Bucket -1 has ties (sets, tokens) of sets to nodes of hot tokens.
    """
    bits = np.uint64(64 - (buckets - 1).bit_length())
    names = ["doc_id", "key", "n", "s", "bucket", *_FIRST]

    def flush(parts, kind):
        s, size, token, place, rank = (np.concatenate([p[k] for p in parts]) for k in range(5))
        hot = rank > HOT_SETS
        rows = []
        if hot.any():
            level = size_class(size[hot], similarity).astype(np.uint64)
            nodes = np.concatenate([mix(token[hot] + mix(level + np.uint64(up + 1))) for up in (0, 1)])
            ties = np.unique(np.stack([np.concatenate([s[hot]] * 2).view(np.uint64), nodes]), axis=1)
            rows.append((-1, pack(ties[0], compress=False), None, None, pack(ties[1], compress=False), None))
            s, size, token, place = s[~hot], size[~hot], token[~hot], place[~hot]
        bucket = (token >> bits).astype(np.int64)
        order = np.lexsort((token, s, bucket))
        s, size, token, place, bucket = s[order], size[order], token[order], place[order], bucket[order]
        keep = np.ones(len(s), bool)  # equal sets of a block send once
        keep[1:] = (token[1:] != token[:-1]) | (s[1:] != s[:-1])
        s, size, token, place, bucket = s[keep], size[keep], token[keep], place[keep], bucket[keep]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            x, y = edges[b], edges[b + 1]
            at = np.flatnonzero(np.append(True, s[x + 1 : y] != s[x : y - 1]))
            rows.append((b, pack(s[x:y][at].view(np.uint64), compress=False), pack(size[x:y][at]), pack(np.diff(np.append(at, y - x))), pack(token[x:y].astype(np.uint32), compress=False), pack(place[x:y])))
        none = [None] * len(rows)
        cols = [pa.array(none, kind), *(pa.array(none, pa.int64()) for _ in range(3)), pa.array([r[0] for r in rows], pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], names=names)

    def run(batches):
        parts, held, kind = [], 0, None
        for p in pieces(batches, 2):
            kind = p.schema.field(0).type
            tokens, of = shingle_sets(Words(*text_buffers(p.column(2))), width)
            ids, n = set_ids(tokens, of), np.diff(of)
            none = [pa.nulls(p.num_rows, pa.int32()), *(pa.nulls(p.num_rows, pa.binary()) for _ in _FIRST)]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), int_array(n), int_array(ids), *none], names=names)
            _, first = np.unique(ids, return_index=True)
            first = np.sort(first[n[first] > 0])
            if not len(first):
                continue
            pick = np.concatenate([tokens[of[d] : of[d + 1]] for d in first])
            token, owner, place, rank = prefixes(pick, np.concatenate([[0], np.cumsum(n[first])]), similarity, ranks.value)
            if len(token):
                parts.append((ids[first][owner], n[first][owner], token, place, rank))
            held += len(pick)
            if held >= block_size(GATHERED, buckets):
                if parts:
                    yield flush(parts, kind)
                parts, held = [], 0
        if parts:
            yield flush(parts, kind)

    return run


def agreeing(token: np.ndarray, s: np.ndarray, n: np.ndarray, place: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """Pairs of sets that may link by a token of both: enough tokens are left from there on. Two rows, (a, b).

    In a list of more than LONG_LIST sets only neighbours by size are tied where some pair across them may link.
    """
    order = np.lexsort((s, n, token))
    token, s, n, place = token[order], s[order], n[order], place[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (token[1:] != token[:-1]) | (s[1:] != s[:-1])
    token, s, n, left = token[keep], s[keep], n[keep], (n - place)[keep]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(s) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(s))
    last = np.repeat(end, end - start)
    short = np.repeat(end - start <= LONG_LIST, end - start)
    out, i, d = [np.zeros((2, 0), np.int64)], np.flatnonzero(short), 1
    while len(i := i[i + d < last[i]]):
        j = i + d
        near = similarity[0] * n[j] <= similarity[1] * n[i]  # sizes ascend: later ones are no nearer
        i, j = i[near], j[near]
        least = needed(n[i] + n[j], similarity)
        ok = (np.minimum(left[i], left[j]) >= least) & ((n[i] < n[j]) | (least < n[i]))
        out.append(np.unique(np.stack([np.minimum(s[i], s[j])[ok], np.maximum(s[i], s[j])[ok]]), axis=1))
        d += 1
    for x, y in zip(start.tolist(), end.tolist()):
        if y - x > LONG_LIST:
            reach = np.maximum.accumulate(left[x:y] * (similarity[0] + similarity[1]) // similarity[0] - n[x:y])
            tied = x + np.flatnonzero(reach[:-1] >= n[x + 1 : y])
            out.append(np.stack([s[tied], s[tied + 1]]))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _edges(pairs: np.ndarray) -> pa.Table:
    a, b = stars(pairs[0].tolist(), pairs[1].tolist())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared_tokens(similarity):
    """One bucket: sets that may link, as stars from the smallest name of each of the bucket's components."""

    def run(table: pa.Table) -> pa.Table:
        s, n, count, token, place = ([unpack(x) for x in table.column(c).to_pylist()] for c in _FIRST)
        count = np.concatenate(count).astype(np.int64)
        s, n = np.repeat(np.concatenate(s).view(np.int64), count), np.repeat(np.concatenate(n).astype(np.int64), count)
        return _edges(agreeing(np.concatenate(token), s, n, np.concatenate(place).astype(np.int64), similarity))

    return run


def _hot_ties(batches):
    """Ties of sets to the nodes of hot tokens."""
    for batch in batches:
        for sets, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(x).view(np.int64)) for x in (sets, nodes)], names=["a", "b"])


# --- step 3: the token-group matrix of one task ----------------------------------------------------------------


def linked(overlap, a, b, similarity=SIMILARITY):
    """denominator * intersection >= numerator * union."""
    return similarity[1] * overlap >= similarity[0] * (a + b - overlap)


def group_links(sets: list[np.ndarray], similarity=SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, by a matrix of groups and tokens."""
    numerator, denominator = similarity
    size = np.array([len(x) for x in sets], np.int64)
    if not len(sets):
        return []
    all_ = np.concatenate(sets)
    values, back = np.unique(all_, return_inverse=True)
    often = np.bincount(back) > 1  # a token of one set adds to no overlap
    column = np.where(often, np.cumsum(often) - 1, -1)[back]
    cut = np.concatenate([[0], np.cumsum(size)])
    cols = [c[c >= 0] for c in (column[cut[i] : cut[i + 1]] for i in range(len(sets)))]
    union = np.zeros((4, int(often.sum())), bool)
    mark = np.zeros(union.shape[1], bool)
    members: list[list[int]] = []
    live: list[int] = []
    low, high = np.zeros(4, np.int64), np.zeros(4, np.int64)
    out = []
    for q in np.argsort(size, kind="stable").tolist():
        own, n, joined = cols[q], int(size[q]), None
        if live and len(own):
            rows = np.array(live)
            rows = rows[high[rows] * denominator >= numerator * n]  # sets come in order of size
            bound = union[np.ix_(rows, own)].sum(1)  # no member shares more; the smallest that can link needs least
            mark[own] = True
            for g in rows[linked(bound, np.maximum(low[rows], -(-numerator * n // denominator)), n, similarity)].tolist():
                for at in range(0, len(members[g]), 64):  # opened: members until one links
                    some = [m for m in reversed(members[g][max(0, len(members[g]) - at - 64) : len(members[g]) - at]) if denominator * size[m] >= numerator * n]
                    hit = next((m for m in some if linked(int(mark[cols[m]].sum()), int(size[m]), n, similarity)), None)
                    if hit is not None:
                        out.append((hit, q))
                        if joined is None:
                            joined = g
                            members[g].append(q)
                            union[g, own] = True
                            high[g] = n
                        else:  # the set ties two groups
                            members[joined] += members[g]
                            members[joined].sort(key=lambda m: size[m])
                            union[joined] |= union[g]
                            low[joined], high[joined] = min(low[joined], low[g]), n
                            live.remove(g)
                            members[g] = []
                        break
            mark[own] = False
        if joined is None:
            g = len(members)
            if g == len(union):
                union = np.vstack([union, np.zeros_like(union)])
                low, high = np.append(low, low * 0), np.append(high, high * 0)
            members.append([q])
            live.append(g)
            union[g, own] = True
            low[g] = high[g] = n
    return out


def _verified(similarity=SIMILARITY):
    """The links of a block of a family, with the sets that were sent to it."""

    def run(table: pa.Table) -> pa.Table:
        s, first = np.unique(table.column("s").to_numpy(), return_index=True)
        tokens = table.column("tokens")
        links = group_links([np.frombuffer(tokens[int(x)].as_py(), np.uint64) for x in first], similarity)
        a, b = stars([int(s[x]) for x, _ in links], [int(s[y]) for _, y in links])
        large = pa.array([table.column("blocks")[0].as_py() > 1] * len(a), pa.bool_())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), large], names=["a", "b", "large"])

    return run


# --- the join --------------------------------------------------------------------------------------------------


def _bounded(df: DataFrame) -> DataFrame:
    """A written table as a join's side: broadcast if it is small, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def _links(sets: DataFrame, similarity) -> DataFrame:
    """Links (a, b) of sets (s, family, block, blocks, members, tokens), with the same components as all links."""
    columns, verify = ["family", "block", "blocks", "s", "tokens"], _verified(similarity)
    others = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    share = F.pmod(F.xxhash64("s", F.lit(11)), F.lit(1 << 30)) / (1 << 30) * F.col("members")
    leaders = sets.where("blocks > 1").where(share < LEADERS).select("family", others("blocks", "block"), "blocks", "s", "tokens")
    found = sets.select(*columns).unionByName(leaders).groupBy("family", "block").applyInArrow(verify, "a long, b long, large boolean")
    found = materialize(found, "links")
    links = found.select("a", "b")
    large = sets.where("blocks > 1").select("s", "family", F.octet_length("tokens").alias("bytes"))
    if not large.limit(1).count():
        return links
    # The sets of a large family outside its greatest component meet all of its blocks, in chunks.
    roots = components(found.where("large").select("a", "b")).withColumnRenamed("node", "s")
    own = materialize(large.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "roots")
    greatest = own.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("greatest"))
    rest = materialize(own.join(_bounded(materialize(greatest, "greatest")), "family").where("root <> greatest").select("s", "family", "bytes"), "rest")
    if not rest.limit(1).count():
        return links
    chunks = rest.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("bytes") / (8 * BLOCK_TOKENS))).cast("int").alias("chunks"))
    chunks = _bounded(materialize(chunks, "chunks"))
    rest = materialize(rest.join(chunks, "family").select("s", F.pmod(F.xxhash64("s", F.lit(12)), F.col("chunks")).cast("int").alias("chunk")).distinct(), "rest")
    build = sets.join(chunks, "family").select(*columns, others("chunks", "chunk"))
    probe = sets.join(_bounded(rest), "s").select("family", others("blocks", "block"), "blocks", "s", "tokens", "chunk")
    more = build.unionByName(probe).groupBy("family", "block", "chunk").applyInArrow(verify, "a long, b long, large boolean")
    return links.unionByName(more.select("a", "b"))


def jaccard_components(docs: DataFrame, width=WIDTH, id_col="doc_id", text_col="text", similarity=SIMILARITY) -> DataFrame:
    """One row per document: doc_id, key (of its id and text), n_shingles, s (its set's name), root (its component's smallest s), component_id."""
    kind = dict(docs.dtypes)[id_col]
    buckets = n_buckets(docs)
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(token_ranks(own.select("text"), width, buckets))
    mapped = arrow_map(own, _sets_and_prefixes(width, buckets, similarity, ranks), f"doc_id {kind}, key long, n long, s long, bucket int, " + ", ".join(f"{c} binary" for c in _FIRST))
    mapped = materialize(mapped, "sets")
    rows = mapped.where("bucket is null").select("doc_id", "key", "n", "s")
    shared = mapped.where("bucket >= 0").select("bucket", *_FIRST).groupBy("bucket").applyInArrow(_shared_tokens(similarity), "a long, b long")
    hot = arrow_map(mapped.where("bucket = -1").select("sets", "tokens"), _hot_ties, "a long, b long")
    families = components(shared.unionByName(hot))
    # Blocks of a family: its sets dealt by hash; their number from the family's sets and tokens.
    size = rows.where("n > 0").groupBy("s").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    size = size.join(families.select(F.col("node").alias("s"), F.col("root").alias("family")), "s")
    total = size.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    members = _bounded(materialize(size.join(total.where("members > 1"), "family").withColumn("block", block), "families"))
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def tokens(batches):
        for p in pieces(batches, 0):
            tokens, of = shingle_sets(Words(*text_buffers(p.column(0))), width)
            raw = [tokens[of[d] : of[d + 1]].tobytes() for d in range(p.num_rows)]
            yield pa.RecordBatch.from_arrays([int_array(set_ids(tokens, of)), *p.columns[1:], pa.array(raw, pa.binary())], names=["got", "s", "family", "block", "blocks", "members", "tokens"])

    # One document of each set brings its text: that of the smallest id. Rows of one id and other texts drop out by name.
    picked = own.join(members.select(text_of("doc_id").alias("k"), "s", "family", "block", "blocks", "members"), text_of("doc_id") == F.col("k"))
    sets = arrow_map(picked.select("text", "s", "family", "block", "blocks", "members"), tokens, "got long, s long, family long, block int, blocks int, members long, tokens binary").where("got = s").drop("got")
    links = _links(materialize(sets, "tokens"), similarity)
    roots = components(links).select(F.col("node").alias("s"), F.col("root"))
    # The smallest id of every component, for sets that link or have copies; any other document is its own.
    least = rows.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).join(roots, "s", "left")
    least = materialize(least.where("copies > 1 or root is not null").select("s", "least", F.coalesce("root", "s").alias("root")), "least")
    names = _bounded(materialize(least.groupBy("root").agg(F.min("least").alias("component_id")), "names"))
    named = _bounded(materialize(least.join(names, "root").select("s", "root", "component_id", F.lit(True).alias("known")), "named"))
    out = rows.join(named, "s", "left")
    component = F.when(F.col("known") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "s", F.coalesce("root", "s").alias("root"), component.alias("component_id"))


def keep_one(docs: DataFrame, width=WIDTH, id_col="doc_id", text_col="text", similarity=SIMILARITY) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns; rows without words all stay."""
    rows = materialize(jaccard_components(docs, width, id_col, text_col, similarity), "components")
    # By root: unlinked components share a component_id where ids are null or repeated.
    first = rows.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"))
    gone = materialize(rows.where("n_shingles > 0").select("key").distinct().join(first, "key", "left_anti"), "gone")
    twice = materialize(rows.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(gone, "key", "left_anti").select("key"), "twice")
    some = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    kept = docs.withColumn("__key", row_key(id_col, text_col)).join(some(gone.withColumnRenamed("key", "__key")), "__key", "left_anti")
    if twice.limit(1).count():  # equal rows of a surviving document
        own = some(twice.withColumnRenamed("key", "__key"))
        kept = kept.join(own, "__key", "left_anti").unionByName(kept.join(own, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def jaccard_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard_components(docs, id_col=id_col, text_col=text_col).select("doc_id", "n_shingles", "component_id")
