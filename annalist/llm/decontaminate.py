"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards (pieces of Arrow batches). Each shard gets a suffix array over its words: the
suffixes that start with the first words of some test suffix, sorted by their words; all other suffixes cannot match.
Every test suffix (every word position of every benchmark item) whose first words the shard has is then binary-searched
in it, all of them at once, which gives its longest verbatim match and, where that reaches a whole window, all its
locations. `longest_matches` reports the longest match of every test suffix over all shards.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark
is a stated query set: its suffixes are written to the shared folder in blocks of about BLOCK_BYTES of text, which workers
memory-map. One pass over the documents meets all blocks, whatever their number.

Rows: a null or empty text has no words, no hits and no items (the digest is that of the empty string). Null item ids
are read as the empty string. Items repeated under one id count once; documents repeated are separate rows. Empty
tables give no rows, or documents without hits. Other columns of either table are ignored.
"""

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .blocks import NOT_ALNUM, Words, arrow_map, int_array, pieces, runs_of, shared_path, text_buffers

WINDOW = 10  # fixed value of the contract
#: Benchmark text, in bytes, of a block (its suffixes take about 30 times that).
BLOCK_BYTES = 4 << 20
#: Words by which suffixes are sorted; longer matches are followed word by word.
DEPTH = 16


class Queries:
    """The suffixes of a block of benchmark items as a matrix of word hashes, 0 behind an item's end."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets, NOT_ALNUM)
        self.ids = [i for i, _ in items]
        self.hashes, self.of = words.hashes(lower=True), words.of
        n = words.counts()
        self.item = words.doc()
        self.place = np.arange(len(self.hashes)) - np.repeat(self.of[:-1], n)
        self.left = np.repeat(n, n) - self.place  # words from here to the item's end
        self.need = np.repeat(np.minimum(n, window), n)  # a match must be so long to hold a window
        self.full = self.left >= self.need  # a window starts here
        self.words = np.zeros((len(self.hashes), DEPTH), np.uint64)
        for d in range(DEPTH):
            have = self.left > d
            self.words[have, d] = self.hashes[np.flatnonzero(have) + d]
        self.first = int(min(2, n[n > 0].min())) if (n > 0).any() else 0
        self.starts = [np.unique(self.words[self.left > d, d]) for d in range(self.first)]
        self.pair = _pair(self.words[:, 0], self.words[:, 1])
        self.pairs = np.unique(self.pair[self.left > 1])

    _ARRAYS = ("hashes", "of", "item", "place", "left", "need", "full", "words", "pair", "pairs")

    def save(self, folder: str, block: int) -> None:
        for name in self._ARRAYS:
            arrays.save(folder, f"{name}-{block}", getattr(self, name))
        for d in range(self.first):
            arrays.save(folder, f"start{d}-{block}", self.starts[d])
        arrays.save(folder, f"ids-{block}", np.frombuffer(json.dumps([self.first, self.ids]).encode(), np.uint8))

    @classmethod
    def load(cls, folder: str, block: int) -> "Queries":
        """A block's arrays, memory-mapped."""
        q = cls.__new__(cls)
        q.first, q.ids = json.loads(arrays.mapped(folder, f"ids-{block}").tobytes())
        for name in cls._ARRAYS:
            setattr(q, name, arrays.mapped(folder, f"{name}-{block}"))
        q.starts = [arrays.mapped(folder, f"start{d}-{block}") for d in range(q.first)]
        return q


@functools.lru_cache(maxsize=64)
def _loaded(folder: str, block: int) -> Queries:
    return Queries.load(folder, block)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) ^ b


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


class SuffixArray:
    """The shard's suffixes that can match, in the order of their first DEPTH words."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, queries: Queries):
        self.hashes, self.of = hashes, of
        n = np.diff(of)
        left = np.repeat(n, n) - (np.arange(len(hashes)) - np.repeat(of[:-1], n))
        keep = _among(hashes, queries.starts[0]) if queries.first else np.zeros(len(hashes), bool)
        at = np.flatnonzero(keep)
        if queries.first == 2:
            at = at[left[at] > 1]
            pair = _pair(hashes[at], hashes[at + 1])
            some = _among(pair, queries.pairs)
            at, self.pairs = at[some], np.unique(pair[some])
        words = np.zeros((len(at), DEPTH), np.uint64)
        for d in range(DEPTH):
            have = left[at] > d
            words[have, d] = hashes[at[have] + d]
        order = np.lexsort(words.T[::-1]) if len(at) else at
        self.at, self.words, self.left = at[order], words[order], left[at][order]

    def search(self, want: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all rows of want at once, by their first width words: the first place not before (after) them."""
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(self.at), np.int64)
        in_width = np.arange(DEPTH) < width[:, None]
        while (open_ := lo < hi).any():
            q = np.flatnonzero(open_)
            mid = (lo[q] + hi[q]) // 2
            have = self.words[mid]
            differ = (have != want[q]) & in_width[q]
            d = differ.argmax(1)
            row = np.arange(len(q))
            less = np.where(differ[row, d], have[row, d] < want[q][row, d], after)
            lo[q[less]], hi[q[~less]] = mid[less] + 1, mid[~less]
        return lo

    def common(self, place: np.ndarray, queries: Queries, q: np.ndarray) -> np.ndarray:
        """Words that the suffixes at the places share with the test suffixes q."""
        out = np.zeros(len(q), np.int64)
        ok = (place >= 0) & (place < len(self.at))
        row = np.flatnonzero(ok)
        p, s = place[row], q[row]
        same = self.words[p] == queries.words[s]
        most = np.minimum(self.left[p], queries.left[s])
        same &= np.arange(DEPTH) < most[:, None]
        n = np.where(same.all(1), DEPTH, same.argmin(1))
        go = np.flatnonzero((n == DEPTH) & (most > DEPTH))
        while len(go):
            go = go[self.hashes[self.at[p[go]] + n[go]] == queries.hashes[s[go] + n[go]]]
            n[go] += 1
            go = go[n[go] < most[go]]
        out[row] = n
        return out


def shard_matches(sa: SuffixArray, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(longest match of each test suffix, and for each occurrence of a window: test suffix, word position, length).

    Where all items have two words at least, matches of one word are not looked for.
    """
    longest, none = np.zeros(len(queries.hashes), np.int64), np.zeros(0, np.int64)
    if not len(sa.at):
        return longest, none, none, none
    q = np.flatnonzero(_among(queries.pair, sa.pairs) & (queries.left > 1)) if queries.first == 2 else np.arange(len(longest))
    if not len(q):
        return longest, none, none, none
    place = sa.search(queries.words[q], np.minimum(queries.left[q], DEPTH), False)
    longest[q] = np.maximum(sa.common(place, queries, q), sa.common(place - 1, queries, q))
    hit = q[queries.full[q] & (longest[q] >= queries.need[q])]
    depth = np.minimum(queries.need[hit], DEPTH)
    lo, hi = sa.search(queries.words[hit], depth, False), sa.search(queries.words[hit], depth, True)
    places, suffix = runs_of(lo, hi - lo), np.repeat(hit, hi - lo)
    length = sa.common(places, queries, suffix)
    true = length >= queries.need[suffix]  # windows longer than DEPTH
    return longest, suffix[true], sa.at[places[true]], length[true]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES):
    """The benchmark's items, driver-side, in blocks of bounded text; items of one id stay in one block."""
    block, size, last = [], 0, None
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct().orderBy("i")
    for r in rows.toLocalIterator():
        if size > limit and r.i != last:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size, last = size + len(r.t.encode()), r.i
    yield block


def _written(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> tuple[str, int]:
    """(folder, number of blocks) of the benchmark's suffixes in the shared folder."""
    folder, n = shared_path(docs.sparkSession, "suffixes"), 0
    for items in _blocks(benchmark, item_col, item_text_col):
        Queries(items, window).save(folder, n)
        n += 1
    return folder, n


def _found(words: Words, folder: str, n: int):
    """For each block of queries: the queries, longest matches, and for each occurrence of a window suffix, word position and length."""
    hashes = words.hashes(lower=True)
    for block in range(n):
        q = _loaded(folder, block)
        yield q, *shard_matches(SuffixArray(hashes, words.of, q), q)


def matches(docs: DataFrame, benchmark: DataFrame, window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """Every location of a matched window: doc_id, word, item_id, item_word and the length of the match from there, in words."""
    folder, n = _written(docs, benchmark, window, item_col, item_text_col)
    names = [id_col, "word", "item_id", "item_word", "length"]

    def run(batches):
        for p in pieces(batches, 1):
            words = Words(*text_buffers(p.column(1)), NOT_ALNUM)
            for q, _, suffix, at, length in _found(words, folder, n):
                order = np.lexsort((at, suffix))
                suffix, at, length = suffix[order], at[order], length[order]
                doc = np.searchsorted(words.of, at, side="right") - 1
                item = pa.array([q.ids[i] for i in q.item[suffix].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(doc)), int_array(at - words.of[doc]), item, int_array(q.place[suffix]), int_array(length)], names=names)

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, word long, item_id string, item_word long, length long")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window=WINDOW, text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """item_id, item_word and longest: the longest verbatim match, in words, of every test suffix that matches anywhere."""
    folder, n = _written(docs, benchmark, window, item_col, item_text_col)

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for p in pieces(batches, 0):
            for block, (_, longest, *_) in enumerate(_found(Words(*text_buffers(p.column(0)), NOT_ALNUM), folder, n)):
                best[block] = np.maximum(best.get(block, 0), longest)
        for block, longest in best.items():
            q, some = _loaded(folder, block), np.flatnonzero(longest)
            item = pa.array([q.ids[i] for i in q.item[some].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([item, int_array(q.place[some]), int_array(longest[some])], names=["item_id", "item_word", "longest"])

    found = arrow_map(docs.select(F.col(text_col)), run, "item_id string, item_word long, longest long")
    return found.groupBy("item_id", "item_word").agg(F.max("longest").alias("longest"))


def contamination(docs: DataFrame, benchmark: DataFrame, window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", keep=()) -> DataFrame:
    """One row per document: its id and the columns of keep, n_words, n_hit, items (sorted), longest match that holds a window."""
    folder, n = _written(docs, benchmark, window, item_col, item_text_col)
    keys = [id_col, *(k for k in keep if k != id_col)]

    def run(batches):
        for p in pieces(batches, len(keys)):
            words = Words(*text_buffers(p.column(len(keys))), NOT_ALNUM)
            cover = np.zeros(len(words.start) + 1, np.int32)
            best = np.zeros(p.num_rows, np.int64)
            ids: list[set[str]] = [set() for _ in range(p.num_rows)]
            for q, _, suffix, at, length in _found(words, folder, n):
                doc = np.searchsorted(words.of, at, side="right") - 1
                np.add.at(cover, at, 1)
                np.add.at(cover, at + q.need[suffix], -1)
                np.maximum.at(best, doc, length)
                for x in np.unique(doc * max(len(q.ids), 1) + q.item[suffix]).tolist():
                    ids[x // len(q.ids)].add(q.ids[x % len(q.ids)])
            sums = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            yield pa.RecordBatch.from_arrays([*p.columns[: len(keys)], int_array(words.counts()), int_array(np.diff(sums[words.of])), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), int_array(best)], names=[*keys, "n_words", "n_hit", "items", "longest"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return arrow_map(docs.select(*(F.col(f"`{k}`") for k in keys), F.col(text_col)), run, f"{head}, n_words long, n_hit long, items array<string>, longest long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window=WINDOW, text_col="text", **cols) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(text_col).alias("__text"))
    return contamination(whole, benchmark, window, "__doc", "__text", **cols).where("n_hit = 0").select("__doc.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    c = contamination(docs, benchmark, id_col=id_col, text_col=text_col)
    return c.select(F.col(id_col).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")
