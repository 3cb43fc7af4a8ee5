"""Exact token counts at every prefix, by dynamic programming over words.

The library's tokenizer drops white space and never merges across it, so the count of a prefix that ends inside word j
is the count of the prefix before the word plus that of the word's part: T[i] = T[end of word j-1] + tokens(part of j).
The counts of all parts of a word come from one pass over its bytes (prefixes.py), in time linear in its length; for a
vocabulary of another build the library encodes every distinct part, which is quadratic in a stretch's length.
The table T has one entry for each code point of the text. Questions about the whole text, truncation and budgets are
answered from it without encoding a text again.

With longest=None every entry is counted. With a number, as the operator has by default, entries after so many code points
of a stretch without white space and ASCII digits are null but for its end; a digit is a token of its own, so a stretch
ends there.

Rows: a null or empty text has no tokens and an empty table, one of white space alone has no tokens. Repeated rows give
repeated results, an empty table none. Other columns of the input are ignored. A null id stays null.
"""

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, arrow_map, byte_sums, mix, pieces, runs_of, text_buffers
from .prefixes import prefix_counter

#: Distinct parts of words whose counts a worker remembers; beyond it the memory starts anew (about 100 MB).
REMEMBERED = 1_000_000
LONG = 256


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok, {}


def _stretches(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what is encoded at once: words, cut around the ASCII digits of long ones."""
    start, end, data = words.start, words.end, words.data
    long = np.flatnonzero(end - start > LONG)
    if not len(long):
        return start, end
    at = runs_of(start[long], (end - start)[long])
    digit = (data >= 48) & (data < 58)
    ascii_ = data < 128
    # A border lies between two ASCII characters of which one is a digit.
    inner = at[~np.isin(at, start[long])]
    cuts = inner[(digit[inner] | digit[inner - 1]) & ascii_[inner] & ascii_[inner - 1]]
    return np.sort(np.append(start, cuts)), np.sort(np.append(end, cuts))


def _counted(keys: np.ndarray, spans, data: np.ndarray, path: str) -> np.ndarray:
    """The library's counts of distinct parts named by hashes; spans(new) gives where the parts of these indices are."""
    tok, known = _tokenizer(path)
    counts = np.fromiter((known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
    new = np.flatnonzero(counts < 0)
    if len(new):
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(*(v.tolist() for v in spans(new)))]
        got = np.array([len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
        counts[new] = got
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update(zip(keys[new].tolist(), got.tolist()))
    return counts


def _inside(words: Words, a, m, at, begin, longest: int | None, sums, up, path: str) -> np.ndarray:
    """The counts of distinct stretches (at a, of m bytes) at each byte that ends a code point; -1: not counted."""
    data = words.data
    counter = prefix_counter(path)
    if counter and longest is None:
        return counter.counts(data[at], begin)
    last = np.ones(len(data) + 1, bool)  # a code point ends with this byte
    last[: max(len(data) - 1, 0)] = (data[1:] & 0xC0) != 0x80
    of = np.repeat(np.arange(len(a)), m)
    place = at - a[of]
    wanted = last[at]
    if longest is not None:  # up to so many of them, and the end
        points = np.concatenate([[0], np.cumsum(wanted)])
        wanted = wanted & ((points[1:] - points[begin][of] <= longest) | (place == m[of] - 1))
    if counter:
        return np.where(wanted, counter.counts(data[at], begin), -1)
    # Another vocabulary: every part by the library.
    part = np.flatnonzero(wanted)
    h = mix((sums[at[part] + 1] - sums[a[of[part]]]) * up[a[of[part]]] + (place[part] + 1).astype(np.uint64))
    keys, one, which = np.unique(h, return_index=True, return_inverse=True)
    table = np.full(len(at), -1, np.int64)
    table[part] = _counted(keys, lambda new: (a[of[part[one[new]]]], at[part[one[new]]] + 1), data, path)[which]
    return table


def prefix_counts(words: Words, path: str, inside: bool = True, longest: int | None = LONG) -> np.ndarray:
    """For every byte of a piece: the tokens of its document up to and with the code point that this byte ends; -1: not counted."""
    data = words.data
    n = len(data)
    sums, up = byte_sums(data, False)
    start, end = _stretches(words)
    size = end - start
    whole = mix((sums[end] - sums[start]) * up[start] + size.astype(np.uint64))
    distinct, first, back = np.unique(whole, return_index=True, return_inverse=True)
    if inside:  # distinct stretches at every end of a code point
        a, m = start[first], size[first]
        at, begin = runs_of(a, m), np.cumsum(m) - m
        table = _inside(words, a, m, at, begin, longest, sums, up, path)
        begin = begin[back]
        total = table[begin + size - 1] if len(size) else size
    else:
        total = _counted(distinct, lambda new: (start[first[new]], end[first[new]]), data, path)[back]
    # Every stretch stands on top of all before it in its document.
    all_ = np.concatenate([[0], np.cumsum(total)])
    doc_first = all_[np.searchsorted(start, words.offsets[:-1])]
    base = all_[:-1] - doc_first[np.searchsorted(words.offsets, start, side="right") - 1]
    out, gap = np.full(n, -1, np.int64), np.ones(n, bool)
    spot = runs_of(start, size)
    gap[spot] = False
    if inside:
        own = table[runs_of(begin, size)]
        out[spot] = np.where(own < 0, -1, own + np.repeat(base, size))
    else:
        out[end - 1] = total + base
    # White space has the count of the last stretch before it in the document.
    at = np.flatnonzero(gap)
    out[at] = all_[np.searchsorted(end, at, side="right")] - doc_first[np.searchsorted(words.offsets, at, side="right") - 1]
    return out


def token_prefixes(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", inside: bool = True, longest: int | None = LONG) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and counts: the tokens of the text's first 1, 2, ... code points.

    Without inside, entries that end within a word are null; longest=None leaves no others null.
    """

    def table(batches):
        for p in pieces(batches, 1):
            data, offsets = text_buffers(p.column(1))
            counts = prefix_counts(Words(data, offsets), tokenizer, inside, longest)
            last = np.ones(len(data), bool)
            last[: max(len(data) - 1, 0)] = (data[1:] & 0xC0) != 0x80
            points = np.concatenate([[0], np.cumsum(last)])[offsets].astype(np.int32)
            counts = counts[last]
            lists = pa.ListArray.from_arrays(pa.array(points), pa.array(counts.astype(np.int32), mask=counts < 0))
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.diff(offsets), pa.int64()), lists], names=["doc_id", "n_bytes", "counts"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), table, f"doc_id {kind}, n_bytes long, counts array<int>")


def n_tokens(counts: Column) -> Column:
    """The tokens of the whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def tokens_within(counts: Column, n_chars: Column) -> Column:
    """The tokens of the text's first n_chars code points (of the whole text, if it has no more)."""
    at = F.least(n_chars.cast("int"), F.size(counts))
    return F.when(at <= 0, F.lit(0)).otherwise(F.try_element_at(counts, F.greatest(at, F.lit(1)))).cast("long")


def chars_within(counts: Column, budget: Column) -> Column:
    """The code points of the longest prefix that has at most budget tokens."""
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col="doc_id", text_col="text", inside: bool = False, longest: int | None = LONG) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and cut_chars: the longest prefix, in code points, within limit tokens.

    Without inside, the cut is not within a word.
    """
    t = token_prefixes(docs, tokenizer, id_col, text_col, inside, longest).withColumn("n_tokens", n_tokens(F.col("counts")))
    cut = F.when(F.col("n_tokens") > limit, chars_within(F.col("counts"), F.lit(limit))).otherwise(F.size("counts").cast("long"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), cut.alias("cut_chars"))
