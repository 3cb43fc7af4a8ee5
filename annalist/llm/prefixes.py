"""Token counts of all prefixes of a word under byte-pair merges with an end mark, in linear time.

A sequence of tokens is the encoding of its bytes if and only if every token encodes to itself and every two neighbours
would be left as they are (merges apply by rank, leftmost first, and a merge's parts are older than the merge). So the
encoding of a prefix is that of a shorter prefix and one more token, found among the vocabulary's entries that end there:
C[i] = C[i - len(t)] + 1 for the only t that the shorter prefix's last token is a valid neighbour of. The last token of a
finished word is taken from the entries with the end mark in the same way. The words of a piece share the prefixes that they
have in common; entries are found by hashes of suffixes, and prefixes of one length are counted at once.

Before the merges a text is normalized (NFC, lower case by code point) and split into letters, single numbers, other
runs and contractions. A code point's class and lower case are asked of the library. In text that NFC leaves as it is, every
prefix is as normal, and prefixes of a text are prefixes of its normal form; other text, and text with special strings,
goes through a slower reader that takes back what the next code point changes.
"""

import functools
import json
import os
import re
import unicodedata
from array import array

import numpy as np

from .blocks import byte_sums, mix, runs_of

#: Whether two tokens are neighbours is remembered in so many slots (18 MB), and by the scalar paths for so many pairs.
SLOTS = 1 << 21
REMEMBERED = 500_000
#: Longer words, in bytes, are counted one by one.
DEPTH = 256
#: More code points that may change one another (a letter and its marks) are counted by the library, from the word before on.
MARKS = 64

END = "</w>"
SPACE, LETTER, NUMBER, OTHER = range(4)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str, spec: dict):
        from tokenizers import Tokenizer, normalizers

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.encode = tok.encode_batch_fast
        self.split, self.nfc, self.lowercase = tok.pre_tokenizer.pre_tokenize_str, normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Tokens are named by rank: those without a merge, then merges in order.
        made = {a + b for a, b in merges}
        names = [t for t in vocab if t not in made]
        self.split_of = [(i, i) for i in range(len(names))]
        rank = {t: i for i, t in enumerate(names)}
        self.pair: dict[int, int] = {}
        for a, b in merges:
            i = rank[a + b] = len(self.split_of)
            self.split_of.append((rank[a], rank[b]))
            self.pair[rank[a] << 32 | rank[b]] = i
        # Tokens that do not encode to themselves never occur.
        occurs = [True] * len(names)
        for i in range(len(names), len(self.split_of)):
            a, b = self.split_of[i]
            occurs.append(occurs[a] and occurs[b] and self._neighbours(a, b, i))
        letters = _byte_letters()
        #: bytes: (token without end mark, with it), -1 for none
        self.tokens: dict[bytes, tuple[int, int]] = {}
        for t, i in rank.items():
            if occurs[i]:
                end = t.endswith(END)
                raw = bytes(letters[c] for c in (t[: -len(END)] if end else t))
                free, last = self.tokens.get(raw, (-1, -1))
                self.tokens[raw] = (free, i) if end else (i, last)
        self.most = max(map(len, self.tokens))
        self._char, self._class, self._lower = functools.cache(self._char), functools.cache(self._class), functools.cache(self.lowercase)
        ascii_ = [self._char(chr(c)) for c in range(128)]
        self.ascii_low, self.ascii_class = np.array([x[0] for x in ascii_], np.uint32), np.array([x[1] for x in ascii_], np.uint8)
        self.valid: dict[int, bool] = {}
        self.slot_pair, self.slot_valid = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
        self._suffixes()
        self.contracted = {c: self._scalar(c.encode())[-1] for c in CONTRACTIONS}

    def _suffixes(self) -> None:
        """A hash table of the suffixes of all tokens' bytes; free and final are their tokens, -1 for none."""
        names = list(self.tokens)
        size = np.array([len(t) for t in names])
        sums, up = byte_sums(np.frombuffer(b"".join(names), np.uint8), False)
        end = np.cumsum(size)
        start = runs_of(end - size, size)
        width = np.repeat(end, size) - start
        key = mix((sums[start + width] - sums[start]) * up[start] + width.astype(np.uint64))
        whole = np.zeros(len(key), np.int64) - 1
        whole[end - size] = np.arange(len(names))
        order = np.argsort(whole, kind="stable")
        keys, back = np.unique(key, return_inverse=True)
        of = np.zeros(len(keys), np.int64)
        of[back[order]] = whole[order]  # a suffix that is a token is one, whatever else ends with it
        free, final = (np.array([self.tokens[t][i] for t in names] + [-1], np.int64) for i in (0, 1))
        self.free, self.final = free[of], final[of]
        bits = int(len(keys) * 3).bit_length()
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        while len(left):
            empty = self.slot_at[slot] < 0
            self.slot_at[slot[empty]] = left[empty]
            lost = self.slot_at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.slots
        used = self.slot_at >= 0
        self.slot_key[used] = keys[self.slot_at[used]]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where the suffixes with these hashes are in free and final; -1: none has it."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.slot_at[slot]
        far = np.flatnonzero((out >= 0) & (self.slot_key[slot] != keys))
        slot = slot[far]
        while len(far):
            slot = (slot + 1) & self.slots
            out[far] = self.slot_at[slot]
            on = (out[far] >= 0) & (self.slot_key[slot] != keys[far])
            far, slot = far[on], slot[on]
        return out

    # --- merges ------------------------------------------------------------------------------------------------

    def _neighbours(self, a: int, b: int, limit: int = 1 << 31) -> bool:
        """Whether merges leave tokens a and b side by side as they are (limit: pairs of that rank and above do not count)."""
        split, pair = self.split_of, self.pair
        while True:
            if pair.get(a << 32 | b, limit) < limit:
                return False
            # Take back the later of the two merges.
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def _step(self, word, i: int, before, last, opened) -> tuple[int, int, int]:
        """(last token, tokens, tokens with the end mark) of word[:i + 1]; last and opened at before[j] are those of word[:j + 1]."""
        valid, tokens = self.valid, self.tokens
        token = n = ended = 0
        for k in range(min(i + 1, self.most), 0, -1):
            t = tokens.get(bytes(word[i + 1 - k : i + 1]))
            if t is None:
                continue
            free, final = t
            if k == i + 1:
                left, count = -1, 1
            else:
                at = before[i - k]
                left, count = last[at], opened[at] + 1
            for new in (free if not n else -1, final if not ended else -1):
                if new < 0:
                    continue
                if left >= 0:
                    key = left << 32 | new
                    ok = valid.get(key)
                    if ok is None:
                        ok = valid[key] = self._neighbours(left, new)
                    if not ok:
                        continue
                if new == free:
                    token, n = new, count
                else:
                    ended = count
            if n and ended:
                break
        return token, n, ended

    def _scalar(self, word: bytes) -> array:
        """The tokens of every prefix of a word, in bytes, one by one."""
        last, opened, ended = array("i"), array("i"), array("i")
        if len(self.valid) > REMEMBERED:
            self.valid.clear()
        for i in range(len(word)):
            token, n, m = self._step(word, i, range(len(word)), last, opened)
            last.append(token)
            opened.append(n)
            ended.append(m)
        return ended

    def _all_neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_neighbours of pairs of tokens."""
        pair = left.astype(np.uint64) << np.uint64(32) | (right + 1).astype(np.uint64)
        slot = (mix(pair) & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.slot_valid[slot]
        new = np.flatnonzero(self.slot_pair[slot] != pair)
        if len(new):
            _, one, back = np.unique(pair[new], return_index=True, return_inverse=True)
            one = new[one]
            got = np.array([self._neighbours(a, b) for a, b in zip(left[one].tolist(), right[one].tolist())])
            out[new] = got[back]
            # Pairs of one slot: the last one written, of both arrays alike, stays.
            _, stay = np.unique(slot[one], return_index=True)
            self.slot_pair[slot[one[stay]]], self.slot_valid[slot[one[stay]]] = pair[one[stay]], got[stay]
        return out

    def _words(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of every prefix, in bytes, of the words start to end of raw, one word after another."""
        size = end - start
        data = np.frombuffer(raw, np.uint8)
        sums, up = byte_sums(data, False)
        _, first, back = np.unique(mix((sums[end] - sums[start]) * up[start] + size.astype(np.uint64)), return_index=True, return_inverse=True)
        begin, long = start[first], size[first]
        place = np.cumsum(long) - long
        counts = np.zeros(int(long.sum()), np.int64)
        short = long <= DEPTH
        for i in np.flatnonzero(~short).tolist():
            counts[place[i] : place[i] + long[i]] = self._scalar(raw[begin[i] : begin[i] + long[i]])
        if short.any():
            counts[runs_of(place[short], long[short])] = self._together(sums, up, begin[short], long[short])
        return counts[runs_of(place[back], size)]

    def _together(self, sums, up, start, size) -> np.ndarray:
        at, origin = runs_of(start, size), np.repeat(start, size)
        depth = at - origin + 1
        _, one, which = np.unique(mix((sums[at + 1] - sums[origin]) * up[origin] + depth.astype(np.uint64)), return_index=True, return_inverse=True)
        # Distinct prefixes: where they end, their length, and the vocabulary's entries that end there.
        stop, length = at[one] + 1, depth[one]
        nodes, widths, entries = [], [], []
        live, k = np.arange(len(one)), 0
        while len(live):
            k += 1
            live = live[length[live] >= k]
            s = stop[live] - k
            found = self._find(mix((sums[stop[live]] - sums[s]) * up[s] + np.uint64(k)))
            live, found = live[found >= 0], found[found >= 0]
            some = (self.free[found] >= 0) | (self.final[found] >= 0)
            nodes.append(live[some])
            widths.append(np.full(len(nodes[-1]), k))
            entries.append(found[some])
        node, width, entry = np.concatenate(nodes), np.concatenate(widths), np.concatenate(entries)
        rest = length[node] - width
        before = np.where(rest > 0, which[one[node] - np.where(rest > 0, width, 0)], -1)
        free, final = self.free[entry], self.final[entry]
        last, opened, ended = (np.full(len(one) + 1, x, np.int64) for x in (-1, 0, 0))  # at -1: nothing yet
        # Without the end mark, by length.
        order = np.flatnonzero(free >= 0)
        order = order[np.argsort(length[node[order]], kind="stable")]
        bounds = np.searchsorted(length[node[order]], np.arange(1, length.max() + 2))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c = order[x:y]
            b = before[c]
            ok = b < 0
            on = np.flatnonzero(~ok)
            ok[on] = self._all_neighbours(last[b[on]], free[c[on]])
            c, b = c[ok], b[ok]
            last[node[c]], opened[node[c]] = free[c], opened[b] + 1
        # With it.
        c = np.flatnonzero(final >= 0)
        b = before[c]
        ok = b < 0
        on = np.flatnonzero(~ok)
        ok[on] = self._all_neighbours(last[b[on]], final[c[on]])
        ended[node[c[ok]]] = opened[b[ok]] + 1
        return ended[which]

    # --- code points -------------------------------------------------------------------------------------------

    def _char(self, c: str) -> tuple[int, int]:
        """(lower case, class) of a code point; without a lower case of one code point, -1."""
        low = self.lowercase(c)
        return (ord(low) if len(low) == 1 else -1), self._class(low[0])

    def _class(self, c: str) -> int:
        n = len(self.split(c + c))
        return SPACE if not n else NUMBER if n == 2 else LETTER if len(self.split("a" + c)) == 1 else OTHER

    def _chars(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower case and class of code points; the third array tells those whose lower case has several code points (theirs is left)."""
        low, kind, several = points.copy(), np.zeros(len(points), np.uint8), np.zeros(len(points), bool)
        plain = points < 128
        low[plain], kind[plain] = self.ascii_low[points[plain]], self.ascii_class[points[plain]]
        high = np.flatnonzero(~plain)
        if len(high):
            some, back = np.unique(points[high], return_inverse=True)
            got = [self._char(chr(c)) for c in some.tolist()]
            to, of = np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.uint8)
            several[high] = (to < 0)[back]
            low[high] = np.where(to < 0, some, to)[back]
            kind[high] = of[back]
        return low, kind, several

    # --- stretches ---------------------------------------------------------------------------------------------

    def counts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For stretches without white space that lie one after another: at the last byte of each code point the tokens
        of its stretch so far; at other bytes -1."""
        n = len(data)
        out = np.full(n, -1, np.int64)
        if not n:
            return out
        raw, end = data.tobytes(), np.append(begin[1:], n)
        lead = (data & 0xC0) != 0x80
        text = raw.decode()
        points = data.astype(np.uint32) if len(text) == n else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        final = np.append(np.flatnonzero(lead)[1:], n) - 1  # a code point's last byte
        first = np.cumsum(lead)[begin] - 1  # a stretch's first code point
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(first, len(points))))
        low, kind, several = self._chars(points)
        odd = np.zeros(len(begin), bool)  # for the slower reader
        odd[of[several]] = True
        for m in self.special.finditer(text):
            odd[of[m.start()]] = True
        high = np.flatnonzero(np.add.reduceat(data >= 128, begin))
        parts = [raw[s:e].decode() for s, e in zip(begin[high].tolist(), end[high].tolist())]
        joined = "\n".join(parts)
        if self.nfc(joined) != joined:
            odd[high[[self.nfc(p) != p for p in parts]]] = True

        # Words as the splitter makes them.
        opens = np.zeros(len(points), bool)
        opens[first] = True
        stretch = opens.copy()
        opens[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        opens &= kind != SPACE
        half = self._contract(low, kind, opens, stretch)
        inside = kind != SPACE
        inside &= ~odd[of]
        opens &= inside
        word = np.cumsum(opens)  # words up to and with this code point
        width = 1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000)
        lower = low.astype(np.uint8).tobytes() if len(text) == n and not (low >= 128).any() else low.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.cumsum(width)
        start = np.flatnonzero(opens)
        stop = start + np.bincount(word[inside] - 1, minlength=len(start)) - 1
        own = np.zeros(len(points), np.int64)
        if len(start):
            own[inside] = self._words(lower, ends[start] - width[start], ends[stop])[np.cumsum(width[inside]) - 1]
        own[half] = 2  # an apostrophe and a letter, until the second letter makes them one word
        sums = np.concatenate([[0], np.cumsum(own[stop])])
        count = np.where(inside, own + sums[np.maximum(word - 1, 0)], sums[word])
        out[final] = count - sums[word[first] - opens[first]][of]
        for i in np.flatnonzero(odd).tolist():
            s, e = int(begin[i]), int(end[i])
            part = raw[s:e].decode()
            out[final[first[i] : first[i] + len(part)]] = self._read(part)
        return out

    @staticmethod
    def _contract(low, kind, opens, stretch) -> np.ndarray:
        """Make contractions words of their own, in place; the first letters of those with two are returned."""
        n = len(low)
        at = np.flatnonzero(opens & (low == ord("'")))
        far = lambda k: (at + k < n) & ~stretch[np.minimum(at + k, n - 1)]
        there = far(1)
        one, two = low[np.minimum(at + 1, n - 1)], low[np.minimum(at + 2, n - 1)]
        short = there & np.isin(one, [ord(c[1]) for c in CONTRACTIONS if len(c) == 2])
        long = there & far(2) & np.isin(one.astype(np.uint64) << np.uint64(32) | two, np.array([ord(c[1]) << 32 | ord(c[2]) for c in CONTRACTIONS if len(c) == 3], np.uint64))
        for found, size in ((short, 2), (long, 3)):
            opens[at[found] + 1] = False
            after = at[found] + size
            after = after[after < n]
            opens[after] = kind[after] != SPACE
        return at[long] + 1

    # --- the slower reader -------------------------------------------------------------------------------------

    def _read(self, text: str) -> list[int]:
        """The tokens of the first 1, 2, ... code points of a stretch."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text):
            # Until its last character a special string is text like any other.
            out += [base + c for c in self._normal(text[at : m.end() - 1])]
            before = m.start() - at
            base = (out[m.start() - 1] if before else base) + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self._normal(text[at:])]

    def _normal(self, text: str) -> list[int]:
        reader, out, i = _Reader(self), [], 0
        start, base = 0, 0  # where a word starts, the tokens before it
        while i < len(text):
            j = i + 1
            while j < len(text) and _joins(text[j]):
                j += 1
            mark, have = len(reader.rows), ""
            if j - i > MARKS:
                for k in range(i + 1, j + 1, MARKS):
                    parts = [text[start:x] for x in range(k, min(k + MARKS, j + 1))]
                    out += [base + len(e.ids) for e in self.encode(parts, add_special_tokens=False)]
                reader.text(self.nfc(text[i:j]))
                i = j
                continue
            for k in range(i + 1, j + 1):
                # What the code point changes in the normal form is taken back.
                now = self.nfc(text[i:k])
                same = len(os.path.commonprefix([have, now]))
                reader.back(mark + sum(len(self._lower(c)) for c in have[:same]))
                reader.text(now[same:])
                have = now
                out.append(reader.rows[-1][-1])
            if reader.opens(mark):
                start, base = i, reader.rows[mark][3]
            i = j
        return out


class _Reader:
    """Reads normal code points one by one and can go back; a row: kind, apostrophe or first letter after it, first byte of the
    word, tokens before the word, tokens so far."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.rows, self.sizes = counter, [], []
        self.raw, self.last, self.open = bytearray(), array("i"), array("i")

    def back(self, rows: int) -> None:
        del self.rows[rows:], self.sizes[rows:]
        size = self.sizes[-1] if rows else 0
        del self.raw[size:], self.last[size:], self.open[size:]

    def opens(self, row: int) -> bool:
        """Whether a word starts with this row, whatever comes after it."""
        kind, seen, first, _, _ = self.rows[row]
        return kind in (LETTER, OTHER) and seen in ("", "'") and first == (self.sizes[row - 1] if row else 0)

    def text(self, normal: str) -> None:
        for c in normal:
            for d in self.counter._lower(c):
                self.push(d)

    def push(self, c: str) -> None:
        kind = self.counter._class(c)
        was, seen, first, base, count = self.rows[-1] if self.rows else (SPACE, "", 0, 0, 0)
        size, new = len(self.raw), c.encode()
        if kind == LETTER and seen and seen + c in self.counter.contracted:
            base = self.rows[-len(seen)][3]
            self._bytes(new, size)
            row = (NUMBER, "", size, base, base + self.counter.contracted[seen + c])  # like a number, joined by nothing
        elif kind == SPACE:
            self._bytes(new, size)
            row = (kind, "", size, count, count)
        elif kind == was and kind != NUMBER:
            row = (kind, "", first, base, base + self._bytes(new, first))
        else:
            mark = "'" if c == "'" else seen + c if seen == "'" and kind == LETTER else ""
            row = (kind, mark, size, count, count + self._bytes(new, size))
        self.rows.append(row)
        self.sizes.append(len(self.raw))

    def _bytes(self, new: bytes, first: int) -> int:
        for b in new:
            self.raw.append(b)
            # Only as many bytes as a token can have are looked at.
            low = max(first, len(self.raw) - self.counter.most - 1)
            word = self.raw[low:]
            token, n, ended = self.counter._step(word, len(word) - 1, range(low, len(self.raw)), self.last, self.open)
            self.last.append(token)
            self.open.append(n)
        return ended


@functools.cache
def _seconds() -> frozenset[str]:
    """Code points that can become one with an earlier one."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d:
            found |= {chr(int(x, 16)) for x in d.split()[1:]}
    return frozenset(found)


@functools.cache
def _joins(c: str) -> bool:
    """Whether the normal form of what stands before c may depend on c; a code point unknown here counts as one that may."""
    if c < "\u0300":
        return False
    d = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(d) != 0 or d in _seconds() or c in _seconds() or unicodedata.category(c) == "Cn"


@functools.cache
def prefix_counter(path: str) -> PrefixCounter | None:
    """The counter for a vocabulary of the build described above; None for others."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].isascii() for t in spec["added_tokens"])
    if model != MODEL or spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} or not plain:
        return None
    seen = set(spec["model"]["vocab"]) - {"".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]}
    if seen != {c + e for c in _byte_letters() for e in ("", END)}:
        return None  # every byte is a token, with the end mark and without
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        if a not in seen or b not in seen or a + b in seen:
            return None  # parts are older than their merge, and each token has one merge
        seen.add(a + b)
    return PrefixCounter(path, spec)
