"""Tables of small counts by 64-bit hash: sorted arrays in one file, memory-mapped.

The first bits of a hash choose a cell of 2 to 4 hashes, and the REST bits after them are stored; so a table of n
hashes tells them apart by about REST + log2(n) - 1 bits, and a hash that it lacks is taken for another with a chance of
about 4 / 2**REST. Rows whose counts are the usual ones are kept apart, without counts. Counts are bytes; those of 255
and more are listed beside them.
"""

import functools

import numpy as np

from . import arrays

REST = 32


#: Cells that share a base, from which their first places are counted.
GROUP = 256


def _sections(hashes: np.ndarray) -> list[np.ndarray]:
    """(bits of a cell's number, bases, first places of cells from their bases, stored bits) of sorted hashes."""
    bits = max(1, len(hashes).bit_length() - 2)
    cells = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    bases = cells[::GROUP]
    steps = cells - np.repeat(bases, GROUP)[: len(cells)]
    if steps.max() > 65535:  # never with hashes that are spread
        raise ValueError("hashes are not spread over their cells")
    return [np.array([bits], np.int64), bases.astype(np.int64), steps.astype(np.uint16), (hashes << np.uint64(bits) >> np.uint64(64 - REST)).astype(np.uint32)]


def save(folder: str, name: str, hashes: np.ndarray, columns: list[np.ndarray], usual: tuple[int, ...]) -> None:
    """Write sorted distinct hashes and their counts; a row whose first count is the usual one has the usual others."""
    plain = columns[0] == usual[0]
    sections = _sections(hashes[plain]) + _sections(hashes[~plain])
    for c in columns:
        c = c[~plain]
        wide = np.flatnonzero(c >= 255)
        sections += [np.minimum(c, 255).astype(np.uint8), wide, c[wide].astype(np.int64)]
    raw, ends = [], []
    for s in sections:
        body = s.tobytes()
        raw.append(body + b"\0" * (-len(body) % 8))
        ends.append((len(raw[-1]), len(body)))
    head = np.array([len(sections), *(n for e in ends for n in e)], np.int64).tobytes()
    arrays.save(folder, name, np.frombuffer(head + b"".join(raw), np.uint8))


class Table:
    """A table in place; values() looks hashes up by binary search within their cells."""

    def __init__(self, folder: str, name: str, usual: tuple[int, ...]):
        raw, self.usual = arrays.opened(folder, name), usual
        n = int(raw[:8].view(np.int64)[0])
        sizes = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2).tolist()
        kinds = [np.int64, np.int64, np.uint16, np.uint32] * 2 + [np.uint8, np.int64, np.int64] * len(usual)
        at, parts = 8 + 16 * n, []
        for (held, size), kind in zip(sizes, kinds):
            parts.append(np.asarray(raw[at : at + size]).view(kind))
            at += held
        self.plain, self.rest, self.columns = parts[:4], parts[4:8], [parts[k : k + 3] for k in range(8, len(parts), 3)]

    @staticmethod
    def _find(part: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, places of those found)."""
        (bits,), bases, steps, have = part
        if not len(have):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        cell = (hashes >> np.uint64(64 - int(bits))).astype(np.int64)
        want = (hashes << np.uint64(bits) >> np.uint64(64 - REST)).astype(np.uint32)
        low = bases[cell // GROUP] + steps[cell]
        cell += 1
        end = bases[cell // GROUP] + steps[cell]
        size = end - low
        for _ in range(int(size.max(initial=0)).bit_length()):
            half = size >> 1
            less = (size > 0) & (np.take(have, low + half, mode="clip") < want)
            low = np.where(less, low + half + 1, low)
            size = np.where(less, size - half - 1, half)
        found = (low < end) & (np.take(have, low, mode="clip") == want)
        return found, low[found]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """A row of counts for each column; 0 for hashes that the table lacks."""
        out = np.zeros((len(self.usual), len(hashes)), np.int64)
        found, _ = self._find(self.plain, hashes)
        out[:, found] = np.array(self.usual)[:, None]
        left = np.flatnonzero(~found)
        found, places = self._find(self.rest, hashes[left])
        left = left[found]
        for k, (narrow, wide, counts) in enumerate(self.columns):
            own = narrow[places].astype(np.int64)
            big = np.flatnonzero(own == 255)
            own[big] = counts[np.searchsorted(wide, places[big])]
            out[k, left] = own
        return out


@functools.lru_cache(8 * arrays.MAPPED)
def table(folder: str, name: str, usual: tuple[int, ...]) -> Table:
    return Table(folder, name, usual)
