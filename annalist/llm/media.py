"""Media columns: signature sniffing, with carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. A validator of the format
then confirms structure and lengths at each hit: only what parses is reported, with its true length. The format at
position 0 corrects the declared type; valid media further inside are carved.

`store_wav` writes bytes losslessly as 8-bit PCM samples of a RIFF/WAVE file; `wav_samples` reads them back.

Rows: a null text is stored as an empty one (576 bytes of padding); a null or empty media value has type
application/octet-stream and no parts. Repeated rows give repeated results, an empty table none. Other columns of the
input are ignored. Very long values are read whole, one at a time.
"""

import bisect
import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import arrow_map, pieces, text_buffers

UNIT, PAD = 576, 255  # fixed values of the contract

# Magic bytes of the formats, with the distance from the start of the file.
MAGICS = {
    b"RIFF": ("riff", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"BM": ("bmp", 0),
    b"%PDF-": ("pdf", 0),
    b"PK\x03\x04": ("zip", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
}
MIME = {"wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4"}
UNKNOWN = "application/octet-stream"


# --- validators: (format, length) of valid media at position i, or None -----------------------------------------


def _riff(b, i):
    if i + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I4s", b, i + 4)
    end, name = i + 8 + size, {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(kind)
    if not name or end > len(b) or size < 4:
        return None
    at, seen = i + 12, set()
    while at + 8 <= end:
        tag, n = struct.unpack_from("<4sI", b, at)
        if at + 8 + n > end:
            return None
        seen.add(tag)
        at += 8 + n + (n & 1)
    if at not in (end, end + 1) or (name == "wav" and not {b"fmt ", b"data"} <= seen) or not seen:
        return None
    return name, end - i


def _png(b, i):
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, tag = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or (first and tag != b"IHDR"):
            return None
        if zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if tag == b"IEND":
            return "png", at - i
    return None


def _gif(b, i):
    if i + 13 > len(b):
        return None
    flags = b[i + 10]
    at = i + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(at):
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1 if at < len(b) else None

    while at is not None and at < len(b):
        if b[at] == 0x3B:
            return "gif", at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            f = b[at + 9]
            at = blocks(at + 10 + (3 << ((f & 7) + 1) if f & 128 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b, i):
    at = i + 2
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            return None
        tag = b[at + 1]
        if tag == 0xD9:
            return "jpeg", at + 2 - i
        if at + 4 > len(b):
            return None
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2 or at + 2 + n > len(b):
            return None
        at += 2 + n
        if tag == 0xDA:
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    return None
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                else:
                    break
    return None


def _bmp(b, i):
    if i + 30 > len(b):
        return None
    size, zero, data, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, i + 2)
    if zero or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or width <= 0 or not height:
        return None
    rows = ((width * depth + 31) // 32) * 4 * abs(height)
    if data < 14 + header or size < data + (rows if b[i + 30 : i + 34] == b"\0\0\0\0" else 1) or i + size > len(b):
        return None
    return "bmp", size


class Value:
    """A media value with the places of end marks, each found once however many starts ask for them."""

    def __init__(self, raw: bytes):
        self.raw, self.marks = raw, {}

    def _places(self, mark: bytes) -> list[int]:
        if mark not in self.marks:
            places, found = [], self.raw.find(mark)
            while found >= 0:
                places.append(found)
                found = self.raw.find(mark, found + 1)
            self.marks[mark] = places
        return self.marks[mark]

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or -1."""
        places = self._places(mark)
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def before(self, mark: bytes, at: int) -> int:
        """The last place of mark before at, or -1."""
        k = bisect.bisect_left(self._places(mark), at)
        return self.marks[mark][k - 1] if k else -1


def _pdf(v, i):
    """%PDF-n.n ... startxref, the offset of a cross reference inside the file, %%EOF."""
    b = v.raw
    if not re.match(rb"%PDF-[0-9]\.[0-9]", b[i : i + 8]):
        return None
    end = v.next(b"%%EOF", i)
    at = v.before(b"startxref", end) if end >= 0 else -1
    m = re.match(rb"startxref\s+([0-9]{1,10})\s+%%EOF", b[at : at + 40]) if at >= i else None
    if not m:
        return None
    x = i + int(m[1])
    return ("pdf", at + m.end() - i) if b[x : x + 4] == b"xref" or re.match(rb"[0-9]{1,10} [0-9]{1,5} obj", b[x : x + 20]) else None


def _zip(v, i):
    """The first end record whose central directory starts behind the first file and has as many entries as it says."""
    b, end = v.raw, v.next(b"PK\x05\x06", i)
    if end < 0 or end + 22 > len(b):
        return None
    entries, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
    if i + start + size != end or end + 22 + note > len(b):
        return None
    at = i + start
    for _ in range(entries):
        if at + 46 > end or b[at : at + 4] != b"PK\x01\x02":
            return None
        name, extra, comment = struct.unpack_from("<HHH", b, at + 28)
        local = struct.unpack_from("<I", b, at + 42)[0]
        if b[i + local : i + local + 4] != b"PK\x03\x04":
            return None
        at += 46 + name + extra + comment
    return ("zip", end + 22 + note - i) if at == end and entries else None


def _gzip(v, i):
    b = v.raw
    try:
        d = zlib.decompressobj(31)
        at = i
        while not d.eof and at < len(b):
            part = b[at : at + 65536]
            while part and not d.eof:  # bounded output: the length and sum at the end are checked by zlib
                d.decompress(part, 1 << 20)
                part = d.unconsumed_tail
            at += 65536
    except zlib.error:
        return None
    return ("gzip", min(at, len(b)) - len(d.unused_data) - i) if d.eof else None


@functools.cache
def _crc_table(bits: int, poly: int) -> tuple[int, ...]:
    """The table of a cyclic redundancy check, most significant bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        out.append(x)
    return tuple(out)


def crc(data: bytes, bits: int, poly: int) -> int:
    table, shift, mask, x = _crc_table(bits, poly), bits - 8, (1 << bits) - 1, 0
    for c in data:
        x = (x << 8 & mask) ^ table[x >> shift ^ c]
    return x


def _flac(v, i):
    """fLaC, metadata blocks from a stream description on, and a first frame whose header's sum is right.

    Frames do not say their length: the stream ends where the value does, or where other media starts.
    """
    b, at, last, first = v.raw, i + 4, False, True
    while not last:
        if at + 4 > len(b):
            return None
        kind, n = b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        last = bool(b[at] & 128)
        if kind > 6 or first != (kind == 0) or first and n != 34 or at + 4 + n > len(b):
            return None
        at, first = at + 4 + n, False
    if at == len(b):
        return "flac", at - i
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    block, rate, x = b[at + 2] >> 4, b[at + 2] & 15, b[at + 4]
    number = 1 if x < 128 else 8 - (x ^ 0xFF).bit_length()  # its length is coded as in UTF-8
    size = 4 + number + (1 if block == 6 else 2 if block == 7 else 0) + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if not block or rate == 15 or number > 7 or at + size >= len(b) or crc(b[at : at + size], 8, 0x07) != b[at + size]:
        return None
    return "flac", len(b) - i


def _ogg(v, i):
    """Pages of right sums, from the first of a stream to the last that its streams mark."""
    b, at, open_, pages = v.raw, i, set(), 0
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and b[at + 4] == 0:
        n = b[at + 26]
        size = 27 + n + sum(b[at + 27 : at + 27 + n])
        if at + size > len(b):
            return None
        page = b[at : at + size]
        if crc(page[:22] + bytes(4) + page[26:], 32, 0x04C11DB7) != int.from_bytes(page[22:26], "little"):
            return None
        kind, serial = page[5], page[14:18]
        if kind & 2:
            open_.add(serial)
        elif serial not in open_:
            return None
        if kind & 4:
            open_.discard(serial)
        at, pages = at + size, pages + 1
        if not open_:
            return "ogg", at - i
    return None


#: Boxes of the top level of an MP4 file.
_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"pdin", b"emsg"}


def _mp4(v, i):
    """A file type box with a brand, then known boxes as long as they follow; one with the media or its description."""
    b, at, seen = v.raw, i, set()
    while at + 8 <= len(b):
        n, tag = struct.unpack_from(">I4s", b, at)
        head = 8
        if n == 1 and at + 16 <= len(b):
            n, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        if tag not in _BOXES or n < head or at + n > len(b) or (at == i and (tag != b"ftyp" or n < 16 or n % 4)):
            break
        seen.add(tag)
        at += n
    return ("mp4", at - i) if seen & {b"moov", b"mdat", b"moof"} else None


def _plain(check):
    return lambda v, i: check(v.raw, i)


_VALID = {k: _plain(f) for k, f in (("riff", _riff), ("png", _png), ("gif", _gif), ("jpeg", _jpeg), ("bmp", _bmp))} | {"pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (name, before) in MAGICS.items():
        a.add_word(magic.decode("latin-1"), (name, len(magic) - 1 + before))
    a.make_automaton()
    return a


def sniff(media: bytes) -> list[tuple[str, int, int]]:
    """(format, start, end) of all valid media in a value, outermost first; parts inside a valid part are listed too."""
    out, value = [], Value(media)
    for at, (name, back) in _automaton().iter(media.decode("latin-1")):
        if at - back >= 0 and (found := _VALID[name](value, at - back)):
            out.append((found[0], at - back, at - back + found[1]))
    return sorted(out, key=lambda x: (x[1], -x[2]))


# --- lossless storage ------------------------------------------------------------------------------------------


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + bytes([PAD]) * (-len(payload) % unit or (0 if payload else unit))


def store_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM; the samples are the bytes."""
    odd = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def wav_samples(media: bytes) -> bytes:
    at = 12
    while at + 8 <= len(media):
        tag, n = struct.unpack_from("<4sI", media, at)
        if tag == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


# --- operators -------------------------------------------------------------------------------------------------


def store_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, declared (type) and media: each text's bytes, padded, as a WAVE file."""

    def store(batches):
        for p in pieces(batches, 1):
            data, off = text_buffers(p.column(1))
            raw = data.tobytes()
            media = [store_wav(padded(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.diff(off), pa.int64()), pa.array([UNKNOWN] * len(media), pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), store, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, declared string, media binary")


def sniff_media(rows: DataFrame, media_col="media", declared_col="declared") -> DataFrame:
    """All columns of rows, and mime (declared, corrected), corrected, parts (format, start, end) and payload.

    payload: the samples of a WAVE file, else the bytes. Columns of these names in rows are replaced.
    """
    added = ["mime", "corrected", "parts", "payload"]
    rows = rows.drop(*added)
    names = rows.columns
    m, d = names.index(media_col), names.index(declared_col)
    kind = pa.list_(pa.struct([("format", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for p in pieces([batch], m):
                cols = [[], [], [], []]
                for media, declared in zip(p.column(m), p.column(d).to_pylist()):
                    b = media.as_py() or b""
                    parts = sniff(b)
                    top = next((x for x in parts if x[1] == 0), None)
                    mime = MIME[top[0]] if top else (UNKNOWN if declared is None or declared in MIME.values() else declared)
                    payload = wav_samples(b) if top and top[0] == "wav" else b
                    for c, v in zip(cols, (mime, mime != declared, [{"format": f, "start": s, "end": e} for f, s, e in parts], payload)):
                        c.append(v)
                made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), kind, pa.binary()))]
                yield pa.RecordBatch.from_arrays([*p.columns, *made], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "mime string", "corrected boolean", "parts array<struct<format:string,start:long,end:long>>", "payload binary"])
    return arrow_map(rows, run, schema)


def carve(rows: DataFrame, media_col="media") -> DataFrame:
    """One row per valid media inside each value of sniffed rows: format, mime, start, end and the bytes carved."""
    part = F.explode("parts").alias("part")
    mime = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return rows.select("*", part).select(*[c for c in rows.columns if c not in ("parts", "payload", media_col, "mime")], F.col("part.format"), mime[F.col("part.format")].alias("mime"), F.col("part.start"), F.col("part.end"), F.substring(F.col(media_col), F.col("part.start").cast("int") + 1, (F.col("part.end") - F.col("part.start")).cast("int")).alias("carved"))


def media_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    s = sniff_media(store_texts(docs, id_col, text_col))
    inner = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["format"], p["start"].cast("string"), (p["end"] - p["start"]).cast("string"))), ",")
    tail = F.col("payload").substr(F.length("payload") - 31, F.lit(32))
    feature = F.concat_ws("|", "mime", F.when(F.col("corrected"), "corrected").otherwise("declared"), inner)
    return s.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
