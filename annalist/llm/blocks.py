"""Columnar text kernels shared by the operators of this subpackage.

Text columns travel as Arrow buffers. A batch is cut into pieces of about 1 MB (a longer document is a piece of its
own), and words, their hashes and rolling hashes are found with numpy over the raw UTF-8 bytes of a piece.
All separators used here are ASCII, so byte positions split words exactly as code points would.
"""

import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20

# Separators of the contracts, as byte values.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_ALNUM = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))  # before lower-casing A-Z

_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)


# --- session helpers -------------------------------------------------------------------------------------------


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def n_buckets(df: DataFrame, per_bucket: int = 6 << 20, least: int = 64, most: int = 1 << 20) -> int:
    """Hash buckets, a power of two, so that one holds about per_bucket bytes of the input files; above 6 TB it holds more."""
    n = int(min(most, max(least, -(-plan_bytes(df) // per_bucket))))
    return 1 << (n - 1).bit_length()


def block_size(base: int, buckets: int) -> int:
    """Entries that a task gathers before it deals them to buckets: a packed row should hold several."""
    return max(base, 8 * buckets)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where none is set, as in tests, one under the warehouse."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not own:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(own)
    return own.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/annalist-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that Spark sends to a worker; the default of 64 MB would fill an executor with long texts.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with the session's batches bounded in bytes."""
    conf = df.sparkSession.conf
    if not 0 < int(re.sub(r"\D", "", conf.get(_BATCH_CONF)) or 0) <= BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


# --- pieces of Arrow batches -----------------------------------------------------------------------------------


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = column.buffers()[1]
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batches, text: int, limit: int = PIECE_BYTES):
    """Cut record batches so that the text column of each holds about limit bytes, or one document."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_buffers(batch.column(text))
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


@functools.cache
def _word_table(separators: tuple[int, ...]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; with lower, A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * _ROOT
    return x ^ (x >> np.uint64(32))


def byte_sums(data: np.ndarray, lower: bool, base: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """(sums, up): (sums[e] - sums[s]) * up[s] is the polynomial hash, modulo 2**64, of bytes s to e-1."""
    up, down = _power_tables(len(data) + 1, base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(_byte_values(lower), data, out=sums[1:])
    sums[1:] *= down[: len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    return sums, up


class Words:
    """The words of a piece: byte starts and ends, and of[d]:of[d+1] the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...] = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 1, bool)
        np.take(_word_table(separators), data, out=inside[:n])
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before[offsets[:-1]] = False  # a document starts here
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n + 1, bool)
        after[:n] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, mixed with its length."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums, up = byte_sums(self.data, lower)
        h = (sums[self.end] - sums[self.start]) * up[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _STEP)


def rolling(values: np.ndarray, width: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every run of width consecutive values; result i covers i to i+width-1."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n + 1, base)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(values, down[:n], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[: n - width + 1])


def whole(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the runs of width words from word i on lie in one document; starts: first word of each document."""
    if n < width:
        return np.zeros(0, bool)
    ok = np.ones(n - width + 1, bool)
    cut = np.zeros(n + 2, np.int32)
    inner = starts[(starts > 0) & (starts < n)]  # a run over such a border holds words of two documents
    np.add.at(cut, np.maximum(inner - width + 1, 0), 1)
    np.add.at(cut, inner, -1)
    ok &= np.cumsum(cut)[: n - width + 1] == 0
    return ok


def runs_of(flags_start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i], start[i]+1, ... of counts[i] members."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    first, size = flags_start[keep], counts[keep]
    at = np.cumsum(size) - size
    out[at] = first
    out[at[1:]] -= first[:-1] + size[:-1] - 1
    return np.cumsum(out)


def int_array(values, kind=pa.int64()) -> pa.Array:
    return pa.array(np.ascontiguousarray(values), kind)


def row_key(id_col: str, text_col: str):
    """Names a row by its id and text; equal rows share it."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def as_key(column):
    """A string that is never null and tells null from any text."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


# --- packed columns: many entries travel in one row ------------------------------------------------------------


def pack(values: np.ndarray, compress: bool = True) -> bytes:
    """An integer array as bytes: the narrowest width, byte planes apart, zstd."""
    import zstandard

    if compress and len(values) and values.dtype != np.uint64:
        for kind in (np.uint8, np.uint16, np.uint32):
            if values.min() >= 0 and values.max() <= np.iinfo(kind).max:
                values = values.astype(kind)
                break
    name = values.dtype.str.encode()
    if not compress:
        return b"r" + name + values.tobytes()
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return b"z" + name + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    kind, body = np.dtype(raw[1:4].decode()), raw[4:]
    if raw[:1] == b"r":
        return np.frombuffer(body, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31), np.uint8)
    size = kind.itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).reshape(-1)


class Entries:
    """Word positions grouped by document, packed: the ids and tags of the documents, how many entries each has, and their starts."""

    NAMES = ("ids", "tags", "per_doc", "starts")

    @staticmethod
    def packed(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """doc: for each entry, ascending, the document's index in ids and tags; starts ascend within a document."""
        cut = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
        some = doc[cut]
        first = ids[some]
        step = np.diff(starts, prepend=0)
        step[cut] = starts[cut]
        return [pack(np.diff(first, prepend=0)), pack(tags[some].astype(np.uint32)), pack(np.diff(np.append(cut, len(doc)))), pack(step)]

    @staticmethod
    def unpacked(ids: bytes, tags: bytes, per_doc: bytes, starts: bytes):
        """(ids, tags, per_doc, starts) as arrays, starts within their documents."""
        n = unpack(per_doc).astype(np.int64)
        sums = np.cumsum(unpack(starts).astype(np.int64))
        at = np.cumsum(n) - n
        if len(sums):
            base = np.where(at > 0, sums[at - 1], 0)
            sums = sums - np.repeat(base, n)
        return np.cumsum(unpack(ids).astype(np.int64)), unpack(tags), n, sums
