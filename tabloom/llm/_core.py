"""Shared pieces of the corpus operators: Arrow text buffers, word hashes, durable stages, components."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: ASCII white space that separates words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Fixed odd multipliers and the masks that keep the first 0 to 8 bytes of a lane.
_M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
LONG = 4096
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches by bytes, so that a run of long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def buckets(spark: SparkSession, size: int = 0, mb: int = 32) -> int:
    """How many hash buckets for `size` bytes: at most about `mb` MB each, and no fewer than the session's shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


# ---------------------------------------------------------------- durable stages


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one in local mode (tests); a cluster has to name it."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tabloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folder of each settled table, for discard().
_FOLDER: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Parquet looks at its buffers after 100 rows only, and a reader holds a row group's column at once: too late for rows of some MB.
_WIDE = {"parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1"}


def settle(df: DataFrame, name: str = "stage", wide: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors; its shuffle files
    go when it is written. wide: its rows are blocks of megabytes, so row groups are small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(compression="zstd", **(_WIDE if wide else {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDER[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for df in tables:
        path = _FOLDER.pop(df, None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append_columns(df: DataFrame, make, fields: list[tuple[str, str]]) -> DataFrame:
    """df with the columns that make(record batch) returns as Arrow arrays, in one narrow pass; columns of those names are replaced."""
    kept = df.drop(*[n for n, _ in fields])
    names = [f.name for f in kept.schema.fields]

    def run(batches):
        for b in batches:
            new = make(b)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], *new], names=[*names, *[n for n, _ in fields]])

    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields)).fields])
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- texts as bytes


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[raw[0] : raw[-1]], raw - raw[0]


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of at most limit bytes; a longer text stands alone."""
    buf, off = string_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", buffer=padded.data, strides=(1,))


def hash_runs(every: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of bytes (every: lanes of the buffer). Eight bytes at a time go through a one-to-one mix of
    the whole state, so it is no polynomial: runs of at most eight bytes and one length never collide, others by chance.
    Runs of more than LONG bytes are hashed whole."""
    h = mix(size.astype(np.uint64) * _M1 + U64(seed * int(_M2) % 2**64))
    for k in np.flatnonzero(size > LONG):
        raw = every.base[start[k] : start[k] + size[k]]
        h[k] = int.from_bytes(blake2b(raw.tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    at = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(at):
        left = size[at] - done
        lane = every[start[at] + done] & _MASK[np.minimum(left, 8)]
        h[at] = mix((h[at] ^ lane) * _M2 + _M1)
        done += 8
        at = at[left > 8]
    return h


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a chunk, in order, and the n + 1 word offsets of its texts."""
    start, end = word_bounds(buf, off)
    return hash_runs(lanes(_LOWER[buf]), start, end - start), np.searchsorted(start, off).astype(np.int64)


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a chunk of texts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = off[:-1][off[:-1] < n]
    begins[inner] |= solid[inner]
    ends = np.empty(n, bool)
    ends[-1] = solid[-1]
    ends[:-1] = solid[:-1] & (~solid[1:] | begins[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


_POSITION = np.random.default_rng(977).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def ngrams(h: np.ndarray, off: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text (all, not distinct) and their offsets; short: a text of fewer words is one shingle."""
    count = np.diff(off)
    full = np.maximum(count - n + 1, 0)
    total = len(h)
    if total >= n:
        every = np.zeros(total - n + 1, np.uint64)
        for i in range(n):
            every += h[i : total - n + 1 + i] * _POSITION[i]
        doc = np.repeat(np.arange(len(count)), full)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(off[:-1], full)
        every = mix(every[at])
    else:
        every = np.zeros(0, np.uint64)
    small = np.flatnonzero((count > 0) & (count < n)) if short else np.zeros(0, np.int64)
    if not len(small):
        return every, np.concatenate([[0], np.cumsum(full)])
    sizes = full.copy()
    sizes[small] = 1
    new = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(new[-1], np.uint64)
    is_small = np.zeros(len(count), bool)
    is_small[small] = True
    out[np.repeat(~is_small, sizes)] = every
    for d in small:
        one = U64(0)
        with np.errstate(over="ignore"):
            for i in range(count[d]):
                one += h[off[d] + i] * _POSITION[i]
            out[new[d]] = mix(np.array([one + U64(count[d])], np.uint64))[0]
    return out, new


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each run, and the new offsets."""
    h = h.copy()
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    first = off[:-1][off[:-1] < len(h)]
    keep[first] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], total[off]


def sets(column: pa.Array, n: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, offsets): the set of distinct n-word shingles of every text of a column."""
    for lo, hi, buf, off in text_chunks(column, limit):
        yield lo, hi, *distinct(*ngrams(*words(buf, off), n))


def sum_runs(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run, 0 for an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


#: What stands for a missing key among packed ones.
NO_KEY = -(1 << 63)


def pack_keys(column: pa.Array) -> bytes:
    """A column of whole numbers as bytes, missing ones marked."""
    return np.asarray(column.cast(pa.int64()).fill_null(NO_KEY)).tobytes()


def unpack_keys(keys: np.ndarray) -> pa.Array:
    return pa.array(keys, mask=keys == NO_KEY)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def as_json(x: object) -> str:
    return json.dumps(x, sort_keys=True)


# ---------------------------------------------------------------- components

#: Edges that one task contracts at a time.
EDGES = 1 << 18


def fewer(df: DataFrame, rows: int, size: int = EDGES) -> DataFrame:
    """df in as many partitions as `rows` rows of it need, where its shuffle would deal out more: no task then is nearly empty."""
    spark = df.sparkSession
    need = max(spark.sparkContext.defaultParallelism, -(-rows // size))
    return df.coalesce(need) if 4 * need <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def contract(size: int, whole: bool = False):
    """Edges (u, v) to a forest of the same components, some edges after the other: each node with the smallest it is connected
    to among them; whole: the smallest ones with themselves too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u, v = (np.concatenate([h[k] for h in held]) for k in range(2))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = forest(len(ids), at[: len(u)], at[len(u) :])
            keep = np.ones(len(ids), bool) if whole else low != np.arange(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[low[keep]])], names=["u", "v"])

        held, count = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            count += b.num_rows
            if count >= size and not whole:
                yield forest_of(held)
                held, count = [], 0
        if count:
            yield forest_of(held)

    return run


def components(edges: DataFrame, nodes: DataFrame | None = None, size: int = EDGES) -> DataFrame:
    """(id, component): the smallest id reachable by the edges (a, b); ids of nodes without an edge are their own.

    Edges are contracted to forests where they lie. While more than `size` of them are left, large-star and small-star steps
    (Kiveris et al. 2014) alternate: every step is a grouped minimum and a rewrite of the edges, so no group is gathered and a
    hot node costs one aggregate. The number of steps grows with the logarithm of the longest path. Each step is a table in the
    shared folder, of as many parts as it has edges for. The last `size` edges are one contraction.
    """
    plain = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    e = settle(plain.mapInArrow(contract(size), "u long, v long"), "edges")

    lows: list[DataFrame] = []

    def star(e: DataFrame, large: bool, rows: int) -> DataFrame:
        both = e.select("u", "v")
        if large:
            both = both.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join below reads two plain exchanges and a hot node can be split
        low = settle(fewer(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), rows, size), "low")
        lows.append(low)
        out = both.join(low, "u")
        if large:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0] > size:
        wide = settle(fewer(star(e, True, before[0]), before[0], size), "large")
        new = settle(fewer(star(wide, False, before[0]).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), before[0], size), "small")
        discard(e, wide, *lows)
        lows.clear()
        e = new
        now = mark(e)
        if now == before:
            break
        before = now
    if before[0] <= size:
        found = settle(e.coalesce(1).mapInArrow(contract(size, True), "u long, v long"), "components").select(F.col("u").alias("id"), F.col("v").alias("component"))
    else:
        found = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        found = found.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes is connected to by the links (i, j)."""
    low = np.arange(n)
    while True:
        p, q = low[i], low[j]
        m = np.minimum(p, q)
        new = low.copy()
        for at in (i, j, p, q):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new
