"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size: band s holds items of s/2 < n <= s shingles (s a power of two, 8 at least); items of at
most four shingles are looked up by each of their shingles instead, which finds all. A document is cut into
blocks of the smallest s shingles; MinHash values of blocks combine by minimum into those of windows of two adjacent blocks
of every band, so a passage of up to s shingles lies whole in one window of its band and the similarity of item and window
is bounded below by t q / (2s + (1 - t) q) for an item of q shingles and containment t. The search uses one row a band of
the hash table: an item is a candidate if any of `hashes` values agrees, so a passage of containment 3/4 in the worst place
of its band (similarity 3/19) is missed with probability below (16/19)^hashes, 3e-5 with 60. Each candidate is then held
against the exact shingle set of the whole document: it is a leak if at least t of the item's distinct shingles occur there.

The items are the stated query set. They are handled in blocks of at most so many items and characters (a longer item alone),
so what is shipped to the executors is bounded whatever the size of the benchmark; documents are never moved.

Defined results: null or empty documents and items match nothing; an item of fewer than five words is one shingle (its whole
word sequence) and is found only as a document of just that sequence; repeated items and documents are each reported; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

HASHES, BLOCK_ITEMS, BLOCK_CHARS, SMALL = 60, 20_000, 16 << 20, 4
_ODD = np.random.default_rng(31337).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Items:
    """A block of items: exact shingles, and for each size band the sorted MinHash values of each hash."""

    ids: list
    h: np.ndarray
    off: np.ndarray
    bands: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]
    small: tuple[np.ndarray, np.ndarray]  # sorted shingles of the smallest items, and whose they are


def prepare(ids: list, texts: list[str | None], n: int, hashes: int) -> Items:
    parts = list(C.sets(pa.array(texts, pa.string()), n))
    h = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
    size = np.concatenate([np.diff(p[3]) for p in parts]) if parts else np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    bands = []
    level = np.array([max(3, int(s - 1).bit_length()) if s > SMALL else -1 for s in size])
    every, owner = h[np.repeat(size <= SMALL, size)], np.repeat(np.arange(len(size)), size)[np.repeat(size <= SMALL, size)]
    by_value = np.argsort(every, kind="stable")
    for k in sorted({*level.tolist()} - {-1}):
        mine = np.flatnonzero(level == k)
        tables = []
        for j in range(hashes):
            low = np.array([(h[off[i] : off[i + 1]] * _ODD[j]).min() for i in mine], np.uint64)
            order = np.argsort(low)
            tables.append((low[order], mine[order]))
        bands.append((1 << k, tables))
    return Items(ids, h, off, bands, (every[by_value], owner[by_value]))


def candidates(items: Items, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """(document of the chunk, item) pairs that share a MinHash value of a window, or a shingle of a small item; h: shingles of the documents in order."""
    if not len(h):
        return
    found = set()
    values, who = items.small
    if len(values):
        at = np.flatnonzero(values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h)
        a, b = np.searchsorted(values, h[at], "left"), np.searchsorted(values, h[at], "right")
        found.update((int(d), int(i)) for d, p, q in zip(np.searchsorted(off, at, "right") - 1, a, b, strict=True) for i in who[p:q])
    if items.bands:
        found.update(by_windows(items, h, off))
    yield from sorted(found)


def by_windows(items: Items, h: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
    step = items.bands[0][0]
    count = np.diff(off)
    blocks = -(-count // step)
    doc = np.repeat(np.arange(len(count)), blocks)
    first_block = np.cumsum(blocks) - blocks
    at = (np.arange(len(doc)) - np.repeat(first_block, blocks)) * step + np.repeat(off[:-1], blocks)
    found = set()
    # windows of a band: runs of step, then of twice as many blocks, inside each document
    widths = [s // step for s, _ in items.bands]
    for j in range(len(items.bands[0][1])):
        low = np.minimum.reduceat(h * _ODD[j], at)
        run, width = low, 1
        for w, (_, tables) in zip(widths, items.bands, strict=True):
            while width < w:  # minimum over 2 * width blocks from each block on
                run = ahead(run, doc, width)
                width *= 2
            window = ahead(run, doc, width)
            values, who = tables[j]
            if len(values) > len(window):
                hit = np.flatnonzero(np.isin(window, values))
            else:
                lo = np.searchsorted(values, window)
                lo[lo == len(values)] = 0
                hit = np.flatnonzero(values[lo] == window)
            if len(hit):
                a, b = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                found.update((int(doc[x]), int(i)) for x, p, q in zip(hit, a, b, strict=True) for i in who[p:q])
    return found


def ahead(run: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """Minimum of each value and the one `by` blocks on in the same document."""
    out = run.copy()
    if by < len(run):
        same = doc[by:] == doc[:-by]
        out[:-by][same] = np.minimum(run[:-by][same], run[by:][same])
    return out


def leaks_of(items: Items, column: pa.Array, n: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shingles of the item, those found in the text) of every verified leak."""
    for lo, _, buf, woff in C.text_chunks(column, 1 << 20):
        h, off = C.ngrams(*C.words(buf, woff), n)
        last, known = -1, None
        for d, i in candidates(items, h, off):
            if d != last:
                last, known = d, np.unique(h[off[d] : off[d + 1]])
            item = items.h[items.off[i] : items.off[i + 1]]
            p = np.searchsorted(known, item)
            p[p == len(known)] = 0
            shared = int((known[p] == item).sum())
            if 100 * shared >= percent * len(item):
                yield lo + d, i, len(item), shared


def item_blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size, streamed to the driver one partition at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        more = len(r[1] or "")
        if ids and (len(ids) == size or held + more > BLOCK_CHARS):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += more
    if ids:
        yield ids, texts


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 5, percent: int = 75, hashes: int = HASHES, block: int = BLOCK_ITEMS) -> DataFrame:
    """(key, item_key, item_shingles, shared_shingles, containment) of every test item found in a document."""
    C.arrow_limits(docs.sparkSession)
    item_type = benchmark.schema[item_key].dataType.simpleString()
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, `{item_key}` {item_type}, item_shingles long, shared_shingles long"
    source = docs.select(F.col(key), F.col(text))
    out = None
    for ids, texts in item_blocks(benchmark, item_key, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(ids, texts, n, hashes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            kind = None
            for b in batches:
                got = list(leaks_of(items, b.column(1), n, percent))
                kind = kind or b.schema.field(0).type
                rows, who, size, common = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([items.ids[i] for i in who], ITEM_TYPES.get(item_type)), pa.array(size, pa.int64()), pa.array(common, pa.int64())], names=[key, item_key, "item_shingles", "shared_shingles"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


ITEM_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
