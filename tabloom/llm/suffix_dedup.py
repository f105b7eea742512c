"""Removal of repeated passages by distributed prefix doubling.

A position is repeated if the `length` bytes from it also start somewhere else; all bytes of such strings go. Repeats are found
on a sparse suffix array. Its positions are the minimizers: of each window of W (64) positions the one whose eight bytes have
the smallest key, the first on ties, so that equal strings choose alike and no two neighbours lie further apart than W. The
reduced string has one symbol for each of them, the bytes up to and with the eight of the next one.

1. Spark sorts the symbols (128-bit names of at most W + 8 bytes) over the corpus and numbers them: ranks of offset 1.
2. At offsets 1, 2, 4, ... the pairs (rank at a position, rank that many positions on) are sorted by Spark and numbered anew.
   A position whose pair is unique falls out; one whose next offset would lead past `length` bytes is done. This goes on until
   every position is unique or past the threshold.
3. A last pair of overlapping ranks reaches just past `length` from each position: where it is repeated, the string is.
4. Between two such positions all bytes go anyway. Every other byte position whose ranks are still in play is decided
   exactly: the pair of ranks that spans the minimizers of its own `length` bytes, with the bytes before and after them
   (fewer than W each), is sorted by Spark once more. Positions that need no decision of their own are evidence where another
   position with the same rank needs one: an exchange of ranks finds them, and of all alike (the same two ranks past the
   threshold around them) a single one is asked. A repeated minimizer before a stretch that step 3 leaves open is sorted too,
   as evidence: elsewhere its string may be followed by other bytes, where step 3 alone can't tell.

Ranks are numbers of sorted runs, so equality of ranks is equality of strings; only symbols and the short ends of step 4 are
compared by 128-bit names. A block of texts sends each distinct pair once, marked if it occurs again there: thousands of
copies are one row a block, and a run is numbered as a stream, so no group is gathered. Unique text, the bulk, sends one row for each 32 bytes or so
in step 1 and nothing after.

Defined results: null or empty texts have no bytes; texts shorter than `length` keep all; matches never cross texts; repeated
rows cover each other whole; rows without a key are kept without one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C
from tabloom.llm.katz import narrow, wide

#: Bytes of text in a block, bytes looked at for a position's key, bits of a rank that number the runs of one task.
BLOCK, SEED, RUN_BITS = 4 << 20, 8, 34
_ORDER = np.uint64(0xA24BAED4963EE407)
_LOW32 = np.uint64(0xFFFFFFFF)


def window_of(length: int) -> int:
    """W: the largest power of two up to 64 and a sixth of the length, so that first and last window of a string never meet."""
    if length < 24:
        raise ValueError("repeats shorter than 24 bytes are not supported")
    return min(64, 1 << ((length // 6).bit_length() - 1))


def least_level(length: int) -> int:
    """The highest offset (as a power of two) that the minimizers of every string of `length` bytes span."""
    w = window_of(length)
    return (-(-(length - 2 * w - SEED + 2) // w)).bit_length() - 1


class Chunk:
    """Some texts of a block: the minimizer of the window at each position, and the sorted minimizers."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int) -> None:
        self.length, self.w, n = length, window_of(length), len(buf)
        self.lanes = C.lanes(buf)
        self.end = np.repeat(off[1:], np.diff(off))
        at = np.arange(n)
        low = (self.lanes[:n] * _ORDER & ~_LOW32) | at.astype(np.uint64)
        step = 1
        while step < self.w:
            if n > step:
                low[:-step] = np.minimum(low[:-step], low[step:])
            step *= 2
        self.window = at + (self.w + SEED - 1) <= self.end
        self.low = (low & _LOW32).astype(np.int64)  # only where the window lies in one text
        chosen = np.zeros(n, bool)
        chosen[self.low[self.window]] = True
        self.place = np.flatnonzero(chosen)
        self.number = np.cumsum(chosen) - 1  # of the last minimizer up to each position
        self.stop = self.end[self.place] if n else self.place

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each minimizer, how many positions on the first one past the threshold lies (or the last of its text), and whether there is one."""
        goal = np.searchsorted(self.place, self.place + self.length - SEED)
        last = np.searchsorted(self.place, self.stop) - 1
        whole = goal <= last
        return np.where(whole, goal, last) - np.arange(len(self.place)), whole

    def gaps(self) -> np.ndarray:
        """Bytes from each minimizer to the next one of its text, 0 for the last."""
        out = np.zeros(len(self.place), np.int64)
        out[:-1] = np.where(self.stop[:-1] == self.stop[1:], np.diff(self.place), 0)
        return out

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which minimizers have a next one in their text, 128-bit names of the symbols in two halves)."""
        has = np.flatnonzero((self.stop[:-1] == self.stop[1:])) if len(self.place) else np.zeros(0, np.int64)
        return has, *name(self.lanes, self.place[has], self.place[has + 1] - self.place[has] + SEED)

    def undecided(self, ranks: list[np.ndarray], full: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions that the ranks leave open here or, where asked, elsewhere; names of their strings in two halves)."""
        n, none, level = len(self.end), np.zeros(0, np.int64), least_level(self.length)
        if not len(self.place) or len(ranks) <= level:
            return none, none.astype(np.uint64), none.astype(np.uint64)
        starts = np.flatnonzero(np.arange(n) + self.length <= self.end)
        first = self.number[self.low[starts]]
        alive = ranks[level][first] > 0
        starts, first = starts[alive], first[alive]
        before = self.number[starts]
        after = np.minimum(before + 1, len(self.place) - 1)
        inside = before >= 0
        left = np.maximum(before, 0)
        # a minimizer whose neighbour is not full as well goes anyway, but its string is evidence and so is named
        sure = inside & full[left] & full[after] & (self.stop[left] == self.end[starts]) & (self.stop[after] == self.end[starts]) & (self.place[after] - self.place[left] <= self.length)
        sure &= ~asked[left]
        starts, first = starts[~sure], first[~sure]
        last = self.number[self.low[starts + (self.length - SEED + 1 - self.w)]]
        level = np.floor(np.log2(last - first)).astype(np.int64)
        a, b = pick(ranks, level, first), pick(ranks, level, last - (1 << level))
        open_ = (a > 0) & (b > 0)
        starts, first, last, level, a, b = (x[open_] for x in (starts, first, last, level, a, b))
        ahead, tail = self.place[first] - starts, self.place[last] + SEED
        behind = starts + self.length - tail
        parts = [*name(self.lanes, starts, ahead), *name(self.lanes, tail, behind)]
        sizes = (ahead * 4096 + behind * 16 + level).astype(np.uint64)
        out = []
        for k in (0, 1):
            h = C.mix(sizes + np.uint64(k + 7))
            for x in (a.astype(np.uint64), b.astype(np.uint64), parts[k], parts[2 + k]):
                h = C.mix((h ^ x) * C._M2 + np.uint64(2 * k + 1))
            out.append(h)
        return starts, out[0], out[1]


def name(lanes: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.hash_runs(lanes, at, size, 11), C.hash_runs(lanes, at, size, 23)


def pick(ranks: list[np.ndarray], level: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in np.unique(level):
        if k < len(ranks):
            out[level == k] = ranks[k][at[level == k]]
    return out


def chunks(buf: np.ndarray, sizes: np.ndarray, length: int) -> Iterator[tuple[int, Chunk]]:
    """(first byte, chunk) of runs of whole texts of a block, about a quarter of a megabyte each."""
    off, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 18), "right")) - 1)
        yield int(off[lo]), Chunk(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length)
        lo = hi


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index of each distinct pair, which of them each pair is, how often it occurs)."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    x = a[order]
    new[1:] = x[1:] != x[:-1]
    x = b[order]
    new[1:] |= x[1:] != x[:-1]
    which = np.empty(len(a), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], which, np.diff(np.flatnonzero(new), append=len(a))


# ---------------------------------------------------------------- sorting and ranking in Spark

_PAIRS = "a long, b long, block long, code long"
_RANKS = "block long, at int, rank long"


def pair_rows(block: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows of a block's distinct pairs; code: number of the pair, doubled, and one more if it occurs again in the block."""
    first, _, count = distinct_pairs(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.full(len(first), block)), pa.array(np.arange(len(first)) * 2 + (count > 1))], names=["a", "b", "block", "code"])


def number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of sorted pairs: numbers of the runs of equal ones; runs of a single occurrence are unique and fall out.

    A stream: what passes from batch to batch is the last pair, its weight and at most one row held back."""
    top = (TaskContext.get().partitionId() << RUN_BITS) + 1
    last, weight, held = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, block, code = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = last != (a[0], b[0])
        run = np.cumsum(new)
        size = np.bincount(run, 1 + (code & 1))
        if not new[0]:
            size[0] += weight
        keep = size[run] >= 2
        rank, at = top + run, code >> 1
        out = [block[keep], at[keep].astype(np.int32), rank[keep]]
        if held is not None and not new[0] and size[0] >= 2:
            out = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip((*held, top), out, strict=True)]
        weight = int(size[-1])
        top += int(run[-1])
        last = (a[-1], b[-1])
        if weight >= 2:
            held = None
        elif new[-1]:
            held = (block[-1], at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["block", "at", "rank"])


def ranked(pairs: DataFrame, parts: int) -> DataFrame:
    """(block, at, rank) of the pairs that occur more than once, sorted and numbered by Spark."""
    return pairs.repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(number_runs, _RANKS)


def asked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by rank, and within it by evidence (0: need), the first of each evidence where there is need."""
    last, needed = (None, None, None), False
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, c, block, code = (x.to_numpy() for x in batch.columns)
        new = np.concatenate([[a[0] != last[0]], a[1:] != a[:-1]])
        fresh = np.concatenate([[(b[0], c[0]) != last[1:]], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) | new
        wanted = np.concatenate([[needed], b[new] == 0])
        flag = wanted[np.cumsum(new)]
        last, needed = (a[-1], b[-1], c[-1]), bool(flag[-1])
        keep = flag & fresh & (b != 0)
        yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(code[keep].astype(np.int32)), pa.array(a[keep])], names=["block", "at", "rank"])


def asked(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "a").sortWithinPartitions("a", "b", "c", "block").mapInArrow(asked_runs, _RANKS)


def sparse(rank: np.ndarray) -> bytes:
    """Positions and values of the ranks above 0."""
    at = np.flatnonzero(rank)
    return at.astype(np.uint32).tobytes() + rank[at].tobytes()


def dense(raw: bytes, n: int) -> np.ndarray:
    out, k = np.zeros(n, np.int64), len(raw) // 12
    out[np.frombuffer(raw, np.uint32, k)] = np.frombuffer(raw, np.int64, k, 4 * k)
    return out


_STATE = "block long, n long, steps binary, gaps binary, whole binary, same binary, ranks array<binary>, open long"


class State:
    """The minimizers of a block: steps to the threshold, and the ranks of every offset so far (0: unique)."""

    def __init__(self, row: dict) -> None:
        self.block, self.n = row["block"], row["n"]
        self.steps, self.gaps = wide(row["steps"], self.n), wide(row["gaps"], self.n)
        self.whole = np.unpackbits(np.frombuffer(row["whole"], np.uint8))[: self.n].astype(bool)
        self.same = row["same"]
        self.ranks = [dense(r, self.n) for r in row["ranks"] or []]

    def double(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions not yet past the threshold whose two ranks are both repeated, the ranks)."""
        offset, rank = 1 << (len(self.ranks) - 1), self.ranks[-1]
        at = np.flatnonzero((rank > 0) & (self.steps >= 2 * offset))
        at = at[rank[at + offset] > 0]
        return at, rank[at], rank[at + offset]

    def reach(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions with a way past the threshold still in play, their two overlapping ranks, told apart by the steps between)."""
        at = np.flatnonzero(self.whole)
        level = np.floor(np.log2(self.steps[at])).astype(np.int64)
        a, b = pick(self.ranks, level, at), pick(self.ranks, level, at + self.steps[at] - (1 << level))
        ok = (a > 0) & (b > 0)
        return at[ok], a[ok], b[ok] ^ (self.steps[at[ok]] << 54)

    def fill(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, told: pa.Table) -> np.ndarray:
        """New ranks: those told of the block's distinct pairs, at their positions."""
        _, which, count = distinct_pairs(a, b)
        value = np.zeros(len(count), np.int64)
        value[told.column("at").to_numpy()] = told.column("rank").to_numpy()
        out = np.zeros(self.n, np.int64)
        out[at] = value[which]
        return out

    def needs(self, reach: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rank, b, c, gap): of the gap before each minimizer, the ranks that the strings from its positions may start with, by
        the first level that every string spans; b and c are 0 where positions of the gap may be open, else the ranks past the
        threshold on both sides, which decide all strings from there. A gap is named by the minimizer it starts at."""
        level, w = least_level(length), window_of(length)
        if len(self.ranks) <= level or not self.n:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        rank, ends = self.ranks[level], self.gaps == 0  # ends: the last minimizer of a text
        place = np.concatenate([[0], np.cumsum(np.where(ends, 4 * w, self.gaps))[:-1]])
        text = np.cumsum(np.concatenate([[0], ends[:-1]]))
        right = np.append(reach[1:], 0)
        sure = ~ends & (reach > 0) & (right > 0)
        out = [], [], []

        def put(gap: np.ndarray, to: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
            ok = rank[to] > 0
            out[0].append(rank[to][ok])
            out[1].append(np.stack([b[ok], c[ok]], 1))
            out[2].append(gap[ok])

        at, none = np.arange(self.n), np.zeros(self.n, np.int64)
        b, c = np.where(sure, reach, 0), np.where(sure, right, 0)
        begin = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
        put(begin, begin, none[begin], none[begin])  # positions before the first minimizer of a text
        step = 0
        while len(at):
            put(at, at + step, b[at], c[at])
            step += 1
            at = at[at + step < self.n]
            at = at[(text[at + step] == text[at]) & (place[at + step] - place[at + 1] < w)]
            more = begin[begin + step < self.n]
            more = more[(text[more + step] == text[more]) & (place[more + step] - place[more] < w)]
            put(more, more + step, none[more], none[more])
        rank, both, gap = (np.concatenate(x) for x in out)
        return rank, both[:, 0], both[:, 1], gap

    def packed(self, length: int) -> list[bytes]:
        """The ranks, without those of levels that no later step reads."""
        return [sparse(r) if k >= least_level(length) or k == len(self.ranks) - 1 else b"" for k, r in enumerate(self.ranks)]

    def row(self, length: int) -> pa.Table:
        """The state as a table of one row."""
        columns = [[self.block], [self.n], [narrow(self.steps)], [narrow(self.gaps)], [np.packbits(self.whole).tobytes()], [self.same], [self.packed(length)], [len(self.double()[0]) if self.ranks else 0]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(["block", "n", "steps", "gaps", "whole", "same", "ranks", "open"], columns, kinds, strict=True)})


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


# ---------------------------------------------------------------- the passes over text


def read_blocks(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Texts in blocks of bounded size with the steps of their minimizers; same: index of the first minimizer with the same symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, buf, off in C.text_chunks(b.column(1), BLOCK):
                sizes = np.diff(off)
                steps, gaps, whole, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
                at, one, two = ([np.zeros(0, k)] for k in (np.int64, np.uint64, np.uint64))
                for _, c in chunks(buf, sizes, length):
                    s, w = c.steps()
                    has, x, y = c.symbols()
                    for out, v in ((steps, s), (gaps, c.gaps()), (whole, w), (at, has + count), (one, x), (two, y)):
                        out.append(v)
                    count += len(s)
                has = np.concatenate(at)
                first, which, _ = distinct_pairs(np.concatenate(one), np.concatenate(two))
                same = np.full(count, -1, np.int64)
                same[has] = which
                parts = [np.concatenate(steps), np.concatenate(gaps), np.concatenate(whole)]
                columns = [block, C.pack_keys(b.column(0).slice(lo, hi - lo)), sizes.tobytes(), buf.tobytes(), count, narrow(parts[0]), narrow(parts[1]), np.packbits(parts[2]).tobytes(), narrow(same + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, [pa.int64(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 4], strict=True)], names=["block", "keys", "sizes", "text", "n", "steps", "gaps", "whole", "same"])
                block += 1

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "block long, keys binary, sizes binary, text binary, n long, steps binary, gaps binary, whole binary, same binary")


def symbol_rows(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            names = [c.symbols()[1:] for _, c in chunks(np.frombuffer(r["text"], np.uint8), np.frombuffer(r["sizes"], np.int64), length)]
            if names:
                yield pair_rows(r["block"], *(np.concatenate(x) for x in zip(*names, strict=True)))

    return run


def state_rows(pairs_of: Callable[[State], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            s = State(r)
            _, a, b = pairs_of(s)
            if len(a):
                yield pair_rows(s.block, a, b)

    return run


def first_ranks(length: int) -> Callable:
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _empty_state()
        s = State(row.to_pylist()[0])
        which = wide(s.same, s.n) - 1
        value = np.zeros(int(which.max(initial=-1)) + 2, np.int64)
        value[told.column("at").to_numpy()] = told.column("rank").to_numpy()
        s.ranks, s.same = [np.where(which >= 0, value[which], 0)], b""
        return s.row(length)

    return run


def next_ranks(length: int) -> Callable:
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _empty_state()
        s = State(row.to_pylist()[0])
        s.ranks.append(s.fill(*s.double(), told))
        return s.row(length)

    return run


def _empty_state() -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in (("block", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("gaps", pa.binary()), ("whole", pa.binary()), ("same", pa.binary()), ("ranks", pa.list_(pa.binary())), ("open", pa.int64()))})


_KNOWN = "block long, n long, gaps binary, ranks array<binary>, reach binary"
_ASKS = "a long, b long, c long, block long, code long"


def reached(length: int) -> Callable:
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        s = State(row.to_pylist()[0])
        reach = s.fill(*s.reach(), told)
        ranks = [r if k >= least_level(length) else b"" for k, r in enumerate(s.packed(length))]
        return pa.table({"block": pa.array([s.block]), "n": pa.array([s.n]), "gaps": row.column("gaps"), "ranks": pa.array([ranks], pa.list_(pa.binary())), "reach": C.binary_array([sparse(reach)])})

    return run


def needed(row: dict, length: int) -> tuple[np.ndarray, ...]:
    """The distinct rows of a block's needs, and of each one its gap."""
    s = State(row | {"steps": bytes(row["n"]), "whole": bytes(row["n"]), "same": b""})
    a, b, c, gap = s.needs(dense(row["reach"], s.n), length)
    order = np.lexsort((c, b, a))
    x, y, z = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    return x[new], y[new], z[new], gap[order][new]


def need_rows(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            a, b, c, _ = needed(r, length)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(np.full(len(a), r["block"])), pa.array(np.arange(len(a)))], names=["a", "b", "c", "block", "code"])

    return run


def with_asked(length: int) -> Callable:
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        r = row.to_pylist()[0]
        flag = np.zeros(r["n"], bool)
        flag[needed(r, length)[3][told.column("at").to_numpy()]] = True
        full = dense(r["reach"], r["n"]) > 0
        return pa.table({"block": row.column("block"), "n": row.column("n"), "ranks": row.column("ranks"), "full": C.binary_array([np.packbits(full).tobytes()]), "asked": C.binary_array([np.packbits(flag).tobytes()])})

    return run


_OPEN = "block long, sure binary, at binary, which binary, a binary, b binary"


def marked(raw: bytes) -> np.ndarray:
    """Which positions of a block bits name; up to seven more behind its end are False."""
    return np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)


def open_positions(length: int) -> Callable:
    """A block's text and ranks to the starts that are sure, and those still open with the names of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            ranks = [dense(x, r["n"]) for x in r["ranks"]]
            full, wanted = (np.unpackbits(np.frombuffer(r[c], np.uint8)).astype(bool) for c in ("full", "asked"))
            n = len(r["text"])
            sure, at, count = np.zeros(n, bool), np.zeros(n, bool), 0
            one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for first, c in chunks(np.frombuffer(r["text"], np.uint8), np.frombuffer(r["sizes"], np.int64), length):
                mine = slice(count, count + len(c.place))
                count += len(c.place)
                p, a, b = c.undecided([x[mine] for x in ranks], full[mine], wanted[mine])
                sure[c.place[full[mine]] + first] = True
                at[p + first] = True
                one.append(a)
                two.append(b)
            a = np.concatenate(one)
            one.clear()
            b = np.concatenate(two)
            two.clear()
            k, which, times = distinct_pairs(a, b)
            again = times > 1  # repeated in this block already: sent too, for the other blocks' sake
            a, b, which = a[k], b[k], which.astype(np.uint32) * 2 + again[which]
            columns = [np.packbits(sure), np.packbits(at), which, a, b]
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), *[C.binary_array([x.tobytes()]) for x in columns]], names=["block", "sure", "at", "which", "a", "b"])

    return run


def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in rows_of(batches):
        a, b, which = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64), np.frombuffer(r["which"], np.uint32)
        if len(a):
            code = np.zeros(len(a), np.int64)
            code[which >> 1] = which
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), r["block"])), pa.array(code)], names=["a", "b", "block", "code"])


def decided(row: pa.Table, told: pa.Table) -> pa.Table:
    """All starts of repeated strings of a block, as bits."""
    sure, at, which = marked(row.column("sure")[0].as_py()), marked(row.column("at")[0].as_py()), np.frombuffer(row.column("which")[0].as_py(), np.uint32)
    yes = np.zeros(len(row.column("a")[0].as_py()) // 8, bool)
    yes[told.column("at").to_numpy()] = True
    sure[np.flatnonzero(at)[yes[which >> 1]]] = True
    return pa.table({"block": row.column("block"), "starts": C.binary_array([np.packbits(sure).tobytes()])})


def cut_out(key: str, length: int, with_kept: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            buf, sizes, starts = np.frombuffer(r["text"], np.uint8), np.frombuffer(r["sizes"], np.int64), np.flatnonzero(marked(r["starts"]))
            off = np.concatenate([[0], np.cumsum(sizes)])
            apart = np.flatnonzero(np.diff(starts) > length)  # the last start of each run of overlapping strings but one
            step = np.zeros(len(buf) + 1, np.int8)
            step[starts[np.concatenate([[0], apart + 1])] if len(starts) else starts] = 1
            step[(starts[np.append(apart, len(starts) - 1)] if len(starts) else starts) + length] = -1
            gone = np.cumsum(step[: len(buf)], dtype=np.int8) > 0
            spans, digest, kept = [], [], []
            for x, y in zip(off[:-1], off[1:], strict=True):
                cut, raw = gone[x:y], buf[x:y]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                left = raw[~cut].tobytes()
                digest.append(hashlib.sha256(left).hexdigest())
                if with_kept:
                    kept.append(left)
            columns = [C.unpack_keys(np.frombuffer(r["keys"], np.int64)), pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [C.binary_array(kept)] * with_kept, names=[key, "n_bytes", "spans", "kept_sha256"] + ["kept"] * with_kept)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, with_kept: bool = True) -> DataFrame:
    """(key, n_bytes, spans: start and length in bytes of the maximal removed runs, kept_sha256, and with_kept: the bytes left)."""
    spark = docs.sparkSession
    window_of(length)
    C.arrow_limits(spark, BLOCK >> 20)
    blocks = C.settle(read_blocks(docs, key, text, length), "text-blocks", wide=True)
    C.arrow_limits(spark, 16)
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = C.buckets(spark, 32 * total)

    def told(rows: DataFrame) -> DataFrame:
        return C.settle(ranked(rows, parts), "ranks")

    def by_block(left: DataFrame, answers: DataFrame, f: Callable, schema: str, name: str) -> DataFrame:
        out = C.settle(left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema), name, wide=True)
        C.discard(answers)
        return out

    bare = blocks.select("block", "n", "steps", "gaps", "whole", "same", F.lit(None).cast("array<binary>").alias("ranks"))
    answers = told(blocks.select("block", "sizes", "text").mapInArrow(symbol_rows(length), _PAIRS))
    state = by_block(bare, answers, first_ranks(length), _STATE, "state")
    while state.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]:
        answers = told(state.where("open > 0").mapInArrow(state_rows(State.double), _PAIRS))
        new = by_block(state, answers, next_ranks(length), _STATE, "state")
        C.discard(state)
        state = new
    answers = told(state.mapInArrow(state_rows(State.reach), _PAIRS))
    reach = by_block(state, answers, reached(length), _KNOWN, "reached")
    C.discard(state)
    answers = C.settle(asked(reach.mapInArrow(need_rows(length), _ASKS), parts), "asked")
    known = by_block(reach, answers, with_asked(length), "block long, n long, ranks array<binary>, full binary, asked binary", "known")
    C.discard(reach)
    found = C.settle(blocks.select("block", "sizes", "text").join(known, "block").mapInArrow(open_positions(length), _OPEN), "open", wide=True)
    C.discard(known)
    answers = told(found.select("block", "which", "a", "b").mapInArrow(open_rows, _PAIRS))
    starts = by_block(found, answers, decided, "block long, starts binary", "starts")
    C.discard(found)
    schema = f"`{key}` long, n_bytes long, spans array<struct<start:long,length:long>>, kept_sha256 string" + (", kept binary" if with_kept else "")
    return blocks.select("block", "keys", "sizes", "text").join(starts, "block").mapInArrow(cut_out(key, length, with_kept), schema)
