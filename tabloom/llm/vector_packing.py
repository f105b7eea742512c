"""Packing of token sequences by vector bin packing.

Every sequence holds at most `tokens` tokens, `segments` pieces and `loss` loss-bearing tokens. Bins are filled one at a
time: of the pieces that fit, the one with the largest dot product of its demand with the bin's free room (each dimension
weighted by how scarce it is) goes in; when none fits, the one that fills most is cut to fill the bin. A bin that a limit other than
`tokens` closes early is cut back to a power of two, and the last bins of a partition are powers of two, so nothing is
padded. Examples are packed where they are read: no shuffle, no driver, memory for one pool of examples a task.

Which tokens bear loss is told by a mask of 0/1 per id, or by a prompt: so many words at the beginning of a text bear none.

Ids come from a public tokenizer file, word by word (white space never enters a token of this vocabulary), with a bounded
cache of words. New words are encoded some together with a mark between them, those that hold the mark alone.

Defined results: null or empty texts are the end id alone; a very long text becomes many pieces, each id in exactly one;
repeated rows are packed each; rows without a key keep none; ties go to the example read first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

END, CACHE_WORDS = 2, 1_000_000
#: The mark between words that are encoded together, and how many those are.
MARK, TOGETHER = "|", 20
#: A pool is packed when it holds so many pieces, or tokens of so many sequences, and until it holds a quarter of both.
POOL, POOL_SEQUENCES = 1024, 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


class Words:
    """Ids of a text by the tokenizer's ids of its words, each looked up once while the cache lasts.

    A word's ids are kept as packed bytes, so a text's ids are one join."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), END + 1) <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        self.cache: dict[bytes, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def learn(self, words: list[bytes]) -> None:
        """Put the words' ids into the cache."""
        text = [w.decode() for w in words]
        alone = [k for k, t in enumerate(text) if MARK in t] if len(self.mark) == 1 else range(len(text))
        self.cache.update((words[k], ids.tobytes()) for k, ids in zip(alone, self.encode([text[k] for k in alone]), strict=True))
        rest = sorted(set(range(len(text))).difference(alone))
        groups = [rest[lo : lo + TOGETHER] for lo in range(0, len(rest), TOGETHER)]
        size = self.kind.itemsize
        for group, ids in zip(groups, self.encode([f" {MARK} ".join([text[k] for k in g]) for g in groups]), strict=True):
            raw, at = ids.tobytes(), (np.flatnonzero(ids == self.mark[0]) * size).tolist()
            parts = (raw[a:b] for a, b in zip([0, *(x + size for x in at)], [*at, len(raw)], strict=True))
            self.cache.update(zip([words[k] for k in group], parts, strict=True))

    def ids(self, texts: list[bytes], prompt: Callable[[bytes], int] | None = None) -> list[tuple[np.ndarray, int]]:
        """(ids, how many at the beginning bear no loss) of each text."""
        split = [t.split() for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set().union(*split) if w not in cache]
        for lo in range(0, len(new), 10_000):
            self.learn(new[lo : lo + 10_000])
        out = []
        for t, ws in zip(texts, split, strict=True):
            lead = sum(map(len, map(cache.__getitem__, ws[: prompt(t)]))) // self.kind.itemsize if prompt else 0
            out.append((np.frombuffer(b"".join([*map(cache.__getitem__, ws), self.end]), self.kind).astype(np.uint32), lead))
        return out


def first_line(text: bytes) -> int:
    """Words of a prompt: those of the first line with words, if others follow; a text of one line has none."""
    head, _, rest = text.lstrip().partition(b"\n")
    return len(head.split()) if rest.strip() else 0


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One tokenizer and cache a worker process, kept from task to task."""
    return Words(path)


@dataclass(eq=False)
class Item:
    key: int
    ids: np.ndarray
    start: int = 0
    mask: np.ndarray | None = None  # running count of loss-bearing tokens, one longer than ids
    prompt: int = 0  # without a mask: so many ids at the beginning bear no loss

    @property
    def length(self) -> int:
        return len(self.ids) - self.start

    @property
    def loss(self) -> int:
        return self.bears(self.length)

    def bears(self, n: int) -> int:
        """Loss-bearing tokens among the next n."""
        if self.mask is None:
            return n - min(n, max(0, self.prompt - self.start))
        return int(self.mask[self.start + n] - self.mask[self.start])

    @property
    def lead(self) -> int:
        """How many of the next tokens bear no loss."""
        if self.mask is None:
            return min(self.length, max(0, self.prompt - self.start))
        return min(self.length, int(np.searchsorted(self.mask, self.mask[self.start], "right")) - 1 - self.start)

    def most(self, tokens: int, loss: int) -> int:
        """Longest prefix of what is left within both limits."""
        n = min(tokens, self.length)
        if self.mask is None:
            return min(n, loss + max(0, self.prompt - self.start))
        return min(n, int(np.searchsorted(self.mask, self.mask[self.start] + loss, "right")) - 1 - self.start)


@dataclass
class Packer:
    limits: Limits
    first_id: int
    rows: list[tuple] = field(default_factory=list)
    pool: list[Item] = field(default_factory=list)
    held: int = 0
    made: int = 0

    def put(self, pieces: list[tuple[Item, int, int]]) -> None:
        at = 0
        for item, a, n in pieces:
            ids = item.ids[a : a + n]
            self.rows.append((item.key, a, n, zlib.crc32(ids.astype("<u4").tobytes()), len(item.ids), self.first_id + self.made, at, ids))
            at += n
        self.made += 1

    def add(self, item: Item) -> None:
        lim = self.limits
        while item.length >= lim.tokens and item.most(lim.tokens, lim.loss) == lim.tokens:
            self.put([(item, item.start, lim.tokens)])
            item.start += lim.tokens
        if item.length:
            self.pool.append(item)
            self.held += item.length
            if len(self.pool) >= POOL or self.held >= POOL_SEQUENCES * lim.tokens:
                self.pack(POOL // 4, POOL_SEQUENCES // 4 * lim.tokens)

    def pack(self, keep: int, room: int = 0) -> None:
        """Fill bins until at most `keep` items and `room` tokens are left."""
        lim, items = self.limits, self.pool
        tokens, loss, lead = (np.array([f(i) for i in items], np.int64) for f in (lambda i: i.length, lambda i: i.loss, lambda i: i.lead))
        alive, place = tokens > 0, {id(i): k for k, i in enumerate(items)}
        left = len(items)

        def take(k: int, n: int) -> None:
            nonlocal left
            item = items[k]
            item.start += n
            self.held -= n
            tokens[k], loss[k], lead[k] = item.length, item.loss, item.lead
            if alive[k] != (item.length > 0):
                alive[k] = item.length > 0
                left += 1 if alive[k] else -1

        while left and (left > keep or self.held > room):
            # scarcity: what the pool demands of each limit that it has
            scarce = np.array([tokens[alive].sum() / lim.tokens**2, loss[alive].sum() / lim.loss**2])
            pieces, free = [], [lim.tokens, lim.segments, lim.loss]
            while left and free[0] > 0 and free[1] > 0:
                # the dot product of demand and free room; every piece demands one segment, so that term decides nothing
                score = tokens * (scarce[0] * free[0] / lim.tokens) + loss * (scarce[1] * free[2] / lim.loss)
                fits = alive & (tokens <= free[0]) & (loss <= free[2])
                k = int(np.argmax(np.where(fits, score, -1.0)))
                if not fits[k]:  # none fits: cut the one that fills most
                    k = int(np.argmax(np.where(alive, np.minimum(np.minimum(tokens, free[0]), free[2] + lead), 0)))
                item = items[k]
                n = item.most(free[0], free[2])
                if n <= 0:
                    break
                pieces.append((item, item.start, n))
                free = [free[0] - n, free[1] - 1, free[2] - item.bears(n)]
                take(k, n)
            if not pieces:  # one token bears more loss than a sequence may hold: it stands alone
                k = int(np.flatnonzero(alive)[0])
                pieces = [(items[k], items[k].start, 1)]
                take(k, 1)
            used = sum(n for _, _, n in pieces)
            excess = used - (1 << (used.bit_length() - 1)) if used < lim.tokens else 0
            while excess:  # back to a power of two: what is cut off returns to the pool
                item, at, n = pieces.pop()
                back = min(excess, n)
                excess -= back
                item.start = at + n
                take(place[id(item)], -back)
                if n > back:
                    pieces.append((item, at, n - back))
            self.put(pieces)
        self.pool = [i for i, ok in zip(items, alive, strict=True) if ok]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), loss: Callable[[np.ndarray], np.ndarray] | None = None, prompt: Callable[[bytes], int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and (with_ids) its ids.

    loss: gives 0/1 per id of an example; prompt: how many words of its text bear none; without both all ids bear loss. A sequence's id holds the partition above 2^33, so
    ids are unique without any exchange and the same when a lost task runs again."""
    C.arrow_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + (", ids array<int>" if with_ids else "")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        packer = Packer(limits, TaskContext.get().partitionId() << 33)

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            if rows:
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        kind = None
        for b in batches:
            words = words or words_of(tokenizer)
            kind = b.schema.field(0).type
            labels = b.column(0).to_pylist()
            for lo, hi, buf, off in C.text_chunks(b.column(1), 1 << 20):
                raw = buf.tobytes()
                for k, (ids, lead) in zip(range(lo, hi), words.ids([raw[x:y] for x, y in zip(off[:-1], off[1:], strict=True)], prompt), strict=True):
                    mask = None if loss is None else np.concatenate([[0], np.cumsum(loss(ids))])
                    packer.add(Item(labels[k], ids, 0, mask, lead))
                yield from flush(kind)
        packer.pack(0)
        if kind is not None:
            yield from flush(kind)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
