"""Katz backoff language model over word n-grams, and the score of every text under it.

Tokens are lower-cased words and one end a text. Counts of all training tokens, at any size of corpus, go through exchanges of
sorted key blocks. Texts are read once into token blocks; a block sends each exchange its distinct keys with their counts, the
bucket that owns a key range adds them up and answers each block with the values of its own keys, in order. So a key travels
once a block however often it occurs, no bucket sees more than one entry of a key a block (a hot word is no hot key), and the
model is never gathered or broadcast. Every exchange's answers are a table in the shared folder, laid out by block.

P_1(w) = d c(w) / N for words seen in training; the mass that is left is that of the unknown word. For each longer order,
P_k(w | c) = d c(c w) / c(c) where the n-gram was seen, else alpha(c) P_{k-1}(w | c without its first word), evaluated
recursively for every token; a context not seen passes on to the shorter one. d is the Good-Turing discount of the order
(Katz 1987) for counts up to TOP; higher counts give up a share of SPARE only, so that every context has something left.
alpha(c) = (1 - sum d c / c(c)) / (1 - sum P_{k-1}(w | c')) over the seen w: the probabilities of all words after any context
add up to 1. The words before the beginning of a text are marks of the beginning.

Exchanges: the counts of each order; then which contexts any text has to back off from (unseen n-grams stand only in texts that
teach nothing, so these are few); then, order by order, the two sums of alpha for those contexts, to which the block that owns an n-gram, the first
that holds it, contributes its discounted count and its shorter probability.

Words and n-grams are 64-bit hashes, none of them a polynomial. Defined results: null or empty texts are one end token; repeated
rows are each counted; with no training rows every word is unknown and has probability 1; a row without a key or fold is scored
and teaches like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

END, BEGIN = np.uint64(0xE0D), np.uint64(0xB0)
TOP, SPARE = 5, 0.001  # counts above TOP give up this share of theirs
BLOCK = 8 << 20
_LEFT, _RIGHT = np.uint64(0xD1B54A32D192ED03), np.uint64(0xAEF17502108EF2D9)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each; their number tells the width."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def ranked(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0 on. Numbers that carry their places are sorted, which takes a third of the time
    of sorting places by numbers; what falls together in the bits that this leaves is put in order after."""
    n = len(keys)
    keys = keys.astype(np.uint64, copy=False)
    low = keys.min() if n else np.uint64(0)
    span = int(keys.max() - low) if n else 0
    if not span:
        return np.arange(n)
    bits, spare = (n - 1).bit_length(), 64 - span.bit_length()
    mask = np.uint64((1 << bits) - 1)
    packed = np.sort(((keys - low << np.uint64(spare)) & ~mask) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    if spare < bits:
        packed >>= np.uint64(bits)
        found = keys[order]
        for x in packed[1:][found[1:] < found[:-1]]:
            a, z = np.searchsorted(packed, [x, x + np.uint64(1)])
            order[a:z] = order[a:z][np.argsort(keys[order[a:z]], kind="stable")]
    return order


def kinds_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each key is."""
    order = ranked(keys)
    found = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(first) - 1
    return found[first], which


def read_blocks(docs: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    """(block, keys, held, sizes, vocabulary, tokens): the texts as indices into the block's sorted word hashes."""
    C.arrow_limits(docs.sparkSession, BLOCK >> 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, buf, off in C.text_chunks(b.column(1), BLOCK):
                parts, counts = [], []
                for x, y, small, soff in C.text_chunks(b.column(1).slice(lo, hi - lo), 1 << 20):
                    h, woff = C.words(small, soff)
                    ends = np.insert(h, woff[1:], END)
                    parts.append(ends)
                    counts.append(np.diff(woff) + 1)
                vocabulary, tokens = kinds_of(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        C.binary_array([C.pack_keys(b.column(0).slice(lo, hi - lo))]),
                        C.binary_array([np.asarray(b.column(2).slice(lo, hi - lo).fill_null(False).to_numpy(zero_copy_only=False)).astype(np.uint8).tobytes()]),
                        C.binary_array([np.concatenate(counts).astype(np.uint32).tobytes()]),
                        C.binary_array([vocabulary.tobytes()]),
                        C.binary_array([narrow(tokens)]),
                    ],
                    names=["block", "keys", "held", "sizes", "vocabulary", "tokens"],
                )
                block += 1

    return docs.select(F.col(key).cast("long"), F.col(text), F.col(held_out)).mapInArrow(run, "block long, keys binary, held binary, sizes binary, vocabulary binary, tokens binary")


@dataclass
class Grams:
    """Distinct n-grams of a block: sorted keys, their contexts (among the n-grams one shorter, or the beginning), the n-grams without their first word, and which of them each token ends."""

    keys: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    which: np.ndarray


class Block:
    """One token block and the answers it has had so far."""

    def __init__(self, row: pa.Table, answers: pa.Table | None = None) -> None:
        get = lambda c: row.column(c)[0].as_py()
        self.block = get("block")
        self.keys, self.held = np.frombuffer(get("keys"), np.int64), np.frombuffer(get("held"), np.uint8).astype(bool)
        self.sizes, self.vocabulary = np.frombuffer(get("sizes"), np.uint32).astype(np.int64), np.frombuffer(get("vocabulary"), np.uint64)
        self.tokens = wide(get("tokens"), int(self.sizes.sum()))
        self.off = np.concatenate([[0], np.cumsum(self.sizes)])
        self.train = np.repeat(~self.held, self.sizes)
        self.parts, self.made, self.known, self.told = 0, [], {}, {}
        self.answers: dict[str, list[bytes]] = {}
        if answers is not None:
            rows = sorted(zip(answers.column("step").to_pylist(), answers.column("bucket").to_pylist(), answers.column("values").to_pylist(), strict=True))
            for step, _, x in rows:
                self.answers.setdefault(step, []).append(x)

    def grams(self, k: int) -> Grams:
        """The distinct n-grams of an order in the order of their keys."""
        while len(self.made) < k:
            if not self.made:
                first = np.zeros(len(self.vocabulary), np.int64)
                self.made.append(Grams(self.vocabulary, first, first, self.tokens))
                continue
            below = self.made[-1]
            context = np.empty(len(self.tokens), np.int64)
            context[1:] = below.which[:-1]
            context[self.off[:-1]] = len(below.keys)
            code, which = kinds_of(context * len(self.vocabulary) + self.tokens)
            shorter = np.empty(len(code), np.int64)
            shorter[which] = below.which
            left = code // len(self.vocabulary)
            key = C.mix(self.context_keys(len(self.made) + 1)[left] * _LEFT + self.vocabulary[code % len(self.vocabulary)] * _RIGHT)
            order = ranked(key)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.made.append(Grams(key[order], left[order], shorter[order], place[which]))
        return self.made[k - 1]

    def context_keys(self, k: int) -> np.ndarray:
        """Keys of the contexts of an order: the n-grams one shorter, and the beginning."""
        return np.append(self.grams(k - 1).keys, C.mix(np.array([BEGIN + np.uint64(k)]))[0])

    def values(self, step: str, keys: np.ndarray) -> np.ndarray:
        """The whole numbers answered for sorted keys."""
        at = np.diff(cuts(keys, self.parts))
        return np.concatenate([np.zeros(0, np.int64), *[wide(x, n) for x, n in zip(self.answers.get(step, []), at[at > 0], strict=True)]])

    def bits(self, step: str, keys: np.ndarray) -> np.ndarray:
        at = np.diff(cuts(keys, self.parts))
        return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(self.answers.get(step, []), at[at > 0], strict=True)]]).astype(bool)

    def counts(self, k: int) -> np.ndarray:
        if k not in self.known:
            self.known[k] = self.values(f"c{k}", self.grams(k).keys)
        return self.known[k]

    def context_counts(self, k: int, begins: int) -> np.ndarray:
        return np.append(self.counts(k - 1), begins)

    def contexts(self, k: int, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts that this block asks about or may contribute to, sorted by their keys; these; which it asks about; which it owns a seen n-gram of)."""
        g, c = self.grams(k), self.counts(k)
        size = len(self.grams(k - 1).keys) + 1
        need, have = np.zeros(size, bool), np.zeros(size, bool)
        need[g.context[c == 0]] = True
        need &= self.context_counts(k, begins) > 0
        have[g.context[(c > 0) & self.bits(f"o{k}", g.keys)]] = True
        at = np.flatnonzero(need | have)
        keys = self.context_keys(k)[at]
        order = np.argsort(keys)
        at = at[order]
        return at, keys[order], need[at], have[at]

    def wanted(self, k: int, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(those of the contexts that any block asks about, their keys, whether this one does)."""
        at, keys, need, _ = self.contexts(k, begins)
        yes = self.bits(f"a{k}", keys)
        return at[yes], keys[yes], need[yes]

    def sums(self, k: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """What this block contributes to both sums of each context of an order."""
        g, c = self.grams(k), self.counts(k)
        mine = (c > 0) & self.bits(f"o{k}", g.keys)
        size = len(self.grams(k - 1).keys) + 1
        out = np.zeros(size), np.zeros(size)
        np.add.at(out[0], g.context[mine], model.kept(k, c[mine]))
        np.add.at(out[1], g.context[mine], self.probabilities(k - 1, model)[g.shorter[mine]])
        return out

    def probabilities(self, k: int, model: Model) -> np.ndarray:
        """P_k of every distinct n-gram."""
        if k == 1:
            return model.word(self.counts(1))
        if k not in self.told:
            g, c, base = self.grams(k), self.counts(k), self.context_counts(k, model.begins)
            alpha = np.ones(len(base))
            at, _, need = self.wanted(k, model.begins)
            at = at[need]
            mass, lower = (np.concatenate([np.zeros(0), *[np.frombuffer(x, np.float64) for x in self.answers.get(f"{n}{k}", [])]]) for n in "ml")
            alpha[at] = (1 - mass / np.maximum(base[at], 1)) / np.maximum(1 - lower, 1e-12)
            p = alpha[g.context] * self.probabilities(k - 1, model)[g.shorter]
            seen = c > 0
            p[seen] = model.kept(k, c[seen]) / base[g.context[seen]]
            self.told[k] = p
        return self.told[k]


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys pass from one bucket's range to the next."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def within(keys: np.ndarray, bucket: int, parts: int) -> np.ndarray:
    """32 bits of the keys of a bucket's range. Where two contexts fall together, one is asked about for nothing: its sums are
    sent under its whole key and change nothing."""
    return ((keys - np.uint64((bucket << 64) // parts)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)


def sent(step: str, block: int, keys: np.ndarray, values: list[np.ndarray], parts: int, need: np.ndarray | None = None) -> pa.RecordBatch:
    at = cuts(keys, parts)
    full = [k for k in range(parts) if at[k + 1] > at[k]]
    pack = lambda x: x.tobytes() if x.dtype == np.float64 else narrow(x)
    cut = lambda k: keys[at[k] : at[k + 1]] if step[0] != "a" else within(keys[at[k] : at[k + 1]], k, parts)
    columns = [C.binary_array([cut(k).tobytes() for k in full]), *[C.binary_array([pack(v[at[k] : at[k + 1]]) for k in full]) for v in values]]
    columns += [pa.nulls(len(full), pa.binary())] * (2 - len(values))
    columns.append(pa.nulls(len(full), pa.binary()) if need is None else C.binary_array([np.packbits(need[at[k] : at[k + 1]]).tobytes() for k in full]))
    return pa.RecordBatch.from_arrays([pa.array([step] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *columns], names=["step", "bucket", "block", "keys", "v0", "v1", "need"])


_SENT = "step string, bucket int, block long, keys binary, v0 binary, v1 binary, need binary"
_ANSWER = "step string, bucket int, block long, values binary"
STATS = -1  # the block of rows that hold a bucket's counts of counts


def add_up(key: tuple, group: pa.Table) -> pa.Table:
    """A bucket's keys to answers for each block. c: totals of its keys, whether it owns them, and count statistics; a: whether
    any block asks; m: both sums, to those that ask."""
    step, bucket = key[0].as_py(), int(key[1].as_py())
    group = group.sort_by("block")
    blocks = group.column("block").to_pylist()
    keys = [np.frombuffer(x.as_py(), np.uint32 if step[0] == "a" else np.uint64) for x in group.column("keys")]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    first = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    name = np.cumsum(first) - 1
    where = np.empty(len(every), np.int64)
    where[order] = name
    out = {"step": [], "bucket": [], "block": [], "values": []}

    def put(step: str, block: int, values: bytes) -> None:
        for c, x in zip(out, (step, bucket, block, values), strict=True):
            out[c].append(x)

    ends, kind, k = np.cumsum([len(k) for k in keys]), step[0], step[1:]
    mine = [slice(e - len(k), e) for k, e in zip(keys, ends, strict=True)]
    if kind == "m":
        for c, title in (("v0", "m"), ("v1", "l")):
            total = np.bincount(where, np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in group.column(c)]))
            for b, m, x in zip(blocks, mine, group.column("need"), strict=True):
                flags = np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: m.stop - m.start].astype(bool)
                if flags.any():
                    put(title + k, b, total[where[m][flags]].tobytes())
    else:
        values = np.concatenate([wide(x.as_py(), len(k)) for x, k in zip(group.column("v0"), keys, strict=True)])
        total = np.zeros(int(name[-1]) + 1, np.int64)
        np.add.at(total, where, values)
        owner = np.zeros(len(every), bool)
        owner[order[first]] = True
        for b, m in zip(blocks, mine, strict=True):
            if kind == "a":
                put(step, b, np.packbits(total[where[m]] > 0).tobytes())
            else:
                put(step, b, narrow(total[where[m]]))
                put("o" + k, b, np.packbits(owner[m]).tobytes())
        if kind == "c":
            seen = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
            put(step, STATS, np.array([total.sum(), (total > 0).sum(), *seen[1 : TOP + 2]], np.int64).tobytes())
    return pa.table({"step": pa.array(out["step"], pa.string()), "bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "values": C.binary_array(out["values"])})


def statistics(answers: DataFrame, k: int) -> np.ndarray:
    """Total, kinds, and the numbers of keys counted 1 to 6 times: one small row a bucket."""
    total = np.zeros(TOP + 3, np.int64)
    for r in answers.where((F.col("block") == STATS) & (F.col("step") == f"c{k}")).select("values").toLocalIterator():
        total += np.frombuffer(bytes(r[0]), np.int64)
    return total


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..TOP) and that of higher counts, from the numbers of keys counted 1..TOP + 1 times; where the estimate fails, half a count is taken off."""
    r = np.arange(1, TOP + 1)
    d = half = (r - 0.5) / r
    if n[0]:
        common = (TOP + 1) * n[TOP] / n[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = ((r + 1) * n[1 : TOP + 1] / (r * n[:TOP]) - common) / (1 - common)
        d = np.where(np.isfinite(d) & (d > 0.01) & (d < 1), d, half)
    return np.concatenate([[0.0], d, [1 - SPARE]])


class Model:
    """What is the same for all blocks: totals, the number of training texts, and the discounts of each order."""

    def __init__(self, words: np.ndarray, longer: list[np.ndarray], begins: int) -> None:
        self.tokens, self.kinds, self.begins = int(words[0]), int(words[1]), begins
        self.d = [discounts(x[2:]) for x in (words, *longer)]
        n, r = words[2 : 2 + TOP], np.arange(1, TOP + 1)
        taken = ((1 - self.d[0][1 : TOP + 1]) * r * n).sum() + SPARE * (self.tokens - (r * n).sum())
        self.unknown = taken / self.tokens if self.tokens else 1.0

    def kept(self, k: int, c: np.ndarray) -> np.ndarray:
        """Counts after the discount of an order."""
        return self.d[k - 1][np.minimum(c, TOP + 1)] * c

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(1, c) / max(self.tokens, 1), self.unknown)


def score(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; rows where held_out is true teach nothing."""
    spark = docs.sparkSession
    blocks = C.settle(read_blocks(docs, key, text, held_out), "blocks")
    C.arrow_limits(spark, 16)
    size = blocks.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0]
    parts = C.buckets(spark, 6 * size)
    # the number of training texts is what the beginning's count is
    begins = docs.where(~F.coalesce(F.col(held_out), F.lit(False))).count()

    def load(row: pa.Table, answers: pa.Table | None = None) -> Block:
        b = Block(row, answers)
        b.parts = parts
        return b

    def send_counts(orders: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = load(pa.Table.from_batches([batch.slice(i, 1)]))
                    for k in orders:
                        g = b.grams(k)
                        yield sent(f"c{k}", b.block, g.keys, [np.bincount(g.which[b.train], minlength=len(g.keys))], parts)

        return run

    def told(rows: DataFrame, name: str) -> DataFrame:
        return C.settle(rows.groupBy("step", "bucket").applyInArrow(add_up, _ANSWER), name)

    answers = [told(blocks.mapInArrow(send_counts([k]), _SENT), f"counts-{k}") for k in range(1, order + 1)]
    found = [statistics(a, k) for k, a in enumerate(answers, 1)]
    model = Model(found[0], found[1:], begins)

    def with_answers(keep: Column | None = None):
        keep = F.lit(True) if keep is None else keep
        every = reduce(DataFrame.unionByName, [a.where(F.col("block") != STATS) for a in answers])
        return blocks.where(keep).groupBy("block").cogroup(every.where(keep).groupBy("block"))

    def gathered(f, name: str) -> DataFrame:
        """Answers to what f sends, a third of the blocks after the other: blocks and answers meet in a third of the disk."""
        third = F.pmod(F.xxhash64("block"), F.lit(3))
        rows = [C.settle(with_answers(third == i).applyInArrow(f, _SENT), name) for i in range(3)]
        out = told(reduce(DataFrame.unionByName, rows), name)
        C.discard(*rows)
        return out

    def ask(row: pa.Table, told: pa.Table) -> pa.Table:
        b, out = load(row, told), []
        for k in range(2, order + 1):
            _, keys, need, _ = b.contexts(k, begins)
            out.append(sent(f"a{k}", b.block, keys, [need.astype(np.int64)], parts))
        return pa.Table.from_batches(out, _ARROW_SENT)

    def contribute(k: int):
        def run(row: pa.Table, told: pa.Table) -> pa.Table:
            b = load(row, told)
            at, keys, need = b.wanted(k, begins)
            mass, lower = b.sums(k, model)
            return pa.Table.from_batches([sent(f"m{k}", b.block, keys, [mass[at], lower[at]], parts, need)], _ARROW_SENT)

        return run

    if order > 1:
        answers.append(gathered(ask, "asked"))
    for k in range(2, order + 1):
        answers.append(gathered(contribute(k), f"sums-{k}"))

    def final(row: pa.Table, told: pa.Table) -> pa.Table:
        b = load(row, told)
        p, c1 = b.probabilities(order, model), b.counts(1)
        n, v = model.tokens, model.kinds
        plain = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        each = lambda x: pa.array(np.add.reduceat(x, b.off[:-1]))
        return pa.table(
            {
                key: C.unpack_keys(b.keys),
                "held_out": pa.array(b.held),
                "n_tokens": pa.array(b.sizes),
                "n_known": each((c1 > 0).astype(np.int64)[b.tokens]),
                "train_tokens": pa.array(np.full(len(b.keys), n, np.int64)),
                "base_score": each(plain[b.tokens]),
                "score": each(np.log10(p)[b.grams(order).which]),
            }
        )

    schema = f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers().applyInArrow(final, schema)


_ARROW_SENT = pa.schema([("step", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("v0", pa.binary()), ("v1", pa.binary()), ("need", pa.binary())])
