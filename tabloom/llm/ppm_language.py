"""Language identification by prediction by partial matching over bytes.

One context tree per language, of orders 0 to 3, learned from a bounded sample of labelled texts and then frozen. The code
length of a byte is -log2 of its probability: in the longest context of the tree, count / (total + distinct) if the byte
was seen there, else an escape, distinct / (total + distinct), and the same question in the context shorter by one byte;
below order 0 every byte has 1/256. A-Z count as a-z. A text's language is the one with the shortest exact code for the whole text.

A tree keeps every context of order 0 and 1 and, of orders 2 and 3, those its own sample holds LEAST_SEEN times. Trees of some
languages share one table: a row for each context that any of them keeps, a column for each byte seen in training (and one
for all others), a code length for each language, so a position costs two lookups. As many languages go into a table as
TABLE_BYTES hold; with more, texts pass through one table after the other and the code lengths are put together. A tree, and
so a code length, is the same in whatever table it stands: no language and no context is dropped for want of room.

The sample of a language is about SAMPLE_TEXTS texts and SAMPLE_BYTES bytes, of texts of at most an eighth of that.

Defined results: null or empty text, or text without a letter: ``und`` with score 0. Ties: the language first in sort
order. No labelled row: every text is ``und``. Repeated rows are judged alike; extra columns pass through, and columns
named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

#: Expected sample of each language, most bytes of a shared table, and how often a longer context must have been seen.
SAMPLE_TEXTS, SAMPLE_BYTES, TABLE_BYTES, LEAST_SEEN = 240, 8 << 20, 48 << 20, 3
UND = "und"


@dataclass
class PPM:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    row_of: np.ndarray  # three symbols -> row of the table
    cost: np.ndarray  # (row * symbols + symbol, language) -> bits

    @property
    def size(self) -> int:
        return int(self.symbol.max()) + 1


def fold(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, text: str, label: str, key: str, n: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """About n texts and `size` bytes for each label, chosen by a hash of the key; labels are counted over all rows."""
    length = F.octet_length(F.col(text))
    known = docs.where(F.col(label).isNotNull() & (length <= size // 8)).select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"), length.alias("size"))
    counts = known.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("label").collect()
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, n / r[1], size / max(r[2], 1)))])
    place = F.pmod(F.xxhash64("key", F.lit("ppm")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out: dict[str, list[bytes]] = {r[0]: [] for r in counts}
    for r in known.where(place < share[F.col("label")]).select("label", "text").toLocalIterator():
        out[r[0]].append(r[1].encode())
    return {k: sorted(v) for k, v in sorted(out.items()) if v}


def train(texts: dict[str, list[bytes]], table_bytes: int = TABLE_BYTES) -> list[PPM] | None:
    """The trees of all languages, in as many tables as it takes."""
    if not texts:
        return None
    symbol, grams = count(texts)
    a, tables, group, rows = int(symbol.max()) + 1, [], [], 0
    for lang, g in grams.items():
        more = sum(len(kept_contexts(g, order, a)) for order in range(4))
        if group and (rows + more) * a * (len(group) + 1) * 4 > table_bytes:
            tables.append(table_of(symbol, {k: grams[k] for k in group}))
            group, rows = [], 0
        group.append(lang)
        rows += more
    tables.append(table_of(symbol, {k: grams[k] for k in group}))
    return tables


def kept_contexts(gram: list, order: int, a: int) -> np.ndarray:
    """Sorted contexts of an order that a language keeps."""
    code, n = gram[order]
    context, where = np.unique(code // a, return_inverse=True)
    return context[np.bincount(where, n) >= (LEAST_SEEN if order > 1 else 1)]


def count(texts: dict[str, list[bytes]]) -> tuple[np.ndarray, dict[str, list]]:
    """(symbol of each byte; for each language and order, codes of context + symbol and their counts)."""
    seen = np.zeros(256, bool)
    for group in texts.values():
        for t in group:
            seen[np.frombuffer(t.lower(), np.uint8)] = True
    seen[0x20] = True
    symbol = np.full(256, seen.sum(), np.int32)
    symbol[seen] = np.arange(seen.sum())
    symbol[0x41:0x5B] = symbol[0x61:0x7B]  # A-Z count as a-z
    a, grams = int(seen.sum()) + 1, {}
    for lang in texts:
        codes = []
        for t in texts[lang]:
            s = np.concatenate([np.full(3, symbol[0x20]), symbol[np.frombuffer(t, np.uint8)]]).astype(np.int64)
            codes.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
        every = np.concatenate(codes)
        grams[lang] = [np.unique(every % a ** (k + 1), return_counts=True) for k in range(4)]
    return symbol, grams


def table_of(symbol: np.ndarray, grams: dict[str, list]) -> PPM:
    """The shared table of some languages."""
    a, languages = int(symbol.max()) + 1, list(grams)
    kept = [np.unique(np.concatenate([kept_contexts(g, order, a) for g in grams.values()])) for order in range(4)]
    if not len(kept[0]):
        kept[0] = np.zeros(1, np.int64)

    def lengths(order: int, below: np.ndarray) -> np.ndarray:
        """Probability for each kept context of an order; below: the probabilities of its shorter contexts."""
        p = below.copy()
        for k, g in enumerate(grams.values()):
            code, n = g[order]
            ok = np.isin(code // a, kept_contexts(g, order, a))
            at, sym, n = np.searchsorted(kept[order], code[ok] // a), code[ok] % a, n[ok]
            total, kinds = np.bincount(at, n, len(kept[order])), np.bincount(at, None, len(kept[order]))
            used = total > 0
            p[used, :, k] *= (kinds[used] / (total[used] + kinds[used]))[:, None]
            p[at, sym, k] = n / (total[at] + kinds[at])
        return p

    probability = [lengths(0, np.full((1, a, len(languages)), 1 / 256))]
    start = [0]
    lookup = [np.zeros(1, np.int64)]  # for each order: context -> row of the longest kept suffix
    for order in range(1, 4):
        start.append(start[-1] + len(kept[order - 1]))
        shorter = lookup[order - 1]
        full = np.tile(shorter, a)
        every = np.concatenate(probability)
        here = lengths(order, every[shorter[kept[order] % a ** (order - 1)]]) if len(kept[order]) else np.zeros((0, a, len(languages)))
        full[kept[order]] = start[order] + np.arange(len(kept[order]))
        probability.append(here)
        lookup.append(full)
    cost = -np.log2(np.concatenate(probability)).astype(np.float32)
    return PPM(languages, symbol, lookup[3].astype(np.int32), np.ascontiguousarray(cost.reshape(-1, len(languages))))


def code_lengths(m: PPM, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of every text of a chunk under every language; (texts, languages)."""
    a, pad, n = m.size, m.symbol[0x20], len(buf)
    s = np.empty(n + 3, np.int32)
    s[:3], s[3:] = pad, m.symbol[buf]
    total = np.zeros((len(off) - 1, len(m.languages)))
    if not n:
        return total
    one, two, three = s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()
    first = off[:-1]
    for back, x in ((1, one), (2, two), (3, three)):  # no context reaches into the text before
        for j in range(back):
            at = first + j
            x[at[at < off[1:]]] = pad
    row = m.row_of[(three * a + two) * a + one]
    bits = m.cost[row * np.int32(a) + s[3:]]
    full = np.flatnonzero(off[1:] > off[:-1])
    total[full] = np.add.reduceat(bits, off[full], axis=0, dtype=np.float64)
    return total


def identify(docs: DataFrame, model: list[PPM] | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: its probability with all languages equally likely beforehand) and bits_per_byte of
    the best language; one narrow pass over whole texts for each table."""
    C.arrow_limits(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    if model is None:
        return docs.select("*", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    flag, total, least = "__has_letter", "__others", "__bits"
    fields = [("lang_pred", "string"), (least, "double"), (total, "double")]

    def score(m: PPM, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its bits, log2 of the sum of 2^-bits over all languages so far, less the best)."""
        names, bits, rest = [], [], []
        for _, _, buf, off in C.text_chunks(b.column(b.schema.get_field_index(text)), 1 << 19):
            every = code_lengths(m, buf, off)
            best = every.argmin(1)
            low = every[np.arange(len(every)), best]
            names.append(best)
            bits.append(low)
            rest.append(np.log2(np.exp2(-np.minimum(every - low[:, None], 1000)).sum(1)))
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in (names, bits, rest))

    out = docs.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    for k, one in enumerate(model):
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def make(b: pa.RecordBatch, shared=shared, first: bool = k == 0) -> list[pa.Array]:
            m = shared.value
            best, bits, rest = score(m, b)
            lang = [m.languages[int(i)] for i in best]
            if not first:
                old = [b.column(b.schema.get_field_index(c)) for c, _ in fields]
                was, sums = old[1].to_numpy(), old[2].to_numpy()
                keep = was <= bits
                lang = [x if same else y for x, y, same in zip(old[0].to_pylist(), lang, keep, strict=True)]
                low = np.minimum(was, bits)
                rest = np.log2(np.exp2(sums - np.minimum(was - low, 1000)) + np.exp2(rest - np.minimum(bits - low, 1000)))
                bits = low
            return [pa.array(lang, pa.string()), pa.array(bits.astype(float)), pa.array(rest.astype(float))]

        out = C.append_columns(out, make, fields)
    known = F.col(flag)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(
        *names,
        F.when(known, F.col("lang_pred")).otherwise(UND).alias("lang_pred"),
        F.when(known, F.pow(F.lit(2.0), -F.col(total))).otherwise(0.0).alias("score"),
        F.when(known, F.col(least) / F.octet_length(F.col(text))).alias("bits_per_byte"),
    )


def language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 4, held_out: int = 2) -> list[PPM] | None:
    """Trees learned from a bounded sample of the labelled rows outside the held-out fold."""
    return train(sample(docs.where(fold(F.col(key), folds) != held_out), text, label, key))
