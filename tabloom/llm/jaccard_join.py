"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

A set's distinct shingle hashes are dealt to the segments of its size band (sizes 2^k to 2^(k+1) - 1). Sets of n and
r <= n/t elements with Jaccard similarity >= t differ in at most H = (n + r)(1 - t)/(1 + t) elements, so of more than H
segments at least one is alike in both. Each set lists its filled segments in its own band and, where a smaller partner
may lie below, in the band below; pairs are looked for in the band of the smaller set.

Allocation by cost: a filled segment costs one index entry for an exact match (threshold 0); a segment whose content more
than `hot` sets share is skipped (threshold -1) as long as the set's other filled segments still outnumber H; a set with
too few filled segments also lists every segment with its one-deletion neighbourhood (threshold 1, worth two).

Equal sets are one class from the start. Links are certified where the alike segments alone hold enough elements; all
other candidates in different components are verified on the exact sets. Sets with too few cold segments are parted once more, an element
a segment: a partner lacks at most a quarter of their elements, so with more cold elements than that one is shared. What is
nearly all hot is joined with the smallest set of each hot element; those that still meet other components in their rarest
elements are compared block by block. No group of near copies yields all its pairs.

Sets are compared by 64-bit hashes of words and shingles, segments by 64-bit signatures, none of them a polynomial. Defined results: null or empty texts have an empty set, are
linked with nothing and are their own component; rows without an id keep none of their own; repeated rows fall into one class; ties go to the smallest id; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabloom.llm import _core as C

#: A segment content shared by more sets than this is hot.
HOT = 12
#: Texts, or sets, of one task where there are few of them.
TEXTS = 1 << 13
_EMPTY = np.uint64(0x5EED)


def most_apart(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Most elements by which two sets of `total` elements together may differ at that similarity."""
    least = -((-percent * total) // (100 + percent))
    return total - 2 * least


def segments(band: int, percent: int) -> int:
    """Segments of the band of sizes 2^band .. 2^(band+1)-1: enough that filled ones outnumber the differences of its largest sets."""
    top = (2 << band) - 1
    apart = top * (100 - percent) // percent
    return max(2 * apart // 1 if top < 64 else 0, int(1.2 * apart) + 4)


def set_stats(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(key, n_shingles, id: fingerprint of the set, own, low: filled segments in the own band and the band below)."""
    C.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [[] for _ in range(4)]
            for _, _, h, off in C.sets(b.column(1), n):
                size = np.diff(off)
                parts[0].append(size)
                parts[1].append(fingerprints(h, off))
                own, low = zip(*(filled(h[a:z], percent) for a, z in zip(off[:-1], off[1:], strict=True)), strict=True) if len(size) else ((), ())
                parts[2].append(np.array(own, np.int64))
                parts[3].append(np.array(low, np.int64))
            size, ids, own, low = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(ids.astype(np.uint64).view(np.int64)), pa.array(own), pa.array(low)], names=["key", "n", "id", "own", "low"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n long, id long, own long, low long")


def fingerprints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    return C.mix(C.sum_runs(C.mix(h ^ np.uint64(0xA5A5)), off) + np.diff(off).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def entries(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, role) in which a set of n elements is listed: role 0 in its own band, 1 in the band below."""
    if n < 3:  # differs from no other set by few enough elements
        return []
    band = n.bit_length() - 1
    out = [(band, 0)]
    if band and n * percent <= 100 * ((1 << band) - 1):
        out.append((band - 1, 1))
    return out


def deal(h: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, content hash, elements) of the filled segments of one set."""
    m = segments(band, percent)
    place = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    # h is sorted and its high half decides the segment, so each segment is one run
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    content = np.add.reduceat(C.mix(h + np.uint64(band + 1)), first)
    return place[first], content, np.diff(np.append(first, len(h)))


def filled(h: np.ndarray, percent: int) -> tuple[int, int]:
    out = [0, 0]
    for band, role in entries(len(h), percent):
        place = ((h >> np.uint64(32)) * np.uint64(segments(band, percent))) >> np.uint64(32)
        out[role] = int((place[1:] != place[:-1]).sum()) + 1
    return out[0], out[1]


def apart_of(n: int, role: int, percent: int) -> int:
    """Most elements by which a set of n elements differs from any partner in the band of that role."""
    return n * (100 - percent) // percent if role == 0 else 2 * n * (100 - percent) // (100 + percent)


def neighbourhood(h: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Signatures of all segments, empty ones too: whole, and with each one element deleted."""
    m = segments(band, percent)
    place = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    v = C.mix(h + np.uint64(band + 1))
    whole = np.zeros(m, np.uint64)
    np.add.at(whole, place, v)
    base = C.mix(np.arange(m, dtype=np.uint64) + _EMPTY + np.uint64(band << 32))
    return C.mix(np.concatenate([whole + base, whole[place] - v + base[place]]) ^ np.uint64(0xDE1E7E))


def signatures(h: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, elements, role) of every index entry of one set; neighbourhood entries hold 0 elements."""
    sig, size, roles = [], [], []
    for band, role in entries(len(h), percent):
        place, content, count = deal(h, band, percent)
        sig.append(C.mix(content + C.mix(place + np.uint64((band + 1) << 40))))
        size.append(count)
        roles.append(np.full(len(place), role, np.uint8))
        if len(place) <= apart_of(len(h), role, percent):
            near = np.unique(neighbourhood(h, band, percent))
            sig.append(near)
            size.append(np.zeros(len(near), np.int64))
            roles.append(np.full(len(near), role, np.uint8))
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(sig), np.concatenate(size), np.concatenate(roles)


def elements(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of single elements."""
    return C.mix(h ^ _EMPTY), np.ones(len(h), np.int64), np.zeros(len(h), np.uint8)


def index(docs: DataFrame, text: str, n: int, percent: int, parts: int, single: bool = False) -> DataFrame:
    """(bucket, ids, counts, sig, meta): blocks of index entries, by the hash bucket of their signatures; single: of elements."""
    list_of = elements if single else lambda h: signatures(h, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, off in C.sets(b.column(0), n):
                ids = fingerprints(h, off)
                _, first = np.unique(ids, return_index=True)
                every = [(ids[d], list_of(h[off[d] : off[d + 1]])) for d in first]
                every = [(i, s) for i, s in every if len(s[0])]
                if not every:
                    continue
                sig = np.concatenate([s[0] for _, s in every])
                meta = np.concatenate([np.minimum(s[1], 127).astype(np.uint8) | (s[2] << np.uint8(7)) for _, s in every])
                who = np.repeat(np.arange(len(every), dtype=np.int32), [len(s[0]) for _, s in every])
                names = np.array([i for i, _ in every], np.uint64)
                bucket = ((sig >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(parts + 1))
                rows = [[], [], [], [], []]
                for k in range(parts):
                    o = order[cut[k] : cut[k + 1]]
                    if len(o):
                        w, counts = np.unique(who[o], return_counts=True)
                        for x, y in zip(rows, (k, names[w].tobytes(), counts.astype(np.uint16).tobytes() if counts.max() < 65536 else counts.astype(np.uint64).tobytes(), sig[o].tobytes(), meta[o].tobytes()), strict=True):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[C.binary_array(x) for x in rows[1:]]], names=["bucket", "ids", "counts", "sig", "meta"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, ids binary, counts binary, sig binary, meta binary")


_MATCHES = "kind int, a long, b long, alike long, mass long"
PAIR, STAR, HOT_OF, MEMBER = range(4)


def match(hot: int):
    """A bucket's entries to rows: PAIR (a, b, alike segments, their elements) from cold segments, STAR (pivot, member) from hot
    ones, HOT_OF (id, role, number of its hot segments), MEMBER (segment, id) of hot segments."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids, sig, meta = [], [], []
        for r in range(group.num_rows):
            names = np.frombuffer(group.column("ids")[r].as_py(), np.uint64)
            raw = group.column("counts")[r].as_py()
            counts = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(names) else np.uint64).astype(np.int64)
            ids.append(np.repeat(names, counts))
            sig.append(np.frombuffer(group.column("sig")[r].as_py(), np.uint64))
            meta.append(np.frombuffer(group.column("meta")[r].as_py(), np.uint8))
        ids, sig, meta = (np.concatenate(x) for x in (ids, sig, meta))
        order = np.argsort(sig)
        s = sig[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        order = order[twin]
        ids, sig, meta = ids[order], sig[order], meta[order]
        order = np.lexsort((ids, sig))
        ids, sig, meta = ids[order], sig[order], meta[order]
        if len(ids):
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1])
            ids, sig, meta = ids[fresh], sig[fresh], meta[fresh]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(sig)))
        size, role = (meta & np.uint8(127)).astype(np.int64), meta >> np.uint8(7)
        many = np.repeat(count, count)
        out = []

        def pairs(i: np.ndarray, j: np.ndarray, kind: int) -> None:
            ok = (role[i] & role[j]) == 0  # one of them in its own band
            i, j = i[ok], j[ok]
            if not len(i):
                return
            a, b, w = ids[i].view(np.int64), ids[j].view(np.int64), np.minimum(size[i], size[j])
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            out.append((kind, a[at], b[at], np.diff(np.append(at, len(a))), np.add.reduceat(w, at)))

        cold = np.flatnonzero((many > 1) & (many <= hot))
        lefts, rights = [], []
        for k in range(1, hot):
            i = cold[cold + k < len(sig)]
            i = i[sig[i] == sig[i + k]]
            lefts.append(i)
            rights.append(i + k)
        pairs(np.concatenate(lefts), np.concatenate(rights), PAIR)
        pivot = np.repeat(first, count)
        at = np.flatnonzero(many > hot)
        if len(at):
            star = at[pivot[at] != at]
            pairs(pivot[star], star, STAR)
            both = ids[at] * np.uint64(2) + role[at].astype(np.uint64)
            order = np.argsort(both, kind="stable")
            runs = np.flatnonzero(np.concatenate([[True], (ids[at][order][1:] != ids[at][order][:-1]) | (role[at][order][1:] != role[at][order][:-1])]))
            out.append((HOT_OF, ids[at][order][runs].view(np.int64), role[at][order][runs].astype(np.int64), np.diff(np.append(runs, len(order))), np.zeros(len(runs), np.int64)))
            out.append((MEMBER, sig[at].view(np.int64), ids[at].view(np.int64), role[at].astype(np.int64), np.zeros(len(at), np.int64)))
        columns = [np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out]) if out else np.zeros(0, np.int32)]
        columns += [np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(1, 5)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b", "alike", "mass"])

    return run


def to_sets(n: int):
    """(id, text) rows to (id, items: sorted shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, h, off in C.sets(b.column(1), n):
                out += [h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), C.binary_array(out)], names=["id", "items"])

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set of x with every set of y: products of 0/1 matrices, some elements at a time."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, every)
        at[at == len(shared)] = 0
        ok = shared[at] == every
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], who[ok][order]

    if not len(shared):
        return out
    sides = [places(x), places(y)]
    step = 2048
    for lo in range(0, len(shared), step):
        block = []
        for (at, who), sets in zip(sides, (x, y), strict=True):
            p, q = np.searchsorted(at, [lo, lo + step])
            m = np.zeros((len(sets), step), np.float32)
            m[who[p:q], at[p:q] - lo] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out


def family_links(docs: DataFrame, family: DataFrame, key: str, text: str, n: int, percent: int, size: int = 512) -> DataFrame:
    """(a, b): a spanning forest of the links between the texts of each family, all of them compared, block by block.

    family has (id, component); a block of 512 sets at most meets each other block of its family in a task of its own, and
    tasks report links that connect, not pairs."""
    sizes = C.settle(family.groupBy("component").agg(F.ceil(F.count("*") / (size // 2)).alias("blocks")), "family-sizes")
    placed = C.settle(family.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")), "placed")
    nodes = placed.select("component", "block").distinct()
    left, right = nodes.withColumnRenamed("block", "p"), nodes.withColumnRenamed("block", "q")
    pairs = C.settle(left.join(right, "component").where("p <= q"), "block-pairs")
    whole = placed.join(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id").groupBy("id").agg(F.first("text").alias("text"))
    items = C.settle(placed.join(whole.select("id", "text").mapInArrow(to_sets(n), "id long, items binary"), "id"), "family-items")
    sent = pairs.withColumn("block", F.explode(F.array_distinct(F.array("p", "q")))).join(items, ["component", "block"])

    def compare(group: pa.Table) -> pa.Table:
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        block, ids = group.column("block").to_numpy(), group.column("id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("items")]
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        shared = overlaps([sets[i] for i in x], [sets[i] for i in y])
        length = np.array([len(s) for s in sets])
        i, j = np.nonzero((100 * shared >= percent * (length[x][:, None] + length[y][None, :] - shared)) & (shared > 0))
        i, j = x[i], y[j]
        low = C.forest(len(ids), i, j)
        k = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": pa.array(ids[k]), "b": pa.array(ids[low[k]])})

    return sent.groupBy("component", "p", "q").applyInArrow(compare, "a long, b long")


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text: str, key: str, n: int, percent: int, parts: int) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose sets are similar, verified on the exact sets.

    Pairs are grouped by a block of their first member (hashed, so that a hot member spreads over salts of its partners); a
    set is sent once to each block that needs it."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(8))), F.lit(8 * parts)).cast("int").alias("block"))
    salted = C.settle(salted, "pairs")
    rows = 2 * salted.count()
    needed = salted.select("block", F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = needed.join(classes.select("id", F.col("rep").alias(key)), "id").select("block", key, "id")

    whole = wanted.select(key, "id").distinct().join(docs.select(key, F.col(text).alias("text")), key).groupBy("id").agg(F.first("text").alias("text"))
    items = C.settle(C.fewer(whole, rows, TEXTS).select("id", "text").mapInArrow(to_sets(n), "id long, items binary"), "items")
    sent = wanted.select("block", "id").join(items, "id").select("block", "id", F.lit(None).cast("long").alias("b"), "items")
    asked = salted.select("block", F.col("a").alias("id"), "b", F.lit(None).cast("binary").alias("items"))

    def verify(group: pa.Table) -> pa.Table:
        known, ask = {}, []
        for i, b, x in zip(*(group.column(c).to_pylist() for c in ("id", "b", "items")), strict=True):
            if x is None:
                ask.append((i, b))
            else:
                known[i] = np.frombuffer(x, np.uint64)
        good = []
        for a, b in ask:
            x, y = known[a], known[b]
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                good.append((a, b))
        return pa.table({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())})

    return C.fewer(sent.unionByName(asked).groupBy("block").applyInArrow(verify, "a long, b long"), rows, TEXTS)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, hot: int = HOT) -> DataFrame:
    """(key, n_shingles, component_id): smallest key reachable by links of similarity >= percent / 100."""
    spark = docs.sparkSession
    parts = C.buckets(spark, 2)
    stats = C.settle(set_stats(docs, key, text, n, percent), "stats")
    rows, shingles = stats.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = stats.where("n > 0 and key is not null").groupBy("id").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.max("own").alias("own"), F.max("low").alias("low"))
    classes = C.settle(C.fewer(classes, rows), "classes")
    found = C.settle(C.fewer(index(docs, text, n, percent, parts).groupBy("bucket").applyInArrow(match(hot), _MATCHES), shingles), "matches")

    warm = found.where(F.col("kind") == HOT_OF).groupBy(F.col("a").alias("id")).agg(F.sum(F.when(F.col("b") == 0, F.col("alike"))).alias("hot_own"), F.sum(F.when(F.col("b") == 1, F.col("alike"))).alias("hot_low"))
    size = F.col("n")
    facts = classes.join(warm, "id", "left").select(
        "id",
        "rep",
        "n",
        F.floor(F.log2(F.greatest(size, F.lit(1)) + 0.5)).cast("int").alias("band"),
        (F.col("own") - F.coalesce("hot_own", F.lit(0))).alias("own"),
        (F.col("low") - F.coalesce("hot_low", F.lit(0))).alias("low"),
    )
    apart = 100 - percent
    facts = C.settle(
        C.fewer(facts, rows).withColumn("hard_own", F.expr(f"own <= floor(n * {apart} / {percent})")).withColumn("hard_low", F.expr(f"n * {percent} <= 100 * (shiftleft(1L, band) - 1) and low <= floor(2 * n * {apart} / {100 + percent})")), "facts"
    )

    def with_facts(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(facts.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "band", "own", "low", "hard_own", "hard_low")]), side)
        return pairs.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))

    cold = lambda x: F.expr(f"if(band_{x} = least(band_a, band_b), own_{x}, low_{x})")
    hard = lambda x: F.expr(f"if(band_{x} = least(band_a, band_b), hard_own_{x}, hard_low_{x})")
    total = F.col("n_a") + F.col("n_b")
    most = total - 2 * F.ceil(percent * total / (100 + percent))
    pairs = found.where(F.col("kind").isin(PAIR, STAR)).groupBy("a", "b").agg(
        F.sum(F.when(F.col("kind") == PAIR, F.col("alike")).otherwise(0)).alias("alike"), F.max((F.col("kind") == STAR).cast("int")).alias("star"), F.sum("mass").alias("mass")
    )
    judged = with_facts(pairs).select(
        "a",
        "b",
        "rep_a",
        "rep_b",
        (100 * F.col("mass") >= percent * (total - F.col("mass"))).alias("sure"),
        (((F.col("alike") > 0) & (F.col("alike") >= F.greatest(cold("a"), cold("b")) - most)) | ((F.col("star") == 1) & hard("a") & hard("b"))).alias("maybe"),
    )
    judged = C.settle(C.fewer(judged.where("sure or maybe"), shingles), "judged")
    links = judged.where("sure").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    parts_of = C.settle(C.components(links), "parts")

    def apart_pairs(pairs: DataFrame) -> DataFrame:
        """Pairs whose classes are in different components so far."""
        for side in "ab":
            pairs = pairs.join(parts_of.select(F.col("id").alias(f"rep_{side}"), F.col("component").alias(f"c_{side}")), f"rep_{side}", "left")
        return pairs.where(F.coalesce("c_a", "rep_a") != F.coalesce("c_b", "rep_b")).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        good = C.settle(similar(docs, classes, pairs, text, key, n, percent, parts), "verified")
        named = good.join(facts.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(facts.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b")
        return named.select(F.col("x").alias("a"), F.col("y").alias("b"))

    chain = parts_of.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
    chain = chain.unionByName(verified(apart_pairs(judged.where("maybe and not sure"))))
    parts_of = C.settle(C.components(chain), "parts")

    # what is left: pairs of two sets with too few cold segments. Their universe is parted once more, an element a segment
    unsure = C.settle(facts.where("hard_own or hard_low").select("id", F.col("rep").alias("key"), "n"), "unsure")
    texts = unsure.select("key").join(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").groupBy("key").agg(F.first("text").alias("text"))
    shingles = unsure.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = C.settle(C.fewer(index(C.fewer(texts, unsure.count(), TEXTS), "text", n, percent, parts, single=True).groupBy("bucket").applyInArrow(match(hot), _MATCHES), shingles), "elements")
    warm = found.where(F.col("kind") == HOT_OF).groupBy(F.col("a").alias("id")).agg(F.sum("alike").alias("hot"))
    # a partner lacks at most a quarter of a set's elements: with more cold ones, one of those is shared
    few = unsure.join(warm, "id", "left").select("id", "key", "n", (F.col("n") - F.coalesce("hot", F.lit(0))).alias("cold"), F.expr(f"floor(n * {apart} / 100)").alias("lacks"))
    few = C.settle(C.fewer(few, rows), "few")
    sides = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("alike").alias("alike"))
    for side in "ab":
        sides = sides.join(few.select(F.col("id").alias(side), F.col("key").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}"), F.col("cold").alias(f"cold_{side}")), side)
    least = F.ceil(percent * total / (100 + percent))
    sides = sides.where((F.col("alike") >= F.greatest(F.col("cold_a") - F.col("n_a"), F.col("cold_b") - F.col("n_b")) + least) & F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    # hot elements of sets that are nearly all hot: first each with the smallest set that has the element
    member = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("seg"), F.col("b").alias("id")).join(few.where("cold <= lacks"), "id")
    member = C.settle(C.fewer(member, shingles).select("seg", "id", "key", "n", (F.col("lacks") + 1 - F.col("cold")).alias("needs")), "member")
    pivot = member.groupBy("seg").agg(F.min(F.struct("n", "id", "key")).alias("p"), F.count("*").alias("size")).select("seg", "size", F.col("p.id").alias("p"), F.col("p.n").alias("p_n"), F.col("p.key").alias("p_key"))
    pivot = C.settle(C.fewer(pivot, shingles), "pivot")
    star = member.join(pivot, "seg").where(F.expr(f"p <> id and 100 * least(n, p_n) >= {percent} * greatest(n, p_n)")).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"), F.expr("if(id < p, key, p_key)").alias("rep_a"), F.expr("if(id < p, p_key, key)").alias("rep_b"))
    more = C.settle(C.fewer(sides.select("a", "b", "rep_a", "rep_b").unionByName(star.distinct()).distinct(), shingles), "more")
    chain = chain.unionByName(verified(apart_pairs(more.join(judged.select("a", "b"), ["a", "b"], "left_anti"))))
    parts_of = C.settle(C.components(chain), "parts")
    # then, where different components meet in as many of its rarest elements as a set needs: families of such sets, by blocks
    order = W.partitionBy("id").orderBy("size", "seg")
    rare = member.join(pivot.select("seg", "size"), "seg").withColumn("place", F.row_number().over(order)).where("place <= needs")
    rare = rare.join(parts_of.select(F.col("id").alias("key"), "component"), "key", "left").select("seg", "id", "key", F.coalesce("component", "key").alias("c"))
    rare = C.settle(C.fewer(rare, shingles), "rare")
    mixed = rare.groupBy("seg").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("key").alias("first")).where("low < high").select("seg", "first")
    mixed = C.settle(C.fewer(mixed, shingles), "mixed")
    met = rare.join(mixed, "seg").select(F.col("key").alias("a"), F.col("first").alias("b"))
    if not mixed.isEmpty():
        family = C.settle(C.components(met), "families")
        chain = chain.unionByName(C.settle(family_links(docs, family, key, text, n, percent), "family-links"))
        parts_of = C.settle(C.components(chain), "parts")
    final = classes.select("id", "rep").join(parts_of.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    final = C.settle(C.fewer(final, rows), "final")
    return C.fewer(stats.join(final, "id", "left"), rows).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id")
    )
