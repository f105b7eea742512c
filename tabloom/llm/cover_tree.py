"""Exact near-duplicate pairs of embeddings by dual traversal of a cover tree.

On unit vectors cosine >= c is a distance of at most e = sqrt(2 - 2c). Within each label a tree of nested levels with halving
radii is laid over the vectors: the upper levels are fitted on a bounded sample (points farther than the level's radius from
all centres so far become centres), every vector is placed under its nearest centre, and each node keeps its true covering
radius. A pair of nodes can hold a pair of vectors only if d(centres) <= r1 + r2 + e; all others are pruned. What is left goes
to tasks as pairs of blocks, where further levels are built and traversed in the same way, and cosines in double precision
decide. Large nodes are split into blocks by hash, so no task depends on the size of a label or a cluster.

Equal vectors of a label are one class from the start, counted by their number. A task reports the number of links of each
class and a spanning forest of what it has linked, never all pairs.

Defined results: null ids or labels, null or zero vectors and those with null or non-finite components have no links and are their
own component; vectors of different lengths are not compared; repeated rows are equal vectors and link; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import _core as C

#: Vectors a block should hold, sampled vectors for the upper levels, partners of a block in one task.
BLOCK, SAMPLE, PARTNERS = 1024, 4096, 16


def unit(raw: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, vec: the doubles as bytes, null if the vector takes no part)."""
    for b in batches:
        out = []
        for i, label, x in zip(b.column(0), b.column(1), b.column(2), strict=True):
            raw = None
            if i.is_valid and label.is_valid and x.is_valid and len(x) and x.values.null_count == 0:
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    raw = (v / (2.0 ** np.floor(np.log2(top)))).tobytes() if not 1e-100 < top < 1e100 else v.tobytes()
            out.append(raw)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), C.binary_array(out)], names=["id", "label", "vec"])


def centres(x: np.ndarray, want: int) -> np.ndarray:
    """Indices of the centres of the first of the nested levels (radii 2, 1, 1/2, ...) that has at least `want` of them."""
    chosen, near = [0], np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
    radius = 2.0
    while len(chosen) < want and radius > 1e-3:
        radius /= 2
        while len(chosen) < want:
            k = int(np.argmax(near))
            if near[k] <= radius:
                break
            chosen.append(k)
            near = np.minimum(near, np.sqrt(np.maximum(2 - 2 * (x @ x[k]), 0)))
    return np.array(chosen)


class Node:
    """A node with the rows below it; children appear by nested levels of halving radii while they separate the rows."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> None:
        self.rows, self.centre = rows, centre
        self.radius = float(np.sqrt(np.maximum(2 - 2 * (x[rows] @ centre), 0)).max())

    def split(self, x: np.ndarray) -> list[Node]:
        own = x[self.rows]
        pick = centres(own, min(16, len(own) // 32))
        side = np.argmax(own @ own[pick].T, axis=1)
        return [Node(x, self.rows[side == k], own[p]) for k, p in enumerate(pick) if (side == k).any()]


def traverse(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) with cosine >= threshold, each unordered pair once where both sides are the same."""
    reach = np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    kids: dict[int, list[Node]] = {}

    def children(n: Node, z: np.ndarray) -> list[Node]:
        if id(n) not in kids:
            below = n.split(z) if len(n.rows) >= 128 else []
            kids[id(n)] = below if below and max(c.radius for c in below) < 0.7 * n.radius else []
        return kids[id(n)]

    a = Node(x, np.arange(len(x)), x[0])
    b = a if same else Node(y, np.arange(len(y)), y[0])
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p is not q and np.sqrt(max(2 - 2 * float(p.centre @ q.centre), 0)) > p.radius + q.radius + reach:
            continue
        if p is q:
            below = children(p, x)
            if below:
                stack += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
                continue
        else:
            first, second = (children(p, x), children(q, y))
            if first and (not second or p.radius >= q.radius):
                stack += [(c, q) for c in first]
                continue
            if second:
                stack += [(p, c) for c in second]
                continue
        i, j = np.nonzero(x[p.rows] @ y[q.rows].T >= threshold)
        i, j = p.rows[i], q.rows[j]
        if p is q:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def link_blocks(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        mine = next(r for r in rows if r["b"] == r["a"])
        out_id, out_n, edge_a, edge_b = [], [], [], []

        def unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64)
            return ids, n, unit([r["vecs"]], len(r["vecs"]) // 8 // len(ids))

        ids, n, x = unpack(mine)
        for r in rows:
            same = r["b"] == r["a"]
            if same and not r["inner"]:
                continue
            other, m, y = (ids, n, x) if same else unpack(r)
            found = list(traverse(x, y, threshold, same))
            if not found:
                continue
            i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            out_id += [ids, other]
            out_n += [np.bincount(i, m[j], len(ids)).astype(np.int64), np.bincount(j, n[i], len(other)).astype(np.int64)]
            every = ids if same else np.concatenate([ids, other])
            low = C.forest(len(every), i, j if same else j + len(ids))
            k = np.flatnonzero(low != np.arange(len(low)))
            edge_a.append(every[k])
            edge_b.append(every[low[k]])
        some = np.concatenate(out_n) if out_n else np.zeros(0, np.int64)
        who = np.concatenate(out_id)[some > 0] if out_n else some
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (edge_a, edge_b))
        return pa.table(
            {
                "id": pa.array(np.concatenate([who, a])),
                "links": pa.array(np.concatenate([some[some > 0], np.zeros(len(a), np.int64)])),
                "to": pa.array(np.concatenate([np.full(len(who), -1), b]), mask=np.concatenate([np.ones(len(who), bool), np.zeros(len(b), bool)])),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    kind = vectors.schema[label].dataType.simpleString()
    rows = C.settle(vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).mapInArrow(as_bytes, f"id long, label {kind}, vec binary"), "vectors")
    grouped = rows.where("vec is not null").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    classes = C.settle(grouped, "classes").withColumn("dim", F.length("vec"))
    # upper levels from a bounded sample; every (label, length) met in it has its own centres
    total = classes.count()
    share = F.lit(min(1.0, SAMPLE / max(total, 1)))
    place = F.pmod(F.xxhash64("rep", F.lit("cover")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample: dict[tuple, list[bytes]] = {}
    for r in classes.where(place < share).select("label", "dim", "vec").toLocalIterator():
        sample.setdefault((r["label"], r["dim"]), []).append(bytes(r["vec"]))
    tree: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
    at = 1
    for k, raw in sorted(sample.items()):
        x = unit(sorted(raw), k[1] // 8)
        pick = x[centres(x, max(1, round(len(x) * total / max(len(x), min(SAMPLE, total)) / BLOCK)))]
        tree[k] = at, pick, np.bincount(np.argmax(x @ pick.T, axis=1), minlength=len(pick)) * (total / max(min(SAMPLE, total), 1))
        at += len(pick)
    shared = spark.sparkContext.broadcast(tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            labels, dims, vecs, reps = (b.column(i).to_pylist() for i in range(4))
            cell, part, far = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64), np.zeros(len(reps))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(k, []).append(i)
            for k, i in groups.items():
                if k in tree:
                    first, centre, size = tree[k]
                    dots = unit([vecs[j] for j in i], k[1] // 8) @ centre.T
                    best = dots.argmax(1)
                    cell[i] = first + best
                    far[i] = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(i)), best], 0))
                    blocks = np.maximum(1, np.ceil(size[best] / (2 * BLOCK))).astype(np.uint64)
                    part[i] = (C.mix(np.array([reps[j] for j in i], np.int64).astype(np.uint64)) % blocks).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(cell), pa.array(part), pa.array(far)], names=["label", "dim", "vec", "rep", "n", "cell", "part", "far"])

    placed = C.settle(classes.select("label", "dim", "vec", "rep", "n").mapInArrow(put, f"label {kind}, dim int, vec binary, rep long, n long, cell long, part long, far double"), "placed")
    radius = {r["cell"]: r["r"] for r in placed.where("cell > 0").groupBy("cell").agg(F.max("far").alias("r")).collect()}
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    near = []
    for first, centre, _ in tree.values():
        gap = np.sqrt(np.maximum(2 - 2 * (centre @ centre.T), 0))
        r = np.array([radius.get(first + i, -9.0) for i in range(len(centre))])
        i, j = np.nonzero((gap <= r[:, None] + r[None, :] + reach) & (r[:, None] >= 0) & (r[None, :] >= 0))
        near += [(int(first + p), int(first + q)) for p, q in zip(i, j, strict=True) if p <= q]
    cells = spark.createDataFrame(near, "c long, d long")

    # cell 0: labels too rare for the sample; their label and length are the node
    node = F.struct("cell", F.when(F.col("cell") == 0, F.col("label").cast("string")).alias("rare"), F.when(F.col("cell") == 0, F.col("dim")).alias("dim"), "part")

    def gather(group: pa.Table) -> pa.Table:
        return pa.table({"node": group.column("node").slice(0, 1), "ids": C.binary_array([group.column("rep").to_numpy().tobytes()]), "counts": C.binary_array([group.column("n").to_numpy().tobytes()]), "vecs": C.binary_array([b"".join(group.column("vec").to_pylist())])})

    blocks = C.settle(placed.select(F.to_json(node).alias("node"), "rep", "n", "vec").groupBy("node").applyInArrow(gather, "node string, ids binary, counts binary, vecs binary"), "blocks")
    nodes = blocks.select("node", F.get_json_object("node", "$.cell").cast("long").alias("cell"))
    left, right = nodes.select(F.col("node").alias("a"), F.col("cell").alias("c")), nodes.select(F.col("node").alias("b"), F.col("cell").alias("d"))
    pairs = left.join(cells, "c").join(right, "d").where("c < d or a < b").select("a", "b")
    pairs = pairs.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    pairs = C.settle(pairs.join(many, "a").select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.col("salts"))).alias("salt")), "node-pairs")
    own = pairs.select("a", F.col("a").alias("b"), "salt", (F.col("salt") == 0).alias("inner")).distinct()
    asked = own.unionByName(pairs.where("a <> b").select("a", "b", "salt", F.lit(False).alias("inner")))
    work = asked.join(blocks.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "inner", "ids", "counts", "vecs")
    found = C.settle(work.groupBy("a", "salt").applyInArrow(link_blocks(threshold), "id long, links long, `to` long"), "links")
    degree = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    parts = C.components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    facts = classes.join(degree, classes["rep"] == degree["id"], "left").drop("id").join(parts, F.col("rep") == parts["id"], "left")
    facts = C.settle(facts.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "facts")
    out = rows.join(facts, ["label", "vec"], "left")
    component = F.coalesce("component", F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
