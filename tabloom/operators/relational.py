"""Row-set operators between tables: memorized and novel rows, indicators, neighbours, sampling up, batches of columns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabloom.errors import ParameterError
from tabloom.functions.expressions import is_numeric, scrub


def all_cast(df: DataFrame, name: str) -> bool:
    """Whether every present value of a column reads as a number."""
    c = F.col(f"`{name}`")
    row = df.agg(F.count(c).alias("n"), F.count(c.try_cast("double")).alias("k")).first()
    return row["n"] == row["k"]


def harmonise(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with their shared columns comparable: numbers as double; where one side is text, as numbers if all of it
    reads as such, else both as text."""
    shared = [c for c in a.columns if c in b.columns]
    left, right = [], []
    for c in shared:
        na, nb = (is_numeric(d.schema[c].dataType) for d in (a, b))
        x, y = scrub(a, c), scrub(b, c)
        if na and nb:
            kind = None if a.schema[c].dataType == b.schema[c].dataType and not a.schema[c].dataType.typeName() in ("double", "float") else "double"
        elif na == nb:
            kind = None if a.schema[c].dataType == b.schema[c].dataType else "string"
        else:
            kind = "double" if all_cast(b if na else a, c) else "string"
        if kind:
            x, y = (v.try_cast(kind) if kind == "double" else v.cast(kind) for v in (x, y))
        left.append(x.alias(c))
        right.append(y.alias(c))
    return a.select(*left), b.select(*right), shared


def memorized_rows(training: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Distinct rows of all shared columns that both tables hold; missing equals missing. Without shared columns: none."""
    a, b, shared = harmonise(training, synthetic)
    if not shared:
        raise ParameterError("the tables share no column")
    return a.intersect(b)


def count_memorized(training: DataFrame, synthetic: DataFrame) -> DataFrame:
    return memorized_rows(training, synthetic).agg(F.count("*").alias("memorized"))


def novel_rows(training: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Distinct synthetic rows that training does not hold."""
    a, b, _ = harmonise(training, synthetic)
    return b.subtract(a)


def outer_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both sides with `side`: left_only, right_only or both; missing keys match each other."""
    a = left.select(*[F.col(k).alias(f"__l_{k}") for k in keys]).distinct().withColumn("__l", F.lit(True))
    b = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys]).distinct().withColumn("__r", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}"))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full_outer").select(*[F.when(F.col("__l").isNotNull(), F.col(f"__l_{k}")).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys], side.alias("side"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


#: Distinct points of a cell, cells at most, vectors drawn for the cells' cuts (and bytes of them), distances held at once.
CELL_POINTS, MOST_CELLS, CUT_DRAWS, CUT_BYTES, HELD = 4096, 4096, 8192, 32 << 20, 1 << 20


class Cells:
    """A tree of cuts across the widest side of drawn vectors: any vector falls into one of `size` cells. Cuts only balance."""

    def __init__(self, drawn: np.ndarray, most: int) -> None:
        self.side, self.cut, self.low, self.high = [], [], [], []  # of each inner node; below: a node, or the complement of a cell
        self.size, self.root = 1, ~0
        heap = [(-len(drawn), 0, drawn, None)]  # cells by falling number of vectors, and where the tree points at each
        while heap and self.size < most:
            _, cell, x, owner = heapq.heappop(heap)
            spread = np.ptp(x, axis=0) if x.size else np.zeros(1)
            if not spread.max(initial=0) > 0:
                continue
            side = int(spread.argmax())
            v = np.sort(x[:, side])
            cut = v[(len(v) - 1) // 2]
            cut = cut if cut < v[-1] else v[np.searchsorted(v, v[-1]) - 1]
            node, new = len(self.side), self.size
            for out, value in ((self.side, side), (self.cut, cut), (self.low, ~cell), (self.high, ~new)):
                out.append(value)
            if owner is None:
                self.root = node
            else:
                owner[0][owner[1]] = node
            below = x[:, side] <= cut
            heapq.heappush(heap, (-int(below.sum()), cell, x[below], (self.low, node)))
            heapq.heappush(heap, (-int((~below).sum()), new, x[~below], (self.high, node)))
            self.size += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        side, cut, low, high = (np.array(v) for v in (self.side, self.cut, self.low, self.high))
        at = np.full(len(x), self.root)
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            at[open_] = np.where(x[open_, side[node]] <= cut[node], low[node], high[node])
        return ~at


def as_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(-1, width)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the differences along the first axis, summed in the order of squared_distance."""
    out = np.zeros(x.shape[1:])
    for d in x:
        out += d * d
    return np.sqrt(out)


def closest(q: np.ndarray, p: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of each query's m closest points, the earlier point first on ties, some queries at a time."""
    m, step = min(m, len(p)), max(1, HELD // max(1, len(p)))
    for at in range(0, len(q) if m else 0, step):
        some = q[at : at + step]
        away = np.zeros((len(some), len(p)))
        for j in range(p.shape[1]):
            d = some[:, j, None] - p[None, :, j]
            away += d * d
        away = np.sqrt(away)
        row, col = np.nonzero(away <= np.partition(away, m - 1, axis=1)[:, m - 1, None])
        order = np.lexsort((col, away[row, col], row))
        row, col = row[order], col[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < m
        yield row[keep] + at, col[keep], away[row[keep], col[keep]]


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int = 5, blocks: int = 64) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): k nearest points of each query; ties to the smaller id; a point is not its own.

    Exact. The points lie in cells. The k + 1 best of a query's own cell bound how far its neighbours are, and it visits every
    cell whose box is not farther; equal vectors are searched once, and of equal points only the k + 1 smallest ids can count.
    Distances that are no number come last: infinite, then NaN, then missing. Queries that are not finite, or not of the common
    length, meet all points."""
    m = k + 1
    numbers = F.col(vector).cast("array<double>")
    q = queries.select(F.col(key).alias("query_id"), numbers.alias("qv")).where("query_id is not null")
    p = points.select(F.col(key).alias("neighbour_id"), numbers.alias("pv")).where("neighbour_id is not null")

    def finite(c: str) -> Column:
        return F.coalesce(F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))

    order = [F.col("distance").asc_nulls_last(), F.col("neighbour_id")]
    width = q.where(finite("qv") & (F.size("qv") > 0)).agg(F.mode(F.size("qv"), True)).first()[0]
    plain_q, plain_p = (finite(c) & (F.size(c) == F.lit(width)) if width else F.lit(False) for c in ("qv", "pv"))
    found = []
    if width:
        found.append(among_cells(q.where(plain_q), p.where(plain_p), width, m))
        odd = p.where(~plain_p)
        if not odd.isEmpty():
            known = F.col("pv").isNotNull() & (F.size("pv") == width) & ~F.exists("pv", lambda x: x.isNull())
            away = F.when(known, F.when(F.exists("pv", F.isnan), float("nan")).otherwise(float("inf")))
            few = odd.select("neighbour_id", away.alias("distance")).withColumn("r", F.row_number().over(W.partitionBy("distance").orderBy("neighbour_id"))).where(F.col("r") <= m)
            found.append(q.where(plain_q).select("query_id").crossJoin(F.broadcast(few.select("neighbour_id", "distance"))))
    odd = q.where(~plain_q)
    if not odd.isEmpty():
        spread = odd.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = spread.join(p.withColumn("block", F.pmod(F.xxhash64("neighbour_id"), F.lit(blocks))), "block").where("query_id <> neighbour_id").select("query_id", "neighbour_id", "block", F.sqrt(squared_distance(F.col("qv"), F.col("pv"))).alias("distance"))
        local = pairs.withColumn("r", F.row_number().over(W.partitionBy("query_id", "block").orderBy(*order))).where(F.col("r") <= k)
        found.append(local.select("query_id", "neighbour_id", "distance"))
    if not found:
        found.append(q.crossJoin(p).select("query_id", "neighbour_id", F.lit(None).cast("double").alias("distance")).where("false"))
    best = reduce(DataFrame.unionByName, found).where("query_id <> neighbour_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "neighbour_id", "rank", "distance")


def among_cells(q: DataFrame, p: DataFrame, width: int, m: int) -> DataFrame:
    """(query_id, neighbour_id, distance): for every finite query the m closest of the finite points, and some more."""
    few = p.withColumn("r", F.row_number().over(W.partitionBy("pv").orderBy("neighbour_id"))).where(F.col("r") <= m).drop("r")
    draws = max(256, min(CUT_DRAWS, CUT_BYTES // (8 * width)))
    drawn = p.select("pv", F.xxhash64("pv").alias("draw")).distinct().orderBy("draw").limit(draws).collect()
    share = (max(r.draw for r in drawn) + 2**63 + 1) / 2**64 if len(drawn) == draws else 1  # of the distinct points, that was drawn
    cells = Cells(np.array([r.pv for r in drawn]).reshape(-1, width), max(1, min(MOST_CELLS, int(len(drawn) / share / CELL_POINTS))))
    id_type = p.schema["neighbour_id"].dataType.simpleString()

    def placed(column: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(as_matrix(b.column(b.schema.get_field_index(column)), width)), pa.int64())], names=[*b.schema.names, "cell"])

        return run

    placed_p = few.mapInArrow(placed("pv"), f"neighbour_id {id_type}, pv array<double>, cell long")
    placed_q = q.select("qv").distinct().mapInArrow(placed("qv"), "qv array<double>, cell long")
    sides = [f(F.col("pv")[j]).alias(f"{n}{j}") for n, f in (("a", F.min), ("b", F.max)) for j in range(width)]
    boxes = placed_p.groupBy("cell").agg(*sides).collect()
    number = np.array([r[0] for r in boxes], np.int64)
    low, high = (np.array([r[x : x + width] for r in boxes]).reshape(-1, width).T for x in (1, 1 + width))

    def bounded(asks: pa.Table, there: pa.Table) -> pa.Table:
        bound = np.full(asks.num_rows, np.inf)
        if asks.num_rows and there.num_rows >= m:
            for row, _, away in closest(as_matrix(asks.column("qv"), width), as_matrix(there.column("pv"), width), m):
                bound[row[m - 1 :: m]] = away[m - 1 :: m]
        return pa.table({"qv": asks.column("qv"), "bound": pa.array(bound)})

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, bound = as_matrix(b.column(0), width), b.column(1).to_numpy()
            step = max(1, HELD // max(1, len(number) * width))
            for at in range(0, len(x), step):
                some = x[at : at + step].T[:, :, None]
                gap = np.maximum(np.maximum(low[:, None, :] - some, some - high[:, None, :]), 0)
                row, cell = np.nonzero(norms(gap) <= bound[at : at + step, None])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), pa.array(number[cell], pa.int64())], names=["qv", "cell"])

    def met(asks: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("neighbour_id")
        parts = list(closest(as_matrix(asks.column("qv"), width), as_matrix(there.column("pv"), width), m)) if asks.num_rows and there.num_rows else []
        row, col, away = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*parts, strict=True) if parts else ([], [], []), strict=True))
        return pa.table({"qv": asks.column("qv").take(pa.array(row)), "neighbour_id": there.column("neighbour_id").take(pa.array(col)), "distance": pa.array(away)})

    bounds = placed_q.groupBy("cell").cogroup(placed_p.groupBy("cell")).applyInArrow(bounded, "qv array<double>, bound double")
    asks = bounds.mapInArrow(visits, "qv array<double>, cell long")
    best = asks.groupBy("cell").cogroup(placed_p.groupBy("cell")).applyInArrow(met, f"qv array<double>, neighbour_id {id_type}, distance double")
    return q.join(best, "qv").select("query_id", "neighbour_id", "distance")


def upsample(df: DataFrame, target: int, order: str, seed: int | None = None) -> DataFrame:
    """At least `target` rows: whole repeats, then the rest of one more, the first by `order` or (seed) at random."""
    n = df.count()
    if n == 0 or n >= target:
        return df
    whole, rest = divmod(target, n)
    repeats = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("__copy")
    extra = df.orderBy(F.rand(seed), order) if seed is not None else df.orderBy(order)
    return repeats.unionByName(extra.limit(rest)) if rest else repeats


def column_batches(names: Sequence[str], size: int = 15) -> list[list[str]]:
    """Columns in ceil(n / size) groups whose sizes differ by one at most, larger ones first."""
    n = -(-len(names) // size)
    out, at = [], 0
    for i in range(n):
        take = len(names) // n + (i < len(names) % n)
        out.append(list(names[at : at + take]))
        at += take
    return out


def vertical_split(df: DataFrame, key: str, size: int = 15) -> list[DataFrame]:
    return [df.select(key, *batch) for batch in column_batches([c for c in df.columns if c != key], size)]


def reassemble(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Column batches joined on their row key, columns in the original order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out.select(*order)


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ParameterError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ParameterError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ParameterError(f"no such columns: {missing}")
    return df.drop(*names)


def row_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def force_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Condition columns overwritten by the requested constants."""
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


def integers_where_possible(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns whose present values all read as whole numbers become bigint; the others stay."""
    facts = df.agg(*[(F.count(f"`{c}`") == F.count(F.when(F.col(f"`{c}`").try_cast("double") == F.col(f"`{c}`").try_cast("bigint"), 1))).alias(c) for c in names]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("double").cast("bigint") for c in names if facts[c]})


def cast_like(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast(like.schema[c].dataType).alias(c) if c in like.columns else F.col(f"`{c}`") for c in df.columns])
