"""Clusters of related columns, complex identifiers, record length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabloom.errors import ParameterError
from tabloom.functions.expressions import scrub
from tabloom.operators.stats import correlation_matrix

#: Fixed values of the identifier test: share of distinct values, mean length, characters looked at.
ID_UNIQUE, ID_LENGTH, ID_PREFIX = 0.85, 16, 1500


def complex_ids(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, is_complex_id): nearly unique, long on average, with a digit and only letters, digits, _ and - in its first 1,500 characters."""
    columns = list(columns or [c for c in df.columns if c != order])
    cells = df.select(F.col(order).alias("__o"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), scrub(df, c).cast("string").alias("v")) for c in columns]))).where("v is not null")
    facts = cells.groupBy("column").agg((F.count_distinct("v") / F.count("*")).alias("ratio"), (F.avg(F.length("v")) - 1).alias("mean_length"))
    # the prefix: the first rows by order until 1,500 characters; at most that many rows can count
    first = cells.withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy("__o"))).where(F.col("rn") <= ID_PREFIX)
    upto = F.sum(F.length("v") + 1).over(W.partitionBy("column").orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    before = first.withColumn("before", upto - F.length("v") - 1).where(F.col("before") < ID_PREFIX).withColumn("v", F.substr("v", F.lit(1), (F.lit(ID_PREFIX) - F.col("before")).cast("int")))
    text = before.groupBy("column").agg(F.bool_and(F.col("v").rlike("^[A-Za-z0-9_-]*$")).alias("plain"), F.bool_or(F.col("v").rlike("[0-9]")).alias("digit"))
    test = (F.col("ratio") >= ID_UNIQUE) & (F.col("mean_length") >= ID_LENGTH) & F.col("plain") & F.col("digit")
    return facts.join(text, "column", "left").select("column", F.coalesce(test, F.lit(False)).alias("is_complex_id"))


def mean_lengths(df: DataFrame) -> dict[str, float]:
    """Mean text length of each column (missing counts as 0), from one aggregation."""
    row = df.agg(*[F.avg(F.coalesce(F.length(scrub(df, c).cast("string")), F.lit(0))).alias(f"l{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"l{i}"] or 0.0 for i, c in enumerate(df.columns)}


def record_length(df: DataFrame) -> DataFrame:
    """One row, length: mean characters of a record as delimited text."""
    one = F.lit(0)
    for c in df.columns:
        one = one + F.coalesce(F.length(scrub(df, c).cast("string")), F.lit(0))
    return df.agg((F.avg(one) + (len(df.columns) - 1)).alias("length"))


class Tree:
    """A node of the merge tree: leaves in order, and the two parts it was merged from."""

    def __init__(self, leaves: list[int], left: Tree | None = None, right: Tree | None = None) -> None:
        self.leaves, self.left, self.right = leaves, left, right


def linkage(points: np.ndarray, method: str = "single") -> Tree:
    """Agglomerative clustering of a few points (columns) by Euclidean distance, with neighbouring leaves kept close."""
    if method not in ("single", "complete", "average"):
        raise ParameterError(f"unknown linkage {method}")
    nodes = [Tree([i]) for i in range(len(points))]
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    merge = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(nodes) > 1:
        best = min(((float(merge(gap[np.ix_(a.leaves, b.leaves)])), i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j))
        a, b = nodes[best[1]], nodes[best[2]]
        # of the four ways to lay the two parts end to end, the one whose meeting leaves are closest
        ways = [(gap[x[-1], y[0]], k, x + y) for k, (x, y) in enumerate(((a.leaves, b.leaves), (a.leaves[::-1], b.leaves), (a.leaves, b.leaves[::-1]), (a.leaves[::-1], b.leaves[::-1])))]
        nodes = [n for n in nodes if n is not a and n is not b] + [Tree(min(ways)[2], a, b)]
    return nodes[0]


def cluster_columns(df: DataFrame, order: str | None = None, prefix: Sequence[str] = (), most: int = 20, length_threshold: float = 0, method: str = "single", nominal: Sequence[str] = (), isolate_ids: bool = True) -> list[list[str]]:
    """Groups of columns to be handled together: at most `most` columns, records under the length threshold (0: any).

    Columns whose rows of the absolute correlation matrix are alike come together; identifiers stand alone; prefix columns come first."""
    if missing := [c for c in prefix if c not in df.columns]:
        raise ParameterError(f"no such columns: {missing}")
    names = [c for c in df.columns if c not in prefix]
    alone: list[str] = []
    if len(names) > 1 and isolate_ids and order is not None:
        flags = {r["column"]: r["is_complex_id"] for r in complex_ids(df, order, names).collect()}
        alone = [c for c in names if flags.get(c)]
    rest = [c for c in names if c not in alone]
    out: list[list[str]] = []
    if len(rest) == 1:
        out = [rest]
    elif rest:
        cells = {(r["row_col"], r["col_col"]): abs(r["value"]) for r in correlation_matrix(df.select(*rest), nominal).collect()}
        profile = np.array([[cells[a, b] for b in rest] for a in rest])
        lengths = mean_lengths(df.select(*rest)) if length_threshold else {}

        def size(group: Sequence[int]) -> float:
            return sum(lengths[rest[i]] for i in group) + len(group) - 1 if length_threshold else 0.0

        def fits(group: Sequence[int]) -> bool:
            return len(group) <= most and (not length_threshold or size(group) <= length_threshold or len(group) == 1)

        def descend(t: Tree) -> list[list[int]]:
            return [t.leaves] if fits(t.leaves) or t.left is None else descend(t.left) + descend(t.right)

        merged: list[list[int]] = []
        for g in descend(linkage(profile, method)):
            if merged and fits(merged[-1] + g):
                merged[-1] = merged[-1] + g
            else:
                merged.append(g)
        out = [[rest[i] for i in g] for g in merged]
    out += [[c] for c in alone]
    if prefix:
        out = [[*prefix, *out[0]], *out[1:]] if out else [list(prefix)]
    return out
