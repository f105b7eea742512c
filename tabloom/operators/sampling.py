"""Conditional sampling: category probabilities, inverse sampling, matching rows, condition vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabloom.errors import ParameterError
from tabloom.functions.expressions import category
from tabloom.operators.sequences import numbered, running_sums

#: Slots of the unit interval that drawn numbers and intervals meet in.
SLOTS = 4096


def category_probabilities(df: DataFrame, columns: Sequence[str], log: bool = False) -> DataFrame:
    """(column, value, n, probability, low, high): shares of each column's values, by count or ln(count + 1), and their cumulative interval."""
    counts = stacked(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    weight = F.ln(F.col("n") + 1.0) if log else F.col("n").cast("double")
    per = W.partitionBy("column")
    rows = counts.withColumn("w", weight).withColumn("probability", F.col("w") / F.sum("w").over(per))
    high = F.sum("probability").over(per.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("column", "value", "n", "probability", (high - F.col("probability")).alias("low"), high.alias("high"))


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the given columns, missing as a value."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(f"`{c}`")).alias("value")) for c in columns])))


def uniform_column_probabilities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, probability, high): every column equally likely, its values by share; one cumulative order over all."""
    each = category_probabilities(df, columns).select("column", "value", (F.col("probability") / len(columns)).alias("probability"))
    return running_sums(each, ["column", "value"], {"high": F.col("probability")}).select("column", "value", "probability", "high")


def rows_by_category(df: DataFrame, column: str, key: str) -> DataFrame:
    """(value, rn, key): rows of each category numbered from 1 by key, so that a draw is a join on (value, rn).

    All rows are numbered in the order of value and key, by ranges, and a category's numbers start behind those before it: a
    category of any size is split."""
    rows = df.select(category(F.col(f"`{column}`")).alias("value"), F.col(key))
    first = rows.groupBy("value").agg(F.count("*").alias("__n"))
    first = running_sums(first, "value", {"__upto": F.col("__n")}).select("value", (F.col("__upto") - F.col("__n")).alias("__before"))
    return numbered(rows, ["value", key], "__at").join(first, "value").select("value", key, (F.col("__at") - F.col("__before") + 1).cast("int").alias("rn"))


def draw(uniforms: DataFrame, r: str, intervals: DataFrame) -> DataFrame:
    """uniforms with the value whose interval [low, high) holds r, the last one beyond all.

    The unit interval is cut into SLOTS equal slots; a slot lists the intervals that end in it and the next one after, so a
    draw meets the few intervals of its slot whatever their number."""
    n = SLOTS
    place = lambda c: F.least(F.floor(c * n), F.lit(n - 1)).cast("int")
    mine = intervals.select("high", "value").withColumn("slot", place(F.col("high"))).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("high", "value"))).alias("steps"))
    every = uniforms.sparkSession.range(n).select(F.col("id").cast("int").alias("slot")).join(mine, "slot", "left")
    # a fixed number of slots: one window over all of them is small
    after = F.min(F.get("steps", F.lit(0))).over(W.orderBy("slot").rowsBetween(1, W.unboundedFollowing))
    last = F.max(F.element_at("steps", -1)).over(W.partitionBy())
    slots = every.select("slot", "steps", after.alias("after"), last.alias("last"))
    found = uniforms.withColumn("slot", place(F.col(r))).join(slots, "slot", "left")
    step = F.coalesce(F.get(F.filter("steps", lambda s: s["high"] > F.col(r)), F.lit(0)), "after", "last")
    return found.withColumn("value", step["value"]).drop("slot", "steps", "after", "last")


def match_rows(drawn: DataFrame, r: str, index: DataFrame) -> DataFrame:
    """drawn (with `value`) joined to one uniformly chosen real row of that value, by the uniform r."""
    counts = index.groupBy("value").agg(F.count("*").alias("cnt"))
    picked = drawn.join(counts, "value").withColumn("rn", (F.floor(F.col(r) * F.col("cnt")) + 1).cast("int")).drop("cnt")
    return picked.join(index, ["value", "rn"])


def condition_vector(sizes: Sequence[int], at: Mapping[int, Column]) -> Column:
    """Encoded row of zeros with a one at the value of each condition: column number to ordinal."""
    if bad := [i for i in at if not 0 <= i < len(sizes)]:
        raise ParameterError(f"no such columns: {bad}")
    one = lambda n, value: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == value).cast("int"))
    parts = [one(n, at[i]) if i in at else F.array_repeat(F.lit(0), n) for i, n in enumerate(sizes)]
    return F.concat(*parts)


def mask(columns: int, probability: float, seed: int) -> Column:
    """0/1 per column, one with the given probability."""
    return F.array(*[(F.rand(seed + i) < probability).cast("int") for i in range(columns)])


def expand_mask(m: Column, sizes: Sequence[int]) -> Column:
    """A mask by columns as a mask by entries of the encoded row."""
    return F.concat(*[F.array_repeat(m[i], n) for i, n in enumerate(sizes)])


def masked(v: Column, m: Column) -> Column:
    return F.zip_with(v, m, lambda x, k: x * k)
