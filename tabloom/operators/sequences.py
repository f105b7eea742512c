"""Sequences of examples: reshaping, validity, repair, two-level scaling, padding, fixed windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabloom.errors import DataError, ParameterError

#: Smallest range when scaling; limits of missing values for a valid example.
LEAST_RANGE, MOST_MISSING, RUN_SHARE, RUN_LOW, RUN_HIGH = 1e-6, 0.1, 0.05, 2.0, 5.0
#: Ranges that rows are numbered in at most, rows that make a further range worth it, and keys drawn for each to set its bounds.
MOST_RANGES, RANGE_ROWS, RANGE_DRAWS = 256, 20_000, 20


def positions(df: DataFrame, example: str, time: str) -> DataFrame:
    """df with `pos`, each row's place (from 0) in its example by time."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(example).orderBy(time)) - 1)


def long_to_sequences(df: DataFrame, example: str, time: str, features: Sequence[str], attributes: Sequence[str] = ()) -> DataFrame:
    """One row per example: its attributes, its length and `steps`, an array of structs by time."""
    steps = F.array_sort(F.collect_list(F.struct(time, *features)))
    return df.groupBy(example).agg(*[F.first(a, ignorenulls=True).alias(a) for a in attributes], steps.alias("steps")).withColumn("length", F.size("steps"))


def sequences_to_long(df: DataFrame, example: str, features: Sequence[str], attributes: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """Steps as rows with their position; with a flag feature an example ends after its first false one."""
    steps = F.col("steps")
    if flag:
        ends = F.array_position(F.transform(steps, lambda s: s[flag]), F.lit(False))
        steps = F.when(ends > 0, F.slice(steps, F.lit(1), ends.cast("int"))).otherwise(steps)
    out = df.select(example, *attributes, F.posexplode(steps).alias("pos", "step"))
    return out.select(example, *attributes, "pos", *[F.col(f"step.{f}").alias(f) for f in features])


def wide_to_long(df: DataFrame, ids: Sequence[str], times: Sequence[str], value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(times), "t", value)


def long_to_wide(df: DataFrame, ids: Sequence[str], time: str, value: str, times: Sequence[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(time, list(times)).agg(F.first(value))


def longest_null_run(df: DataFrame, example: str, order: str, value: str) -> DataFrame:
    """(example, run): most missing values in a row."""
    w = W.partitionBy(example).orderBy(order)
    marked = df.select(example, order, F.col(value).isNull().alias("gone"), F.count(value).over(w).alias("island"))
    runs = marked.groupBy(example, "island").agg(F.sum(F.col("gone").cast("long")).alias("run"))
    return runs.groupBy(example).agg(F.max("run").alias("run"))


def example_validity(df: DataFrame, example: str, order: str, features: Sequence[str]) -> DataFrame:
    """(example, valid): every feature misses under a tenth of its values and under clip(5 %, 2, 5) in a row."""
    facts = None
    for f in features:
        ratio = df.groupBy(example).agg(F.avg(F.col(f).isNull().cast("double")).alias("ratio"), F.count("*").alias("n"))
        limit = F.greatest(F.lit(RUN_LOW), F.least(F.lit(RUN_HIGH), F.col("n") * RUN_SHARE))
        one = ratio.join(longest_null_run(df, example, order, f), example).select(example, ((F.col("ratio") < MOST_MISSING) & (F.col("run") < limit)).alias("ok"))
        facts = one if facts is None else facts.unionByName(one)
    return facts.groupBy(example).agg(F.bool_and("ok").alias("valid"))


def keep_valid(df: DataFrame, validity: DataFrame, example: str) -> DataFrame:
    """Rows of valid examples; an error where under half of the examples are valid."""
    share = validity.agg(F.avg(F.col("valid").cast("double"))).first()[0]
    if share is not None and share < 0.5:
        raise DataError(f"only {share:.0%} of the examples are valid")
    return df.join(validity.where("valid").select(example), example, "left_semi")


def interpolate(df: DataFrame, example: str, order: str, value: str) -> DataFrame:
    """df with missing values of a feature filled linearly by position; at the edges by the nearest value."""
    w = W.partitionBy(example).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    rn = F.row_number().over(w)
    at = F.when(F.col(value).isNotNull(), F.col("__rn"))
    out = df.withColumn("__rn", rn)
    out = out.withColumns({"__v0": F.last(value, True).over(back), "__v1": F.first(value, True).over(ahead), "__p0": F.last(at, True).over(back), "__p1": F.first(at, True).over(ahead)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__rn") - F.col("__p0")) / (F.col("__p1") - F.col("__p0"))
    filled = F.coalesce(F.col(value).cast("double"), F.when(F.col("__p0").isNotNull() & F.col("__p1").isNotNull(), line), F.col("__v0"), F.col("__v1"))
    return out.withColumn(value, filled).drop("__rn", "__v0", "__v1", "__p0", "__p1")


def scale(c: Column, low: Column, high: Column, symmetric: bool = False) -> Column:
    unit = (c - low) / F.greatest(high - low, F.lit(LEAST_RANGE))
    return unit * 2 - 1 if symmetric else unit


def unscale(c: Column, low: Column, high: Column, symmetric: bool = False) -> Column:
    unit = (c + 1) / 2 if symmetric else c
    return unit * (high - low) + low


def min_max(df: DataFrame, value: str) -> tuple[float, float]:
    return tuple(df.agg(F.min(value), F.max(value)).first())


def two_level_scale(df: DataFrame, example: str, value: str, low: float, high: float, symmetric: bool = False) -> DataFrame:
    """df with the feature scaled by its own range, then within each example; `<value>_midpoint` and `<value>_half_range` hold the example's level."""
    w = W.partitionBy(example)
    one = df.withColumn("__x", scale(F.col(value), F.lit(low), F.lit(high), symmetric))
    lo, hi = F.min("__x").over(w), F.max("__x").over(w)
    out = one.withColumns({"__lo": lo, "__hi": hi})
    return out.withColumns({f"{value}_midpoint": (F.col("__hi") + F.col("__lo")) / 2, f"{value}_half_range": (F.col("__hi") - F.col("__lo")) / 2, value: scale(F.col("__x"), F.col("__lo"), F.col("__hi"), symmetric)}).drop("__x", "__lo", "__hi")


def two_level_unscale(df: DataFrame, value: str, low: float, high: float, symmetric: bool = False) -> DataFrame:
    mid, half = F.col(f"{value}_midpoint"), F.col(f"{value}_half_range")
    inner = unscale(F.col(value), mid - half, mid + half, symmetric)
    return df.withColumn(value, unscale(inner, F.lit(low), F.lit(high), symmetric)).drop(f"{value}_midpoint", f"{value}_half_range")


def generation_flag(df: DataFrame, example: str, order: str, name: str = "flag") -> DataFrame:
    """df with a feature that is true on all steps but an example's last."""
    return df.withColumn(name, F.lead(F.lit(1)).over(W.partitionBy(example).orderBy(order)).isNotNull())


def pad(df: DataFrame, column: str, length: int, fill: Column | float = 0.0) -> DataFrame:
    """Arrays extended to the given length; a longer one raises."""
    c = F.col(column)
    value = fill if isinstance(fill, Column) else F.lit(fill)
    longer = F.raise_error(F.lit(f"a sequence is longer than {length}"))
    return df.withColumn(column, F.when(F.size(c) > length, longer).otherwise(F.concat(c, F.array_repeat(value, F.lit(length) - F.size(c)))))


def autosplit(df: DataFrame, order: str, length: int, time: str | None = None) -> DataFrame:
    """Fixed windows: rows by `order` cut to a multiple of length, then by time; `example_id` counts windows.

    Numbered in two steps, within ranges of the order key and by the ranges' sizes, so no task sees all rows."""
    n = df.count()
    kept = numbered(df, order, "__rn").where(F.col("__rn") < n // length * length).drop("__rn") if n % length else df
    ranked = numbered(kept, [time, order] if time else [order], "__rn")
    return ranked.withColumn("example_id", F.floor(F.col("__rn") / length).cast("long")).drop("__rn")


def comparable(c: Column, kind: T.DataType) -> Column:
    """A key in the same order, in types whose values come back from Python as they went, whatever the time zones."""
    if isinstance(kind, T.StructType):
        return F.struct(*[comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) if isinstance(kind, T.TimestampNTZType) else c


def literal(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with `__part`: ranges in the total order of the keys.

    The bounds are constants of the plan, so a row's range is the same wherever the plan is run; Spark's own ranges are drawn
    anew for each exchange and merged by its size, and two branches of a plan number different ones. The bounds come from a
    few keys of each range, chosen by hash, and only balance the ranges: whatever they are, every row has its right place."""
    key = comparable(F.struct(*keys), df.select(*keys).schema)
    parts = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = df.select(key.alias("key")).withColumn("draw", F.xxhash64("key", F.monotonically_increasing_id())).orderBy("draw").limit(parts * RANGE_DRAWS)
    kind = drawn.schema["key"].dataType
    rows = drawn.orderBy("key").collect()
    share = (max(r.draw for r in rows) + 2**63 + 1) / 2**64 if len(rows) == parts * RANGE_DRAWS else 1  # of the rows, that was drawn
    parts = min(parts, 1 + int(len(rows) / share / RANGE_ROWS))
    bounds = [literal(rows[len(rows) * i // parts].key, kind) for i in range(1, parts)]

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return df.withColumn("__part", place(0, len(bounds)))


def numbered(df: DataFrame, order: str | Sequence[str], name: str) -> DataFrame:
    """df with row numbers from 0 in the total order of the keys: ranges, numbered inside, shifted by those before."""
    keys = [order] if isinstance(order, str) else list(order)
    ranged = in_ranges(df, keys)
    inner = ranged.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(*keys)) - 1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inner.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")


def running_sums(df: DataFrame, order: str | Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each expression up to and with each row in the total order, by ranges like numbered."""
    keys = [order] if isinstance(order, str) else list(order)
    ranged = in_ranges(df.withColumns({f"__x_{n}": c for n, c in sums.items()}), keys)
    w = W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    inner = ranged.withColumns({f"__s_{n}": F.sum(f"__x_{n}").over(w) for n in sums})
    totals = ranged.groupBy("__part").agg(*[F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    out = inner.join(F.broadcast(before), "__part")  # a row a partition
    return out.withColumns({n: F.col(f"__s_{n}") + F.col(f"__b_{n}") for n in sums}).drop("__part", *[f"__{k}_{n}" for n in sums for k in "xsb"])


def check_lengths(df: DataFrame, example: str, most: int) -> DataFrame:
    """One row: longest, shortest, examples, variable; an example longer than `most` is an error."""
    facts = df.groupBy(example).agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"), F.min("n").alias("shortest"), F.count("*").alias("examples"))
    row = facts.first()
    if row["longest"] is not None and row["longest"] > most:
        raise DataError(f"an example has {row['longest']} steps; at most {most} are allowed")
    return facts.withColumn("variable", F.col("shortest") < F.lit(most))


def attribute_constancy(df: DataFrame, example: str, attributes: Sequence[str]) -> DataFrame:
    """(attribute, broken): examples in which an attribute has more than one value; a mix with missing is one more, all missing is not."""
    counts = df.groupBy(example).agg(*[F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit("\0missing"))).alias(a) for a in attributes])
    broken = counts.agg(*[F.coalesce(F.sum((F.col(a) > 1).cast("long")), F.lit(0)).alias(a) for a in attributes])
    return broken.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("broken")) for a in attributes])))


def cycle_times(df: DataFrame, times: Sequence[str], position: str = "pos", name: str = "time") -> DataFrame:
    """Time values in turn by position."""
    values = F.array(*[F.lit(t) for t in times])
    return df.withColumn(name, F.element_at(values, (F.col(position) % len(times) + 1).cast("int")))


def discrete_difference(df: DataFrame, example: str, order: str, value: str, name: str = "difference") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(W.partitionBy(example).orderBy(order)))


def check_columns(columns: Sequence[str], example: str | None, time: str | None, attributes: Sequence[str], features: Sequence[str], discrete: Sequence[str] = ()) -> None:
    """Raises where the roles of columns contradict each other."""
    if example is not None and example == time:
        raise ParameterError("example id and time are the same column")
    for name, role in ((example, "example id"), (time, "time")):
        if name is not None and (name in attributes or name in features):
            raise ParameterError(f"the {role} column is also an attribute or a feature")
    if both := set(attributes) & set(features):
        raise ParameterError(f"both attribute and feature: {sorted(both)}")
    if unknown := {*attributes, *features, *discrete, *([example] if example else []), *([time] if time else [])} - set(columns):
        raise ParameterError(f"no such columns: {sorted(unknown)}")
