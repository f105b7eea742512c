"""Data-quality statistics: missing values, distributions, distances, mixed-type correlation, normalisation, PCA."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabloom.functions.expressions import category, is_numeric, scrub, scrubbed

#: Distance where one side has no mass; most bins; share of distinct values above which a column counts as high-unique.
EMPTY_DISTANCE, MOST_BINS, HIGH_UNIQUE = 0.5887, 500, 0.1
#: Aggregates in one agg(): wide tables are done in several.
CHUNK = 200


def total(columns: Iterable[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out + c
    return out


def count_missing(df: DataFrame) -> DataFrame:
    """One row: missing cells of all columns (null, NaN, infinities)."""
    return df.agg(F.coalesce(total(F.sum(scrub(df, n).isNull().cast("long")) for n in df.columns), F.lit(0)).cast("long").alias("missing"))


def categorical_distribution(df: DataFrame, name: str) -> DataFrame:
    """(key, share): text of each value and its percentage of all rows; missing is a key."""
    counts = df.groupBy(category(scrub(df, name)).alias("key")).agg(F.count("*").alias("n"))
    return counts.select("key", (F.col("n") * 100.0 / df.agg(F.count("*")).scalar()).alias("share"))


def doane_bins(n: Column, low: Column, high: Column, skew: Column) -> Column:
    """Number of bins by Doane's rule; 1 for constant or nearly empty data; the maximum where it exceeds it."""
    spread = F.sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3)))
    width = (high - low) / (1 + F.log2(n.cast("double")) + F.log2(1 + F.abs(skew) / spread))
    return F.when((n <= 2) | (high == low) | skew.isNull(), 1).when(F.ceil((high - low) / width) + 1 > MOST_BINS, MOST_BINS).otherwise(F.ceil((high - low) / width)).cast("int")


def shared_bins(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """One row for both sides together: n_values, low, high, bins."""
    both = a.select(scrub(a, name).cast("double").alias("x")).unionAll(b.select(scrub(b, name).cast("double").alias("x")))
    one = both.agg(F.count("x").alias("n_values"), F.min("x").alias("low"), F.max("x").alias("high"), F.skewness("x").alias("skew"))
    return one.select("n_values", "low", "high", doane_bins(F.col("n_values"), F.col("low"), F.col("high"), F.nanvl("skew", F.lit(None))).alias("bins"))


def binned_distribution(df: DataFrame, name: str, bins: DataFrame) -> DataFrame:
    """(bin, mass): right-closed bins from 1, and their share of all rows, missing ones included in the total.

    bins is the single row of shared_bins, attached as one scalar subquery."""
    edge = bins.select(F.struct("low", "high", "bins").alias("e")).scalar()
    rows = df.select(scrub(df, name).cast("double").alias("x"), edge.alias("e")).select("x", "e.low", "e.high", "e.bins")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    at = F.when(F.col("x").isNull(), None).when(width == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("bins"), F.ceil((F.col("x") - F.col("low")) / width))))
    counts = rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("n") / df.agg(F.count("*")).scalar()).alias("mass")).where("bin is not null")


def js_distance(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row, distance: base-2 Jensen-Shannon distance of two (key, mass) frames; keys absent on a side have no mass."""
    a, b = p.toDF("k", "p"), q.toDF("k", "q")
    both = a.join(b, a["k"].eqNullSafe(b["k"]), "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    mass = both.agg(F.struct(F.sum("p").alias("p"), F.sum("q").alias("q")).alias("s")).scalar()
    # the masses of both sides are one row; every key adds its term where it is, and the terms are summed up
    rows = both.withColumn("s", mass)
    x, y = F.col("p") / F.col("s.p"), F.col("q") / F.col("s.q")
    part = lambda v: F.when(v > 0, v * F.log2(v / ((x + y) / 2))).otherwise(0.0)
    usable = (F.col("s.p") > 0) & (F.col("s.q") > 0) & ~F.isnan("s.p") & ~F.isnan("s.q")
    sums = rows.agg(F.count("*").alias("keys"), F.bool_and(usable).alias("usable"), F.sum(F.when(usable, (part(x) + part(y)) / 2)).alias("t"))
    return sums.select(F.when(F.col("keys") == 0, 0.0).when(~F.col("usable"), EMPTY_DISTANCE).otherwise(F.sqrt(F.greatest("t", F.lit(0.0)))).alias("distance"))


def column_distance(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """One row (column, kind, distance) for a column of two tables: numeric in shared bins, others by value."""
    if is_numeric(a.schema[name].dataType) and is_numeric(b.schema[name].dataType):
        bins = shared_bins(a, b, name)
        kind, one = "numeric", js_distance(binned_distribution(a, name, bins), binned_distribution(b, name, bins))
    else:
        kind, one = "categorical", js_distance(categorical_distribution(a, name), categorical_distribution(b, name))
    return one.select(F.lit(name).alias("column"), F.lit(kind).alias("kind"), "distance")


def distances(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, kind, distance) of every column of two tables, in two passes whatever the number of columns: one for the
    shared bins of all numeric columns, one that counts all columns' values on both sides."""
    numbers = [c for c in names if is_numeric(a.schema[c].dataType) and is_numeric(b.schema[c].dataType)]
    cast = lambda d, c: scrub(d, c).cast("double") if c in numbers else category(scrub(d, c))
    sides = [d.select(*[cast(d, c).alias(f"v{i}") for i, c in enumerate(names)], F.lit(side).alias("side")) for side, d in enumerate((a, b))]
    both = sides[0].unionByName(sides[1])
    place = {c: names.index(c) for c in numbers}
    bins: dict[str, tuple] = {}
    for at in range(0, len(numbers), CHUNK // 4):
        part = numbers[at : at + CHUNK // 4]
        facts = both.agg(*[f(f"v{place[c]}").alias(f"{n}{place[c]}") for c in part for n, f in (("n", F.count), ("l", F.min), ("h", F.max), ("s", F.skewness))])
        row = facts.select(*[F.struct(f"l{i}", f"h{i}", doane_bins(F.col(f"n{i}"), F.col(f"l{i}"), F.col(f"h{i}"), F.nanvl(f"s{i}", F.lit(None)))).alias(c) for c in part for i in (place[c],)]).first()
        bins |= {c: tuple(row[c]) for c in part}

    def key(i: int, c: str) -> Column:
        if c not in bins:
            return F.col(f"v{i}")
        low, high, k = bins[c]
        if low is None or high == low:
            return F.when(F.col(f"v{i}").isNotNull(), F.lit("1"))
        return F.greatest(F.lit(1), F.least(F.lit(k), F.ceil((F.col(f"v{i}") - low) / ((high - low) / k)))).cast("string")

    cells = F.array(*[F.struct(F.lit(i).alias("i"), key(i, c).alias("key")) for i, c in enumerate(names)])
    counts = both.select("side", F.inline(cells)).where("key is not null").groupBy("i", "key").agg(F.sum(1 - F.col("side")).alias("p"), F.sum("side").alias("q"))
    sums = counts.groupBy("i").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    x, y = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    part = lambda v: F.when(v > 0, v * F.log2(v / ((x + y) / 2))).otherwise(0.0)
    terms = counts.join(F.broadcast(sums), "i").groupBy("i").agg(F.sum(F.when((F.col("sp") > 0) & (F.col("sq") > 0), (part(x) + part(y)) / 2)).alias("t"), F.min(F.least("sp", "sq")).alias("least"))
    listed = both.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit("numeric" if c in bins else "categorical").alias("kind")) for i, c in enumerate(names)])))
    value = F.when(F.col("least").isNull(), 0.0).when(F.col("least") == 0, EMPTY_DISTANCE).otherwise(F.sqrt(F.greatest(F.col("t"), F.lit(0.0))))
    return listed.join(F.broadcast(terms), "i", "left").select("column", "kind", value.alias("distance"))


def pearson_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(row_col, col_col, value) of all pairs, from one pass; pairs without variance or rows are 0."""
    pairs = list(combinations(names, 2))
    # every column is scrubbed once, below the aggregation
    place = {c: f"v{i}" for i, c in enumerate(names)}
    exprs = [F.coalesce(F.nanvl(F.corr(place[a], place[b]), F.lit(0.0)), F.lit(0.0)) for a, b in pairs]
    if not pairs:
        return df.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "row_col string, col_col string, value double")
    rows = F.array(*[F.struct(F.lit(a).alias("row_col"), F.lit(b).alias("col_col"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs)], *[F.struct(F.lit(b).alias("row_col"), F.lit(a).alias("col_col"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs)], *[F.struct(F.lit(n).alias("row_col"), F.lit(n).alias("col_col"), F.lit(1.0).alias("value")) for n in names])
    return df.select(*[scrub(df, c).cast("double").alias(v) for c, v in place.items()]).agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).select(F.inline(rows))


def correlation_ratio(df: DataFrame, cat: str, num: str) -> DataFrame:
    """One row, value: eta of a numeric column by a categorical one; rows with a missing side are left out."""
    rows = df.select(scrub(df, cat).alias("x"), scrub(df, num).cast("double").alias("y")).where("x is not null and y is not null")
    groups = rows.groupBy("x").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("inner"))
    sums = groups.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("inner").alias("inner"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    between = F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return sums.select(F.when((F.coalesce("n", F.lit(0)) < 2) | (between + F.col("inner") <= 0), 0.0).otherwise(F.sqrt(between / (between + F.col("inner")))).alias("value"))


def _entropies(counts: DataFrame) -> DataFrame:
    """(pair, value) with U(x given y) from (pair, x, y, n)."""
    sx, sy, n = (F.sum("n").over(W.partitionBy(*k)) for k in (("pair", "x"), ("pair", "y"), ("pair",)))
    rows = counts.select("pair", "x", "y", "n", sx.alias("nx"), sy.alias("ny"), n.alias("all"))
    # H(x) summed over cells: each cell carries its share of -p(x) ln p(x)
    hx = -F.sum(F.col("n") / F.col("all") * F.ln(F.col("nx") / F.col("all")))
    hxy = -F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") / F.col("ny")))
    u = rows.groupBy("pair").agg(hx.alias("hx"), hxy.alias("hxy"), F.max("nx").alias("top"), F.max("all").alias("all"))
    return u.select("pair", F.when(F.col("top") == F.col("all"), 1.0).otherwise((F.col("hx") - F.col("hxy")) / F.col("hx")).alias("value"))


def theils_u(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, value): U(x given y) of every pair, all pairs in one aggregation; pairs without rows are 0."""
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), scrub(df, a).cast("string").alias("x"), scrub(df, b).cast("string").alias("y")) for i, (a, b) in enumerate(pairs)])
    counts = df.select(F.inline(cells)).where("x is not null and y is not null").groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("x"), F.lit(b).alias("y")) for i, (a, b) in enumerate(pairs)])
    listed = df.sparkSession.range(1).select(F.inline(names))
    return listed.join(F.broadcast(_entropies(counts)), "pair", "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def profile(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, dict]:
    """n, present, distinct, low, high of each column (driver metadata, one row per chunk of columns)."""
    names = list(names or df.columns)
    out: dict[str, dict] = {}
    for at in range(0, len(names), CHUNK // 2):
        part = names[at : at + CHUNK // 2]
        row = df.agg(F.count("*").alias("n"), *[F.count(scrub(df, c)).alias(f"p{i}") for i, c in enumerate(part)], *[F.count_distinct(scrub(df, c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            out[c] = {"n": row["n"], "present": row[f"p{i}"], "distinct": row[f"d{i}"]}
    return out


def uniqueness(df: DataFrame) -> DataFrame:
    """(column, n_distinct, ratio) of every column; missing values are not counted as a value."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_distinct(scrub(df, c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"), F.try_divide(F.col(f"d{i}"), F.col("n")).alias("ratio")) for i, c in enumerate(df.columns)])
    return counts.select(F.inline(rows))


def correlation_matrix(df: DataFrame, nominal: Sequence[str] = (), fill_zero: bool = False) -> DataFrame:
    """(row_col, col_col, value) of all pairs of columns of mixed types.

    Later rules overwrite earlier ones: unique columns (row 1, column log ratio), constant columns (0), Theil's U of nominal
    pairs (asymmetric), eta of other nominal and numeric columns (symmetric), U for high-unique nominal columns (one
    direction only), Pearson of numeric pairs. Three aggregations whatever the number of columns; the caller's frame is
    never changed.
    """
    df = scrubbed(df)
    names = df.columns
    if fill_zero:
        df = df.na.fill(0)
    nominal = [c for c in names if c in set(nominal)]
    first = profile(df)
    rows = first[names[0]]["n"] if names else 0
    proxied = {c: first[c]["distinct"] + (c in nominal and first[c]["present"] < rows) for c in names}
    single = [c for c in names if proxied[c] == 1]
    texts = [c for c in names if c not in single and c not in nominal and not is_numeric(df.schema[c].dataType)]
    for c in texts:
        proxied[c] += first[c]["present"] < rows
    nominal += texts
    nominal = [c for c in nominal if c not in single]
    numeric = [c for c in names if c not in single and c not in nominal]
    df = df.select(*[(category(F.col(f"`{c}`")) if c in nominal else F.col(f"`{c}`")).alias(c) for c in names])
    ratio = {c: proxied[c] / rows if rows else 0.0 for c in names}
    unique = [c for c in names if ratio[c] == 1]
    high = [c for c in nominal if HIGH_UNIQUE < ratio[c] < 1]
    low = [c for c in nominal if ratio[c] <= HIGH_UNIQUE]
    cell = {(a, b): 0.0 for a in names for b in names}
    for x in unique:
        for y in names:
            cell[x, y] = 1.0
            cell[y, x] = math.log(proxied[y]) / math.log(proxied[x]) if proxied[y] and proxied[x] > 1 else 0.0
        cell[x, x] = 1.0
    for x in single:
        for y in names:
            cell[x, y] = cell[y, x] = 0.0
        cell[x, x] = 1.0
    plain = [c for c in nominal if c not in unique]
    asked = [(a, b) for a in plain for b in plain if a != b] + [(c, y) for c in high for y in numeric]
    if asked:
        for r in theils_u(df, asked).collect():  # one row a pair of columns
            cell[(r["y"], r["x"])] = r["value"]
    for c in nominal + numeric:
        cell[c, c] = 1.0
    etas = [(c, y) for c in low if c not in unique for y in numeric]
    if etas:
        for r in eta_pairs(df, etas).collect():
            cell[r["x"], r["y"]] = cell[r["y"], r["x"]] = r["value"]
    if len(numeric) > 1:
        for r in pearson_matrix(df, numeric).collect():
            cell[r["row_col"], r["col_col"]] = r["value"]
    return df.sparkSession.createDataFrame([(a, b, float(v)) for (a, b), v in cell.items()], "row_col string, col_col string, value double")


def eta_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, value): correlation ratio of every (categorical, numeric) pair, in one aggregation."""
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    groups = df.select(F.inline(cells)).where("x is not null and y is not null").groupBy("pair", "x").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("inner"))
    sums = groups.groupBy("pair").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("inner").alias("inner"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    between = F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    value = F.when((F.col("n") < 2) | (between + F.col("inner") <= 0), 0.0).otherwise(F.sqrt(between / (between + F.col("inner"))))
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("x"), F.lit(b).alias("y")) for i, (a, b) in enumerate(pairs)])
    return df.sparkSession.range(1).select(F.inline(names)).join(F.broadcast(sums.select("pair", value.alias("value"))), "pair", "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def normalise(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns: median for missing; others: each value's number of rows. All to mean 0 and deviation 1."""
    df = scrubbed(df)
    names = [c for c in df.columns if c not in keep]
    numbers = [c for c in names if is_numeric(df.schema[c].dataType)]
    # one join a nominal column on its small table of counts, no window over all rows
    out = df
    for i, c in enumerate(c for c in names if c not in numbers):
        counts = df.groupBy(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Missing")).alias(f"__k{i}")).agg(F.count("*").cast("double").alias(f"__n{i}"))
        out = out.withColumn(f"__k{i}", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Missing"))).join(counts, f"__k{i}").withColumn(c, F.col(f"__n{i}")).drop(f"__k{i}", f"__n{i}")
    if numbers:
        medians = df.agg(*[F.median(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        out = out.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[f"m{numbers.index(c)}"])).alias(c) if c in numbers else F.col(f"`{c}`") for c in out.columns])
    facts = out.agg(*[F.avg(f"`{c}`").alias(f"a{i}") for i, c in enumerate(names)], *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(names)]).first()

    def unit(i: int, c: str) -> Column:
        s = facts[f"s{i}"]
        return ((F.col(f"`{c}`") - F.lit(facts[f"a{i}"])) / F.lit(s if s else 1.0)).alias(c)

    return out.select(*[F.col(f"`{c}`") for c in keep], *[unit(i, c) for i, c in enumerate(names)])


def pca(df: DataFrame, k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Columns pc1..pck of the normalised table; each component's largest loading is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    present = df.agg(*[F.count(scrub(df, c)).alias(c) for c in df.columns]).first()
    df = df.select(*[c for c in df.columns if present[c] or c in keep])
    flat = normalise(df, keep)
    inputs = [c for c in flat.columns if c not in keep]
    rows = VectorAssembler(inputCols=inputs, outputCol="__v").transform(flat)
    model = PCA(k=min(k, len(inputs)), inputCol="__v", outputCol="__pc").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    v = vector_to_array("__pc")
    return model.transform(rows).select(*keep, *[(v[j] * s).alias(f"pc{j + 1}") for j, s in enumerate(signs)])


def modes(df: DataFrame, name: str) -> DataFrame:
    """(value, n) of all most frequent values, missing included."""
    counts = df.groupBy(F.col(f"`{name}`").alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select("value", "n")


def schema_kinds(df: DataFrame) -> dict[str, str]:
    """Column to numeric, boolean, datetime or categorical, by type."""
    out = {}
    for f in df.schema.fields:
        k = f.dataType
        out[f.name] = "boolean" if isinstance(k, T.BooleanType) else "numeric" if is_numeric(k) else "datetime" if isinstance(k, (T.TimestampType, T.DateType)) else "categorical"
    return out
