"""Reversible encoders of columns, fitted to small dictionaries or limits, and encoded rows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabloom.errors import DataError, ParameterError
from tabloom.functions import expressions as X

#: From this number of distinct values on a discrete column is coded in bits.
BINARY_FROM = 500
#: Digits tried when learning rounding; bound of a normalised value; width of a component.
MOST_DIGITS, NORMAL_BOUND, COMPONENT_WIDTH = 14, 0.99, 4.0


def dictionary(df: DataFrame, name: str, order: str) -> DataFrame:
    """(value, ordinal): values by first appearance along `order`, from 0; missing is a value of its own."""
    first = df.groupBy(X.category(X.scrub(df, name)).alias("value")).agg(F.min(order).alias("first"))
    return first.select("value", (F.row_number().over(W.orderBy("first", "value")) - 1).alias("ordinal"))


def with_ordinal(df: DataFrame, name: str, codes: DataFrame, out: str = "ordinal") -> DataFrame:
    """df with the ordinal of a column's value; null for a value outside the dictionary."""
    lookup = codes.select(F.col("value").alias("__value"), F.col("ordinal").alias(out))
    return df.withColumn("__key", X.category(X.scrub(df, name))).join(lookup, F.col("__key") == F.col("__value"), "left").drop("__key", "__value")


class ColumnCodec(ABC):
    """fit learns from a table; encode and decode are column expressions or joins on what was learned."""

    column: str

    @abstractmethod
    def fit(self, df: DataFrame, order: str) -> ColumnCodec: ...

    @abstractmethod
    def encode(self, df: DataFrame) -> DataFrame:
        """df with the column replaced by an array of numbers."""

    @abstractmethod
    def decode(self, df: DataFrame) -> DataFrame:
        """df with the array replaced by values."""


@dataclass
class OneHotCodec(ColumnCodec):
    column: str
    codes: DataFrame | None = None
    size: int = 0

    def fit(self, df: DataFrame, order: str) -> OneHotCodec:
        self.codes = dictionary(df, self.column, order)
        self.size = self.codes.count()
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return with_ordinal(df, self.column, self.codes, "__o").withColumn(self.column, X.one_hot(F.col("__o"), self.size)).drop("__o")

    def decode(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__o", X.one_hot_decode(F.col(self.column)))
        return out.join(self.codes.select("value", F.col("ordinal").alias("__o")), "__o", "left").withColumn(self.column, F.nullif("value", F.lit(X.MISSING))).drop("__o", "value").select(*df.columns)


@dataclass
class BinaryCodec(ColumnCodec):
    """Ordinals from 1 in bits; an unknown code decodes to the most frequent value, or to missing."""

    column: str
    unknown_to_mode: bool = True
    codes: DataFrame | None = None
    bits: int = 0
    mode: str | None = None

    def fit(self, df: DataFrame, order: str) -> BinaryCodec:
        self.codes = dictionary(df, self.column, order).withColumn("ordinal", F.col("ordinal") + 1)
        self.bits = X.bits_for(self.codes.count())
        top = df.groupBy(X.category(X.scrub(df, self.column)).alias("value")).count().orderBy(F.desc("count"), "value").first()
        self.mode = top["value"] if top else None
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return with_ordinal(df, self.column, self.codes, "__o").withColumn(self.column, X.binary(F.col("__o"), self.bits)).drop("__o")

    def decode(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__o", X.binary_decode(X.above_half(F.col(self.column))))
        value = F.coalesce("value", F.lit(self.mode)) if self.unknown_to_mode else F.col("value")
        return out.join(self.codes.select("value", F.col("ordinal").alias("__o")), "__o", "left").withColumn(self.column, F.nullif(value, F.lit(X.MISSING))).drop("__o", "value").select(*df.columns)


@dataclass
class FloatCodec(ColumnCodec):
    """Numbers as one-entry arrays; back: clipped to the range seen, rounded to the digits seen, cast to the type seen."""

    column: str
    low: float | None = None
    high: float | None = None
    digits: int | None = None
    kind: T.DataType = field(default_factory=T.DoubleType)

    def fit(self, df: DataFrame, order: str = "") -> FloatCodec:
        row = df.agg(F.min(X.scrub(df, self.column).cast("double")).alias("low"), F.max(X.scrub(df, self.column).cast("double")).alias("high"), rounding_digits(X.scrub(df, self.column)).alias("digits")).first()
        self.low, self.high, self.digits, self.kind = row["low"], row["high"], row["digits"], df.schema[self.column].dataType
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.array(X.scrub(df, self.column).cast("double")))

    def decode(self, df: DataFrame) -> DataFrame:
        v = F.col(self.column)[0]
        if self.low is not None:
            v = F.when(v.isNotNull(), X.clip(v, self.low, self.high))
        if self.digits is not None:
            v = X.round_half_even(v, self.digits)
        return df.withColumn(self.column, v.cast(self.kind))


@dataclass
class EmptyCodec(ColumnCodec):
    """A column without values: 0 forth, missing back."""

    column: str
    kind: T.DataType = field(default_factory=T.DoubleType)

    def fit(self, df: DataFrame, order: str = "") -> EmptyCodec:
        self.kind = df.schema[self.column].dataType
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.array(F.lit(0.0)))

    def decode(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.lit(None).cast(self.kind))


@dataclass
class DatetimeCodec(ColumnCodec):
    """Timestamps as unix microseconds and a missing flag; missing becomes the mean."""

    column: str
    mean: float | None = None

    def fit(self, df: DataFrame, order: str = "") -> DatetimeCodec:
        self.mean = df.agg(F.avg(F.unix_micros(F.col(self.column).cast("timestamp")))).first()[0]
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        ts = F.col(self.column).cast("timestamp")
        return df.withColumn(self.column, F.array(F.coalesce(F.unix_micros(ts).cast("double"), F.lit(self.mean)), ts.isNull().cast("double")))

    def decode(self, df: DataFrame) -> DataFrame:
        v = F.col(self.column)
        return df.withColumn(self.column, F.when(v[1] <= 0.5, F.timestamp_micros(v[0].cast("bigint"))))


@dataclass
class FrequencyCodec(ColumnCodec):
    """Each value as the midpoint of its share of [0, 1], most frequent first."""

    column: str
    codes: DataFrame | None = None

    def fit(self, df: DataFrame, order: str = "") -> FrequencyCodec:
        counts = df.groupBy(X.category(X.scrub(df, self.column)).alias("value")).agg(F.count("*").alias("n"))
        w = W.orderBy(F.desc("n"), "value")
        upto, all_n = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum("n").over(W.partitionBy())
        self.codes = counts.select("value", ((upto - F.col("n")) / all_n).alias("low"), (upto / all_n).alias("high"))
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__key", X.category(X.scrub(df, self.column))).join(self.codes, F.col("__key") == F.col("value"), "left")
        return out.withColumn(self.column, F.array((F.col("low") + F.col("high")) / 2)).select(*df.columns)

    def decode(self, df: DataFrame) -> DataFrame:
        v = F.col("__v")
        out = df.withColumn("__v", X.clip(F.col(self.column)[0], 0.0, 1 - 1e-12)).join(self.codes, (v >= F.col("low")) & (v < F.col("high")), "left")
        return out.withColumn(self.column, F.nullif("value", F.lit(X.MISSING))).select(*df.columns)


@dataclass
class MixtureCodec(ColumnCodec):
    """A number as its place in one component of a fitted normal mixture: [normalised value, component one-hot].

    The component is drawn from the posterior with the given seed. Fitted on at most `sample` rows; expectation
    maximisation with components under the least weight dropped."""

    column: str
    components: int = 10
    least_weight: float = 0.005
    sample: int = 250_000
    seed: int = 0
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, order: str = "") -> MixtureCodec:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.feature import VectorAssembler

        x = df.select(X.scrub(df, self.column).cast("double").alias("x")).where("x is not null")
        n = x.count()
        if not n:
            raise DataError(f"column {self.column} has no values")
        share = min(1.0, self.sample / n)
        rows = x if share == 1 else x.sample(share, self.seed)
        m, s = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
        rows = rows.select(((F.col("x") - m) / (s or 1.0)).alias("x"))
        k = min(self.components, max(1, rows.distinct().limit(self.components).count()))
        model = GaussianMixture(k=k, seed=self.seed).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
        found = [(w, float(g.mean[0]) * (s or 1.0) + m, max(float(g.cov.toArray()[0, 0]) ** 0.5, 1e-6) * (s or 1.0)) for w, g in zip(model.weights, model.gaussians, strict=True) if w > self.least_weight]
        self.weights, self.means, self.deviations = (list(v) for v in zip(*found, strict=True))
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        x = X.scrub(df, self.column).cast("double")
        density = [F.lit(w / d) * F.exp(-0.5 * ((x - m) / d) * ((x - m) / d)) + 1e-6 for w, m, d in zip(self.weights, self.means, self.deviations, strict=True)]
        out = df.withColumn("__p", F.array(*density)).withColumn("__r", F.rand(self.seed) * F.aggregate("__p", F.lit(0.0), lambda s, v: s + v))
        run = F.lit(0.0)
        pick = F.lit(len(self.means) - 1)
        sums = []
        for i in range(len(self.means)):
            run = run + F.col("__p")[i]
            sums.append(run)
        for i in reversed(range(len(self.means) - 1)):
            pick = F.when(F.col("__r") < sums[i], i).otherwise(pick)
        out = out.withColumn("__k", pick)
        at = F.element_at(F.array(*map(F.lit, self.means)), F.col("__k") + 1), F.element_at(F.array(*map(F.lit, self.deviations)), F.col("__k") + 1)
        value = X.clip((x - at[0]) / (COMPONENT_WIDTH * at[1]), -NORMAL_BOUND, NORMAL_BOUND)
        vector = F.concat(F.array(value), F.transform(X.one_hot(F.col("__k"), len(self.means)), lambda b: b.cast("double")))
        return out.withColumn(self.column, vector).drop("__p", "__r", "__k")

    def decode(self, df: DataFrame) -> DataFrame:
        v = F.col(self.column)
        k = X.one_hot_decode(F.slice(v, 2, len(self.means))) + 1
        mean, dev = F.element_at(F.array(*map(F.lit, self.means)), k), F.element_at(F.array(*map(F.lit, self.deviations)), k)
        return df.withColumn(self.column, v[0] * COMPONENT_WIDTH * dev + mean)


def rounding_digits(c: Column) -> Column:
    """Aggregate: fewest digits after the point that keep every present value; null where none do."""
    x = c.cast("double")
    checks = [F.bool_and(F.coalesce(x == F.bround(x, d), F.lit(True))) for d in range(MOST_DIGITS + 1)]
    out = F.lit(None).cast("int")
    for d in reversed(range(MOST_DIGITS + 1)):
        out = F.when(checks[d], d).otherwise(out)
    return out


def binary_valued(c: Column) -> Column:
    """Aggregate: whether every present value is 0 or 1."""
    return F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(False))


def discrete_columns(df: DataFrame) -> list[str]:
    """Columns to code as categories: text, booleans, and numbers that are all 0 or 1."""
    numbers = [f.name for f in df.schema.fields if X.is_numeric(f.dataType)]
    flags = df.agg(*[binary_valued(X.scrub(df, c)).alias(f"b{i}") for i, c in enumerate(numbers)]).first() if numbers else {}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType)) or f.name in numbers and flags[f"b{numbers.index(f.name)}"]]


#: Codec names accepted for a column.
CODECS = {"one_hot": OneHotCodec, "binary": BinaryCodec, "float": FloatCodec, "empty": EmptyCodec, "datetime": DatetimeCodec, "frequency": FrequencyCodec, "mixture": MixtureCodec}


@dataclass
class TableCodec:
    """Codecs of all columns: the user's choice first, then what the data asks for."""

    order: str
    binary_from: int = BINARY_FROM
    chosen: dict[str, str] = field(default_factory=dict)
    continuous: str = "mixture"
    codecs: list[ColumnCodec] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> TableCodec:
        names = list(columns or df.columns)
        facts = df.agg(*[F.count_distinct(X.category(X.scrub(df, c))).alias(f"d{i}") for i, c in enumerate(names)], *[F.count(X.scrub(df, c)).alias(f"p{i}") for i, c in enumerate(names)]).first()
        discrete = discrete_columns(df.select(*names))
        for i, c in enumerate(names):
            kind = self.chosen.get(c)
            if kind is None:
                if not facts[f"p{i}"]:
                    kind = "empty"
                elif isinstance(df.schema[c].dataType, (T.TimestampType, T.DateType)):
                    kind = "datetime"
                elif c in discrete:
                    kind = "binary" if facts[f"d{i}"] >= self.binary_from else "one_hot"
                else:
                    kind = self.continuous
            if kind not in CODECS:
                raise ParameterError(f"unknown codec {kind}")
            self.codecs.append(CODECS[kind](c).fit(df, self.order))
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        for c in self.codecs:
            df = c.encode(df)
        return df

    def decode(self, df: DataFrame) -> DataFrame:
        for c in self.codecs:
            df = c.decode(df)
        return df

    def row_vector(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        """The arrays of all columns as one."""
        return df.withColumn(name, F.concat(*[F.transform(F.col(c.column), lambda x: x.cast("double")) for c in self.codecs]))
