"""Pluggable synthesizers behind one contract, with defaults that need nothing but Spark and NumPy.

These are other models than neural ones behind the same data contract: a Gaussian copula for tables, a bootstrap with
autoregressive noise for sequences, character n-grams for text.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabloom.errors import GenerationError, ParameterError
from tabloom.functions.expressions import category, is_numeric, scrub
from tabloom.operators.sampling import draw as draw_value
from tabloom.operators.sequences import min_max, numbered, positions, running_sums

#: Points of a fitted marginal distribution; a column with more categories than MANY keeps them all in a table of its own.
QUANTILES, MANY = 101, 1000
#: A constraint that leaves too few of this many times the wanted rows (and 10,000 more) is an error.
MOST_TIMES = 1000


class Synthesizer(ABC):
    @abstractmethod
    def fit(self, df: DataFrame) -> Synthesizer: ...

    @abstractmethod
    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame: ...


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the Abramowitz-Stegun polynomial (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * np.pi)) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def uniform(seed: int, *key: Column) -> Column:
    """A uniform number in (0, 1) that depends on the seed and the key only, not on partitions."""
    h = F.xxhash64(F.lit(seed), *key)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number of the seed and the key (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed, *key))) * F.cos(2 * np.pi * uniform(2 * seed + 1, *key))


@dataclass
class Marginal:
    """A column's distribution: quantiles of a number (with its share of missing), or categories with cumulative shares."""

    name: str
    kind: T.DataType
    quantiles: list[float] = field(default_factory=list)
    missing: float = 0.0
    values: list[str] = field(default_factory=list)
    upto: list[float] = field(default_factory=list)

    @property
    def number(self) -> bool:
        return bool(self.quantiles)

    def invert(self, u: Column, r: Column) -> Column:
        """Value at the uniform u; r decides whether it is missing."""
        if self.number:
            at = u * (len(self.quantiles) - 1)
            low = F.least(F.floor(at), F.lit(len(self.quantiles) - 2)).cast("int")
            q = F.array(*[F.lit(x) for x in self.quantiles])
            v = F.element_at(q, low + 1) + (at - low) * (F.element_at(q, low + 2) - F.element_at(q, low + 1))
            return F.when(r >= self.missing, v)
        steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(v).alias("v")) for h, v in zip(self.upto, self.values, strict=True)])
        return F.nullif(F.coalesce(F.get(F.filter(steps, lambda s: s["h"] > u), F.lit(0))["v"], F.lit(self.values[-1])), F.lit("nan"))


@dataclass
class CopulaSynthesizer(Synthesizer):
    """Marginals of each column, joined by the correlation of their normal scores.

    fields: the columns to learn (all). whole: numbers of integer columns come out whole by their type; digits: rounds fitted
    decimals to the most digits seen. Drawn numbers never leave the fitted range. A column with more than MANY categories is drawn from all of
    them by their frequency, independently of the others. Draws depend on the seed and the row only."""

    constraints: Sequence[str] = ()
    primary_key: str | None = None
    marginals: list[Marginal] = field(default_factory=list)
    correlation: np.ndarray | None = None
    fields: Sequence[str] = ()
    digits: bool = False
    large: dict[str, DataFrame] = field(default_factory=dict)
    scales: dict[str, int] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> CopulaSynthesizer:
        if missing := [c for c in self.fields if c not in df.columns]:
            raise ParameterError(f"no such columns: {missing}")
        names = [c for c in (self.fields or df.columns) if c != self.primary_key]
        numbers = [c for c in names if is_numeric(df.schema[c].dataType)]
        self.marginals, self.large, self.scales = [], {}, {}
        others = [c for c in names if c not in numbers]
        kinds = [F.count_distinct(category(scrub(df, c))).alias(f"d{i}") for i, c in enumerate(others)]
        decimals = [F.max(F.length(F.regexp_extract(F.format_string("%.12f", scrub(df, c).cast("double")), r"\.([0-9]*?)0*$", 1))).alias(f"s{i}") for i, c in enumerate(numbers)] if self.digits else []
        facts = df.agg(F.count("*").alias("n"), *kinds, *decimals, *[F.percentile_approx(scrub(df, c).cast("double"), [i / (QUANTILES - 1) for i in range(QUANTILES)], 10_000).alias(f"q{i}") for i, c in enumerate(numbers)], *[F.avg(scrub(df, c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        for c in names:
            if c in numbers and facts[f"q{numbers.index(c)}"]:
                i = numbers.index(c)
                self.marginals.append(Marginal(c, df.schema[c].dataType, [float(x) for x in facts[f"q{i}"]], facts[f"m{i}"]))
                if self.digits and facts[f"s{i}"] is not None:
                    self.scales[c] = facts[f"s{i}"]
            elif c in others and facts[f"d{others.index(c)}"] > MANY:
                self.marginals.append(Marginal(c, df.schema[c].dataType))
                self.large[c] = shares(df.select(category(scrub(df, c)).alias("value")))
            else:
                rows = df.groupBy(category(scrub(df, c)).alias("v")).count().collect()
                rows.sort(key=lambda r: r["v"])
                total = sum(r["count"] for r in rows) or 1
                self.marginals.append(Marginal(c, df.schema[c].dataType, values=[r["v"] for r in rows], upto=list(np.cumsum([r["count"] for r in rows]) / total)))
        scores = df.select(*[self._score(df, m).alias(f"z{i}") for i, m in enumerate(self.marginals)])
        k = len(self.marginals)
        pairs = scores.agg(*[F.coalesce(F.nanvl(F.corr(f"z{i}", f"z{j}"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}_{j}") for i in range(k) for j in range(i)] or [F.lit(0).alias("none")]).first()
        c = np.eye(k)
        for i in range(k):
            for j in range(i):
                c[i, j] = c[j, i] = pairs[f"c{i}_{j}"]
        w, v = np.linalg.eigh(c)
        c = v @ np.diag(np.maximum(w, 1e-6)) @ v.T
        d = np.sqrt(np.diag(c))
        self.correlation = c / d[:, None] / d[None, :]
        return self

    def range_of(self, name: str) -> tuple[float, float]:
        m = next(m for m in self.marginals if m.name == name)
        return m.quantiles[0], m.quantiles[-1]

    def _score(self, df: DataFrame, m: Marginal) -> Column:
        """Normal score of a value by its place in the fitted distribution."""
        ppf = NormalDist().inv_cdf
        if m.name in self.large:
            return F.lit(None).cast("double")
        if m.number:
            table = F.array(*[F.lit(ppf((i + 0.5) / QUANTILES)) for i in range(QUANTILES)])
            q = F.array(*[F.lit(x) for x in m.quantiles])
            place = F.aggregate(q, F.lit(0), lambda s, x: s + (x < scrub(df, m.name).cast("double")).cast("int"))
            return F.when(scrub(df, m.name).isNotNull(), F.element_at(table, F.greatest(F.lit(1), F.least(place + 1, F.lit(QUANTILES)))))
        low = [0.0, *m.upto[:-1]]
        middle = F.create_map(*[x for v, a, b in zip(m.values, low, m.upto, strict=True) for x in (F.lit(v), F.lit(ppf(min(max((a + b) / 2, 1e-6), 1 - 1e-6))))])
        return F.try_element_at(middle, category(scrub(df, m.name)))

    def draw(self, rows: DataFrame, id: str, given: Sequence[str], seed: int) -> DataFrame:
        """rows with all columns but the given ones drawn for each id, conditionally on the given ones: normal scores of the
        others follow the conditional distribution; a given cell that is missing or unknown to the model tells nothing."""
        known = [i for i, m in enumerate(self.marginals) if m.name in given]
        open_ = [i for i in range(len(self.marginals)) if i not in known]
        c, mean, spread = self.correlation, np.zeros((len(open_), 0)), self.correlation[np.ix_(open_, open_)]
        if known and open_:
            mean = c[np.ix_(open_, known)] @ np.linalg.inv(c[np.ix_(known, known)])
            spread = spread - mean @ c[np.ix_(known, open_)]
        chol = np.linalg.cholesky(spread + 1e-9 * np.eye(len(open_))) if open_ else np.zeros((0, 0))
        out = rows.withColumns({f"__z{i}": F.coalesce(self._score(rows, self.marginals[i]), F.lit(0.0)) for i in known})
        out = out.withColumns({f"__e{i}": normal(seed * 1000 + i, F.col(id)) for i in open_})
        uniforms = {}
        for r, i in enumerate(open_):
            z = F.lit(0.0)
            for q, j in enumerate(known):
                z = z + F.col(f"__z{j}") * float(mean[r, q])
            for q, j in enumerate(open_[: r + 1]):
                z = z + F.col(f"__e{j}") * float(chol[r, q])
            uniforms[f"__u{i}"] = normal_cdf(z)
        out = out.withColumns(uniforms)
        for i in open_:
            m = self.marginals[i]
            if m.name in self.large:
                out = draw_value(out, f"__u{i}", self.large[m.name]).withColumn(m.name, F.nullif(F.col("value"), F.lit("nan")).cast(m.kind)).drop("value")
            else:
                v = m.invert(F.col(f"__u{i}"), uniform(seed * 1000 + 500 + i, F.col(id)))
                out = out.withColumn(m.name, (F.round(v, self.scales[m.name]) if m.name in self.scales else v).cast(m.kind))
        return out.select(id, *[m.name for m in self.marginals])

    def sample(self, spark: SparkSession, n: int, seed: int = 0, conditions: Mapping[str, object] | None = None, force: bool = True, keep_id: bool = False) -> DataFrame:
        """n rows. Constraints are SQL predicates on the result, met by drawing more until n rows are left, or an error.

        conditions: values of some columns; the others are drawn given them. force: those columns are the values themselves,
        otherwise what the model makes of them."""
        if self.correlation is None:
            raise ParameterError("fit first")
        if conditions and (unknown := set(conditions) - {m.name for m in self.marginals}):
            raise ParameterError(f"no such columns: {sorted(unknown)}")
        kinds = {m.name: m.kind for m in self.marginals}

        def drawn(rows: int) -> DataFrame:
            base = spark.range(rows).withColumns({c: F.lit(v).cast(kinds[c]) for c, v in (conditions or {}).items()})
            out = self.draw(base, "id", list(conditions or ()), seed)
            if conditions and not force:
                free = self.draw(base.select("id", *[(F.col(c) if c in conditions else F.lit(None).cast(kinds[c])).alias(c) for c in kinds]), "id", [], seed)
                out = out.drop(*conditions).join(free.select("id", *conditions), "id").select("id", *kinds)
            for predicate in self.constraints:
                out = out.where(predicate)
            return out

        rows, out = n, drawn(n)
        while self.constraints and (got := out.count()) < n:
            if rows >= MOST_TIMES * n + 10_000:
                raise GenerationError(f"{rows} rows drawn, but fewer than {n} meet the constraints {list(self.constraints)}")
            # as many as the share met so far asks for, and a little more
            rows = int(min(1.2 * rows * n / got if got else 8 * rows, 8 * rows)) + 100
            out = drawn(rows)
        out = out.orderBy("id").limit(n)
        if self.primary_key:
            out = out.withColumn(self.primary_key, F.col("id") + 1)
        return out if keep_id else out.drop("id")

    def save(self, path: str) -> None:
        """The fitted distributions as JSON, and columns of many categories as Parquet beside it."""
        rows = [{**m.__dict__, "kind": m.kind.jsonValue()} for m in self.marginals]
        large = {c: f"{path}.{i}.parquet" for i, c in enumerate(self.large)}
        for c, at in large.items():
            self.large[c].write.mode("overwrite").parquet(at)
        Path(path).write_text(json.dumps({"constraints": list(self.constraints), "primary_key": self.primary_key, "marginals": rows, "correlation": self.correlation.tolist(), "large": large, "scales": self.scales, "fields": list(self.fields), "digits": self.digits}))

    @classmethod
    def load(cls, path: str) -> CopulaSynthesizer:
        x = json.loads(Path(path).read_text())
        marginals = [Marginal(**{**m, "kind": T._parse_datatype_json_value(m["kind"])}) for m in x["marginals"]]
        large = {c: SparkSession.active().read.parquet(at) for c, at in x["large"].items()}
        return cls(x["constraints"], x["primary_key"], marginals, np.array(x["correlation"]), x["fields"], x["digits"], large, x["scales"])

    def complete(self, known: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """Known rows with their absent columns drawn given the known ones, row by row; columns in the fitted order."""
        if unknown := [c for c in known.columns if c != key and c not in {m.name for m in self.marginals}]:
            raise ParameterError(f"no such columns: {unknown}")
        return self.draw(known, key, [c for c in known.columns if c != key], seed)


def shares(values: DataFrame) -> DataFrame:
    """(value, high): all values with their cumulative share, in value order."""
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return running_sums(counts, "value", {"upto": F.col("n")}).select("value", (F.col("upto") / counts.agg(F.sum("n")).scalar()).alias("high"))


@dataclass
class SequenceSynthesizer(Synthesizer):
    """Examples drawn with replacement; their features, scaled to 0..1, plus autoregressive noise, clipped and scaled back."""

    example: str
    time: str
    features: Sequence[str]
    attributes: Sequence[str] = ()
    noise: float = 0.02
    memory: float = 0.7
    source: DataFrame | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    examples: DataFrame | None = None

    def fit(self, df: DataFrame) -> SequenceSynthesizer:
        self.ranges = {f: min_max(df, f) for f in self.features}
        self.source = positions(df.select(self.example, self.time, *self.features, *self.attributes), self.example, self.time)
        self.examples = df.select(self.example).distinct()
        self.examples = numbered(self.examples, self.example, "pick")
        return self

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        count = self.examples.count()
        drawn = spark.range(n).select(F.col("id").alias("sample_id"), F.floor(uniform(seed, F.col("id")) * count).cast("long").alias("pick")).join(self.examples, "pick")
        rows = drawn.join(self.source, self.example)
        w = W.partitionBy("sample_id").orderBy("pos").rowsBetween(-8, 0)
        for i, f in enumerate(self.features):
            low, high = self.ranges[f]
            shocks = rows.withColumn("__e", normal(seed + 17 * (i + 1), F.col("sample_id"), F.col("pos")))
            # autoregressive noise as a finite moving average of shocks
            past = F.aggregate(F.zip_with(F.reverse(F.collect_list("__e").over(w)), F.array(*[F.lit(self.memory**k) for k in range(9)]), lambda e, m: F.coalesce(e, F.lit(0.0)) * m), F.lit(0.0), lambda s, x: s + x)
            rows = shocks.withColumn(f, F.greatest(F.lit(low), F.least(F.lit(high), F.col(f).cast("double") + past * self.noise * (high - low)))).drop("__e")
        return rows.select("sample_id", "pos", *self.attributes, *self.features)

    def save(self, path: str) -> None:
        """A folder with the parameters as JSON and the examples as Parquet."""
        Path(path).mkdir(parents=True, exist_ok=True)
        own = {k: getattr(self, k) for k in ("example", "time", "noise", "memory")}
        Path(path, "model.json").write_text(json.dumps({**own, "features": list(self.features), "attributes": list(self.attributes), "ranges": self.ranges}))
        self.source.write.mode("overwrite").parquet(f"{path}/source")
        self.examples.write.mode("overwrite").parquet(f"{path}/examples")

    @classmethod
    def load(cls, path: str) -> SequenceSynthesizer:
        spark, x = SparkSession.active(), json.loads(Path(path, "model.json").read_text())
        ranges = {k: tuple(v) for k, v in x.pop("ranges").items()}
        return cls(**x, source=spark.read.parquet(f"{path}/source"), ranges=ranges, examples=spark.read.parquet(f"{path}/examples"))


@dataclass
class TextSynthesizer(Synthesizer):
    """Lines from character n-gram counts; a start string is continued.

    The table of contexts is shipped to the workers, so the order is the longest up to `order` whose contexts, all of them, are at most
    `most_contexts`: no context is dropped. A start whose last characters were never seen goes on from the characters behind them that were.
    Lines end where the model ends them, at the latest at `most_length` (the longest line learned)."""

    order: int = 3
    column: str = "line"
    most_length: int | None = None
    table: dict[str, tuple[list[str], list[float]]] = field(default_factory=dict)

    def fit(self, df: DataFrame, most_contexts: int = 50_000) -> TextSynthesizer:
        lines = df.select(F.col(self.column).alias("s")).where("s is not null")
        if self.most_length is None:
            self.most_length = lines.agg(F.max(F.length("s"))).first()[0] or 0

        def counted(k: int) -> DataFrame:
            text = F.concat(F.lit("\x02" * k), F.col("s"), F.lit("\n"))
            grams = lines.select(text.alias("s")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - k), lambda i: F.struct(F.substr("s", i, F.lit(k)).alias("c"), F.substr("s", i + k, F.lit(1)).alias("x")))).alias("g"))
            counts = grams.groupBy("g.c", "g.x").count()
            return counts.groupBy("c").agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("x", "count"))).alias("next"))

        for k in range(self.order, 0, -1):
            contexts = counted(k)
            if k == 1 or contexts.limit(most_contexts + 1).count() <= most_contexts:
                break
        self.order, self.table = k, {}
        for r in contexts.toLocalIterator():
            total, run, upto = r["n"], 0, []
            for x in r["next"]:
                run += x["count"]
                upto.append(run / total)
            self.table[r["c"]] = [x["x"] for x in r["next"]], upto
        return self

    def sample(self, spark: SparkSession, n: int, seed: int = 0, start: str = "") -> DataFrame:
        """(id, text) of n lines, generated in parallel, each from its own seeded generator."""
        return self.extend(spark.range(n).select("id", F.lit(start).alias("start")), seed)

    def extend(self, starts: DataFrame, seed: int = 0) -> DataFrame:
        """(id, text): each (id, start) row's line."""
        shared, k, most = starts.sparkSession.sparkContext.broadcast(self.table), self.order, self.most_length or 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = shared.value
            begins = sorted(table)
            for b in batches:
                lines = []
                for i, start in zip(b["id"], b["start"], strict=True):
                    rng, s = np.random.default_rng([seed, int(i) & (1 << 63) - 1]), "\x02" * k + start
                    while len(s) < most + k + len(start):
                        found = table.get(s[-k:])
                        if found is None:  # the shorter end of the text, in the first context that has it
                            found = next((table[c] for m in range(k - 1, 0, -1) for c in begins if c.endswith(s[-m:])), None)
                        if found is None:
                            break
                        x = found[0][min(int(np.searchsorted(found[1], rng.random(), "right")), len(found[0]) - 1)]
                        if x == "\n":
                            break
                        s += x
                    lines.append(s[k:])
                yield pd.DataFrame({"id": b["id"], "text": lines})

        return starts.select(F.col("id").cast("long"), "start").mapInPandas(run, "id long, text string")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"order": self.order, "column": self.column, "most_length": self.most_length, "table": self.table}))

    @classmethod
    def load(cls, path: str) -> TextSynthesizer:
        return cls(**json.loads(Path(path).read_text()))
