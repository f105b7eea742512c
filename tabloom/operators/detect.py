"""Type detection: datetime formats of text columns, empty columns, continuous columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabloom.functions.expressions import literal_suffix, scrub


@dataclass(frozen=True)
class Format:
    """A candidate: how it is reported, how Spark parses it, and the strict shape a text must have."""

    name: str
    pattern: str
    shape: str


#: Components of a date as (reported directive, Spark pattern, shape).
YEARS = [("%Y", "yyyy", "[0-9]{4}"), ("%y", "yy", "[0-9]{2}")]
MONTHS = [("%m", "M", "[0-9]{1,2}"), ("%b", "MMM", "[A-Za-z]{3}"), ("%B", "MMMM", "[A-Za-z]{3,9}")]
DAYS = [("%d", "d", "[0-9]{1,2}")]
TIMES = [
    ("%X", "H:mm:ss", "[0-9]{1,2}:[0-9]{2}:[0-9]{2}"),
    ("%X.%f", "H:mm:ss.SSSSSS", r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6}"),
    ("%H:%M", "H:mm", "[0-9]{1,2}:[0-9]{2}"),
    ("%I:%M %p", "h:mm a", "[0-9]{1,2}:[0-9]{2} [AaPp][Mm]"),
    ("%I:%M:%S %p", "h:mm:ss a", "[0-9]{1,2}:[0-9]{2}:[0-9]{2} [AaPp][Mm]"),
]
ZONES = [("", "", ""), ("%z", "XX", "(?:Z|[+-][0-9]{4})"), ("%!z", "XXX", "(?:Z|[+-][0-9]{2}:[0-9]{2})")]
SEPARATORS = ["/", "-", ".", " ", ", "]
#: Order of the parts, best first: the reading that wins ties.
ORDERS = [("y", "m", "d"), ("m", "d", "y"), ("d", "m", "y")]


def candidates() -> list[Format]:
    """All formats, in the order in which ties are decided."""
    parts = {"y": YEARS, "m": MONTHS, "d": DAYS}
    out = []
    for order in ORDERS:
        for a, b, c in product(*(parts[p] for p in order)):
            for s, t in product(SEPARATORS, SEPARATORS):
                if s != t and not (s == " " and t == ", "):
                    continue
                date = (f"{a[0]}{s}{b[0]}{t}{c[0]}", f"{a[1]}{s}{b[1]}{t}{c[1]}", f"{a[2]}{s.replace('.', '[.]')}{b[2]}{t.replace('.', '[.]')}{c[2]}")
                out.append(Format(*date))
                for time, zone, gap in product(TIMES, ZONES, (" ", "T")):
                    out.append(Format(f"{date[0]}{gap}{time[0]}{zone[0]}", f"{date[1]}{gap if gap == ' ' else chr(39) + 'T' + chr(39)}{time[1]}{zone[1]}", f"{date[2]}{gap}{time[2]}{zone[2]}"))
    out += [Format(n, p, s) for n, p, s in TIMES]
    return out


CANDIDATES = candidates()


def parse(text: Column, f: Format) -> Column:
    """The timestamp of a text in that format, null where it doesn't have its shape or isn't a date."""
    return F.when(text.rlike(f"^{f.shape}$"), F.try_to_timestamp(text, F.lit(f.pattern)))


def likely(df: DataFrame, columns: Sequence[str], formats: Sequence[Format] = CANDIDATES) -> dict[str, list[Format]]:
    """Formats whose shape the first present value of each column has: few, whatever the number of candidates."""
    first = df.agg(*[F.first(F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: [f for f in formats if first[f"c{i}"] is not None and re.fullmatch(f.shape, first[f"c{i}"])] for i, c in enumerate(columns)}


def detect_datetimes(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None, match_all: bool = False, with_suffix: bool = False, seed: int = 0) -> DataFrame:
    """(column, format) of the text columns that hold datetimes.

    Majority: each value votes for every format it matches; the format with most votes wins, the earlier candidate on ties.
    match_all: a format must fit every present value. All candidates of all columns are checked in one aggregation.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    empty = df.sparkSession.createDataFrame([], "column string, format string")
    if not columns:
        return empty
    if sample is not None and not match_all:
        df = df.orderBy(F.rand(seed)).limit(sample)
    # shapes of all values vote first, so a stray first value can't hide a column's format
    shapes = likely(df, columns) if match_all else {c: CANDIDATES for c in columns}
    if not match_all:
        seen = shape_votes(df, columns)
        shapes = {c: [f for f in CANDIDATES if seen.get((c, f.shape))] for c in columns}
    asked = [(c, k, f) for c in columns for k, f in enumerate(shapes[c])]
    if not asked:
        return empty
    counts = df.agg(*[F.count(parse(F.col(f"`{c}`"), f)).alias(f"v{i}") for i, (c, _, f) in enumerate(asked)], *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)], *[F.max(literal_suffix(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = []
    for i, c in enumerate(columns):
        votes = [(-counts[f"v{j}"], k, f) for j, (d, k, f) in enumerate(asked) if d == c and counts[f"v{j}"]]
        if match_all:
            votes = [v for v in votes if -v[0] == counts[f"n{i}"]]
        if votes:
            name = min(votes, key=lambda v: v[:2])[2].name.replace("!", "")
            out.append((c, name.replace("%z", counts[f"s{i}"]) if with_suffix and counts[f"s{i}"] else name))
    return df.sparkSession.createDataFrame(out, "column string, format string") if out else empty


def any_shape() -> str:
    """A pattern of exactly the texts that have the shape of some candidate."""
    times, zones = "|".join(t[2] for t in TIMES), "|".join(z[2] for z in ZONES)
    dates = "|".join(dict.fromkeys(f.shape for f in CANDIDATES if ":" not in f.shape))
    return f"^(?:(?:{dates})(?:[ T](?:{times})(?:{zones}))?|{times})$"


def shape_votes(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], int]:
    """How many values of each column have each distinct shape: masks are counted in Spark, shapes matched on the few masks.

    Values without the shape of a candidate are left out first. The others have few masks, however many rows and columns
    there are, and those of one mask have the same shapes: a run of letters is told by its length and place (T, Z, AM or PM, month).
    """
    masks = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in columns]))).where(F.col("v").rlike(any_shape()))
    masks = masks.withColumn("m", F.regexp_replace(F.regexp_replace("v", "[0-9]", "0"), "[A-Za-z]", "a"))
    rows = masks.groupBy("c", "m").agg(F.count("*").alias("n"), F.min("v").alias("v")).collect()
    out: dict[tuple[str, str], int] = {}
    shapes = [(s, re.compile(s)) for s in {f.shape for f in CANDIDATES}]
    for r in rows:
        for s, p in shapes:
            if p.fullmatch(r["v"]):
                out[r["c"], s] = out.get((r["c"], s), 0) + r["n"]
    return out


def majority_format(df: DataFrame, column: str, formats: Sequence[Format]) -> DataFrame:
    """(format, votes) of the winner among given formats, entirely in one plan."""
    votes = df.select(F.explode(F.array(*[F.when(parse(F.col(column), f).isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(f.name).alias("format"))) for i, f in enumerate(formats)])).alias("v")).where("v is not null")
    counts = votes.groupBy("v.rank", "v.format").agg(F.count("*").alias("votes"))
    return counts.withColumn("r", F.row_number().over(W.orderBy(F.desc("votes"), "rank"))).where("r = 1").select("format", "votes")


def empty_columns(df: DataFrame) -> DataFrame:
    """(column, is_empty) of every column, from one aggregation."""
    counts = df.agg(*[F.count(scrub(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"c{i}") == 0).alias("is_empty")) for i, c in enumerate(df.columns)])))


def continuous_columns(df: DataFrame) -> DataFrame:
    """(column, continuous): whether all present values read as numbers."""
    checks = df.agg(*[(F.count(f"`{c}`") == F.count(F.col(f"`{c}`").cast("string").try_cast("double"))).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return checks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("continuous")) for i, c in enumerate(df.columns)])))


def mean_imputed(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, micros, missing): unix microseconds with the mean for missing values, and whether it was missing."""
    micros = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    mean = df.agg(F.avg(micros).alias("m")).scalar()
    return df.select(key, micros.alias("x"), F.col(column).isNull().alias("missing"), mean.alias("m")).select(key, F.coalesce("x", "m").alias("micros"), "missing")


def merge_choices(detected: dict[str, str], chosen: dict[str, str], overwrite: bool = False) -> dict[str, str]:
    """What the user set wins over what was detected, unless overwrite."""
    return {**chosen, **detected} if overwrite else {**detected, **chosen}
