"""Column expressions: missing values, encodings, text records and dates. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a missing value where it must be a category of its own.
MISSING = "nan"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def scrub(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities as null: null is the only missing value inside the library."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return c


def scrubbed(df: DataFrame) -> DataFrame:
    return df.select(*[scrub(df, n).alias(n) for n in df.columns])


def category(c: Column) -> Column:
    """A value as category: text, with missing as a category of its own."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def floating(c: Column) -> Column:
    return c.cast("double")


# ---------------------------------------------------------------- encodings


def one_hot(ordinal: Column, size: int) -> Column:
    """0/1 array of the given size; null or out of range raises instead of encoding as all zero."""
    ok = (ordinal >= 0) & (ordinal < size)
    return F.when(ok, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == ordinal).cast("int"))).otherwise(F.raise_error(F.lit("ordinal outside the dictionary")))


def one_hot_decode(v: Column) -> Column:
    """Index of the largest entry, the first on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def bits_for(n: int) -> int:
    """Bits that hold the ordinals 1..n."""
    return max(1, n.bit_length())


def binary(ordinal: Column, bits: int) -> Column:
    """Bits of an ordinal, most significant first."""
    return F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda i: F.expr("0") + F.call_function("shiftright", ordinal.cast("int"), i).bitwiseAND(F.lit(1)))


def binary_decode(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda total, b: total * 2 + b.cast("int"))


def above_half(v: Column) -> Column:
    """1 where an entry is strictly above one half, else 0."""
    return F.transform(v, lambda x: (x > 0.5).cast("int"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def vector_part(v: Column, start: int, size: int) -> Column:
    """Entries start .. start + size - 1, counted from 0."""
    return F.slice(v, start + 1, size)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(a) / F.ln(b)


# ---------------------------------------------------------------- text records


def quoted(delimiter: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in delimiter)


def split_record(text: Column, delimiter: str | None) -> Column:
    """Fields of a line: all trailing delimiters are dropped first; no delimiter: null."""
    if delimiter is None:
        return F.lit(None).cast("array<string>")
    d = quoted(delimiter)
    return F.split(F.regexp_replace(text, f"(?:{d})+$", ""), d)


def named_values(values: Column, headers: Sequence[str]) -> Column:
    """Struct of the headers; absent values are empty. A row with more values than headers is null."""
    fields = [F.coalesce(F.get(values, F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(headers)]
    return F.when(F.size(values) <= len(headers), F.struct(*fields))


def has_fields(text: Column, delimiter: str, count: int) -> Column:
    return F.size(F.split(text, quoted(delimiter))) == count


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def to_tokens(line: Column, delimiter: str, field: str = "<d>", end: str = "<n>") -> Column:
    """A line with its delimiters as tokens and an end token."""
    return F.concat(F.replace(strip(line), F.lit(delimiter), F.lit(field)), F.lit(end + "\n"))


def from_tokens(line: Column, delimiter: str, field: str = "<d>", end: str = "<n>") -> Column:
    return F.replace(F.replace(line, F.lit(end + "\n"), F.lit("")), F.lit(field), F.lit(delimiter))


def mark_columns(line: Column, delimiter: str, pattern: str = "<col{}>") -> Column:
    """Every field behind a marker with its position."""
    head, tail = pattern.split("{}")
    return F.array_join(F.transform(F.split(strip(line), quoted(delimiter)), lambda x, i: F.concat(F.lit(head), i.cast("string"), F.lit(tail), x)), "")


def unmark_columns(line: Column, delimiter: str, pattern: str = "<col{}>") -> Column:
    head, tail = pattern.split("{}")
    parts = F.split(line, f"{quoted(head)}[0-9]+{quoted(tail)}")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), delimiter)


def seed_prefix(headers: Sequence[str], delimiter: str) -> Column:
    return F.concat(F.concat_ws(delimiter, *[F.col(f"`{h}`").cast("string") for h in headers]), F.lit(delimiter))


def characters(text: Column) -> Column:
    return F.split(text, "")


def char_encode(text: Column, vocabulary: Sequence[str]) -> Column:
    """Positions in the vocabulary; a character outside raises."""
    known = F.create_map(*[x for i, c in enumerate(vocabulary) for x in (F.lit(c), F.lit(i))])
    return F.transform(characters(text), lambda c: F.coalesce(F.try_element_at(known, c), F.raise_error(F.lit("character outside the vocabulary")).cast("int")))


def char_decode(ids: Column, vocabulary: Sequence[str]) -> Column:
    letters = F.array(*[F.lit(c) for c in vocabulary])
    return F.array_join(F.transform(ids, lambda i: F.element_at(letters, i + 1)), "")


def plain_cell(c: Column, comma: str = "[c]") -> Column:
    """A cell that fits a comma-separated line: null empty, commas named, line breaks as spaces."""
    return F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(","), F.lit(comma)), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


# ---------------------------------------------------------------- dates


def date_mask(text: Column) -> Column:
    """A date's shape: everything but separators as `#`."""
    return F.regexp_replace(text, r"[^/.\- ,TZ+]", "#")


def shift_time(ts: Column, days: float | None = None, ms: int | None = None) -> Column:
    seconds = (days or 0) * 86400 + (ms or 0) / 1000
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def literal_suffix(text: Column) -> Column:
    """The zone as it was written: Z or an offset; empty without one."""
    return F.regexp_extract(text, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
