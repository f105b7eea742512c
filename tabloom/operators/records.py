"""Generated records: validation, seeds, budget of invalid ones, assembly from column batches, summaries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.errors import GenerationError, ParameterError
from tabloom.functions import expressions as X
from tabloom.operators.sequences import numbered, running_sums

RESULT = "struct<valid: boolean, explain: string>"


def python_validator(check: Callable[[str], bool | None]) -> Callable[[Column], Column]:
    """A user's check as a column function: True, False or None; what it raises makes the line invalid and explains it."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                try:
                    v = check(x)
                    rows.append((None if v is None else bool(v), None))
                except Exception as e:  # noqa: BLE001  whatever the user's check raises explains the line
                    rows.append((False, str(e)))
            yield pd.DataFrame(rows, columns=["valid", "explain"])

    return run


def validate(lines: DataFrame, text: str = "text", check: Callable[[str], bool | None] | str | None = None, delimiter: str | None = None) -> DataFrame:
    """lines with valid, explain and values. check: a Python function, a SQL predicate, or None (everything is valid as null)."""
    if check is None:
        out = lines.withColumns({"valid": F.lit(None).cast("boolean"), "explain": F.lit(None).cast("string")})
    elif isinstance(check, str):
        out = lines.withColumns({"valid": F.expr(check), "explain": F.lit(None).cast("string")})
    else:
        out = lines.withColumn("__r", python_validator(check)(F.col(text))).withColumns({"valid": F.col("__r.valid"), "explain": F.col("__r.explain")}).drop("__r")
    return out.withColumn("values", X.split_record(F.col(text), delimiter))


def validate_records(df: DataFrame, check: Callable[[dict], bool | None] | str | None) -> DataFrame:
    """Whole records with valid and explain. check: a SQL predicate over the columns (what fails is explained by it), a Python
    function of the record as a dict, or None (everything is valid as null)."""
    if check is None:
        return df.withColumns({"valid": F.lit(None).cast("boolean"), "explain": F.lit(None).cast("string")})
    if isinstance(check, str):
        good = F.coalesce(F.expr(check), F.lit(False))
        return df.withColumns({"valid": good, "explain": F.when(~good, F.lit(check))})
    judge = python_validator(lambda text: check(json.loads(text)))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.withColumn("__r", judge(whole)).withColumns({"valid": F.col("__r.valid"), "explain": F.col("__r.explain")}).drop("__r")


def accepted(lines: DataFrame) -> DataFrame:
    """Lines that count as valid: true, or not judged."""
    return lines.where(F.coalesce("valid", F.lit(True)))


def field_count_check(text: str, delimiter: str, headers: Sequence[str]) -> Column:
    return X.has_fields(F.col(text), delimiter, len(headers))


def running(lines: DataFrame, order: str) -> DataFrame:
    """lines with n_valid and n_invalid up to and with each."""
    bad = (~F.coalesce("valid", F.lit(True))).cast("long")
    return running_sums(lines, order, {"n_invalid": bad, "n_valid": 1 - bad})


def within_budget(lines: DataFrame, order: str, most_invalid: int, wanted: int | None = None) -> DataFrame:
    """Lines in order until the invalid ones exceed the budget or enough valid ones are there."""
    counted = running(lines, order)
    good = F.coalesce("valid", F.lit(True))
    enough = (F.col("n_valid") < wanted) | (good & (F.col("n_valid") <= wanted)) if wanted is not None else F.lit(True)
    return counted.where((F.col("n_invalid") <= most_invalid) & enough)


def check_budget(lines: DataFrame, most_invalid: int) -> None:
    n = lines.where(~F.coalesce("valid", F.lit(True))).count()
    if n > most_invalid:
        raise GenerationError(f"{n} invalid records; at most {most_invalid} are allowed")


def invalid_cache(lines: DataFrame, order: str, n: int = 100) -> DataFrame:
    return lines.where(~F.coalesce("valid", F.lit(True))).orderBy(order).limit(n)


def summary(lines: DataFrame, wanted: int, most_invalid: int) -> DataFrame:
    """One row: valid and invalid lines, the budget, and whether enough are valid."""
    good = F.coalesce("valid", F.lit(True)).cast("long")
    n = F.coalesce(F.sum(good), F.lit(0))
    return lines.agg(n.alias("valid_lines"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("invalid_lines"), F.lit(most_invalid).alias("max_invalid"), (n >= wanted).alias("is_valid"))


def assemble(batches: Sequence[tuple[DataFrame, Sequence[str]]], order: str, headers: Sequence[str]) -> DataFrame:
    """Records from the valid lines of each column batch, the k-th of each put together, columns in the original order."""
    out = None
    for lines, names in batches:
        ranked = numbered(accepted(lines), order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
        one = ranked.select("rank", X.named_values(F.col("values"), names).alias("r")).where("r is not null").select("rank", "r.*")
        out = one if out is None else out.join(one, "rank")
    return out.select("rank", *headers)


@dataclass(frozen=True)
class Seeds:
    """Values that generated records must start with: one for all, or one record per seed, in order."""

    headers: tuple[str, ...]
    delimiter: str

    def prefix(self, seeds: DataFrame, all_headers: Sequence[str]) -> DataFrame:
        if list(self.headers) != list(all_headers[: len(self.headers)]):
            raise ParameterError("seed columns are the first columns of a batch")
        if len(self.headers) >= len(all_headers):
            raise ParameterError("a seed leaves at least one column to generate")
        return seeds.withColumn("prefix", X.seed_prefix(self.headers, self.delimiter))

    def open_seeds(self, seeds: DataFrame, done: DataFrame, key: str) -> DataFrame:
        """Seeds without an accepted record yet, to be tried again."""
        return seeds.join(accepted(done).select(key).distinct(), key, "left_anti")


def check_start(text: str, delimiter: str | None) -> str:
    if not isinstance(text, str):
        raise ParameterError("a start string is text")
    if delimiter and not text.endswith(delimiter):
        raise ParameterError("a start string ends with the delimiter")
    return text


def worker_count(wanted: int | float | None, cores: int, lines: int, chunk: int = 5) -> int:
    """Parallel workers: a number, a share of the cores (a float up to 1, or a negative number counts back from them), never more than chunks."""
    if wanted is None or wanted == 0:
        n = cores
    elif isinstance(wanted, float):
        n = int(cores * wanted) if wanted > 0 else int(cores + cores * wanted)
    else:
        n = wanted if wanted > 0 else cores + wanted
    return max(1, min(n, ceil(lines / chunk)))
