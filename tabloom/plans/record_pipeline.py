"""The record pipeline end to end: columns in batches, a line model for each, validated generation, records put together again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import GenerationError, ParameterError
from tabloom.functions import expressions as X
from tabloom.operators import records
from tabloom.operators.relational import column_batches
from tabloom.plans.synthesizers import TextSynthesizer


@dataclass
class Batch:
    """Some columns, the model of their lines, and the check a generated line has to pass."""

    columns: list[str]
    model: TextSynthesizer
    check: str | Callable[[str], bool | None] | None = None


@dataclass
class RecordPipeline:
    """fit trains a model for every batch of columns; generate draws lines until enough are valid or too many are not."""

    batch_size: int = 15
    delimiter: str = ","
    order: int = 5
    batches: list[Batch] = field(default_factory=list)
    headers: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, seeds: Sequence[str] = (), groups: Sequence[Sequence[str]] | None = None) -> RecordPipeline:
        """seeds: columns whose values are given when generating; they lead the first batch."""
        self.headers = df.columns
        if missing := [c for c in seeds if c not in df.columns]:
            raise ParameterError(f"no such columns: {missing}")
        rest = [c for c in df.columns if c not in seeds]
        groups = [list(g) for g in groups] if groups else column_batches(rest, self.batch_size)
        groups[0] = [*seeds, *[c for c in groups[0] if c not in seeds]]
        self.batches = []
        for g in groups:
            line = F.concat_ws(self.delimiter, *[F.replace(X.plain_cell(F.col(f"`{c}`"), ","), F.lit(self.delimiter), F.lit(" ")) for c in g])
            d = X.quoted(self.delimiter)
            self.batches.append(Batch(g, TextSynthesizer(self.order).fit(df.select(line.alias("line"))), f"size(split(text, '{d.replace(chr(92), chr(92) * 2)}')) = {len(g)}"))
        return self

    def lines(self, spark: SparkSession, batch: Batch, n: int, seed: int, start: str = "") -> DataFrame:
        """(id, text, valid, explain, values) of n drawn lines."""
        return records.validate(batch.model.sample(spark, n, seed, records.check_start(start, self.delimiter if start else None)), "text", batch.check, self.delimiter)

    def generate(
        self,
        spark: SparkSession,
        n: int,
        seed: int = 0,
        most_invalid: int = 1000,
        start: dict[str, str] | None = None,
        check: Callable[[dict], bool | None] | str | None = None,
        progress: Callable[[dict], None] | None = None,
    ) -> tuple[DataFrame, list[DataFrame]]:
        """(records of text, a summary of each batch). Lines are drawn in rounds; an error where invalid ones exceed the budget.

        check: of whole records; those that fail count as invalid too and others are drawn for them. progress is told after
        each round: batch, drawn, valid and invalid lines (batch None: whole records)."""
        if start and list(start) != self.batches[0].columns[: len(start)]:
            raise ParameterError("start values are for the first columns of the first batch")
        prefix = "".join(v + self.delimiter for v in start.values()) if start else ""
        tell = progress or (lambda facts: None)
        wanted = n
        while True:
            parts, summaries = [], []
            for i, b in enumerate(self.batches):
                kept = self.drawn(spark, i, wanted, seed, most_invalid, prefix if i == 0 else "", tell)
                parts.append((kept, b.columns))
                summaries.append(records.summary(kept, wanted, most_invalid))
            whole = records.assemble(parts, "id", self.headers)
            if check is None:
                return whole, summaries
            judged = records.validate_records(whole, check)
            good = records.accepted(judged).count()
            tell({"batch": None, "drawn": wanted, "valid": good, "invalid": wanted - good})
            if good >= n:
                best = records.accepted(judged).drop("valid", "explain")
                return best.orderBy("rank").limit(n), summaries
            if wanted - good > most_invalid:
                raise GenerationError(f"{wanted - good} invalid records for {good} valid ones; at most {most_invalid} are allowed")
            wanted = min(2 * wanted, wanted + most_invalid + 1)

    def drawn(self, spark: SparkSession, i: int, n: int, seed: int, most_invalid: int, prefix: str, tell: Callable[[dict], None]) -> DataFrame:
        """Lines of a batch up to n valid ones."""
        b, drawn = self.batches[i], n + min(most_invalid, max(16, n // 4))
        while True:
            every = self.lines(spark, b, drawn, seed * 1000 + i, prefix)
            kept = records.within_budget(every, "id", most_invalid, n)
            good = records.accepted(kept).count()
            bad = kept.count() - good
            tell({"batch": i, "drawn": drawn, "valid": good, "invalid": bad})
            if good >= n:
                return kept
            if bad >= most_invalid or drawn > n + most_invalid:
                raise GenerationError(f"batch {i}: {bad} invalid lines for {good} valid ones; at most {most_invalid} are allowed")
            drawn = min(2 * drawn, n + most_invalid + 1)

    def generate_seeded(self, seeds: DataFrame, key: str, columns: Sequence[str], seed: int = 0, rounds: int = 20) -> DataFrame:
        """One record of the first batch for every seed row; seeds whose line is invalid are tried again.

        Seeds are a table throughout: a round extends every open seed's prefix where the row is and keeps the valid lines."""
        b = self.batches[0]
        open_ = records.Seeds(tuple(columns), self.delimiter).prefix(seeds, b.columns).select(F.col(key).cast("long").alias("id"), F.col("prefix").alias("start"))
        done = None
        for k in range(rounds):
            tried = records.validate(b.model.extend(open_, seed + 7919 * k), "text", b.check, self.delimiter)
            good = records.accepted(tried).select("id", "values").checkpoint() if seeds.sparkSession.sparkContext.getCheckpointDir() else records.accepted(tried).select("id", "values").cache()
            done = good if done is None else done.unionByName(good)
            open_ = open_.join(good, "id", "left_anti")
            if open_.isEmpty():
                return done.select(F.col("id").alias("seed_id"), *[F.col("values")[i].alias(c) for i, c in enumerate(b.columns)])
        raise GenerationError(f"{open_.count()} seeds without a valid record after {rounds} rounds")
