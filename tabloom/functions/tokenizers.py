"""Tokenizers of training lines: characters, or a public subword model file."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabloom.errors import ParameterError
from tabloom.functions import expressions as X


def vocabulary(lines: DataFrame, column: str = "line", size: int = 0) -> DataFrame:
    """(token, id): distinct characters of all lines and their line ends, by code point, cut to the first `size` (0: all)."""
    chars = lines.select(F.explode(X.characters(F.concat(F.col(column), F.lit("\n")))).alias("token")).distinct()
    out = chars.select("token", (F.row_number().over(W.orderBy(F.ascii("token"), "token")) - 1).alias("id"))
    return out.where(F.col("id") < size) if size else out


class Tokenizer(ABC):
    delimiter: str | None

    @abstractmethod
    def encode(self, text: Column) -> Column: ...

    @abstractmethod
    def decode(self, ids: Column) -> Column: ...

    def annotate(self, line: Column) -> Column:
        return X.to_tokens(line, self.delimiter) if self.delimiter else F.concat(X.strip(line), F.lit("\n"))

    def settings(self) -> str:
        return json.dumps({"kind": type(self).__name__, **{k: v for k, v in asdict(self).items()}})


@dataclass
class CharTokenizer(Tokenizer):
    tokens: list[str] = field(default_factory=list)
    delimiter: str | None = None

    @classmethod
    def train(cls, lines: DataFrame, column: str = "line", size: int = 0, delimiter: str | None = None) -> CharTokenizer:
        return cls([r["token"] for r in vocabulary(lines, column, size).orderBy("id").collect()], delimiter)

    def encode(self, text: Column) -> Column:
        return X.char_encode(text, self.tokens)

    def decode(self, ids: Column) -> Column:
        return X.char_decode(ids, self.tokens)

    def annotate(self, line: Column) -> Column:
        return F.concat(X.strip(line), F.lit("\n"))


@dataclass
class SubwordTokenizer(Tokenizer):
    """A public model file read by sentencepiece; Arrow batches, one load a worker."""

    model_file: str
    delimiter: str | None = None

    def encode(self, text: Column) -> Column:
        path = self.model_file

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            for s in batches:
                yield pd.Series(model.encode(s.fillna("").tolist(), num_threads=1))

        return run(text)

    def decode(self, ids: Column) -> Column:
        path = self.model_file

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            for s in batches:
                yield pd.Series([model.decode([int(i) for i in x]) for x in s])

        return run(ids)


@dataclass
class ColumnTokenizer(SubwordTokenizer):
    """Subwords behind a marker of each field's position."""

    pattern: str = "<col{}>"

    def __post_init__(self) -> None:
        import re

        if not re.fullmatch(r"<[A-Za-z]{3,5}\{\}>", self.pattern):
            raise ParameterError("a marker has 3 to 5 letters and {} in angle brackets")
        if not self.delimiter:
            raise ParameterError("column markers need a delimiter")

    def annotate(self, line: Column) -> Column:
        return X.mark_columns(line, self.delimiter, self.pattern)


def load(settings: str) -> Tokenizer:
    x = json.loads(settings)
    kind = {"CharTokenizer": CharTokenizer, "SubwordTokenizer": SubwordTokenizer, "ColumnTokenizer": ColumnTokenizer}[x.pop("kind")]
    return kind(**x)


def default(vocab_size: int, model_file: str | None, lines: DataFrame, delimiter: str | None = None) -> Tokenizer:
    """Characters for size 0, else the subword model."""
    if vocab_size == 0:
        return CharTokenizer.train(lines, delimiter=delimiter)
    if model_file is None:
        raise ParameterError("a subword tokenizer needs a model file")
    return SubwordTokenizer(model_file, delimiter)
