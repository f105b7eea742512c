"""Structured Streaming forms of the row-local and associative operators. An extension of this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import category
from tabloom.operators.records import validate


def validated(stream: DataFrame, text: str, check: str, delimiter: str | None = None) -> DataFrame:
    """A stream of lines with valid, explain and values."""
    return validate(stream, text, check, delimiter)


def windowed_distribution(stream: DataFrame, time: str, column: str, width: str, late: str) -> DataFrame:
    """(start, key, n): counts of a column's values by event-time window, late rows up to `late`."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), category(F.col(column)).alias("key")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")


def session_examples(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, steps): examples as sessions of a key, closed after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("steps")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "steps")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, through an in-memory table, as a DataFrame (tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
