"""Validation and row-local repair on streams: the same expressions as in batch, with a quarantine and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from ..operators.formats import Spec, validate


def split(stream: DataFrame, specs: dict[str, Spec]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): rows that meet all specifications, and the others with an array of the columns that don't."""
    bad = F.array_compact(F.array(*[F.when(col(c).isNotNull() & ~s.valid(col(c)), F.lit(c)) for c, s in specs.items()]))
    marked = stream.withColumn("failed", bad)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def violation_counts(stream: DataFrame, row_id: str, clock: str, specs: dict[str, Spec], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, column_name, violations) for each tumbling window of the event clock; rows later than the watermark are dropped."""
    rows = stream.withWatermark(clock, late)
    bad = F.array_compact(F.array(*[F.when(col(c).isNotNull() & ~s.valid(col(c)), F.lit(c)) for c, s in specs.items()]))
    cells = rows.select(col(clock).alias("clock"), F.explode(bad).alias("column_name"))
    return cells.groupBy(F.window("clock", window), "column_name").agg(F.count("*").alias("violations")).select(F.col("window.start").alias("start"), "column_name", "violations")


def deduplicate(stream: DataFrame, clock: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return stream.withWatermark(clock, late).dropDuplicatesWithinWatermark(keys)


def violations(stream: DataFrame, row_id: str, specs: dict[str, Spec]) -> DataFrame:
    """Violation rows as they arrive; the batch operator is row-local."""
    return validate(stream, row_id, specs)
