"""One table of value pairs that dependencies, coherence and imputation hints are read from.

The table has (predictor, target, key, value, cnt): how many rows hold a key of the predictor and a value of the target; a null
value is a gap that a hint could fill. Counts of batches add up, so a new batch is counted by itself and appended; nothing of
the earlier data is read again. Keys are the predictor's text, its month if it is temporal, and 'a|b' for two predictors.
Spellings without case and outer white space are a coarser key, whose counts come from those of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import col, text, text_key
from ..sources.shared import scratch
from . import rules
from .profile import period_key

ROWS = "predictor string, target string, key string, value string, cnt long"


def key_of(predictor: str, temporal: frozenset[str] | set[str] = frozenset(), columns: list[str] = ()) -> Column:
    """What a predictor, or two of the form 'a|b', says of a row: null if one of them is."""
    parts = [predictor] if predictor in columns or "|" not in predictor else predictor.split("|")
    keys = [period_key(col(p), p in temporal) for p in parts]
    return keys[0] if len(keys) == 1 else F.when(F.concat(*keys).isNotNull(), F.concat_ws("|", *keys))


class PairStatistics:
    """The table for some (predictor, target) pairs; a predictor 'a|b' is two columns.

    It lies in the shared folder, or at `path`, where a later session opens it again. A batch that is added under the name of
    an earlier one replaces it, so a repeated append after a failure counts nothing twice.
    """

    def __init__(self, spark: SparkSession, pairs: list[tuple[str, str]], temporal=(), path: str | None = None):
        self.spark, self.pairs, self.temporal = spark, list(pairs), frozenset(temporal)
        self.path = path or scratch(spark, "pair-statistics")

    def add(self, df: DataFrame, batch: str | None = None) -> PairStatistics:
        """Counts the rows of df in one shuffle of their pairs, which tasks add up first."""
        keys = list(dict.fromkeys(p for p, _ in self.pairs))
        targets = list(dict.fromkeys(t for _, t in self.pairs))
        # Keys and values are made once a row, however many pairs use them.
        rows = df.select(*[key_of(p, self.temporal, df.columns).alias(f"k{i}") for i, p in enumerate(keys)], *[text(col(t)).alias(f"t{i}") for i, t in enumerate(targets)])
        cells = F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(t).alias("target"), F.col(f"k{keys.index(p)}").alias("key"), F.col(f"t{targets.index(t)}").alias("value")) for p, t in self.pairs])
        counts = rows.select(F.inline(cells)).where("key is not null or value is null").groupBy("predictor", "target", "key", "value").agg(F.count("*").alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={batch or uuid.uuid4().hex}")
        return self

    def table(self, normalized: bool = False) -> DataFrame:
        """(predictor, target, key, value, cnt) over all batches."""
        rows = self.spark.read.schema(ROWS).parquet(self.path)
        key = text_key(F.col("key")) if normalized else F.col("key")
        return rows.groupBy("predictor", "target", key.alias("key"), "value").agg(F.sum("cnt").alias("cnt"))

    def counts(self, normalized: bool = False) -> DataFrame:
        """rules.pair_counts of all that was added."""
        return self.table(normalized).where("key is not null and value is not null")

    def dependencies(self) -> DataFrame:
        return rules.dependencies(self.counts())

    def coherence(self) -> DataFrame:
        return rules.coherence(self.counts())

    def hints(self, normalized: bool = False) -> tuple[DataFrame, DataFrame]:
        """rules.hints_from of the table."""
        table = self.table(normalized)
        return rules.hints_from(table.where("key is not null and value is not null"), table.where("value is null").select("predictor", "target", "key", F.col("cnt").alias("rows")), normalized)

    def chosen(self) -> DataFrame:
        """One hint a target, of raw and of normalised keys."""
        single = {p for p, _ in self.pairs if "|" not in p}
        return rules.choose_hints(self.hints()[0].unionByName(self.hints(True)[0].where(F.col("predictor").isin(*(single or [""])))))


def single_hints(df: DataFrame, pairs: list[tuple[str, str]], normalized: bool, temporal=()) -> tuple[DataFrame, DataFrame]:
    """(hints, mapping) of rules.hints_from over df; temporal predictors count by month."""
    return PairStatistics(df.sparkSession, pairs, temporal).add(df).hints(normalized)


def pair_hints(df: DataFrame, triples: list[tuple[str, str, str]], temporal=()) -> tuple[DataFrame, DataFrame]:
    """single_hints for two predictors whose key is 'a|b'."""
    return single_hints(df, [(f"{a}|{b}", t) for a, b, t in triples], False, temporal)
