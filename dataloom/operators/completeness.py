"""Completeness: fill rates, rows with gaps, disguised nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import PLACEHOLDERS, col, columns_of, ratio, strip, text_key

SPARSE = 0.9
MOST_CLEARED = 0.3


def nulls_in_row(df: DataFrame, row_id: str) -> Column:
    return sum((col(c).isNull().cast("int") for c in columns_of(df, row_id)), F.lit(0))


def _stacked(counts: DataFrame, names: list[str], prefix: str, value: str) -> DataFrame:
    """Columns prefix0, prefix1 … of a one-row frame as rows (column, position, value)."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.col(f"{prefix}{i}").alias(value)) for i, n in enumerate(names)])
    return counts.select("total", F.inline(cells))


def fill_rates(df: DataFrame, row_id: str) -> DataFrame:
    """(column, position, nulls, total, completeness) of every column, in one aggregation over one scan."""
    names = columns_of(df, row_id)
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)])
    out = _stacked(counts, names, "n", "nulls")
    return out.select("column", "position", "nulls", "total", ratio(F.col("total") - F.col("nulls"), F.col("total")).alias("completeness"))


def overall(df: DataFrame, row_id: str) -> DataFrame:
    names = columns_of(df, row_id)
    one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nulls_in_row(df, row_id)), F.lit(0)).cast("long").alias("null_cells"))
    cells = F.col("rows") * len(names)
    return one.select("rows", F.lit(len(names)).alias("columns"), cells.alias("cells"), "null_cells", ratio(cells - F.col("null_cells"), cells).alias("completeness"))


def row_distribution(df: DataFrame, row_id: str) -> DataFrame:
    n = nulls_in_row(df, row_id)
    return df.agg(F.count_if(n == 0).alias("complete_rows"), F.count_if(n > 0).alias("rows_with_nulls"), F.coalesce(F.max(n), F.lit(0)).alias("most_nulls"))


def worst_rows(df: DataFrame, row_id: str, most: int = 10) -> DataFrame:
    return df.select(col(row_id).alias("row_id"), nulls_in_row(df, row_id).alias("nulls")).where("nulls > 0").orderBy(F.desc("nulls"), "row_id").limit(most)


def sparse_columns(df: DataFrame, row_id: str, least: float = SPARSE) -> DataFrame:
    rates = fill_rates(df, row_id)
    return rates.where((F.col("total") > 0) & (F.col("nulls") >= least * F.col("total"))).select("column", "nulls", "total")


def is_placeholder(c: Column, tokens=PLACEHOLDERS) -> Column:
    return text_key(c).isin(*tokens)


def unmask(df: DataFrame, tokens: dict[str, list[str]]) -> DataFrame:
    """df with each column's own tokens, compared as stripped text, as null. Row-local: works on streams."""
    def clean(n: str) -> Column:
        c = col(n)
        return F.when(~strip(c).isin(*tokens[n]), c).alias(n) if tokens.get(n) else c
    return df.select(*[clean(n) for n in df.columns])


def unmask_guard(df: DataFrame, tokens: dict[str, list[str]], most: float = MOST_CLEARED) -> DataFrame:
    """(column, cleared, populated, accepted): a list that would clear more than `most` of a column's values is refused."""
    names = [n for n in df.columns if tokens.get(n)]
    counts = df.agg(F.count("*").alias("total"), *[F.count(col(n)).alias(f"p{i}") for i, n in enumerate(names)],
                    *[F.count_if(strip(col(n)).isin(*tokens[n])).alias(f"c{i}") for i, n in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("cleared"), F.col(f"p{i}").alias("populated")) for i, n in enumerate(names)])
    return counts.select(F.inline(cells)).withColumn("accepted", F.col("cleared") <= most * F.col("populated"))


def missing_violations(df: DataFrame, row_id: str, but: list[str] = ()) -> DataFrame:
    """One violation for each column with nulls that isn't in `but`; affected_rows counts them."""
    return violation_rows(fill_rates(df, row_id).where((F.col("nulls") > 0) & ~F.col("column").isin(*(but or [""]))), "column", F.lit(-1), F.lit(None), F.lit("missing value"), "completeness", F.col("nulls"))


def violation_rows(df: DataFrame, column, row, value, pattern, kind: str, affected) -> DataFrame:
    """The columns of every violation table."""
    return df.select((F.col(column) if isinstance(column, str) else column).alias("column_name"), row.cast("long").alias("row_id"), value.cast("string").alias("value"), pattern.cast("string").alias("expected_pattern"), F.lit(kind).alias("kind"), affected.cast("long").alias("affected_rows"))


def disguised_nulls(raw: DataFrame, detected: DataFrame, row_id: str) -> DataFrame:
    """Cells that are null once placeholders are unmasked and were not before; both snapshots are one-row aggregates."""
    a, b = overall(raw, row_id).select(F.col("null_cells").alias("raw_nulls")), overall(detected, row_id).select(F.col("null_cells").alias("detected_nulls"))
    return a.join(b, F.lit(True)).withColumn("disguised", F.col("detected_nulls") - F.col("raw_nulls"))


def placeholder_census(freq: DataFrame, tokens=PLACEHOLDERS) -> DataFrame:
    """From value_freq: (column, nulls, null_rate, disguised, distinct_values, fully_empty, sparse) of every column."""
    hit = F.col("value").isNotNull() & text_key(F.col("value")).isin(*tokens)
    n = F.sum("cnt")
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0))
    return freq.groupBy("column").agg(nulls.alias("nulls"), F.round(nulls / n, 4).alias("null_rate"), F.coalesce(F.sum(F.when(hit, F.col("cnt"))), F.lit(0)).alias("disguised"),
                                      F.count("value").alias("distinct_values"), (nulls == n).alias("fully_empty"), (nulls / n > SPARSE).alias("sparse"))


def token_counts(freq: DataFrame, tokens=PLACEHOLDERS) -> DataFrame:
    """From value_freq: how often each placeholder token stands in each column."""
    return freq.where(F.col("value").isNotNull() & text_key(F.col("value")).isin(*tokens)).groupBy("column", text_key(F.col("value")).alias("token")).agg(F.sum("cnt").alias("cells"))


