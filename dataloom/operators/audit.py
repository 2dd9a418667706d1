"""Audit: what changed, cell by cell, column by column, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, text, value_freq

CHANGES = "scope string, row_id long, column string, before string, after string, source string"


def _aligned(before: DataFrame, after: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Rows of both, matched by id: a_i, b_i for columns[i], and __a, __b where a side has the row."""
    a = before.select(col(row_id).alias("__id"), F.lit(True).alias("__a"), *[text(col(c)).alias(f"a_{i}") for i, c in enumerate(columns)])
    b = after.select(col(row_id).alias("__id2"), F.lit(True).alias("__b"), *[text(col(c)).alias(f"b_{i}") for i, c in enumerate(columns)])
    return a.join(b, F.col("__id") == F.col("__id2"), "full_outer").withColumn("__id", F.coalesce("__id", "__id2")).drop("__id2")


def cell_diff(before: DataFrame, after: DataFrame, row_id: str, source: str) -> DataFrame:
    """A record for each changed cell of the columns both have, and one of scope row for each row that is gone or new. Null differs from any value; text decides."""
    columns = [c for c in before.columns if c in after.columns and c != row_id]
    j = _aligned(before, after, row_id, columns)
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    record = lambda scope, c, x, y: F.struct(F.lit(scope).alias("scope"), F.lit(c).alias("column"), x.alias("before"), y.alias("after"))
    cells = [F.when(both & ~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), record("cell", c, F.col(f"a_{i}"), F.col(f"b_{i}"))) for i, c in enumerate(columns)]
    cells.append(F.when(~both, record("row", "", F.when(F.col("__a"), F.lit("present")), F.when(F.col("__b"), F.lit("present")))))
    out = j.select("__id", F.inline(F.array_compact(F.array(*cells))))
    return out.select("scope", F.col("__id").cast("long").alias("row_id"), "column", "before", "after", F.lit(source).alias("source"))


def typed_diff(before: DataFrame, after: DataFrame, row_id: str, source: str) -> DataFrame:
    """cell_diff, but a column whose type changed gives one record of scope column with its counts of values."""
    types_a, types_b = dict(before.dtypes), dict(after.dtypes)
    recast = [c for c in before.columns if c != row_id and c in types_b and types_a[c] != types_b[c]]
    out = cell_diff(before.drop(*recast), after.drop(*recast), row_id, source)
    for c in recast:
        n = before.agg(F.count(col(c)).alias("x")).join(after.agg(F.count(col(c)).alias("y")), F.lit(True))
        out = out.unionByName(n.select(F.lit("column").alias("scope"), F.lit(-1).cast("long").alias("row_id"), F.lit(c).alias("column"), F.concat(F.lit(f"{types_a[c]}: "), "x").alias("before"), F.concat(F.lit(f"{types_b[c]}: "), "y").alias("after"), F.lit(source).alias("source")))
    return out


def column_diff(before: DataFrame, after: DataFrame, row_id: str, renames: dict[str, str] | None = None) -> DataFrame:
    """(column, name_after, status, nulls_before, nulls_after, distinct_before, distinct_after), columns matched through renames."""
    def profile(df: DataFrame, tag: str) -> DataFrame:
        f = value_freq(df, row_id)
        nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0))
        counted = f.groupBy("column").agg(nulls.alias(f"nulls_{tag}"), F.count("value").alias(f"distinct_{tag}"))
        names = df.sparkSession.createDataFrame([(c,) for c in df.columns if c != row_id], f"{tag} string")  # also of a table without rows
        counted = names.join(F.broadcast(counted), F.col(tag) == F.col("column"), "left").drop("column")
        return counted.fillna(0, [f"nulls_{tag}", f"distinct_{tag}"])
    pairs = [x for k, v in (renames or {}).items() for x in (F.lit(k), F.lit(v))]
    a = profile(before, "before")
    a = a.withColumn("to", F.coalesce(F.try_element_at(F.create_map(*pairs), "before"), "before") if pairs else F.col("before"))
    j = a.join(profile(after, "after"), F.col("to") == F.col("after"), "full_outer")
    status = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "renamed").otherwise("kept")
    return j.select(F.col("before").alias("column"), F.col("after").alias("name_after"), status.alias("status"), "nulls_before", "nulls_after", "distinct_before", "distinct_after")


def rows_changed(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """One row: rows_before, rows_after, rows_changed (rows that are gone or new count), nulls_before, nulls_after."""
    columns = [c for c in before.columns if c in after.columns and c != row_id]
    j = _aligned(before, after, row_id, columns)
    differs = F.col("__a").isNull() | F.col("__b").isNull()
    for i in range(len(columns)):
        differs = differs | ~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}"))
    nulls = lambda t, here: F.coalesce(F.sum(F.when(F.col(here), sum((F.col(f"{t}_{i}").isNull().cast("int") for i in range(len(columns))), F.lit(0)))), F.lit(0))
    return j.agg(F.count("__a").alias("rows_before"), F.count("__b").alias("rows_after"), F.count_if(differs).alias("rows_changed"), nulls("a", "__a").alias("nulls_before"), nulls("b", "__b").alias("nulls_after"))


def changes_summary(changes: DataFrame) -> DataFrame:
    """(source, column, changes): by both, by source and in all; a null stands for all."""
    return changes.where("scope = 'cell'").rollup("source", "column").agg(F.count("*").alias("changes"))
