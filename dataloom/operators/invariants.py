"""What a fix must not do: lose rows, invent values, delete values, split spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, text, text_key

MOST_MISSING, MOST_DELETED = 0.5, 0.02


def measures(before: DataFrame, after: DataFrame, row_id: str, columns: list[str], removable: dict[str, list[str]] | None = None) -> DataFrame:
    """(column, rows, nulls_before, nulls_after, populated, deleted, split_before, split_after) of the columns both have, from one join on the row id.

    deleted: values that became null and aren't removable. split: distinct spellings less distinct values without case and
    outer white space; over rows of either side.
    """
    names = [c for c in columns if c in before.columns and c in after.columns]
    if not names:
        return before.sparkSession.createDataFrame([], "rows long, column string, nulls_before long, nulls_after long, populated long, deleted long, split_before long, split_after long")
    a = before.select(col(row_id).alias("__id"), *[text(col(c)).alias(f"a{i}") for i, c in enumerate(names)])
    b = after.select(col(row_id).alias("__id"), F.lit(True).alias("__b"), *[text(col(c)).alias(f"b{i}") for i, c in enumerate(names)])
    j = a.join(b, "__id", "left")
    aggs = [F.count("*").alias("rows"), F.count("__b").alias("kept")]
    for i, c in enumerate(names):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        gone = x.isNotNull() & y.isNull() & F.col("__b")
        allowed = (removable or {}).get(c)
        aggs += [F.count_if(x.isNull()).alias(f"nb{i}"), F.count_if(y.isNull() & F.col("__b")).alias(f"na{i}"), F.count(x).alias(f"p{i}"), F.count_if(gone & ~x.isin(*allowed) if allowed else gone).alias(f"d{i}")]
    one = j.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in (("nb", "nulls_before"), ("na", "nulls_after"), ("p", "populated"), ("d", "deleted"))]) for i, c in enumerate(names)])
    one = one.select("rows", F.inline(cells))
    # Distinct spellings by aggregating (column, value), not by a distinct count a column, which would multiply the table.
    counts = None
    for side, df in (("before", before), ("after", after)):
        found = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(col(c)).alias("value")) for c in names]))).where("value is not null")
        found = found.groupBy("column", "value").agg(F.lit(1)).groupBy("column", text_key(F.col("value")).alias("key")).agg((F.count("*") - 1).alias("more")).groupBy("column").agg(F.sum("more").alias(f"split_{side}"))
        counts = found if counts is None else counts.join(found, "column", "full")
    out = one.join(F.broadcast(counts), "column", "left")
    return out.select("rows", "column", "nulls_before", "nulls_after", "populated", "deleted", *[F.coalesce(f"split_{side}", F.lit(0)).cast("long").alias(f"split_{side}") for side in ("before", "after")])


def row_count(before: DataFrame, after: DataFrame, dedup_declared: bool) -> DataFrame:
    """(column, failure): at most one row."""
    n = before.agg(F.count("*").alias("x")).join(after.agg(F.count("*").alias("y")), F.lit(True))
    bad = n.where("x <> y") if not dedup_declared else n.where("false")
    return bad.select(F.lit("").alias("column"), F.lit("row count changed").alias("failure"))


def invented(m: DataFrame, hinted) -> DataFrame:
    """Filled nulls of a column that was more than half empty, or without a hint for it."""
    filled = F.col("nulls_before") - F.col("nulls_after")
    sparse = F.col("nulls_before") > MOST_MISSING * F.col("rows")
    bad = m.where((filled > 0) & (sparse | ~F.col("column").isin(*(list(hinted) or [""]))))
    return bad.select("column", F.concat("column", F.when(sparse, F.lit(": filled a sparse column")).otherwise(F.lit(": filled without a hint"))).alias("failure"))


def deleted(m: DataFrame) -> DataFrame:
    return m.where(F.col("deleted") > MOST_DELETED * F.col("populated")).select("column", F.concat("column", F.lit(": deleted values")).alias("failure"))


def split(m: DataFrame) -> DataFrame:
    return m.where("split_after > split_before").select("column", F.concat("column", F.lit(": split spellings")).alias("failure"))


def failures(measured: list[dict], hinted=()) -> list[tuple[str, str]]:
    """(column, failure) of what measures say of each column; as invented, deleted and split do on frames."""
    out = []
    for m in measured:
        c, sparse = m["column"], m["nulls_before"] > MOST_MISSING * m["rows"]
        if m["nulls_before"] > m["nulls_after"] and (sparse or c not in (hinted or ())):
            out.append((c, f"{c}: filled a sparse column" if sparse else f"{c}: filled without a hint"))
        if m["deleted"] > MOST_DELETED * m["populated"]:
            out.append((c, f"{c}: deleted values"))
        if m["split_after"] > m["split_before"]:
            out.append((c, f"{c}: split spellings"))
    return out


def check(before: DataFrame, after: DataFrame, row_id: str, columns: list[str], dedup_declared: bool = False, hinted=(), removable: dict[str, list[str]] | None = None) -> DataFrame:
    """(column, failure): every invariant that a fix of the columns breaks; empty if it may stay."""
    out = row_count(before, after, dedup_declared)
    if any(c in before.columns and c in after.columns for c in columns):
        m = measures(before, after, row_id, columns, removable)
        out = out.unionByName(invented(m, hinted)).unionByName(deleted(m)).unionByName(split(m))
    return out
