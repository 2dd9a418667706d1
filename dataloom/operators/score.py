"""Scores and report tables: violations by kind, quality dimensions, reliability, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, ratio, try_number
from .completeness import overall
from .duplicates import exact_duplicates, key_collisions

DIMENSIONS = ("completeness", "uniqueness", "schema_conformity", "validity", "consistency")
KIND_NAMES = ("format", "completeness", "schema", "consistency", "uniqueness")


def kind_of(pattern: Column) -> Column:
    """The kind that a violation's text stands for."""
    return (F.when(pattern.isin("missing value"), "completeness").when(pattern.rlike("^(column name: |sparse column|not coercible to |not nullable|duplicate column)"), "schema")
            .when(pattern.startswith("cross-column:") | pattern.rlike(r"^\S+ = \S+ [+-] \S+$|^(year|month) of "), "consistency").when(pattern.startswith("unique "), "uniqueness").otherwise("format"))


def counts_by_kind(violations: DataFrame) -> DataFrame:
    """(kind, violations) of all five kinds; completeness weighs its rows."""
    kinds = violations.sparkSession.createDataFrame([(k,) for k in KIND_NAMES], "kind string")
    n = violations.groupBy("kind").agg(F.sum(F.when(F.col("kind") == "completeness", F.col("affected_rows")).otherwise(1)).alias("violations"))
    return F.broadcast(kinds).join(n, "kind", "left").select("kind", F.coalesce("violations", F.lit(0)).alias("violations"))


def inconsistent_rows(violations: DataFrame) -> DataFrame:
    """(column_name, rows): distinct rows with consistency violations by column, and in all where column_name is null."""
    return violations.where("kind = 'consistency' and row_id >= 0").rollup("column_name").agg(F.count_distinct("row_id").alias("rows"))


def checked_cells(df: DataFrame, columns: list[str], violations: DataFrame) -> DataFrame:
    """(column, checked, violations): populated cells of the columns that have a specification, and their format violations."""
    one = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("checked")) for i, c in enumerate(columns)])))
    n = violations.where("kind = 'format'").groupBy(F.col("column_name").alias("column")).agg(F.count("*").alias("violations"))
    return cells.join(n, "column", "left").select("column", "checked", F.coalesce("violations", F.lit(0)).alias("violations"))


def metrics(df: DataFrame, row_id: str, violations: DataFrame, specced: list[str], keys: list[str], defective: DataFrame) -> DataFrame:
    """(dimension, value), a row for each dimension; every input is reduced to one row before it is joined."""
    base = overall(df, row_id).select("rows", "columns", F.col("completeness").alias("v_completeness"))
    base = base.join(exact_duplicates(df, row_id).select("duplicates"), F.lit(True))
    conflict = F.lit(0)
    for i, k in enumerate(keys):
        base = base.join(key_collisions(df, row_id, k).select(F.col("rows_in_conflict").alias(f"k{i}")), F.lit(True))
    if keys:
        conflict = F.greatest(*[F.col(f"k{i}") for i in range(len(keys))], F.lit(0))
    base = base.join(defective.agg(F.count_distinct("column").alias("defects")), F.lit(True))
    base = base.join(checked_cells(df, specced, violations).agg(F.sum("checked").alias("checked"), F.sum("violations").alias("bad")), F.lit(True))
    base = base.join(violations.where("kind = 'consistency' and row_id >= 0").agg(F.count_distinct("row_id").alias("odd")), F.lit(True))
    values = {"completeness": F.col("v_completeness"), "uniqueness": ratio(F.col("rows") - F.col("duplicates") - conflict, F.col("rows")), "schema_conformity": ratio(F.col("columns") - F.col("defects"), F.col("columns")),
              "validity": ratio(F.col("checked") - F.col("bad"), F.col("checked")), "consistency": ratio(F.col("rows") - F.col("odd"), F.col("rows"))}
    return base.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("double").alias("value")) for d, v in values.items()])))


def reliability(metric_rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: score, the weighted geometric mean of the dimensions that have a value, and how many do; zero if one is."""
    w = F.lit(1.0)
    for d, x in (weights or {}).items():
        w = F.when(F.col("dimension") == d, F.lit(float(x))).otherwise(w)
    m = metric_rows.where("value is not null").withColumn("w", w)
    mean = F.exp(F.sum(F.when(F.col("value") > 0, F.col("w") * F.log("value"))) / F.sum("w"))
    return m.agg(F.round(F.when(F.min("value") <= 0, 0.0).otherwise(mean), 4).alias("score"), F.count("*").alias("dimensions"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: score_before, score_after, dimensions, over the dimensions that both have."""
    both = before.where("value is not null").select("dimension", F.col("value").alias("b")).join(after.where("value is not null").select("dimension", F.col("value").alias("a")), "dimension")
    x = reliability(both.select("dimension", F.col("b").alias("value"))).select(F.col("score").alias("score_before"), "dimensions")
    return x.join(reliability(both.select("dimension", F.col("a").alias("value"))).select(F.col("score").alias("score_after")), F.lit(True))


def like_for_like(rates: DataFrame, surviving: DataFrame) -> DataFrame:
    """One row: completeness of an earlier snapshot's fill rates over the columns that survive, given as (column, name_after)."""
    kept = rates.join(surviving.where("name_after is not null").select("column"), "column", "left_semi")
    return kept.agg(F.count("*").alias("columns"), ratio(F.sum("total") - F.sum("nulls"), F.sum("total")).alias("completeness"))


def residual(*parts: DataFrame) -> DataFrame:
    """All violations that a delivered dataset still has, by column and kind."""
    return merge_reports(*parts).groupBy("column_name", "kind").agg(F.count("*").alias("violations"), F.sum("affected_rows").alias("rows"))


def merge_reports(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_appendix(diff: DataFrame, types: dict[str, str], rates: DataFrame, detected: DataFrame, outstanding: DataFrame, changes: DataFrame) -> DataFrame:
    """(column, from_name, dtype, completeness, detected, outstanding, changed), a row for each delivered column."""
    kept = diff.where("name_after is not null").select(F.col("name_after").alias("column"), F.col("column").alias("from_name"))
    count = lambda v, n: v.groupBy("column_name").agg(F.sum("affected_rows").alias(n))
    changed = changes.where("scope = 'cell'").groupBy(F.col("column").alias("column_name")).agg(F.count("*").alias("changed"))
    t = kept.sparkSession.createDataFrame(list(types.items()), "column string, dtype string")
    out = kept.join(F.broadcast(t), "column").join(rates.select("column", "completeness"), "column", "left")
    for v, n in ((count(detected, "detected"), "detected"), (changed, "changed")):
        out = out.join(v.withColumnRenamed("column_name", "from_name"), "from_name", "left")
    out = out.join(count(outstanding, "outstanding").withColumnRenamed("column_name", "column"), "column", "left")
    return out.select("column", "from_name", "dtype", "completeness", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("detected", "outstanding", "changed")])


def rule_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule, breaking, remaining) from two rule_counts."""
    j = before.withColumnRenamed("rows", "breaking").join(after.withColumnRenamed("rows", "remaining"), "rule", "full_outer")
    return j.select("rule", F.coalesce("breaking", F.lit(0)).alias("breaking"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


def coverage_table(by_kind: DataFrame, anomalies: DataFrame, groups: DataFrame) -> DataFrame:
    """(area, detected): the six areas of a report."""
    one = by_kind.groupBy().pivot("kind", list(KIND_NAMES)).agg(F.sum("violations"))
    one = one.join(anomalies.agg(F.coalesce(F.sum("detected"), F.lit(0)).alias("anomalies")), F.lit(True)).join(groups.agg(F.count_distinct("group").alias("groups")), F.lit(True))
    areas = {"Schema validation": F.col("schema"), "Completeness": F.col("completeness"), "Consistency": F.col("consistency") + F.col("groups"), "Duplicate detection": F.col("uniqueness"), "Anomaly detection": F.col("anomalies"), "Format validity": F.col("format")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("area"), c.cast("long").alias("detected")) for a, c in areas.items()])))


def recovery(raw: DataFrame, cleaned: DataFrame, key: str, column: str, truth: Column, messy: Column, tolerance: float = 0.011) -> DataFrame:
    """One row: how many messy numbers of raw the cleaned column has right, wrong or lost, and clean ones it changed.

    truth and messy are expressions over raw.
    """
    r = raw.select(col(key).alias("k"), truth.alias("truth"), messy.alias("messy"))
    j = r.join(cleaned.select(col(key).alias("k"), try_number(col(column)).alias("got")), "k").where("truth is not null")
    ok = F.abs(F.col("got") - F.col("truth")) <= tolerance
    return j.agg(F.count_if(F.col("messy") & ok).alias("ok"), F.count_if(F.col("messy") & ~F.coalesce(ok, F.lit(False)) & F.col("got").isNotNull()).alias("wrong"), F.count_if(F.col("messy") & F.col("got").isNull()).alias("lost"), F.count_if(~F.col("messy") & ~F.coalesce(ok, F.lit(False))).alias("overwritten"))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(metric, status) of two metric tables (metric, value): OK, DIFF, MISS (only the first has it) or NEW."""
    j = a.select("metric", F.col("value").alias("x")).join(b.select("metric", F.col("value").alias("y")), "metric", "full_outer")
    return j.select("metric", F.when(F.col("y").isNull(), "MISS").when(F.col("x").isNull(), "NEW").when(F.abs(F.col("x") - F.col("y")) <= tolerance, "OK").otherwise("DIFF").alias("status"))


def check_delivered(appendix: DataFrame, rates: DataFrame, points: float = 0.15) -> DataFrame:
    """(column, problem): stated fill rates that are off by more than 0.15 points, and columns that the report lacks."""
    j = appendix.select("column", F.col("completeness").alias("said")).join(rates.select(F.col("column").alias("c"), F.col("completeness").alias("is")), F.col("column") == F.col("c"), "full_outer")
    problem = F.when(F.col("column").isNull(), "not in the report").when(F.col("c").isNull(), "not in the data").when(F.abs(F.col("said") - F.col("is")) * 100 > points, "fill rate differs")
    return j.select(F.coalesce("column", "c").alias("column"), problem.alias("problem")).where("problem is not null")
