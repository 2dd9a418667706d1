"""Repairs: typed operations, trials of them, and the sequence of automatic ones; operators.plan executes approved plans."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import is_period, normalize_date, normalize_number, normalize_period, replace_values, round_number
from ..functions.values import col, strip, text, text_key, try_number, value_freq
from ..sources.shared import cut
from . import audit
from .duplicates import drop_duplicate_rows
from .pair_statistics import key_of
from .profile import castable
from .rules import dominant, pair_counts, period_part, well_formed
from .schema import conforms, normal_name

#: Operations that make a column's new value from its old one alone.
CHANGED_BY_ROW = ("replace_values", "normalize_numeric", "normalize_date", "normalize_period", "strip_whitespace", "round_decimals", "apply_function")
KINDS = ("replace_values", "normalize_numeric", "normalize_date", "normalize_period", "strip_whitespace", "collapse_casing", "round_decimals", "cast_dtype", "impute_from_lookup", "drop_column", "rename_column", "drop_duplicate_rows", "apply_function")
#: Most spellings that a projection looks up by itself, one after the other.
MAPPED_ROWS = 256
#: Most values whose results a worker keeps.
CACHED = 100_000
SPARK_TYPES = {"integer": "long", "float": "double", "datetime": "timestamp", "boolean": "boolean", "string": "string"}


@dataclass(frozen=True)
class Operation:
    """One repair of one column (or of whole rows); args by kind: mapping, digits, dtype, to, predictor, subset, function."""

    kind: str
    column: str = ""
    args: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown operation {self.kind}")


@dataclass(frozen=True)
class Fix:
    id: str
    operations: tuple[Operation, ...]
    depends_on: tuple[str, ...] = ()

    def fingerprint(self) -> str:
        return json.dumps([(o.kind, o.column, {k: str(v) for k, v in sorted(o.args.items())}) for o in self.operations])

    def columns(self) -> list[str]:
        return list(dict.fromkeys(o.column for o in self.operations if o.column))


def replace_from_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """replace_values for a mapping table (old, new) of any size."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"), F.lit(True).alias("__hit"))
    out = df.join(m, text(col(column)) == F.col("__old"), "left")
    return out.select(*[F.when(F.col("__hit"), F.col("__new")).otherwise(text(col(c))).alias(c) if c == column else col(c) for c in df.columns])


def casing_map(freq: DataFrame, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """From value_freq: (column, value, to): spellings that differ by case and outer white space only, and the one they become.

    That is the declared enum's if it has one, else the most frequent, ties to the smallest. Only spellings that change are listed.
    """
    f = freq.where("value is not null").select("column", "value", "cnt", text_key(F.col("value")).alias("key"))
    if enums:
        declared = [(c, v) for c, vs in enums.items() for v in vs]
        e = F.broadcast(f.sparkSession.createDataFrame(declared, "column string, declared string").withColumn("key", text_key(F.col("declared"))).groupBy("column", "key").agg(F.min("declared").alias("declared")))
        f = f.join(e, ["column", "key"], "left")
    else:
        f = f.withColumn("declared", F.lit(None).cast("string"))
    best = f.groupBy("column", "key").agg(F.coalesce(F.max("declared"), F.min(F.struct((-F.col("cnt")).alias("c"), "value"))["value"]).alias("to"))
    return f.join(best, ["column", "key"]).where("value <> to").select("column", "value", "to")


def collapse_casing(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """df with the spellings of casing_map replaced in the columns.

    All columns at once: cells meet the mapping in one join by (column, value), those that change are folded to one map a
    row, and one projection takes them from there; Spark may split frequent values. Up to MAPPED_ROWS spellings are values
    of the projection itself, and nothing is joined.
    """
    columns = [c for c in columns if c in df.columns]
    mapping = cut(mapping.where(F.col("column").isin(*(columns or [""]))).select("column", "value", "to"))
    n = mapping.count()
    if not columns or not n:
        return df
    some = {r["column"] for r in mapping.select("column").distinct().collect()}  # names of columns
    columns = [c for c in columns if c in some]
    if n <= MAPPED_ROWS:
        maps = {c: mapping.where(F.col("column") == c).agg(F.map_from_entries(F.collect_list(F.struct("value", "to")))).scalar() for c in columns}
        return df.select(*[F.coalesce(F.try_element_at(maps[c], text(col(c))), text(col(c))).alias(c) if c in maps else col(c) for c in df.columns])
    tag = f"__{uuid.uuid4().hex[:8]}"
    rows = cut(df.select("*", F.monotonically_increasing_id().alias(tag)))
    cells = rows.select(tag, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(col(c)).alias("value")) for c in columns]))).where("value is not null")
    found = cells.join(mapping, ["column", "value"]).groupBy(tag).agg(F.map_from_entries(F.collect_list(F.struct("column", "to"))).alias(f"{tag}m"))
    out = rows.join(found, tag, "left")
    return out.select(*[F.coalesce(F.try_element_at(F.col(f"{tag}m"), F.lit(c)), text(col(c))).alias(c) if c in columns else col(c) for c in df.columns])


def cast_column(c: Column, dtype: str) -> Column:
    """The value in the type; null where it has no reading as one."""
    if dtype == "datetime":
        return normalize_date(c)
    if dtype == "string":
        return text(c)
    if dtype == "boolean":
        return F.when(F.lower(text(c)).isin("true", "false"), F.lower(text(c)) == "true")
    return F.when(castable(text(c), F.lit(dtype)), try_number(c)).cast(SPARK_TYPES[dtype])


def blocking_rows(df: DataFrame, row_id: str, column: str, dtype: str) -> DataFrame:
    """(row_id, value) that keep the column from being cast without loss."""
    return df.where(col(column).isNotNull() & cast_column(col(column), dtype).isNull()).select(col(row_id).alias("row_id"), text(col(column)).alias("value"))


def safe_cast(df: DataFrame, column: str, dtype: str, precision: int | None = None) -> DataFrame:
    """df with the column cast, or as it is if a value would be lost or a column of months would get days.

    A float that is recorded with precision 0 becomes an integer, if none of its values has a fraction.
    """
    return safe_casts(df, {column: dtype}, {column: precision})


def states_month(c: Column) -> Column:
    """Whether a text is a year and a month without a day."""
    return text(c).rlike(r"\A(?:\d{4}[-/.]?\d{2}|\d{2}[-/.]\d{4})\z")


def whole_number(c: Column) -> Column:
    """Whether a value isn't a number with a fraction."""
    return F.coalesce(try_number(c) % 1 == 0, F.lit(True))


def safe_casts(df: DataFrame, dtypes: dict[str, str], precisions: dict[str, int | None] | None = None) -> DataFrame:
    """safe_cast of several columns: one aggregate tells for all of them whether they may be cast."""
    dtypes = {c: t for c, t in dtypes.items() if c in df.columns}
    if not dtypes:
        return df
    aggs = []
    for i, (c, t) in enumerate(dtypes.items()):
        x = col(c)
        aggs += [F.count_if(x.isNotNull() & cast_column(x, t).isNull()).alias(f"lost{i}"), F.bool_and(states_month(x)).alias(f"month{i}"), F.count_if(~whole_number(x)).alias(f"fractions{i}")]
    got = df.agg(*aggs).first()
    new = {}
    for i, (c, t) in enumerate(dtypes.items()):
        whole = t == "float" and (precisions or {}).get(c) == 0 and not got[f"fractions{i}"]
        if not got[f"lost{i}"] and not (t == "datetime" and got[f"month{i}"]):
            new[c] = cast_column(col(c), "integer" if whole else t)
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def impute(df: DataFrame, target: str, predictor: str, mapping: DataFrame, normalized: bool = False, temporal=()) -> DataFrame:
    """df with null targets taken from mapping (key, value) by the predictor, 'a|b' for two; keys are made as they were when mined."""
    key = key_of(predictor, frozenset(temporal), df.columns)
    key = text_key(key) if normalized else key
    tag = f"__{uuid.uuid4().hex[:8]}"
    # Rows that need nothing join with nothing, so a frequent key is no hot spot.
    m = mapping.select(F.col("key").alias(f"{tag}k"), F.col("value").alias(f"{tag}v"))
    out = df.join(m, F.when(col(target).isNull(), key) == F.col(f"{tag}k"), "left")
    return out.select(*[F.coalesce(text(col(target)), F.col(f"{tag}v")).alias(target) if c == target else col(c) for c in df.columns])


def vectorised(function: Callable, most: int = CACHED) -> Callable[[Column], Column]:
    """A trusted Python function of one text as a Column expression, null for null.

    It is called for the distinct values of a batch that aren't among up to `most` that the worker has kept; when more come
    the kept ones are dropped. Row by row in effect, so it serves batches and streams alike.
    """
    kept: dict[str, str | None] = {}

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, found = pd.factorize(values)
        new = np.empty(len(found) + 1, object)
        new[-1] = None  # of nulls, whose code is -1
        for i, v in enumerate(found):
            if v not in kept:
                if len(kept) >= most:
                    kept.clear()
                got = function(v)
                kept[v] = None if got is None else str(got)
            new[i] = kept[v]
        return pd.Series(new[codes], dtype=object)

    return lambda c: run(text(c))


def apply_function(df: DataFrame, column: str, function: Callable) -> DataFrame:
    """df with a trusted Python function applied to the column's non-null values; batch or stream."""
    new = vectorised(function)(col(column))
    return df.select(*[new.alias(c) if c == column else col(c) for c in df.columns])


def check_function(samples: DataFrame, function: Callable, dtype: str) -> DataFrame:
    """(value, conforming, issue) for samples (value, conforming): a conforming value must stay, a violating one must change and become null or a value of the type; exceptions are issues."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["value"]:
                try:
                    v = function(x)
                    out.append((None if v is None else str(v), None))
                except Exception as e:  # noqa: BLE001 - any failure of the supplied function is a finding
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield b.assign(new=[o[0] for o in out], error=[o[1] for o in out])
    got = samples.select("value", "conforming").mapInPandas(run, "value string, conforming boolean, new string, error string")
    issue = (F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("conforming") & ~F.col("new").eqNullSafe(F.col("value")), "changes a conforming value")
             .when(~F.col("conforming") & F.col("new").eqNullSafe(F.col("value")), "leaves a violating value").when(~F.col("conforming") & F.col("new").isNotNull() & ~F.coalesce(castable(F.col("new"), F.lit(dtype)), F.lit(False)), f"result is no {dtype}"))
    return got.select("value", "conforming", issue.alias("issue")).where("issue is not null")


def example_split(freq: DataFrame, violations: DataFrame, column: str, most: int = 8) -> DataFrame:
    """(value, conforming, rank): up to 8 distinct values of a column that violations name, and 8 that none does, most frequent first."""
    bad = violations.where((F.col("column_name") == column) & F.col("value").isNotNull()).select(F.col("value").alias("v")).distinct().withColumn("hit", F.lit(True))
    f = freq.where((F.col("column") == column) & F.col("value").isNotNull()).join(bad, F.col("value") == F.col("v"), "left").select("value", "cnt", F.col("hit").isNull().alias("conforming"))
    w = Window.partitionBy("conforming").orderBy(F.desc("cnt"), "value")
    return f.select("value", "conforming", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def vet_function(freq: DataFrame, violations: DataFrame, column: str, function: Callable, dtype: str, most: int = 8) -> DataFrame:
    """(value, conforming, issue): what speaks against a supplied function for a column; empty if nothing does.

    It runs on the column's examples. Where no violation tells conforming values from others it runs on the column's most
    frequent values, of which only exceptions count. A column without any value refuses the function: nothing shows that it works.
    """
    named = violations.where((F.col("column_name") == column) & F.col("value").isNotNull()).limit(1).count()
    if named:
        samples = example_split(freq, violations, column, most).select("value", "conforming")
    else:
        samples = freq.where((F.col("column") == column) & F.col("value").isNotNull()).orderBy(F.desc("cnt"), "value").limit(most).select("value", F.lit(None).cast("boolean").alias("conforming"))
    if not samples.limit(1).count():
        return freq.sparkSession.createDataFrame([(None, None, f"not validated: {column} has no value to run on")], "value string, conforming boolean, issue string")
    return check_function(samples, function, dtype)


def derive_part(df: DataFrame, period: str, column: str, part: str) -> DataFrame:
    """df with the column's values that aren't well formed taken from a canonical period. Row-local."""
    want = period_part(col(period), part)
    return df.select(*[F.when(~well_formed(col(column), part) & want.isNotNull(), want).otherwise(text(col(column))).alias(c) if c == column else col(c) for c in df.columns])


def complete_period(df: DataFrame, period: str, predictor: str, least: float = 0.99) -> DataFrame:
    """df with non-canonical periods taken from the column that determines them, if its canonical ones do for 0.99 of the rows."""
    canonical = df.select(*[F.when(is_period(col(period)), strip(col(period))).alias(period) if c == period else col(c) for c in df.columns])
    d = dominant(pair_counts(canonical, [(predictor, period)]))
    mapping = d.where(F.col("top_cnt") >= 0.95 * F.col("size")).select("key", F.col("top").alias("value"))
    got = d.agg((F.sum("top_cnt") / F.sum("size")).alias("p")).first()
    if got["p"] is None or got["p"] < least:
        return df
    m = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    out = df.join(m, F.when(~is_period(col(period)), text(col(predictor))) == F.col("__key"), "left")
    return out.select(*[F.coalesce(F.col("__value"), text(col(period))).alias(period) if c == period else col(c) for c in df.columns])


def rewritten(op: Operation, c: Column) -> Column:
    """What an operation that looks at one value makes of it."""
    return {"replace_values": lambda: replace_values(c, op.args["mapping"]), "normalize_numeric": lambda: normalize_number(c), "normalize_period": lambda: normalize_period(c), "strip_whitespace": lambda: strip(c),
            "round_decimals": lambda: round_number(c, op.args["digits"], try_number(c)), "normalize_date": lambda: F.coalesce(F.date_format(normalize_date(c), "yyyy-MM-dd"), text(c)),
            "apply_function": lambda: vectorised(op.args["function"])(c)}[op.kind]()


def apply_operation(df: DataFrame, row_id: str, op: Operation, hints: dict[str, DataFrame] | None = None) -> DataFrame:
    """df after one operation; one on a column that isn't there does nothing."""
    if op.kind == "drop_duplicate_rows":
        return drop_duplicate_rows(df, row_id, op.args.get("subset"))
    if op.column not in df.columns:
        return df
    if op.kind == "drop_column":
        return df.drop(op.column)
    if op.kind == "rename_column":
        to = op.args.get("to", "")
        return df.withColumnRenamed(op.column, to) if to and to not in df.columns else df
    if op.kind == "cast_dtype":
        return safe_cast(df, op.column, op.args["dtype"], op.args.get("precision"))
    if op.kind == "impute_from_lookup":
        return impute(df, op.column, op.args["predictor"], hints[op.column], op.args.get("normalized", False), op.args.get("temporal", ())) if hints and op.column in hints else df
    if op.kind == "collapse_casing":
        return collapse_casing(df, casing_map(value_freq(df, row_id, [op.column]), op.args.get("enums")), [op.column])
    new = rewritten(op, col(op.column))
    return df.select(*[new.alias(n) if n == op.column else col(n) for n in df.columns])


def apply_fix(df: DataFrame, row_id: str, fix: Fix, hints: dict[str, DataFrame] | None = None) -> DataFrame:
    for op in fix.operations:
        df = apply_operation(df, row_id, op, hints)
    return df


def trial(df: DataFrame, row_id: str, fix: Fix, hints: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row: what a fix would do: rows before and after, rows changed, nulls before and after. Nothing is kept."""
    after = apply_fix(df, row_id, fix, hints)
    return audit.rows_changed(df, after, row_id)


def trial_diff(df: DataFrame, row_id: str, fix: Fix, hints: dict[str, DataFrame] | None = None, most: int = 8) -> DataFrame:
    """The first cells, in row and column order, that a fix would change, for display: (rank, row_id, column, before, after)."""
    changed = audit.cell_diff(df, apply_fix(df, row_id, fix, hints), row_id, fix.id).orderBy("row_id", "column").limit(most)
    return changed.select(F.row_number().over(Window.orderBy("row_id", "column")).alias("rank"), "row_id", "column", "before", "after")


def violation_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, before, after, delta) from the violations of the data before and after a trial; each counts its affected rows."""
    count = lambda v, name: v.groupBy("column_name").agg(F.sum("affected_rows").alias(name))
    both = count(before, "before").join(count(after, "after"), "column_name", "full").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def schema_proposals(violations: DataFrame, columns: list[str]) -> DataFrame:
    """(column, action, to) from schema violations: drop a sparse column, rename a badly named one unless its new name is taken."""
    v = violations.where("kind = 'schema'")
    drops = v.where("expected_pattern = 'sparse column'").select(F.col("column_name").alias("column"), F.lit("drop_column").alias("action"), F.lit(None).cast("string").alias("to"))
    names = v.where(F.col("expected_pattern").startswith("column name: ")).select(F.col("column_name").alias("column"), F.lit("rename_column").alias("action"), F.regexp_replace("expected_pattern", "^column name: ", "").alias("to"))
    return drops.unionByName(names.where(~F.col("to").isin(*columns)).join(drops.select("column"), "column", "left_anti"))


def aggregate_violations(violations: DataFrame, most: int = 25) -> DataFrame:
    """(column_name, entry, rank, count): violations by pattern, the 25 most frequent of a column, and what is left by kind; schema and uniqueness are left out."""
    v = violations.where("kind not in ('schema', 'uniqueness')").groupBy("column_name", "kind", "expected_pattern").agg(F.sum(F.when(F.col("kind") == "completeness", F.col("affected_rows")).otherwise(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "expected_pattern")
    v = v.withColumn("rank", F.row_number().over(w))
    head = v.where(F.col("rank") <= most).select("column_name", F.col("expected_pattern").alias("entry"), "rank", F.col("n").alias("count"))
    tail = v.where(F.col("rank") > most).groupBy("column_name", "kind").agg(F.sum("n").alias("count")).select("column_name", F.concat(F.lit("further "), "kind").alias("entry"), F.lit(most + 1).alias("rank"), "count")
    return head.unionByName(tail)


def evidence_rows(df: DataFrame, row_id: str, violations: DataFrame, columns: list[str], dirty: int = 10, clean: int = 5) -> DataFrame:
    """Rows of the columns for display: up to 10 with violations in them, up to 5 that are populated in all and have none."""
    bad = violations.where(F.col("column_name").isin(*columns) & (F.col("row_id") >= 0)).select(F.col("row_id").alias("__r")).distinct()
    some = df.select(col(row_id).alias("row_id"), *[text(col(c)).alias(c) for c in columns])
    a = some.join(bad, F.col("row_id") == F.col("__r"), "left_semi").orderBy("row_id").limit(dirty).withColumn("dirty", F.lit(True))
    full = some.where(" and ".join(f"`{c}` is not null" for c in columns))
    b = full.join(bad, F.col("row_id") == F.col("__r"), "left_anti").orderBy("row_id").limit(clean).withColumn("dirty", F.lit(False))
    return a.unionByName(b)


def unaddressed(violations: DataFrame, planned: list[str]) -> DataFrame:
    """(column_name, rows, reason): columns with violations that no fix of the plan touches."""
    v = violations.where(~F.col("column_name").isin(*(planned or [""])))
    return v.groupBy("column_name").agg(F.sum("affected_rows").alias("rows"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).withColumn("reason", F.concat(F.lit("no fix for "), "kinds")).drop("kinds")


def refresh(violations: DataFrame, touched: list[str], recomputed: DataFrame) -> DataFrame:
    """violations after a repair: those of touched columns and all of kind consistency are replaced by the recomputed ones."""
    return violations.where(~F.col("column_name").isin(*(touched or [""])) & (F.col("kind") != "consistency")).unionByName(recomputed)


def auto_remediate(df: DataFrame, row_id: str, period: str | None = None, parts: dict[str, str] | None = None, rounding: dict[str, int] | None = None, determined_by: str | None = None, hints: list[tuple[str, str, DataFrame, bool]] = (), cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The repairs that need no approval, in order: periods, their parts, excess digits, periods from another column, pure hints.

    Steps that only rewrite a row fuse into one projection; `cut` is called before a step that aggregates what they wrote.
    """
    if period:
        df = apply_operation(df, row_id, Operation("normalize_period", period))
        for part, c in (parts or {}).items():
            df = derive_part(df, period, c, part)
    for c, digits in (rounding or {}).items():
        df = apply_operation(df, row_id, Operation("round_decimals", c, {"digits": digits}))
    if period and determined_by:
        df = complete_period(cut(df), period, determined_by)
    for target, predictor, mapping, normalized in hints:
        df = impute(df, target, predictor, mapping, normalized)
    return df


def rewritten_columns(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """(column, rows_rewritten, filled, example_before, example_after): a row for each column that the automatic repairs rewrote; the example is of the first row."""
    cells = audit.cell_diff(before, after, row_id, "auto").where("scope = 'cell'")
    first = F.min(F.struct("row_id", "before", "after"))
    return cells.groupBy("column").agg(F.count("*").alias("rows_rewritten"), F.count_if(F.col("before").isNull()).alias("filled"), first["before"].alias("example_before"), first["after"].alias("example_after"))


def realigned(about: dict, renames: dict[str, str], columns: list[str]) -> dict:
    """What is known by column name (types, specifications, roles) under the names after a repair; of columns that are gone nothing is kept."""
    return {renames.get(c, c): v for c, v in about.items() if renames.get(c, c) in columns}


def rename_candidates(columns: list[str], spark) -> DataFrame:
    """(column, to) of names against the convention."""
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    return names.where(~conforms(F.col("column"))).select("column", normal_name(F.col("column")).alias("to"))


def sweep(df: DataFrame, row_id: str, dtypes: dict[str, str], freq: DataFrame, renames: dict[str, str] | None = None, precisions: dict[str, int] | None = None) -> DataFrame:
    """What follows the approved fixes: one spelling a value in all text columns, then the declared types where nothing is lost.

    dtypes and precisions may still have the names from before the renames.
    """
    dtypes, precisions = realigned(dtypes, renames or {}, df.columns), realigned(precisions or {}, renames or {}, df.columns)
    texts = [c for c, t in df.dtypes if t == "string" and c != row_id]
    out = collapse_casing(df, casing_map(freq), texts)
    return safe_casts(out, dtypes, precisions)
