"""Format validity: specifications as predicates, all columns validated in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import col, full_match, text, try_date, try_number
from .completeness import violation_rows

#: Allowed sets up to this size become a predicate; larger ones are joined.
MOST_LITERALS = 1_000


@dataclass(frozen=True)
class Spec:
    """What a column's values look like: kind enum, regex, range or date."""

    kind: str
    values: tuple[str, ...] = ()
    pattern: str = ""
    low: float | None = None
    high: float | None = None

    def valid(self, c: Column) -> Column:
        """Whether a non-null value conforms; never null for one."""
        if self.kind == "enum":
            return text(c).isin(*self.values)
        if self.kind == "regex":
            return full_match(c, self.pattern)
        if self.kind == "range":
            x = try_number(c)
            ok = x.isNotNull()
            for bound, test in ((self.low, x >= F.lit(self.low)), (self.high, x <= F.lit(self.high))):
                ok = ok & F.coalesce(test, F.lit(False)) if bound is not None else ok
            return ok
        if self.kind == "date":
            return try_date(c, self.pattern).isNotNull()
        raise ValueError(f"unknown format kind {self.kind}")

    def says(self) -> str:
        return {"enum": "|".join(self.values), "regex": self.pattern, "range": f"{self.low}..{self.high}", "date": self.pattern}[self.kind]


def validate(df: DataFrame, row_id: str, specs: dict[str, Spec]) -> DataFrame:
    """Violations of all specs in one scan without a shuffle; row-local, so it takes streams too. Timestamps satisfy date specs."""
    types = dict(df.dtypes)
    cells = []
    for n, spec in specs.items():
        if n not in types or (spec.kind == "date" and types[n].startswith(("timestamp", "date"))):
            continue
        bad = col(n).isNotNull() & ~spec.valid(col(n))
        cells.append(F.when(bad, F.struct(F.lit(n).alias("column"), text(col(n)).alias("value"), F.lit(spec.says()).alias("spec"))))
    if not cells:
        cells = [F.lit(None).cast("struct<column:string,value:string,spec:string>")]
    found = df.select(col(row_id).alias("row_id"), F.inline(F.array_compact(F.array(*cells))))
    return violation_rows(found, "column", F.col("row_id"), F.col("value"), F.col("spec"), "format", F.lit(1))


def outside_large_set(df: DataFrame, row_id: str, column: str, allowed: DataFrame) -> DataFrame:
    """Enum violations where the allowed values (value) are a table; Spark broadcasts it only if it is small."""
    bad = df.where(col(column).isNotNull()).select(col(row_id).alias("row_id"), text(col(column)).alias("value")).join(allowed.select("value").distinct(), "value", "left_anti")
    return violation_rows(bad.withColumn("column", F.lit(column)), "column", F.col("row_id"), F.col("value"), F.lit("not in table"), "format", F.lit(1))


def not_yet_reported(found: DataFrame, known: DataFrame) -> DataFrame:
    """Violations of rows that their column has no violation for yet."""
    return found.join(known.select("column_name", "row_id"), ["column_name", "row_id"], "left_anti")


def offenders(violations: DataFrame, most: int = 100) -> DataFrame:
    """(column_name, rank, value): distinct offending values of each column in value order."""
    w = Window.partitionBy("column_name").orderBy("value")
    values = violations.where("kind = 'format'").select("column_name", "value").distinct()
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def valid_sample(freq: DataFrame, specs: dict[str, Spec], most: int = 10) -> DataFrame:
    """From value_freq: (column, rank, value): conforming values, the most frequent first."""
    ok = F.lit(False)
    for n, spec in specs.items():
        ok = F.when(F.col("column") == n, spec.valid(F.col("value"))).otherwise(ok)
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    return freq.where(F.col("value").isNotNull() & ok).select("column", "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def safe_corrections(freq: DataFrame, corrections: DataFrame, most: float = 0.02) -> DataFrame:
    """corrections (column, old, new) without the deletions (new is null) of a column if they would touch more than `most` of its values."""
    populated = freq.where("value is not null").groupBy("column").agg(F.sum("cnt").alias("populated"))
    touched = corrections.where("new is null").join(freq, (corrections["column"] == freq["column"]) & (corrections["old"] == freq["value"])).groupBy(corrections["column"]).agg(F.sum("cnt").alias("touched"))
    over = touched.join(populated, "column").where(F.col("touched") > most * F.col("populated")).select("column")
    return corrections.where("new is not null").unionByName(corrections.where("new is null").join(over, "column", "left_anti"))


def drift(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, dominant_share, offending): text whose dominant mask holds half of the values or more but not all, the rest under a fifth."""
    mask = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Za-z]", "a")
    m = freq.where("value is not null").groupBy("column", mask.alias("mask")).agg(F.sum("cnt").alias("cnt"))
    t = m.groupBy("column").agg(F.max("cnt").alias("top"), F.sum("cnt").alias("n"), F.count("*").alias("masks"))
    ok = (F.col("masks") > 1) & (F.col("top") >= 0.5 * F.col("n")) & (F.col("n") - F.col("top") < 0.2 * F.col("n"))
    return t.where(ok).select("column", F.round(F.col("top") / F.col("n"), 4).alias("dominant_share"), (F.col("n") - F.col("top")).alias("offending"))


def dtype_census(freq: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """From value_freq: (column, verdict, numeric_rate) of text columns that are mostly or wholly numbers and float columns of whole numbers."""
    x = try_number(F.col("value"))
    n = F.sum("cnt")
    t = freq.where("value is not null").groupBy("column").agg((F.sum(F.when(x.isNotNull(), F.col("cnt")).otherwise(0)) / n).alias("rate"), F.bool_and(x.isNull() | (x == F.floor(x))).alias("whole"))
    is_text = F.col("column").isin(*[c for c, t in dtypes.items() if t == "string"] or [""])
    is_float = F.col("column").isin(*[c for c, t in dtypes.items() if t in ("double", "float")] or [""])
    verdict = F.when(is_text & (F.col("rate") >= 1), "text holding only numbers").when(is_text & (F.col("rate") > 0.5), "numbers with malformed values").when(is_float & F.col("whole"), "float holding only integers")
    return t.select("column", verdict.alias("verdict"), F.round("rate", 4).alias("numeric_rate")).where("verdict is not null")


