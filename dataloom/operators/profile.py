"""Column profiles: counts, numeric and temporal readings, roles, precision, inferred format specifications."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_date, normalize_number
from ..functions.values import CANONICAL_PERIOD, PLACEHOLDERS, SPEC_DATES, col, full_match, text, text_key, try_date, try_number, with_total, texts

FEW = 30
DOMINANT, RARE, LEAST_VALUES = 0.85, 0.01, 5
TEMPORAL = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
KEY_WORDS = ("code", "identifier", "id ", " id", "key", "codice")
MOST_DIGITS = 6


def column_profile(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, position, rows, populated, nulls, distinct, cardinality)."""
    populated = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0))
    out = freq.groupBy("column", "position").agg(F.sum("cnt").alias("rows"), populated.alias("populated"), F.count("value").alias("distinct"))
    return out.withColumn("nulls", F.col("rows") - F.col("populated")).withColumn("cardinality", F.when(F.col("populated") > 0, F.round(F.col("distinct") / F.col("populated"), 4)))


def column_sample(freq: DataFrame, most: int = 30) -> DataFrame:
    """From value_freq: (column, rank, value), a reproducible sample of each column's distinct values by hash."""
    w = Window.partitionBy("column").orderBy(F.md5("value"), "value")
    return freq.where("value is not null").select("column", "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def column_head(df: DataFrame, row_id: str, most: int = 5) -> DataFrame:
    """(column, rank, value): the first values of each column in row order, nulls left out."""
    w = Window.partitionBy("column").orderBy("row_id")
    return texts(df, row_id).where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("column", "rank", "value")


def first_distinct(df: DataFrame, row_id: str, most: int = 150) -> DataFrame:
    """(column, rank, value): the first distinct values of each column in the order in which they appear."""
    seen = texts(df, row_id).where("value is not null").groupBy("column", "value").agg(F.min("row_id").alias("first"))
    w = Window.partitionBy("column").orderBy("first")
    return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("column", "rank", "value")


def numeric_share(freq: DataFrame) -> DataFrame:
    """From value_freq: the share of each column's populated values that read as numbers once human notation is undone; numeric from 0.9 on."""
    reads = try_number(normalize_number(F.col("value"))).isNotNull()
    out = freq.where("value is not null").groupBy("column").agg(F.round(F.sum(F.when(reads, F.col("cnt")).otherwise(0)) / F.sum("cnt"), 4).alias("share"))
    return out.withColumn("numeric", F.col("share") >= 0.9)


def castable(value, dtype):
    """Whether a text value survives an exact cast to the type family."""
    number = try_number(value)
    return (F.when(dtype == "integer", number.isNotNull() & (number == F.floor(number))).when(dtype == "float", number.isNotNull())
            .when(dtype == "datetime", normalize_date(value).isNotNull()).when(dtype == "boolean", F.lower(value).isin("true", "false")).otherwise(F.lit(True)))


def reconcile_dtype(freq: DataFrame, suggested: dict[str, str], inferred: dict[str, str]) -> DataFrame:
    """From value_freq: (column, dtype): the suggestion, if all values cast to it exactly or 0.9 of all rows, nulls included, do as numbers or dates; else what was inferred."""
    want = _lookup(suggested)
    base = freq.withColumn("want", want).withColumn("have", _lookup(inferred))
    fits = F.col("value").isNull() | castable(F.col("value"), F.col("want"))
    number, date = try_number(F.col("value")).isNotNull(), normalize_date(F.col("value")).isNotNull()
    out = base.groupBy("column", "want", "have").agg(F.bool_and(fits).alias("exact"), (F.sum(F.when(number, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("numbers"), (F.sum(F.when(date, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("dates"))
    took = F.col("want").isNotNull() & (F.col("want") != F.col("have")) & (F.col("exact") | (F.col("want").isin("integer", "float") & (F.col("numbers") >= 0.9)) | ((F.col("want") == "datetime") & (F.col("dates") >= 0.9)))
    return out.select("column", F.when(took, F.col("want")).otherwise(F.col("have")).alias("dtype"))


def _lookup(values: dict[str, str]):
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.col("column")) if pairs else F.lit(None).cast("string")


def column_roles(freq: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """From value_freq: (column, role): skip, identifier, temporal, code, measure, category or free_text."""
    prof = column_profile(freq)
    reads = try_number(normalize_number(F.col("value"))).isNotNull()
    shares = freq.where("value is not null").groupBy("column").agg((F.sum(F.when(reads, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("num"), (F.sum(F.when(F.col("value").rlike(f"^{TEMPORAL}"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("tmp"))
    said = F.lower(F.coalesce(_lookup(descriptions or {}), F.lit("")))
    is_key = F.lit(False)
    for w in KEY_WORDS:
        is_key = is_key | said.contains(w)
    role = (F.when(F.col("populated") == 0, "skip").when(F.col("distinct") / F.col("populated") >= 0.9, "identifier").when(F.col("tmp") >= 0.9, "temporal")
            .when((F.col("num") >= 0.9) & (is_key | (F.col("distinct") <= FEW)), "code").when(F.col("num") >= 0.9, "measure").when(F.col("distinct") <= FEW, "category").otherwise("free_text"))
    return prof.join(shares, "column", "left").select("column", "position", role.alias("role"))


def temporal_columns(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, temporal): 0.9 of the values begin with a date and a time of day."""
    hit = F.col("value").rlike(f"^{TEMPORAL}")
    return freq.where("value is not null").groupBy("column").agg((F.sum(F.when(hit, F.col("cnt")).otherwise(0)) >= 0.9 * F.sum("cnt")).alias("temporal"))


def period_key(c, temporal: bool):
    """The month of a temporal value, anything else as it is."""
    return F.date_format(F.try_to_timestamp(text(c)), "yyyy-MM") if temporal else text(c)


def states_no_day(freq: DataFrame) -> DataFrame:
    """From value_freq: whether every populated value is a year and a month; no value, no."""
    hit = full_match(F.col("value"), r"\d{4}[-/.]?\d{2}|\d{2}[-/.]\d{4}")
    return freq.groupBy("column").agg(F.coalesce(F.bool_and(hit), F.lit(False)).alias("month_only"))


def decimals(number):
    """Digits after the point that a double's text has, without trailing zeros; 0 in exponent form."""
    t = text(number)
    return F.when(t.contains("E") | ~t.contains("."), 0).otherwise(F.length(F.regexp_replace(F.substring_index(t, ".", -1), "0+$", "")))


def recorded_precision(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, precision): the fewest digits, up to 6, that half of the numbers keep to; null if there are finer numbers within two more."""
    n = freq.select("column", try_number(F.col("value")).alias("x"), "cnt").where("x is not null").groupBy("column", decimals(F.col("x")).alias("digits")).agg(F.sum("cnt").alias("cnt"))
    by = Window.partitionBy("column").orderBy("digits")
    n = n.withColumn("upto", F.sum("cnt").over(by)).withColumn("all", F.sum("cnt").over(Window.partitionBy("column"))).withColumn("next", F.lead("digits").over(by))
    first = n.where((F.col("upto") >= 0.5 * F.col("all")) & (F.col("digits") <= MOST_DIGITS)).groupBy("column").agg(F.min(F.struct("digits", "next")).alias("f"))
    return first.select("column", F.when(F.col("f.next").isNull() | (F.col("f.next") > F.col("f.digits") + 2), F.col("f.digits")).alias("precision"))


def rounds_cleanly(df: DataFrame, column: str, digits: int) -> DataFrame:
    """Whether the column's total survives rounding, and whether any value changes by it."""
    x = try_number(col(column))
    total, rounded = F.sum(x), F.sum(F.bround(x, digits))
    return df.agg((F.abs(total - rounded) / F.greatest(F.abs(total), F.lit(1.0)) <= 1e-9).alias("clean"), F.coalesce(F.bool_or(F.bround(x, digits) != x), F.lit(False)).alias("excess"))


def shape(c):
    """Runs of ASCII digits, capitals and small letters as d, U, l, one letter a character."""
    c = F.regexp_replace(text(c), "[0-9]", "\u0001")
    c = F.regexp_replace(F.regexp_replace(c, "[A-Z]", "\u0002"), "[a-z]", "\u0003")
    return c


def shape_pattern(marked: str) -> str:
    """A marked shape as a regular expression."""
    names = {"\u0001": r"\d", "\u0002": "[A-Z]", "\u0003": "[a-z]"}
    return "^" + "".join(f"{names[m[0][0]]}{{{len(m[0])}}}" if m[0][0] in names else re.escape(m[0]) for m in re.finditer(r"\x01+|\x02+|\x03+|.", marked, re.S)) + "$"


def format_specs(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, kind, spec): the first of date, range, enum and regex that a column's values call for.

    Needs 5 values; 0.85 of them must fit. spec is the date layout, 'min..max', the common values by frequency joined
    with '|', or the pattern. All candidates are aggregates of the one frequency table.
    """
    f = freq.where("value is not null").select("column", "value", "cnt")
    number = try_number(F.col("value"))
    aggs = [F.sum("cnt").alias("n"), F.count("*").alias("distinct"), F.sum(F.when(number.isNotNull(), F.col("cnt")).otherwise(0)).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high")]
    for i, layout in enumerate(SPEC_DATES):
        d = try_date(F.col("value"), layout)
        aggs += [F.sum(F.when(d.isNotNull(), F.col("cnt")).otherwise(0)).alias(f"d{i}"), F.coalesce(F.bool_and(F.year(d).between(1500, 2200)), F.lit(False)).alias(f"y{i}")]
    base = f.groupBy("column").agg(*aggs)
    date = F.coalesce(*[F.when((F.col(f"d{i}") >= DOMINANT * F.col("n")) & F.col(f"y{i}"), F.lit(layout)) for i, layout in enumerate(SPEC_DATES)])
    spread = F.when(F.col("numbers") >= DOMINANT * F.col("n"), F.concat_ws("..", F.col("low"), F.col("high")))
    base = base.select("column", "n", "distinct", date.alias("date"), spread.alias("range"))
    few = f.join(F.broadcast(base.where(F.col("distinct") <= FEW).select("column", "n")), "column").where(F.col("cnt") >= RARE * F.col("n"))
    enum = few.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "value"))), lambda s: s["value"]), "|").alias("enum"), F.count("*").alias("k"), F.sum("cnt").alias("covered"))
    shapes = f.groupBy("column", shape(F.col("value")).alias("shape")).agg(F.sum("cnt").alias("cnt"))
    top = shapes.groupBy("column").agg(F.max_by("shape", F.struct(F.col("cnt"), F.col("shape"))).alias("shape"), F.max("cnt").alias("top"))
    render = F.udf(shape_pattern, "string")  # one short text a column
    out = base.join(enum, "column", "left").join(top, "column")
    enum_ok = F.when((F.col("k") > 1) & (F.col("covered") >= DOMINANT * F.col("n")), F.col("enum"))
    regex_ok = F.when(F.col("top") >= DOMINANT * F.col("n"), render("shape"))
    enough = F.col("n") >= LEAST_VALUES
    kind = F.when(F.col("date").isNotNull(), "date").when(F.col("range").isNotNull(), "range").when(enum_ok.isNotNull(), "enum").when(regex_ok.isNotNull(), "regex")
    return out.where(enough).select("column", kind.alias("kind"), F.coalesce("date", "range", enum_ok, regex_ok).alias("spec"))


def shape_shares(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, shape, cnt, n): how many values have each shape, with the runs spelled d, U and l."""
    spelled = F.translate(shape(F.col("value")), "\u0001\u0002\u0003", "dUl")
    out = freq.where("value is not null").groupBy("column", spelled.alias("shape")).agg(F.sum("cnt").alias("cnt"))
    return with_total(out)


def numeric_sentinels(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, sentinel): a smallest or greatest number whose integer digits are four or more nines."""
    x = try_number(F.col("value"))
    ends = freq.groupBy("column").agg(F.min(x).alias("low"), F.max(x).alias("high"))
    both = ends.select("column", F.explode(F.array("low", "high")).alias("sentinel")).where("sentinel is not null").distinct()
    return both.where(full_match(F.abs("sentinel").cast("decimal(38,0)"), "9{4,}"))


def placeholder_candidates(freq: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """From value_freq: (column, token): values of the built-in list, numeric sentinels, and what `outside` (column, token) adds."""
    listed = freq.where(text_key(F.col("value")).isin(*PLACEHOLDERS)).select("column", F.col("value").alias("token"))
    high = numeric_sentinels(freq)
    nines = freq.join(high, "column").where(try_number(F.col("value")) == F.col("sentinel")).select("column", F.col("value").alias("token"))
    out = listed.unionByName(nines)
    return (out.unionByName(outside) if outside is not None else out).distinct()


def merge_placeholders(candidates: DataFrame, supplied: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """(column, token): detected and supplied tokens that are no valid value of the column's type, one spelling each."""
    both = candidates.select("column", "token").unionByName(supplied.select("column", "token")).withColumn("dtype", _lookup(dtypes))
    odd = both.where(~F.coalesce(castable(F.col("token"), F.col("dtype")), F.lit(False)) | F.col("dtype").isNull() | (F.col("dtype") == "string"))
    return odd.groupBy("column", text_key(F.col("token")).alias("key")).agg(F.min("token").alias("token")).drop("key")


def canonical_period(c):
    return full_match(F.btrim(text(c)), CANONICAL_PERIOD)


