"""Value semantics that all operators share, as Column expressions; each has a twin in SQL text for the oracle engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
#: Texts that stand for a missing value, compared in lower case without outer white space.
PLACEHOLDERS = (
    "", "-", "--", ".", "..", "...", "//", "///", "?", "??", "???", "#", "n/a", "na", "n.a.", "#n/a", "n/d", "nd", "n.d.", "#n/d", "#nd",
    "null", "none", "nan", "unknown", "missing", "tbd", "error", "not available", "not applicable", "n/c", "nc", "n.c.", "sconosciuto",
    "non disponibile", "non applicabile", "da verificare", "da definire", "da inserire", "da completare", "in attesa", "non pervenuto",
    "non rilevato", "non classificato", "-1", "0", "999", "-999", "9999", "-9999", "99999", "-99999",
)
#: Month abbreviations, Italian before English.
MONTHS = {
    "gen": "01", "feb": "02", "mar": "03", "apr": "04", "mag": "05", "giu": "06", "lug": "07", "ago": "08", "set": "09", "ott": "10", "nov": "11", "dic": "12",
    "jan": "01", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "dec": "12",
}
#: Date layouts, each with the pattern a text must match whole before it is parsed, so that no parser is lenient about it.
DATES = {
    "%Y-%m-%d": ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), "%d/%m/%Y": ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), "%d-%m-%Y": ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    "%Y/%m/%d": ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"), "%Y%m%d": ("yyyyMMdd", r"\d{8}"), "%Y%m": ("yyyyMM", r"\d{6}"), "%m/%Y": ("M/yyyy", r"\d{1,2}/\d{4}"),
    "%m-%Y": ("M-yyyy", r"\d{1,2}-\d{4}"), "%Y": ("yyyy", r"\d{4}"), "%d/%m/%Y %H:%M:%S": ("d/M/yyyy H:m:s", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}"),
    "%Y-%m-%d %H:%M:%S": ("yyyy-M-d H:m:s", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"), "%Y-%m-%dT%H:%M:%S": ("yyyy-M-d'T'H:m:s", r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}"),
}
#: The layouts that a date column is profiled for, in order.
SPEC_DATES = tuple(DATES)[:11]
#: Fixed value: a year and month as six digits.
CANONICAL_PERIOD = r"\d{4}(0[1-9]|1[0-2])"


def col(name: str) -> Column:
    """A top-level column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(WHITE))


def text_key(c: Column) -> Column:
    """What two spellings of one value have in common."""
    return F.lower(strip(c))


def full_match(c: Column, pattern: str) -> Column:
    return text(c).rlike(rf"\A(?:{pattern})\z")


def try_number(c: Column) -> Column:
    """A plain decimal number, or null; never an error, and not what only one engine takes for a number."""
    return F.when(full_match(c, NUMBER), strip(c).try_cast("double"))


def try_date(c: Column, layout: str) -> Column:
    """A timestamp if the text is a date in the layout, or null."""
    pattern, shape = DATES[layout]
    return F.when(full_match(c, shape), F.try_to_timestamp(text(c), F.lit(pattern)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Within 0 and 1, to four digits; null without a denominator."""
    return F.when(denominator > 0, F.round(F.least(F.greatest(numerator / denominator, F.lit(0.0)), F.lit(1.0)), 4))


def scaled(c: Column, digits: int) -> Column:
    """Rounded half to even."""
    return F.bround(c, digits)


def columns_of(df: DataFrame, row_id: str) -> list[str]:
    return [c for c in df.columns if c != row_id]


def texts(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(row_id, column, position, value): one row a cell, values as text."""
    names = columns or columns_of(df, row_id)
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), text(col(n)).alias("value")) for i, n in enumerate(names)])
    return df.select(col(row_id).alias("row_id"), F.inline(cells))


def value_freq(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(column, position, value, cnt) of all columns in one shuffle, nulls included; partial aggregation takes hot values."""
    return texts(df, row_id, columns).groupBy("column", "position", "value").agg(F.count("*").alias("cnt"))


def with_total(freq: DataFrame) -> DataFrame:
    """A frequency table (column, …, cnt) with each column's sum of cnt as n. The sums are a row a column; a window would put a column's whole table into one task."""
    totals = freq.groupBy("column").agg(F.sum("cnt").alias("n"))
    return freq.join(F.broadcast(totals), "column")

