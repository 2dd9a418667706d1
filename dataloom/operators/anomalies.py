"""Anomalies: outliers of measures, rare categories, routing by role."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import col, text, try_number, with_total
from ..sources.shared import cut, spread

FENCE, LISTED = 1.5, 50
#: Bins of a pass of selection, and the most rows of an interval that are fetched value by value.
BINS, FEW = 1024, 2048


def number_freq(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, cnt): how often each number stands in each column; partial aggregation takes frequent ones."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), try_number(col(n)).alias("x")) for n in columns])
    return df.select(F.inline(cells)).where("x is not null").groupBy("column", "x").agg(F.count("*").alias("cnt"))


def _finite(x):
    return F.least(F.greatest(x, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))


def selected(numbers: DataFrame, columns: list[str], ranks: dict[str, list[int]], ends: dict[str, tuple[float, float]], bins: int = BINS, few: int = FEW) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of columns, by selection: nothing is sorted or shuffled but counts.

    A pass counts the values of each interval that still holds a wanted rank by bin, with the bin's least and greatest value;
    the bin that holds the rank is the next interval. An interval of one value is done; one of up to `few` rows is fetched.
    The driver gets at most `bins` rows an interval, and 4 intervals a column at most. Values are compared as they are; only
    the choice of a bin is arithmetic, and it keeps the order.
    """
    wanted = {(c, r): (*ends[c], r) for c in columns for r in ranks[c]}  # interval, and the rank inside it
    sizes: dict[tuple[str, int], int] = {}
    out: dict[tuple[str, int], float] = {}
    while True:
        out |= {k: lo for k, (lo, hi, _) in wanted.items() if lo == hi}
        wanted = {k: w for k, w in wanted.items() if k not in out}
        if not wanted:
            return out
        spans = sorted({(k[0], lo, hi, sizes.get(k, few + 1) <= few) for k, (lo, hi, _) in wanted.items()})
        cells = []
        for i, (c, lo, hi, last) in enumerate(spans):
            x = col(c)
            # Halved, so that the width of any interval is finite.
            place = F.least(F.floor((_finite(x) / 2 - max(lo, -sys.float_info.max) / 2) / (min(hi, sys.float_info.max) / 2 - max(lo, -sys.float_info.max) / 2) * bins), F.lit(bins - 1)).cast("int")
            # The values of a small interval are keys themselves, one by one.
            cells.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), (F.lit(0) if last else place).alias("bin"), (x if last else F.lit(0.0)).alias("v"), x.alias("x"))))
        got = numbers.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("i", "bin", "v").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_span: dict[int, list] = {}
        for r in sorted(got.collect(), key=lambda r: (r["i"], r["bin"], r["v"])):
            by_span.setdefault(r["i"], []).append(r)
        at = {s[:3]: i for i, s in enumerate(spans)}
        for k, (lo, hi, rank) in list(wanted.items()):
            for r in by_span[at[(k[0], lo, hi)]]:
                if rank < r["n"]:
                    wanted[k], sizes[k] = (r["lo"], r["hi"], rank), r["n"]
                    break
                rank -= r["n"]


def numbers_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns' numbers, written once for the passes that read them."""
    return cut(spread(df.select(*[try_number(col(c)).alias(c) for c in columns])))


def quartiles(numbers: DataFrame, columns: list[str]) -> DataFrame:
    """From numbers_of: (column, n, q1, q3, least, greatest) of columns that have numbers, exact and interpolated, by a few passes."""
    one = numbers.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    known = {c: (one[f"n{i}"], one[f"lo{i}"], one[f"hi{i}"]) for i, c in enumerate(columns) if one[f"n{i}"]}
    places = {(c, q): divmod((known[c][0] - 1) * q, 4) for c in known for q in (1, 3)}  # rank and quarters towards the next
    ranks = {c: sorted({min(places[c, q][0] + more, known[c][0] - 1) for q in (1, 3) for more in (0, 1)}) for c in known}
    found = selected(numbers, list(known), ranks, {c: known[c][1:] for c in known})

    def at(c: str, q: int) -> float:
        rank, share = places[c, q]
        low, high = found[c, rank], found[c, min(rank + 1, known[c][0] - 1)]
        return low if not share else (1 - share / 4) * low + share / 4 * high

    rows = [(c, n, at(c, 1), at(c, 3), lo, hi) for c, (n, lo, hi) in known.items()]
    return numbers.sparkSession.createDataFrame(rows, "column string, n long, q1 double, q3 double, least double, greatest double")


def fences(df: DataFrame, columns: list[str], numbers: DataFrame | None = None) -> DataFrame:
    """(column, n, q1, q3, low, high, least, greatest) of numeric columns with 4 values or more and a spread."""
    out = quartiles(numbers_of(df, columns) if numbers is None else numbers, columns).where("n >= 4 and q3 <> q1")
    gap = (F.col("q3") - F.col("q1")) * FENCE
    return out.withColumn("low", F.col("q1") - gap).withColumn("high", F.col("q3") + gap)


def iqr_outliers(df: DataFrame, row_id: str, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """(column, row_id, value) of every value outside its column's fences. The fences, known or not, are a row a column; they stand in the projection, so only outliers become rows."""
    limits = {r["column"]: (r["low"], r["high"]) for r in (fences(df, columns) if known is None else known).select("column", "low", "high").collect()}
    names = [n for n in columns if n in limits]
    numbers = df.select(col(row_id).alias("row_id"), *[try_number(col(n)).alias(f"x{i}") for i, n in enumerate(names)])
    cells = [F.when(~F.col(f"x{i}").between(*limits[n]), F.struct(F.lit(n).alias("column"), F.col(f"x{i}").alias("value"))) for i, n in enumerate(names)]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, row_id long, value double")
    return numbers.select("row_id", F.inline(F.array_compact(F.array(*cells)))).select("column", "row_id", "value")


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """fences with the outliers of each column; the numbers are read from the text once."""
    numbers = numbers_of(df, columns)
    known = fences(df, columns, numbers)
    limits = [(r["column"], r["low"], r["high"]) for r in known.select("column", "low", "high").collect()]  # a row a column
    if not limits:
        return known.withColumn("outliers", F.lit(0).cast("long"))
    one = numbers.agg(*[F.count_if(~col(c).between(low, high)).alias(f"n{i}") for i, (c, low, high) in enumerate(limits)]).first()
    found = df.sparkSession.createDataFrame([(c, one[f"n{i}"]) for i, (c, _, _) in enumerate(limits)], "column string, outliers long")
    return known.join(F.broadcast(found), "column")


def iqr_report(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(column, outliers, rate, q1, q3, low, high): all outliers are counted; the listing is cut only where it is shown."""
    out = counted(df, columns)
    return out.select("column", "outliers", F.round(F.col("outliers") / F.col("n"), 4).alias("rate"), *[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")])


def listed(outliers: DataFrame, most: int = LISTED) -> DataFrame:
    """The first outliers of each column in row order, for display."""
    w = Window.partitionBy("column").orderBy("row_id")
    return outliers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rare_categories(freq: DataFrame, most: int = LISTED) -> DataFrame:
    """From value_freq of category columns: (column, rank, value, cnt, pct) of values rarer than max(3, 0.01 n), up to 50, rarest first."""
    f = with_total(freq.where("value is not null"))
    rare = f.where(F.col("cnt") < F.greatest(F.lit(3.0), 0.01 * F.col("n")))
    w = Window.partitionBy("column").orderBy("cnt", "value")
    return rare.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("column", "rank", "value", "cnt", F.round(100 * F.col("cnt") / F.col("n"), 4).alias("pct"))


def top_values(freq: DataFrame, most: int = 2) -> DataFrame:
    f = with_total(freq.where("value is not null"))
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("column", "rank", "value", "cnt", F.round(100 * F.col("cnt") / F.col("n"), 4).alias("pct"))


def detect(df: DataFrame, row_id: str, roles: dict[str, str], freq: DataFrame) -> DataFrame:
    """(column, kind, detected): outliers of measures, rare values of categories; other roles are skipped."""
    measures, categories = [c for c, r in roles.items() if r == "measure"], [c for c, r in roles.items() if r == "category"]
    out = df.sparkSession.createDataFrame([], "column string, kind string, detected long")
    if measures:
        out = out.unionByName(iqr_outliers(df, row_id, measures).groupBy("column").agg(F.lit("iqr").alias("kind"), F.count("*").alias("detected")))
    if categories:
        rare = rare_categories(freq.where(F.col("column").isin(*categories)), 1 << 30)
        out = out.unionByName(rare.groupBy("column").agg(F.lit("rare_category").alias("kind"), F.count("*").alias("detected")))
    return out


def numeric_census(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(column, outliers, rate, least, greatest, negatives, noisy) of columns with 10 numbers and more than 20 distinct ones; noisy have more than 4 digits after the point."""
    aggs = []
    for i, n in enumerate(columns):
        digits = F.when(text(col(n)).contains("."), F.length(F.substring_index(text(col(n)), ".", -1))).otherwise(0)
        aggs += [F.count_if(try_number(col(n)) < 0).alias(f"m{i}"), F.count_if(digits > 4).alias(f"p{i}")]
    cells = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in (("m", "negatives"), ("p", "noisy"))]) for i, n in enumerate(columns)])
    more = df.agg(*aggs).select(F.inline(cells)).join(number_freq(df, columns).groupBy("column").agg(F.count("*").alias("distinct")), "column")
    out = counted(df, columns).join(more, "column").where("n >= 10 and distinct > 20")
    return out.select("column", "outliers", F.round(F.col("outliers") / F.col("n"), 4).alias("rate"), "least", "greatest", "negatives", "noisy")


def rare_census(freq: DataFrame) -> DataFrame:
    """From value_freq: (column, categories, rare) of columns with 2 to 60 distinct values, at most half as many as rows, that have rare ones."""
    f = with_total(freq.where("value is not null"))
    g = f.groupBy("column").agg(F.count("*").alias("categories"), F.max("n").alias("n"), F.count_if(F.col("cnt") < F.greatest(F.lit(3.0), 0.01 * F.col("n"))).alias("rare"))
    return g.where((F.col("categories").between(2, 60)) & (F.col("categories") <= 0.5 * F.col("n")) & (F.col("rare") > 0)).select("column", "categories", "rare")
