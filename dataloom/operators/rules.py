"""Rules between columns: dependencies, arithmetic identities, periods and their parts, imputation hints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import is_period
from ..functions.values import col, strip, text, text_key, try_number
from ..sources.shared import spread
from .completeness import violation_rows

MOST_PREDICTORS, USABLE = 8, 0.2
LEAST_PURITY, LEAST_GROUPS = 0.9, 3
HINT_PURITY, HINT_COVERAGE, LEAST_FILL = 0.95, 0.5, 0.1
TOLERANCE, RELATIVE = 0.011, 1e-9
LEAST_ROWS, LEAST_DISTINCT, MOST_NUMERIC = 30, 5, 16
#: Rows that are counted together.
BLOCK = 8192


def usable(profile: DataFrame, temporal: list[str] = ()) -> DataFrame:
    """From column_profile: (column, ratio, as_target): columns that may predict; temporal ones never as target."""
    ok = (F.col("populated") > 0) & (F.col("distinct") <= USABLE * F.col("populated"))
    is_t = F.col("column").isin(*(temporal or [""]))
    return profile.where(ok | is_t).select("column", (F.col("distinct") / F.col("populated")).alias("ratio"), (~is_t).alias("as_target"))


def candidate_predictors(usable_columns: DataFrame, related: dict[str, list[str]] | None = None, most: int = MOST_PREDICTORS) -> DataFrame:
    """(target, predictor, rank): supplied related columns first, then up to `most` nearest in cardinality ratio, ties by name.

    A self join of the columns of a table, a few hundred rows at most.
    """
    t, p = usable_columns.where("as_target"), usable_columns
    pairs = t.select(F.col("column").alias("target"), F.col("ratio").alias("tr")).join(F.broadcast(p.select(F.col("column").alias("predictor"), "ratio")), F.col("target") != F.col("predictor"))
    near = pairs.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy(F.abs(F.col("ratio") - F.col("tr")), "predictor"))).where(F.col("n") <= most)
    out = near.select("target", "predictor", (F.col("n") + 1000).alias("n"))
    given = [(a, b, i) for a, bs in (related or {}).items() for i, b in enumerate(bs)]
    if given:
        out = out.unionByName(usable_columns.sparkSession.createDataFrame(given, "target string, predictor string, n int"))
    out = out.groupBy("target", "predictor").agg(F.min("n").alias("n"))
    return out.select("target", "predictor", F.row_number().over(Window.partitionBy("target").orderBy("n", "predictor")).alias("rank"))


def pair_counts(df: DataFrame, pairs: list[tuple[str, str]], keys: dict[str, Column] | None = None) -> DataFrame:
    """(predictor, target, key, value, cnt) of all pairs in one shuffle, over rows where both are populated.

    keys may give another expression for a column when it predicts, such as a period key.
    """
    keys = keys or {}
    cells = F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(t).alias("target"), keys.get(p, text(col(p))).alias("key"), text(col(t)).alias("value")) for p, t in pairs])
    return df.select(F.inline(cells)).where("key is not null and value is not null").groupBy("predictor", "target", "key", "value").agg(F.count("*").alias("cnt"))


def dominant(counts: DataFrame) -> DataFrame:
    """From pair_counts: (predictor, target, key, top, top_cnt, size): each key's most frequent value, ties to the smallest."""
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), "value"))
    g = counts.groupBy("predictor", "target", "key").agg(best.alias("b"), F.sum("cnt").alias("size"))
    return g.select("predictor", "target", "key", F.col("b.value").alias("top"), (-F.col("b.neg")).alias("top_cnt"), "size")


def dependencies(counts: DataFrame) -> DataFrame:
    """From pair_counts: (predictor, target, purity, groups): dependencies that hold for 0.9 of the rows or more but not all."""
    d = dominant(counts).groupBy("predictor", "target").agg((F.sum("top_cnt") / F.sum("size")).alias("p"), F.count_if(F.col("size") >= 2).alias("groups"))
    return d.where((F.col("groups") >= LEAST_GROUPS) & (F.col("p") >= LEAST_PURITY) & (F.col("p") < 1)).select("predictor", "target", F.round("p", 4).alias("purity"), "groups")


def dependency_violations(df: DataFrame, row_id: str, pairs: list[tuple[str, str]], keys: dict[str, Column] | None = None) -> DataFrame:
    """One violation for each target and row that breaks a reported dependency; the first predictor of the list wins.

    Rows meet their key's dominant value by a join on (predictor, target, key), which Spark may split where a key is frequent.
    """
    keys = keys or {}
    counts = pair_counts(df, pairs, keys)
    good = dependencies(counts).select("predictor", "target")
    top = dominant(counts).where("size >= 2").join(F.broadcast(good), ["predictor", "target"]).select("predictor", "target", "key", "top")
    cells = F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(t).alias("target"), keys.get(p, text(col(p))).alias("key"), text(col(t)).alias("value"), F.lit(i).alias("order")) for i, (p, t) in enumerate(pairs)])
    rows = df.select(col(row_id).alias("row_id"), F.inline(cells)).where("key is not null and value is not null")
    bad = rows.join(top, ["predictor", "target", "key"]).where("value <> top")
    one = bad.groupBy("target", "row_id").agg(F.min(F.struct("order", "predictor", "key", "value", "top")).alias("b"))
    said = F.concat(F.lit("cross-column: "), F.col("b.predictor"), F.lit("='"), F.col("b.key"), F.lit("' implies "), F.col("target"), F.lit("='"), F.col("b.top"), F.lit("'"))
    return violation_rows(one, "target", F.col("row_id"), F.col("b.value"), said, "consistency", F.lit(1))


def temporal_stability(df: DataFrame, predictor: str, target: str, clock: Column | None, least: int = 3) -> DataFrame:
    """One row: stable, whether each key that spans two clock values has one dominant target in its first and last period (of 3 rows or more)."""
    if clock is None:
        return df.sparkSession.range(1).select(F.lit(True).alias("stable"))
    r = df.select(text(col(predictor)).alias("k"), text(col(target)).alias("t"), clock.alias("c")).where("k is not null and t is not null and c is not null")
    counts = r.groupBy("k", "c", "t").agg(F.count("*").alias("cnt"))
    ends = counts.groupBy("k").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first < last")
    at = counts.join(ends, "k").where("c = first or c = last")
    tops = at.groupBy("k", "c", (F.col("c") == F.col("first")).alias("begin")).agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "t")).alias("b"), F.sum("cnt").alias("n")).where(F.col("n") >= least)
    both = tops.groupBy("k").agg(F.max(F.when(F.col("begin"), F.col("b.t"))).alias("a"), F.max(F.when(~F.col("begin"), F.col("b.t"))).alias("z")).where("a is not null and z is not null")
    return both.agg(F.coalesce(F.bool_and(F.col("a") == F.col("z")), F.lit(True)).alias("stable"))


def coherence(counts: DataFrame, least: int = 6) -> DataFrame:
    """From pair_counts: (target, coherence): the best share of rows at their key's dominant value over predictors with 6 joint rows or more."""
    d = dominant(counts).groupBy("predictor", "target").agg((F.sum("top_cnt") / F.sum("size")).alias("p"), F.sum("size").alias("n"))
    return d.where(F.col("n") >= least).groupBy("target").agg(F.round(F.max("p"), 4).alias("coherence"))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE + RELATIVE * F.abs(b)


def magnitudes(df: DataFrame, row_id: str, most: int = MOST_NUMERIC) -> list[str]:
    """Up to `most` columns, in order, that read as numbers in 30 rows and half of all rows; one small aggregate."""
    names = [n for n, t in df.dtypes if n != row_id and not t.startswith(("timestamp", "date", "boolean"))]
    got = df.agg(F.count("*").alias("n"), *[F.count(try_number(col(n))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if got[f"c{i}"] >= LEAST_ROWS and got[f"c{i}"] >= 0.5 * got["n"]][:most]


class TripleCounters:
    """Counters of all tests a = b - c and a = b + c among columns of numbers, filled block by block; those of blocks add up.

    n: rows with all three; m: rows that agree within the tolerance; s: rows where b and c are alike, so that their difference
    says nothing. Of a, b, c and the expected value a few distinct values are kept, as many as decide.
    """

    def __init__(self, names: list[str], kept: int = LEAST_DISTINCT):
        k = len(names)
        self.k, self.kept = k, kept
        self.sides = [(b, c, op) for b in range(k) for c in range(k) if b != c for op in "-+" if op == "-" or names[b] < names[c]]
        self.counts = np.zeros((len(self.sides), k, 3), np.int64)
        self.values: dict[tuple, set[float]] = {}

    def _keep(self, key: tuple, x: np.ndarray) -> None:
        have = self.values.setdefault(key, set())
        if len(have) < self.kept:
            have.update(x[:64].tolist())
            if len(have) < self.kept:
                have.update(np.unique(x).tolist())
            if len(have) > self.kept:
                self.values[key] = set(sorted(have)[:self.kept])

    def add(self, x: np.ndarray) -> None:
        """x: a row a column, NaN where there is no number."""
        there = ~np.isnan(x)
        as_number = there.astype(np.float32)
        with np.errstate(invalid="ignore", over="ignore"):
            for i, (b, c, op) in enumerate(self.sides):
                both = there[b] & there[c]
                if not both.any():
                    continue
                e = x[b] - x[c] if op == "-" else x[b] + x[c]
                self.counts[i, :, 0] += (as_number @ both.astype(np.float32)).astype(np.int64)
                self.counts[i, :, 1] += (np.abs(x - e) <= TOLERANCE + RELATIVE * np.abs(e)).sum(axis=1)
                alike = both & (np.abs(x[b] - x[c]) <= TOLERANCE + RELATIVE * np.abs(x[c]))
                self.counts[i, :, 2] += (as_number @ alike.astype(np.float32)).astype(np.int64)
                for a in range(self.k):
                    if a in (b, c) or all(len(self.values.get((a, b, c, op, v), ())) >= self.kept for v in "abce"):
                        continue
                    at = both & there[a]
                    for v, y in zip("abce", (x[a], x[b], x[c], e), strict=True):
                        self._keep((a, b, c, op, v), y[at])

    def rows(self) -> Iterator[tuple]:
        for i, (b, c, op) in enumerate(self.sides):
            for a in range(self.k):
                if a not in (b, c) and self.counts[i, a, 0]:
                    yield (a, b, c, op, *map(int, self.counts[i, a]), *(sorted(self.values[(a, b, c, op, v)]) for v in "abce"))


def identities(df: DataFrame, columns: list[str], least: float = LEAST_PURITY) -> DataFrame:
    """(target, left, operator, right, agreement): a = b - c or a = b + c among the columns, one identity a set of three.

    Of the ways to write one, that of higher agreement counts, then the one whose target comes later. All tests are counted in
    one scan: each task adds its blocks up, and Spark adds the tasks up, a row a test.
    """
    spark, names = df.sparkSession, list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = TripleCounters(names)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                counters.add(np.stack([c.slice(at, BLOCK).to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
        rows = list(counters.rows())
        kinds = [pa.int32()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.list_(pa.float64())] * 4
        fields = "a b c op n m s va vb vc ve".split()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], fields)

    x = spread(df.select(*[try_number(col(n)).alias(f"x{i}") for i, n in enumerate(names)]))
    some = lambda v: F.size(F.array_distinct(F.flatten(F.collect_list(v)))).alias(v)
    kind = "a int, b int, c int, op string, n long, m long, s long, va array<double>, vb array<double>, vc array<double>, ve array<double>"
    counted = x.mapInArrow(run, kind).groupBy("a", "b", "c", "op").agg(*[F.sum(v).alias(v) for v in "nms"], *map(some, ("va", "vb", "vc", "ve")))
    good = counted.where((F.col("n") >= LEAST_ROWS) & (F.col("m") >= least * F.col("n")) & (F.col("s") <= LEAST_PURITY * F.col("n")))
    found = good.collect() if len(names) > 2 else []  # a row an identity
    plain = {(r["a"], r["b"], r["c"]) for r in found if r["op"] == "-"}
    best: dict[frozenset, tuple] = {}
    for r in sorted(found, key=lambda r: (r["a"], r["b"], r["c"], r["op"])):
        a, b, c, op, p = r["a"], r["b"], r["c"], r["op"], r["m"] / r["n"]
        if r["va"] < LEAST_DISTINCT or r["ve"] < LEAST_DISTINCT or r["vb"] <= 1 or r["vc"] <= 1 or (op == "+" and (a, b, c) in plain):
            continue
        key = frozenset((a, b, c))
        if key not in best or (round(p, 4), a) > (round(best[key][4], 4), best[key][0]):
            best[key] = (a, b, op, c, p)
    rows = [(names[a], names[b], op, names[c], round(p, 4)) for a, b, op, c, p in sorted(best.values())]
    return spark.createDataFrame(rows, "target string, left string, operator string, right string, agreement double")


def identity_violations(df: DataFrame, row_id: str, target: str, left: str, operator: str, right: str) -> DataFrame:
    a, b, c = (try_number(col(n)) for n in (target, left, right))
    expected = b - c if operator == "-" else b + c
    bad = df.where((a + expected).isNotNull() & ~close(a, expected)).select(col(row_id).alias("row_id"), text(col(target)).alias("value"), F.lit(target).alias("column"))
    return violation_rows(bad, "column", F.col("row_id"), F.col("value"), F.lit(f"{target} = {left} {operator} {right}"), "consistency", F.lit(1))


def period_part(period: Column, part: str) -> Column:
    """Year, or month without leading zero, of a canonical period; else null."""
    p = strip(period)
    return F.when(is_period(period), F.substring(p, 1, 4) if part == "year" else F.regexp_replace(F.substring(p, 5, 2), "^0", ""))


def well_formed(c: Column, part: str) -> Column:
    x = try_number(c)
    low, high = (1900, 2100) if part == "year" else (1, 12)
    return F.coalesce((x == F.floor(x)) & x.between(low, high), F.lit(False))


def derivable(df: DataFrame, period: str, columns: list[str], least_rows: int = 20, least: float = 0.8) -> DataFrame:
    """(part, column, agreement): the first column, in the order given, that agrees with the period's year or month in 0.8 of comparable rows."""
    tests = [(part, n) for part in ("year", "month") for n in columns if n != period]
    aggs = [F.count_if(is_period(col(period))).alias("canonical")]
    for i, (part, n) in enumerate(tests):
        want = period_part(col(period), part)
        both = want.isNotNull() & col(n).isNotNull()
        aggs += [F.count_if(both).alias(f"n{i}"), F.count_if(both & F.coalesce(try_number(col(n)) == want.cast("double"), F.lit(False))).alias(f"m{i}")]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(i).alias("i"), F.lit(n).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m")) for i, (part, n) in enumerate(tests)])
    ok = one.where(F.col("canonical") >= least_rows).select(F.inline(cells)).where((F.col("n") > 0) & (F.col("m") >= least * F.col("n")))
    first = ok.groupBy("part").agg(F.min(F.struct("i", "column", (F.col("m") / F.col("n")).alias("a"))).alias("f"))
    return first.select("part", F.col("f.column").alias("column"), F.round("f.a", 4).alias("agreement"))


def contested(df: DataFrame, row_id: str, period: str, parts: dict[str, str]) -> DataFrame:
    """Rows where a canonical period and a well-formed part of it, {part: column}, disagree."""
    cells = []
    for part, n in parts.items():
        want = period_part(col(period), part)
        bad = want.isNotNull() & well_formed(col(n), part) & (try_number(col(n)) != want.cast("double"))
        cells.append(F.when(bad, F.struct(F.lit(n).alias("column"), text(col(n)).alias("value"), F.lit(f"{part} of {period}").alias("said"))))
    found = df.select(col(row_id).alias("row_id"), F.inline(F.array_compact(F.array(*cells))))
    return violation_rows(found, "column", F.col("row_id"), F.col("value"), F.col("said"), "consistency", F.lit(1))


def hints_from(counts: DataFrame, gaps: DataFrame, normalized: bool) -> tuple[DataFrame, DataFrame]:
    """(hints, mapping) from pair_counts and gaps (predictor, target, key, rows), the rows whose target is null.

    hints (target, predictor, normalized, purity, coverage): purity, the share of rows at their key's dominant value, or for two
    predictors the share of keys with one value only, of 0.95 or more; coverage, the share of null targets whose key maps, of
    0.5 or more. mapping (target, predictor, key, value) has keys whose own dominant share is 0.95 or more.
    """
    d = dominant(counts)
    share = F.when(F.col("predictor").contains("|"), F.count_if(F.col("top_cnt") == F.col("size")) / F.count("*")).otherwise(F.sum("top_cnt") / F.sum("size"))
    pure = d.groupBy("predictor", "target").agg(share.alias("purity")).where(F.col("purity") >= HINT_PURITY)
    mapping = d.join(F.broadcast(pure), ["predictor", "target"]).where(F.col("top_cnt") >= HINT_PURITY * F.col("size")).select("predictor", "target", "key", F.col("top").alias("value"))
    cover = gaps.join(mapping, ["predictor", "target", "key"], "left").groupBy("predictor", "target").agg((F.sum(F.when(F.col("value").isNotNull(), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("coverage"))
    hints = pure.join(cover, ["predictor", "target"]).where(F.col("coverage") >= HINT_COVERAGE)
    return hints.select("target", "predictor", F.lit(normalized).alias("normalized"), F.round("purity", 4).alias("purity"), F.round("coverage", 4).alias("coverage")), mapping


def choose_hints(hints: DataFrame) -> DataFrame:
    """One hint a target: the purest, then the best covering, then raw keys before normalised ones; confidence strict if purity is 1."""
    w = Window.partitionBy("target").orderBy(F.desc("purity"), F.desc("coverage"), "normalized", "predictor")
    best = hints.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return best.withColumn("confidence", F.when(F.col("purity") == 1, "strict").otherwise("dominant"))


def rule_counts(violations: DataFrame) -> DataFrame:
    """(rule, rows): consistency violations folded to 'p determines t', the identity's text, or 'column: text'."""
    p = F.col("expected_pattern")
    rule = (F.when(p.startswith("cross-column:"), F.concat(F.trim(F.regexp_extract(p, r"^cross-column:([^=]*)", 1)), F.lit(" determines "), "column_name"))
            .when(p.contains(" = "), p).when(F.coalesce(p, F.lit("")) != "", F.concat("column_name", F.lit(": "), p)).otherwise(F.col("column_name")))
    return violations.where("kind = 'consistency'").groupBy(rule.alias("rule")).agg(F.count("*").alias("rows"))


def ambiguous_codes(df: DataFrame, code: str, label: str) -> DataFrame:
    """One row: codes, and codes with more than one label."""
    g = df.where(col(code).isNotNull()).groupBy(text(col(code)).alias("k")).agg(F.count_distinct(col(label)).alias("labels"))
    return g.agg(F.count("*").alias("codes"), F.count_if(F.col("labels") > 1).alias("ambiguous"))


def reconcile_period(df: DataFrame, period: str, year: str, month: str, amount: str) -> DataFrame:
    """One row of counts: rows where period, year and month are all numbers, of those the ones that disagree, unreadable values of each, negative amounts."""
    p, y, m = (try_number(col(n)) for n in (period, year, month))
    all3 = (p + y + m).isNotNull()
    return df.agg(F.count_if(all3).alias("checked"), F.count_if(all3 & (p != y * 100 + m)).alias("mismatches"), *[F.count_if(col(n).isNotNull() & try_number(col(n)).isNull()).alias(f"unreadable_{k}") for k, n in (("period", period), ("year", year), ("month", month))], F.count_if(try_number(col(amount)) < 0).alias("negative"))
