"""Repairs that need no approval, with all that they rest on found in the data itself.

The steps run in one order, each on what the earlier ones left: periods are written as yyyyMM, their years and months fill
columns that can't be read as such, floating-point noise is rounded off, periods that state a year only are completed from a
column that determines them, and nulls are filled from hints. What can't be decided, a well-formed part that contradicts its
period, is reported and left. Specifications, violations and proposed corrections are then those of the data as it now is.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_period, normalize_period, round_number
from ..functions.values import col, columns_of, text, try_number, value_freq
from ..sources.shared import cut
from . import rules
from .formats import Spec, validate
from .pair_statistics import PairStatistics
from .profile import recorded_precision
from .repair import impute

#: A hint is applied without approval from this purity on.
CERTAIN = 0.99
CANONICAL = "%Y%m"
STEPS = "step int, column string, operation string, cells_changed long, predictor string, purity double"


@dataclass
class Remedied:
    data: DataFrame
    steps: DataFrame
    contested: DataFrame
    specs: dict[str, Spec]
    touched: list[str]

    def refreshed(self, row_id: str, violations: DataFrame, consistency: DataFrame | None = None) -> DataFrame:
        """violations of the data before, brought up to date: format findings of touched columns are made anew, missing values
        of them counted anew, those of kind consistency replaced by `consistency` and what is contested; the rest stays."""
        of_touched = F.col("column_name").isin(*(self.touched or [""]))
        missing = F.col("kind") == "completeness"
        stays = violations.where((F.col("kind") != "consistency") & ~(of_touched & (F.col("kind").isin("format") | missing)))
        names = [c for c in self.touched if c in self.data.columns]
        now = validate(self.data, row_id, {c: s for c, s in self.specs.items() if c in self.touched})
        held = stays.where(of_touched & (F.col("row_id") >= 0)).select("column_name", "row_id").distinct()
        out = stays.unionByName(now.join(held, ["column_name", "row_id"], "left_anti").select(violations.columns))
        if names:
            counts = self.data.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("left")) for i, c in enumerate(names)])))
            again = violations.where(of_touched & missing).join(F.broadcast(counts), "column_name").where("left > 0").withColumn("affected_rows", F.col("left"))
            out = out.unionByName(again.select(violations.columns))
        for more in (self.contested, consistency):
            out = out.unionByName(more.select(violations.columns)) if more is not None else out
        return out

    def unsettled(self, row_id: str, corrections: DataFrame) -> DataFrame:
        """corrections (column, value, to) less those of touched columns whose value is no longer there."""
        names = [c for c in self.touched if c in self.data.columns]
        of_touched = F.col("column").isin(*(names or [""]))
        there = value_freq(self.data, row_id, names).select(F.col("column").alias("c"), F.col("value").alias("v")) if names else None
        kept = corrections.where(of_touched).join(there, (F.col("column") == F.col("c")) & (F.col("value") == F.col("v")), "left_semi") if names else corrections.where("false")
        return corrections.where(~of_touched).unionByName(kept)


def rounded_spec(spec: Spec, digits: int) -> Spec:
    """A range whose bounds are rounded as its column was, so that the column's own extremes stay inside."""
    bound = lambda x: None if x is None else round(float(x), digits)
    return dataclasses.replace(spec, low=bound(spec.low), high=bound(spec.high)) if spec.kind == "range" else spec


class _State:
    """The data so far and the log of what was done to it."""

    def __init__(self, df: DataFrame):
        self.df, self.log = df, []

    def rewrite(self, new: dict[str, Column], operation: Callable[[str], str]) -> None:
        """Puts new values for columns, after one aggregate that counts the cells they change; columns of none stay as they are."""
        if not new:
            return
        got = self.df.agg(*[F.count_if(~text(col(c)).eqNullSafe(text(x))).alias(f"n{i}") for i, (c, x) in enumerate(new.items())]).first()
        done = {c: x for i, (c, x) in enumerate(new.items()) if got[f"n{i}"]}
        self.log += [(c, operation(c), got[f"n{i}"], None, None) for i, c in enumerate(new) if c in done]
        self.df = cut(self.df.select(*[done[c].alias(c) if c in done else col(c) for c in self.df.columns])) if done else self.df

    def fill(self, column: str, hint, mapping: DataFrame, operation: str, temporal) -> None:
        """Fills nulls of a column from a hint's mapping."""
        m = mapping.where((F.col("target") == column) & (F.col("predictor") == hint["predictor"])).select("key", "value")
        after = cut(impute(self.df, column, hint["predictor"], m, hint["normalized"], temporal))
        count = lambda d: d.agg(F.count(col(column))).first()[0]
        if filled := count(after) - count(self.df):
            self.log.append((column, operation, filled, hint["predictor"], hint["purity"]))
            self.df = after


def remediate(df: DataFrame, row_id: str, specs: dict[str, Spec], pairs: list[tuple[str, str]] = (), temporal=()) -> Remedied:
    """All steps on df. specs say which columns are periods: those of a date layout without a day.

    pairs (predictor, target) are where hints are sought; a hint is applied from CERTAIN on. Each step costs an aggregate
    and, where it changes something, a write to the shared folder.
    """
    state = _State(cut(df))
    periods = [c for c, s in specs.items() if s.kind == "date" and "%d" not in s.pattern and c in df.columns]
    state.rewrite({p: normalize_period(col(p)) for p in periods}, lambda c: "normalize_period")
    specs = specs | {c: Spec("date", pattern=CANONICAL) for c, *_ in state.log}
    contested = None
    for p in periods:
        parts = {r["part"]: r["column"] for r in rules.derivable(state.df, p, columns_of(state.df, row_id)).collect()}
        if not parts:
            continue
        found = cut(rules.contested(state.df, row_id, p, parts))
        contested = found if contested is None else contested.unionByName(found)
        named = {c: part for part, c in parts.items()}
        want = {c: rules.period_part(col(p), part) for c, part in named.items()}
        state.rewrite({c: F.when(~rules.well_formed(col(c), named[c]) & want[c].isNotNull(), want[c]).otherwise(text(col(c))) for c in named}, lambda c: f"derive_{named[c]}_from_period")
    # Noise: columns recorded to some digits, whose total doesn't change by rounding to them, though some value does.
    digits = {r["column"]: r["precision"] for r in recorded_precision(value_freq(state.df, row_id)).collect() if r["precision"] is not None}
    if digits:
        number = {c: try_number(col(c)) for c in digits}
        aggs = [a for i, (c, n) in enumerate(digits.items()) for x in [number[c]] for a in (F.sum(x).alias(f"s{i}"), F.sum(F.bround(x, n)).alias(f"r{i}"), F.bool_or(F.bround(x, n) != x).alias(f"e{i}"))]
        got = state.df.agg(*aggs).first()
        noisy = [c for i, c in enumerate(digits) if got[f"e{i}"] and abs(got[f"s{i}"] - got[f"r{i}"]) <= 1e-9 * max(abs(got[f"s{i}"]), 1.0)]
        state.rewrite({c: round_number(col(c), digits[c], number[c]) for c in noisy}, lambda c: "round_decimals")
        specs = specs | {c: rounded_spec(specs[c], digits[c]) for c in noisy if c in specs}
    for p in periods:
        others = [c for c in columns_of(state.df, row_id) if c != p]
        if not others or not state.df.where(col(p).isNotNull() & ~is_period(col(p))).limit(1).count():
            continue
        # Only what has no canonical period counts as a gap; a null period says nothing and is left.
        stated = f"__{uuid.uuid4().hex[:8]}"
        probe = state.df.where(col(p).isNotNull()).select(*[F.when(is_period(col(p)), text(col(p))).alias(p) if c == p else col(c) for c in state.df.columns])
        hints, mapping = PairStatistics(df.sparkSession, [(c, p) for c in others], temporal).add(probe).hints()
        best = rules.choose_hints(hints).where(F.col("purity") >= CERTAIN).first()
        if best is None:
            continue
        gaps = state.df.select("*", col(p).alias(stated)).select(*[F.when(is_period(col(p)), text(col(p))).alias(p) if c == p else col(c) for c in [*state.df.columns, stated]])
        m = mapping.where(F.col("predictor") == best["predictor"]).select("key", "value")
        done = cut(impute(gaps, p, best["predictor"], m, temporal=temporal))
        recovered = col(stated).isNotNull() & ~is_period(col(stated)) & col(p).isNotNull()
        n = done.where(recovered).count()
        if n:
            state.log.append((p, "complete_period_from_dependency", n, best["predictor"], best["purity"]))
            state.df = done.select(*[F.when(recovered, col(p)).otherwise(col(stated)).alias(p) if c == p else col(c) for c in state.df.columns])
    pairs = [x for x in pairs if x[1] in state.df.columns]
    if pairs:
        statistics = PairStatistics(df.sparkSession, pairs, temporal).add(state.df)
        for hint in statistics.chosen().where(F.col("purity") >= CERTAIN).orderBy("target").collect():  # a row a column
            state.fill(hint["target"], hint, statistics.hints(hint["normalized"])[1], "impute_from_lookup", temporal)
    steps = df.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(state.log)], STEPS)
    if contested is None:
        contested = validate(df.limit(0), row_id, {})
    return Remedied(state.df, steps, contested, specs, list(dict.fromkeys(x[0] for x in state.log)))
