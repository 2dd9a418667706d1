"""Execution of an approved plan of fixes: which may run together, and one pass over the data for all of those.

Two fixes conflict if one writes a column that the other reads or writes. The plan is cut into levels, each fix in the first
level after those it conflicts with or depends on; fixes of a level touch different columns, so they give the same in any
order. What all of a level do to a row is one projection, in which a changed column stands beside what it was. One aggregate
over it has every fix's invariants, and a fix that breaks one is undone by leaving its columns as they were: no other fix of
the level looks at them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, columns_of, text, text_key
from ..sources.shared import cut
from . import audit, invariants
from .repair import CHANGED_BY_ROW, Fix, Operation, apply_fix, cast_column, rewritten, states_month, whole_number

#: Every column of a row, for fixes that drop rows.
ALL = "*"


@dataclass
class Step:
    """A fix in the plan's order: what it reads and writes, and the level it runs in."""

    fix: Fix
    level: int = 0
    reads: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)

    def conflicts(self, other: Step) -> bool:
        meet = lambda a, b: bool(a and b) and (ALL in a or ALL in b or bool(a & b))
        return meet(self.writes, other.writes | other.reads) or meet(self.reads, other.writes)


def touched(op: Operation) -> tuple[set[str], set[str]]:
    """(columns read, columns written) by an operation."""
    if op.kind == "drop_duplicate_rows":
        return {ALL}, {ALL}
    if op.kind == "rename_column":
        return {op.column}, {op.column, op.args.get("to", "")}
    if op.kind == "impute_from_lookup":
        return {op.column, op.args["predictor"], *op.args["predictor"].split("|")}, {op.column}
    return {op.column}, {op.column}


def by_row(fix: Fix) -> bool:
    """Whether the fix is a projection: each operation rewrites, drops or renames a column by itself. A cast must be the only
    operation on its column, since whether it is done is known only after the level's aggregate."""
    casts = [o.column for o in fix.operations if o.kind == "cast_dtype"]
    named = [c for o in fix.operations for c in touched(o)[1]]
    moved = [o.column for o in fix.operations if o.kind in ("drop_column", "rename_column")]
    return all(o.kind in CHANGED_BY_ROW or o.kind in ("cast_dtype", "drop_column", "rename_column") for o in fix.operations) and all(named.count(c) == 1 for c in [*casts, *moved])


def levels(plan: list[Fix]) -> list[Step]:
    """The steps of a plan, in its order, with their levels. Fixes that are no projection have a level of their own."""
    steps: list[Step] = []
    for fix in plan:
        step = Step(fix)
        for op in fix.operations:
            reads, writes = touched(op)
            step.reads |= reads
            step.writes |= writes
        after = [s.level for s in steps if s.conflicts(step) or s.fix.id in fix.depends_on or s.fix.fingerprint() == fix.fingerprint()]
        step.level = max(after, default=-1) + 1
        alone = {s.level for s in steps if not by_row(s.fix)}
        if by_row(fix):
            while step.level in alone:
                step.level += 1
        else:
            taken = {s.level for s in steps}
            while step.level in taken:
                step.level += 1
        steps.append(step)
    return steps


def _changed(df: DataFrame, fixes: list[Fix]) -> dict[str, tuple[Fix, Operation | None, Column]]:
    """For each column that a fix rewrites: the fix, the cast if it is one, and the column's new value."""
    out: dict[str, tuple[Fix, Operation | None, Column]] = {}
    for fix in fixes:
        for op in fix.operations:
            if op.column not in df.columns or op.kind in ("drop_column", "rename_column"):
                continue
            now = out[op.column][2] if op.column in out else col(op.column)
            out[op.column] = (fix, op, cast_column(now, op.args["dtype"])) if op.kind == "cast_dtype" else (fix, None, rewritten(op, now))
    return out


def measured(df: DataFrame, changed: dict[str, Column], removable: dict[str, list[str]] | None = None) -> DataFrame:
    """invariants.measures of columns against what they become in the same row, with rows_months, rows_fractions of what they are.

    One shuffle of (column, before, after) counts; a column that rows share a value of is added up in each task first.
    """
    # Values are made in a projection of their own: an expression inside a generator is evaluated anew wherever it stands.
    sides = df.select(*[x for i, (c, new) in enumerate(changed.items()) for x in (text(col(c)).alias(f"b{i}"), text(new).alias(f"a{i}"))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, c in enumerate(changed)])
    counts = sides.select(F.inline(pairs)).groupBy("column", "before", "after").agg(F.count("*").alias("cnt"))
    gone = F.col("before").isNotNull() & F.col("after").isNull()
    for c, values in (removable or {}).items():
        gone = gone & ~((F.col("column") == c) & F.col("before").isin(*values))
    add = lambda where: F.coalesce(F.sum(F.when(where, F.col("cnt"))), F.lit(0)).alias
    # Both uses of the counts read all of their columns, so that one shuffle serves both. A spelling counts once a side; spellings are grouped by their key, so that no column's values meet in one task.
    spelt = counts.select("column", "cnt", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("value")), F.struct(F.lit(1).alias("side"), F.col("after").alias("value"))))).where("value is not null")
    more = spelt.groupBy("column", "side", "value").agg(F.sum("cnt").alias("cnt")).groupBy("column", "side", text_key(F.col("value")).alias("key")).agg((F.count("*") - 1).alias("more"))
    split = more.groupBy("column").agg(*[F.coalesce(F.sum(F.when(F.col("side") == i, F.col("more"))), F.lit(0)).alias(n) for i, n in enumerate(("split_before", "split_after"))])
    one = counts.groupBy("column").agg(
        F.sum("cnt").alias("rows"), add(F.col("before").isNull())("nulls_before"), add(F.col("after").isNull())("nulls_after"), add(F.col("before").isNotNull())("populated"), add(gone)("deleted"),
        add(F.col("before").isNotNull() & F.col("after").isNull())("lost"), add(F.col("before").isNotNull() & ~states_month(F.col("before")))("other_than_months"), add(~whole_number(F.col("before")))("fractions"))
    return one.join(F.broadcast(split), "column", "left").fillna(0, ["split_before", "split_after"])


def _log(df: DataFrame, row_id: str, kept: dict[str, tuple[Fix, Column]]) -> DataFrame | None:
    """The changed cells of a level: before and after stand in one row, so nothing is joined."""
    kept = {c: x for c, x in kept.items() if c != row_id}
    if not kept:
        return None
    sides = df.select(col(row_id).cast("long").alias("row_id"), *[x for i, (c, (_, new)) in enumerate(kept.items()) for x in (text(col(c)).alias(f"b{i}"), text(new).alias(f"a{i}"))])
    cells = [F.when(~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")), F.struct(F.lit("cell").alias("scope"), F.lit(c).alias("column"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"), F.lit(fix.id).alias("source"))) for i, (c, (fix, _)) in enumerate(kept.items())]
    return sides.select("row_id", F.inline(F.array_compact(F.array(*cells)))).select("scope", "row_id", "column", "before", "after", "source")


def _shape(columns: list[str], fixes: list[Fix]) -> list[tuple[str, str]]:
    """(column, name) of the columns that stay after the drops and renames of the fixes."""
    names = {c: c for c in columns}
    for fix in fixes:
        for op in fix.operations:
            if op.kind == "drop_column":
                names.pop(op.column, None)
            elif op.kind == "rename_column" and op.column in names and op.args.get("to") and op.args["to"] not in names.values():
                names[op.column] = op.args["to"]
    return [(c, names[c]) for c in columns if c in names]


def run_level(df: DataFrame, row_id: str, fixes: list[Fix], hinted=(), removable: dict[str, list[str]] | None = None, cut: Callable[[DataFrame], DataFrame] = cut, write: bool = False):
    """(df after the fixes that hold, {fix id: what it breaks}, log or None) of fixes that are projections on different columns.

    With write, rows are written once with their new values beside the old ones; without, the values are made where they are read.
    """
    columns, changed = df.columns, _changed(df, fixes)
    if write or any(o.kind == "apply_function" for f in fixes for o in f.operations):  # Python runs once a value, not for the aggregate, the log and the data
        tags = {c: f"__{uuid.uuid4().hex[:8]}" for c in changed}
        df = cut(df.select("*", *[new.alias(tags[c]) for c, (_, _, new) in changed.items()]))
        changed = {c: (fix, cast, col(tags[c])) for c, (fix, cast, _) in changed.items()}
    broken: dict[str, list[str]] = {f.id: [] for f in fixes}
    if changed:
        known = measured(df, {c: new for c, (_, _, new) in changed.items()}, removable)
        facts = {r["column"]: r for r in known.collect()}  # a row a column
        for c, (fix, cast, new) in list(changed.items()):
            if cast is None or c not in facts:
                continue
            dtype, r = cast.args["dtype"], facts[c]
            if r["lost"] or (dtype == "datetime" and r["populated"] and not r["other_than_months"]):
                del changed[c]  # nothing is cast where a value would be lost, or months would get days
                del facts[c]
            elif dtype == "float" and cast.args.get("precision") == 0 and not r["fractions"]:
                changed[c] = (fix, cast, cast_column(col(c), "integer"))
        owner = {c: fix.id for c, (fix, _, _) in changed.items()}
        for c, failure in invariants.failures([facts[c].asDict() for c in sorted(facts)], hinted):
            broken[owner[c]].append(failure)
    good = [f for f in fixes if not broken[f.id]]
    kept = {c: (fix, new) for c, (fix, _, new) in changed.items() if not broken[fix.id]}
    after = df.select(*[(kept[c][1] if c in kept else col(c)).alias(name) for c, name in _shape(columns, good)])
    return after, broken, _log(df, row_id, kept)


def _run_alone(df: DataFrame, row_id: str, fix: Fix, hints, hinted, removable, cut) -> tuple[DataFrame, list[str], DataFrame | None]:
    """A fix that joins, aggregates or drops rows, held against the data before by row id."""
    if [o.kind for o in fix.operations] == ["drop_duplicate_rows"]:  # rows only go: the ids that stay tell all, and only they are written
        names = [c for c in fix.operations[0].args.get("subset") or columns_of(df, row_id)]
        stay = cut(df.groupBy(*[col(c) for c in names]).agg(F.min(col(row_id)).alias("stay")).select("stay"))
        met = lambda how: df.join(stay, col(row_id) == F.col("stay"), how)
        gone = met("left_anti").select(F.lit("row").alias("scope"), col(row_id).cast("long").alias("row_id"), F.lit("").alias("column"), F.lit("present").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(fix.id).alias("source"))
        return met("left_semi"), [], gone
    after = cut(apply_fix(df, row_id, fix, hints))
    dedup = any(o.kind == "drop_duplicate_rows" for o in fix.operations)
    broken = [r["failure"] for r in invariants.check(df, after, row_id, fix.columns(), dedup, hinted, removable).collect()]
    return after, broken, None if broken else audit.cell_diff(df, after, row_id, fix.id)


def execute(df: DataFrame, row_id: str, plan: list[Fix], approved: set[str] | None = None, hints: dict[str, DataFrame] | None = None, hinted: set[str] = frozenset(), removable: dict[str, list[str]] | None = None, cut: Callable[[DataFrame], DataFrame] = cut):
    """(df, status, changes): the approved fixes of the plan under the invariants, as if they ran one after the other in its order.

    A fix is skipped if one it depends on wasn't executed or an equal one was, and rejected, its effect undone, if it breaks an
    invariant. status: (fix, status, reason), a row a fix. changes: the cell log of the executed ones. A level costs one
    aggregate; `cut`, which writes to shared storage, is called on the data with the first level's new values beside the old
    ones, before a fix with a level of its own if rows were rewritten since, and on what that fix makes.
    """
    spark, done, seen, logs = df.sparkSession, set(), set(), []
    status: dict[str, tuple[str, str]] = {f.id: ("not approved", "") for f in plan if approved is not None and f.id not in approved}
    steps = levels([f for f in plan if f.id not in status])
    place = {f.id: i for i, f in enumerate(plan)}
    rewritten_since, fresh = False, True  # whether rows were rewritten since they were written, and whether they never were
    for level in sorted({s.level for s in steps}):
        ready = []
        for fix in (s.fix for s in steps if s.level == level):
            if missing := [d for d in fix.depends_on if d not in done or place[d] > place[fix.id]]:
                status[fix.id] = ("skipped", f"needs {', '.join(missing)}")
            elif fix.fingerprint() in seen:
                status[fix.id] = ("skipped", "same as an earlier fix")
            else:
                ready.append(fix)
        if not ready:
            continue
        if by_row(ready[0]):
            df, broken, log = run_level(df, row_id, ready, hinted, removable, cut, fresh)
            rewritten_since = rewritten_since or not fresh
        else:
            df, rewritten_since = cut(df) if rewritten_since or fresh else df, False
            after, failures, log = _run_alone(df, row_id, ready[0], hints, hinted, removable, cut)
            broken = {ready[0].id: failures}
            df = df if failures else after
        fresh = False
        for fix in ready:
            status[fix.id] = ("rejected", "; ".join(sorted(broken[fix.id]))) if broken[fix.id] else ("executed", "")
            if not broken[fix.id]:
                done.add(fix.id)
                seen.add(fix.fingerprint())
        logs += [log] if log is not None else []
    changes = spark.createDataFrame([], audit.CHANGES)
    for log in logs:
        changes = changes.unionByName(log)
    return df, spark.createDataFrame([(f.id, *status[f.id]) for f in plan], "fix string, status string, reason string"), changes
