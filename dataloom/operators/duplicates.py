"""Duplicate rows, colliding keys, duplicate columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import col, columns_of, text, text_key, try_number
from ..sources.shared import spread
from .completeness import violation_rows
from .rules import BLOCK, RELATIVE, TOLERANCE
from .schema import conforms, normal_name

KEY_SHARE, MOST_KEYS, SAME, DIVERGED = 0.95, 2, 0.80, 0.01


def exact_duplicates(df: DataFrame, row_id: str) -> DataFrame:
    """One row: rows, and rows beyond the first of equal ones, nulls being equal. Partial aggregation collapses frequent rows before the shuffle."""
    g = df.groupBy(*[col(c) for c in columns_of(df, row_id)]).agg(F.count("*").alias("__n"))
    return g.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def key_columns(profile: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """From column_profile: (column, uniqueness) of the best columns that are 0.95 unique or more."""
    u = F.col("distinct") / F.col("populated")
    return profile.where((F.col("populated") > 0) & (u >= KEY_SHARE)).select("column", F.round(u, 4).alias("uniqueness"), u.alias("u")).orderBy(F.desc("u"), "column").limit(most).drop("u")


def _groups(df: DataFrame, row_id: str, key: str) -> DataFrame:
    others = [F.coalesce(text(col(c)), F.lit("\0")) for c in columns_of(df, row_id) if c != key]
    versions = df.where(col(key).isNotNull()).groupBy(text(col(key)).alias("key"), F.sha2(F.to_json(F.array(*others)), 256).alias("rest")).agg(F.count("*").alias("n"), F.min(col(row_id)).alias("first"))
    return versions.groupBy("key").agg(F.sum("n").alias("rows"), F.count("*").alias("versions"), F.min("first").alias("first"))


def key_collisions(df: DataFrame, row_id: str, key: str) -> DataFrame:
    """One row of counts: repeated keys, their rows, keys whose rows differ elsewhere, rows of those."""
    g = _groups(df, row_id, key).where("rows > 1")
    return g.agg(F.count("*").alias("duplicated_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("affected_rows"), F.count_if(F.col("versions") > 1).alias("conflicting_keys"), F.coalesce(F.sum(F.when(F.col("versions") > 1, F.col("rows"))), F.lit(0)).alias("rows_in_conflict"))


def collision_violations(df: DataFrame, row_id: str, key: str) -> DataFrame:
    """One violation for each key whose rows differ elsewhere."""
    g = _groups(df, row_id, key).where("versions > 1").withColumn("column", F.lit(key))
    return violation_rows(g, "column", F.col("first"), F.col("key"), F.lit(f"unique {key}"), "uniqueness", F.col("rows"))


def drop_duplicate_rows(df: DataFrame, row_id: str, subset: list[str] | None = None) -> DataFrame:
    """df with the row of smallest id of each set of rows equal in the subset (all columns by default), nulls being equal.

    Only ids are grouped and partial aggregation keeps one a task, so a row that fills a third of the table is no hot spot.
    """
    names = subset or columns_of(df, row_id)
    keep = df.groupBy(*[col(c) for c in names]).agg(F.min(col(row_id)).alias("__keep")).select(F.col("__keep").alias(row_id))
    return df.join(keep, row_id, "left_semi")


class PairCounters:
    """What pairs of columns have in common, filled block by block; the counters of blocks add up.

    A row of many columns costs a sort of its values, not a look at every pair: equal texts, and numbers within the tolerance,
    stand next to each other in that order, so pairs come up only where columns do hold one value. Rows that both columns of a
    pair populate are a matrix product.
    """

    def __init__(self, k: int, absolute: float, relative: float):
        self.k, self.absolute, self.relative = k, absolute, relative
        self.both, self.same, self.numbers, self.near = (np.zeros((k, k), np.int64) for _ in range(4))

    def _count(self, out: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        out += np.bincount(left * self.k + right, minlength=self.k * self.k).reshape(self.k, self.k)

    @staticmethod
    def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, values) of each row by value; a row of x a column."""
        rows = np.ascontiguousarray(x.T)
        order = np.argsort(rows, axis=1)
        return np.ascontiguousarray(order.T), np.ascontiguousarray(np.take_along_axis(rows, order, 1).T)

    def add(self, code: np.ndarray, x: np.ndarray) -> None:
        """code: equal numbers for equal texts, -1 for none; x: numbers, NaN for none; a row a column in both."""
        there = (code >= 0).astype(np.float32)
        self.both += (there @ there.T).astype(np.int64)
        order, ranked = self._ordered(code)
        for step in range(1, self.k):
            hit = (ranked[step:] == ranked[:-step]) & (ranked[step:] >= 0)
            if not hit.any():
                break
            a, b = order[:-step][hit], order[step:][hit]
            self._count(self.same, a, b)
            self._count(self.same, b, a)
        there = (~np.isnan(x)).astype(np.float32)
        self.numbers += (there @ there.T).astype(np.int64)
        order, ranked = self._ordered(x)  # NaN comes last
        for step in range(1, self.k):
            low, high = ranked[:-step], ranked[step:]
            with np.errstate(invalid="ignore"):
                gap = high - low
                hit = gap <= self.absolute + self.relative * np.maximum(np.abs(low), np.abs(high))
            if not hit.any():
                break
            a, b, gap, low, high = order[:-step][hit], order[step:][hit], gap[hit], low[hit], high[hit]
            for left, right, y in ((a, b, high), (b, a, low)):  # the tolerance is the right column's
                close_ = gap <= self.absolute + self.relative * np.abs(y)
                self._count(self.near, left[close_], right[close_])


def pair_counters(df: DataFrame, names: list[str], absolute: float = TOLERANCE, relative: float = RELATIVE, blank: bool = False) -> DataFrame:
    """(i, j, n, t, c, e) of every two of the columns, by their places in names: rows that both populate, with equal text, with
    two numbers, with numbers alike. One scan whatever the number of columns; a task sends a row a pair. With blank, null is an empty text."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = PairCounters(k, absolute, relative)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                cells = pc.dictionary_encode(pa.concat_arrays([c.cast(pa.large_string()) for c in part.columns[:k]]))
                code = pc.fill_null(cells.indices, -1).to_numpy().reshape(k, part.num_rows)
                found.add(code, np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[k:]]))
        i, j = np.nonzero(~np.eye(k, dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, *(m[i, j] for m in (found.both, found.same, found.numbers, found.near)))], list("ijntce"))

    values = spread(df.select(*[text(col(c)).alias(f"v{i}") for i, c in enumerate(names)]))
    keys = [text_key(F.col(f"v{i}")) for i in range(k)]
    rows = values.select(*[(F.coalesce(t, F.lit("")) if blank else t).alias(f"t{i}") for i, t in enumerate(keys)], *[try_number(F.col(f"v{i}")).alias(f"x{i}") for i in range(k)])
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in "ijntce")).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "ntce"])


def _named(counters: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    at = {c: i for i, c in enumerate(names)}
    wanted = counters.sparkSession.createDataFrame([(a, b, at[a], at[b]) for a, b in pairs], "left string, right string, i long, j long")
    return counters.join(F.broadcast(wanted), ["i", "j"])


def similarity(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, text_share, numeric_share, similarity) for pairs of columns.

    text_share: equal stripped lower-case text where both are populated. numeric_share: equal numbers where both read as
    numbers, times the share of jointly populated rows that do. similarity is the greater.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    out = _named(pair_counters(df, names), names, pairs)
    t, n = F.col("t") / F.col("n"), F.when(F.col("c") > 0, F.col("e") / F.col("c") * F.col("c") / F.col("n"))
    out = out.where("n > 0").select("left", "right", F.round(t, 4).alias("text_share"), F.round(F.coalesce(n, F.lit(0.0)), 4).alias("numeric_share"))
    return out.withColumn("similarity", F.greatest("text_share", "numeric_share"))


def all_pairs(df: DataFrame, row_id: str) -> list[tuple[str, str]]:
    names = columns_of(df, row_id)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def column_groups(similar: DataFrame, least: float = SAME) -> DataFrame:
    """(column, group): connected components of columns over pairs of at least `least`; group is the first name. Rows are pairs of columns of one table."""
    up: dict[str, str] = {}

    def root(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for r in similar.where(F.col("similarity") >= least).select("left", "right").collect():
        a, b = sorted((root(r["left"]), root(r["right"])))
        up[b] = a
    return similar.sparkSession.createDataFrame([(c, root(c)) for c in sorted(up)], "column string, group string")


def elect_survivors(groups: DataFrame, coherence: DataFrame, rates: DataFrame) -> DataFrame:
    """(group, survivor): the member of best coherence, then fewest nulls, then first position."""
    m = groups.join(coherence.select(F.col("target").alias("column"), "coherence"), "column", "left").join(rates.select("column", "nulls", "position"), "column")
    w = Window.partitionBy("group").orderBy(F.desc(F.coalesce("coherence", F.lit(-1.0))), "nulls", "position")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("group", F.col("column").alias("survivor"))


def elect_names(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """(group, name): the only conforming member, else the first member's normal name."""
    m = groups.join(rates.select("column", "position"), "column").withColumn("good", conforms(F.col("column")))
    g = m.groupBy("group").agg(F.count_if("good").alias("n"), F.max(F.when(F.col("good"), F.col("column"))).alias("only"), F.min(F.struct("position", "column")).alias("first"))
    return g.select("group", F.when(F.col("n") == 1, F.col("only")).otherwise(normal_name(F.col("first.column"))).alias("name"))


def collapse(df: DataFrame, survivor: str, siblings: list[str], name: str) -> DataFrame:
    """df with the survivor's nulls filled from its siblings in order, renamed, and the siblings dropped. Row-local."""
    same = dict(df.dtypes)
    parts = [col(c) if all(same[s] == same[survivor] for s in siblings) else text(col(c)) for c in [survivor, *siblings]]
    return df.select(*[(F.coalesce(*parts) if c == survivor else col(c)).alias(name if c == survivor else c) for c in df.columns if c not in siblings])


def divergence(df: DataFrame, survivor: str, sibling: str, most: int = 10) -> DataFrame:
    """(differing, only_in_sibling): rows where both are populated and differ, and up to 10 values that the survivor lacks."""
    a, b = text(col(survivor)), text(col(sibling))
    n = df.agg(F.count_if(a != b).alias("differing"))
    lost = df.select(b.alias("v")).where("v is not null").distinct().join(df.select(a.alias("v")).where("v is not null").distinct(), "v", "left_anti")
    return n.join(lost.orderBy("v").limit(most).agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("only_in_sibling")), F.lit(True))


def divergence_violations(df: DataFrame, survivor: str, siblings: list[str]) -> DataFrame:
    """A schema violation for the survivor if more than 0.01 of the rows differ from its siblings."""
    differs = sum((F.count_if(text(col(survivor)) != text(col(s))) for s in siblings), F.lit(0))
    n = df.agg(F.count("*").alias("rows"), differs.alias("differing")).where(F.col("differing") > DIVERGED * F.col("rows")).withColumn("column", F.lit(survivor))
    return violation_rows(n, "column", F.lit(-1), F.lit(None), F.lit("duplicate column diverges"), "schema", F.col("differing"))


def census_pairs(df: DataFrame, row_id: str, least: float = 0.90) -> DataFrame:
    """(left, right, text_share, numeric_share): pairs alike in 0.9 of all rows as text, or of the rows where both are numbers."""
    names = columns_of(df, row_id)
    n = df.count()
    counted = _named(pair_counters(df, names, 1e-8, 1e-5, blank=True), names, all_pairs(df, row_id))
    out = counted.select("left", "right", (F.col("t") / n).alias("t"), F.when(F.col("c") > 0, F.col("e") / F.col("c")).alias("e"))
    return out.where(F.greatest("t", "e") >= least).select("left", "right", F.round("t", 4).alias("text_share"), F.round("e", 4).alias("numeric_share"))


def row_census(df: DataFrame, row_id: str, key: str) -> DataFrame:
    """One row: duplicate rows, duplicate rows leaving the key out, repeated key values."""
    full = exact_duplicates(df, row_id).select(F.col("duplicates").alias("exact"))
    rest = exact_duplicates(df.drop(key), row_id).select(F.col("duplicates").alias("exact_without_key"))
    keys = df.agg((F.count(col(key)) - F.count_distinct(col(key))).alias("repeated_keys"))
    return full.join(rest, F.lit(True)).join(keys, F.lit(True))


