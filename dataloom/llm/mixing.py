"""Mixing sources to target weights by weighted fair queueing.

Every document of every source, up to a number of repeats, has a virtual finish time: the words its source has queued
up to its end, in a shuffled order that no rerun changes, divided by the source's weight. All items are put into the
order of their finish times, and the order is cut where it has filled the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, mix31, mix31_sql, running_total, small_side, stash

#: About so many rows share a bucket of the shuffled order or of virtual time.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 64
RANGE = 2147483647


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def place_of(doc_id: Column) -> Column:
    """A document's place in the shuffled order."""
    return mix31(F.coalesce(F.pmod(doc_id, F.lit(RANGE)), F.lit(0)), 7)


def targets(sources: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """Adds source_rank, weight, level and target to (source, source_size), one row a source.

    Weights go to sources in code-point order, null last, and repeat. The sources share the sum of all sizes by
    weight; none gets more than `repeats` times its size, and what that leaves is shared again by weight: target is
    min(repeats * size, level * weight) at the level where the targets fill the budget.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("source_rank", F.row_number().over(order)).withColumn("weight", F.get(cycle, (F.col("source_rank") - 1) % len(weights)))
    by_cap = Window.orderBy(F.col("source_size") * repeats / F.col("weight"), "source_rank")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    step = ranked.withColumn("at", (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("at") <= F.col("source_size") * repeats / F.col("weight"), F.col("at"))
    step = step.withColumn("level", F.coalesce(F.max(fits).over(whole), F.lit(0.0)))
    target = F.least((F.col("source_size") * repeats).cast("double"), F.col("level") * F.col("weight"))
    return step.select("source", "source_size", "source_rank", "weight", "level", target.alias("target"))


def queue(docs: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """(rows with finish-time parts, cut): what `mix` and `mixed_documents` derive their results from.

    rows: doc_id, source, size, source_size, target, weight, source_rank, place, ahead - `ahead` are the source's words
    up to and with the document in the shuffled order; its e-th repeat finishes at (e * source_size + ahead) / weight.
    cut: the (finish, source_rank, place, doc_id, size) of the last item that the budget holds, or None.
    """
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stash(targets(sources, list(weights), repeats), "targets")
    count = rows.count()
    buckets = max(LEAST_BUCKETS, math.ceil(count / BUCKET_ROWS))
    rows = rows.withColumn("place", place_of(F.col("doc_id"))).withColumn("bucket", F.floor(F.col("place") * buckets / RANGE).cast("long"))
    named = sources.withColumnRenamed("source", "__name")
    rows = rows.join(small_side(named), F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    totals = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("words"))
    totals = stash(totals.withColumn("earlier", running_total(totals, ["bucket"], "words", ["source_rank"])).drop("words"), "offsets")
    inside = Window.partitionBy("source_rank", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(totals, ["source_rank", "bucket"])
    rows = stash(rows.select("doc_id", "source", "size", "source_size", "target", "weight", "level", "source_rank", "place", (F.col("earlier") + F.col("inside")).alias("ahead")), "queue")
    # The order of finish times, in buckets of virtual time; only the bucket in which the budget ends is sorted here.
    items = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    items = items.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("ahead")) / F.col("weight"))
    span = F.when(F.col("level") > 0, F.col("level")).otherwise(1.0)
    items = items.withColumn("bucket", F.least(F.floor(F.col("finish") / span * buckets), F.lit(buckets * 64)).cast("long"))
    sums = items.groupBy("bucket").agg(F.sum("size").alias("words"))
    sums = stash(sums.withColumn("earlier", running_total(sums, ["bucket"], "words")), "time")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    edge = sums.where(F.col("earlier") + F.col("words") > budget).agg(F.min_by(F.struct("bucket", "earlier"), "bucket").alias("e")).first()["e"]
    cut = None
    key = ["finish", "source_rank", "place", "doc_id", "size"]
    if edge is not None:
        upto = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        last = items.where(F.col("bucket") == edge["bucket"]).withColumn("upto", F.sum("size").over(upto))
        last = last.where(F.col("upto") + edge["earlier"] <= budget)
        cut = last.agg(F.max(F.struct(*key)).alias("k")).first()["k"]
        if cut is None:  # nothing of that bucket fits: the order ends with the one before
            cut = items.where(F.col("bucket") < edge["bucket"]).agg(F.max(F.struct(*key)).alias("k")).first()["k"]
    return rows, (cut, edge is not None)


def _taken(rows: DataFrame, cut, repeats: int):
    """How often the mix takes each row."""
    last, ends = cut
    if not ends:
        return F.lit(repeats)
    if last is None:
        return F.lit(0)
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("ahead")) / F.col("weight")
    least = -(1 << 63)  # null ids come first, as they do in the sort
    limit = F.struct(F.lit(last["finish"]), F.lit(last["source_rank"]).cast("int"), F.lit(last["place"]).cast("long"), F.lit(least if last["doc_id"] is None else last["doc_id"]).cast("long"), F.lit(last["size"]).cast("long"))

    def not_after(e):
        return F.struct(finish(e), F.col("source_rank").cast("int"), F.col("place").cast("long"), F.coalesce(F.col("doc_id"), F.lit(least)), F.col("size")) <= limit

    return sum((not_after(e).cast("int") for e in range(1, repeats)), not_after(0).cast("int"))


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3, **cols: str) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, times.

    size counts the words of the whole text (null: none), target is the share of the row's source, taken the words
    the mix takes of the row with repeats (times * size). Sources are compared by code point, null is a source of its
    own and last. Rows with equal id are ordered by size; rows equal in both are interchangeable. Empty input gives an
    empty result; where no row has a word, nothing is short and every row is taken `repeats` times for zero words.
    """
    rows, cut = queue(docs, weights, repeats, **cols)
    times = _taken(rows, cut, repeats)
    return rows.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"))


def mixed_documents(docs: DataFrame, weights=(1.0, 2.0, 3.0), repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, with its columns; rows taken zero times are left out.

    The copies of a row stay together; `queue` has the finish times for a reader that wants them in order. Finish times
    rise with the shuffled order inside a source, so the cut is one last (place, doc_id, size) a source and repeat: rows
    are held against that table of a row a source, and texts are never shuffled.
    """
    rows, cut = queue(docs, weights, repeats, id_col, text_col, source_col)
    least = F.lit(-(1 << 63))
    spot = F.struct("place", F.coalesce("doc_id", least).alias("id"), "size")
    last = [F.max(F.when(_taken(rows, cut, repeats) > e, spot)).alias(f"__last_{e}") for e in range(repeats)]
    lasts = stash(rows.groupBy(F.col("source").alias("__name")).agg(*last), "lasts")
    known = docs.join(small_side(lasts), F.col(source_col).cast("string").eqNullSafe(F.col("__name")))
    doc_id, where = F.coalesce(docs[id_col].cast("long"), least), place_of(docs[id_col].cast("long"))

    def taken(e: int):
        at = F.col(f"__last_{e}")
        same = F.when(where < at["place"], True).when(where > at["place"], False).when(doc_id < at["id"], True).when(doc_id > at["id"], False)
        return F.when(at.isNull(), 0).otherwise(same.otherwise(word_count(text_col) <= at["size"]).cast("int"))  # words are counted for ties only

    known = known.withColumn("__times", sum((taken(e) for e in range(1, repeats)), taken(0))).where("__times > 0")
    return known.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("times")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS rk FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::DOUBLE AS weight FROM r),
a AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(weight) OVER (ORDER BY source_size * 3 / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
l AS (SELECT *, coalesce(max(CASE WHEN lv <= source_size * 3 / weight THEN lv END) OVER (), 0.0) AS level FROM a),
q AS (SELECT d.doc_id, d.size, l.source_size, least((l.source_size * 3)::DOUBLE, l.level * l.weight) AS target, l.weight, l.rk, {mix31_sql('d.doc_id % 2147483647', 7)} AS place
      FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY rk ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ahead FROM q),
i AS (SELECT c.*, (e * source_size + ahead)::DOUBLE / weight AS finish FROM c, range(3) t(e)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM i)
SELECT doc_id, size, source_size, target, sum(CASE WHEN upto <= (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM o GROUP BY doc_id, size, source_size, target
"""
