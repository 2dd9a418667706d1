"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table in buckets of the digest, each file sorted by it. New rows are digested once, grouped, matched
with the index by a sort-merge anti-join, and the digests it lacks are appended under the name of their batch. The
index is never shuffled for that; `compact` makes one file a bucket again after many appends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keyed, squeeze, stash, without

ROWS = "text_sha256 string, keep_id long, batch string"


def text_digest(text: str = "text"):
    """SHA-256, in lowercase hex, of the text with runs of white space as one space; null counts as empty."""
    return F.sha2(squeeze(F.coalesce(F.col(text).cast("string"), F.lit(""))), 256)


class DigestIndex:
    """(text_sha256, keep_id, batch), one row for each text seen so far.

    An index of the same table name is opened again, also by another session on the same catalogue; without a name a
    new one is made. A reader sees complete appends only.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        if spark.catalog.tableExists(self.table):
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {self.table}").collect()}
            self.path, self.buckets = about["Location"], int(about["Num Buckets"])
        else:
            self._write(spark.createDataFrame([], ROWS), self.table, self.path)

    def _write(self, rows: DataFrame, table: str, path: str) -> None:
        (rows.repartition(self.buckets, "text_sha256").write.mode("append").format("parquet").option("path", path)
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(table))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def compact(self) -> None:
        """Rewrites the index with one file a bucket, in a new folder; frames read before still read the old one."""
        fresh, path = f"{self.table}_{uuid.uuid4().hex[:8]}", fresh_path(self.spark, "digest-index")
        self._write(self.rows(), fresh, path)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")
        self.path = path

    def drop(self) -> None:
        """Takes the index out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Indexes docs and returns one row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

        Of equal texts the row with the smallest id stays, unless another batch has put the text into the index: then
        none does and keep_id names the row indexed then. group_size counts the rows of docs with that text. A batch
        that is added again under its name, after a failure or by mistake, appends nothing and gives the same answer.
        A null text is empty. Null ids come last. Of rows with equal id and text one is kept. Empty input gives an
        empty result and leaves the index as it is; other columns of docs are not read.
        """
        batch = batch or uuid.uuid4().hex
        seen = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("text_sha256"))
                     .groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = stash(seen.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("group_size")), "groups")
        known = self.rows().hint("merge")
        old = stash(groups.join(known, "text_sha256").select("text_sha256", F.col("keep_id").alias("old_id"), (F.col("batch") != batch).alias("known")), "known")
        fresh = groups.join(known, "text_sha256", "left_anti")
        self._write(stash(fresh.select("text_sha256", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")), "fresh"), self.table, self.path)
        groups = groups.join(old, "text_sha256", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        groups = stash(groups.withColumn("keep_id", F.when(F.col("known"), F.col("old_id")).otherwise(F.col("first_id"))), "verdicts")
        return (
            seen.join(groups, "text_sha256")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1) & ~F.col("known")).alias("kept"), "text_sha256")
        )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", single: bool = False) -> DataFrame:
    """docs without the rows whose text a kept row has already; all columns stay.

    Rows that repeat both id and text are all kept if their group keeps that id, or with single one of them is, so that
    one row of each text stays.
    """
    rows, key, numbered = keyed(docs, id_col)
    own = index or DigestIndex(docs.sparkSession)
    verdicts = stash(own.add(rows, id_col, text_col), "exact")
    if index is None:
        own.drop()
    if numbered:
        all_rows = stash(rows.select(key, F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("text_sha256")), "row-digests")
        kept = verdicts.where("kept").select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("sha"))
        stay = all_rows.join(kept, (F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("of"))).select(key, "text_sha256")
        if single:
            stay = stay.groupBy("text_sha256").agg(F.min(key).alias(key))
        dropped = all_rows.join(stay.select(key), key, "left_anti").select(key)
    else:
        dropped = verdicts.where("not kept").select(F.col("doc_id").alias(key))
    return without(rows, key, stash(dropped, "dropped"), docs.columns)


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """index.add over ranges of ids, smaller ids first, as if they had come one after the other.

    The result is that of one batch into an empty index: group_size counts the rows of all batches. Null ids come with
    the last batch.
    """
    edges = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = sum(((F.col(id_col).cast("long") > e).cast("int") for e in sorted(set(edges))), F.lit(0))
    number = F.when(F.col(id_col).isNull(), F.lit(len(set(edges)))).otherwise(number)
    rows = None
    for k in range(len(set(edges)) + 1):
        found = stash(index.add(docs.where(number == k), id_col, text_col, f"{id_col} range {k}"), "batch")
        rows = found if rows is None else rows.unionByName(found)
    totals = stash(rows.groupBy("text_sha256").agg(F.count("*").alias("group_size")).where("group_size > 1"), "sizes")
    return rows.drop("group_size").join(totals, "text_sha256", "left").select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "kept", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark)
    found = stash(dedup_in_batches(docs, index), "exact")
    index.drop()
    return found


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
