"""Snapshots of a table that meet each other by row id without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.values import col
from .shared import scratch

#: Rows a bucket is sized for, where the number of buckets isn't given.
BUCKET_ROWS = 2_000_000


def snapshot(df: DataFrame, row_id: str, buckets: int | None = None) -> DataFrame:
    """df as it is now, written to the shared folder in buckets of the row id, each sorted by it.

    Two snapshots of one number of buckets, and frames that are derived from one row by row, join on the id without an
    Exchange. What is already bucketed so, such as rows derived from a snapshot, is written without one too. The number
    of buckets follows the rows, 8 at least, unless it is given; frames that are to meet take one number.
    """
    spark = df.sparkSession
    n = buckets or max(8, -(-df.count() // BUCKET_ROWS))
    name = f"snapshot_{uuid.uuid4().hex}"
    rows = df.repartition(n, col(row_id)).sortWithinPartitions(col(row_id))
    rows.write.bucketBy(n, row_id).sortBy(row_id).option("path", scratch(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)

