"""Sharding by a keyed permutation of global row numbers, in DataFrame operations only.

Rows are numbered globally in the order of their id. An alternating Feistel network over Z_a x Z_b, with a*b just
above the number of rows, permutes the numbers; a result outside the range walks on along its cycle until it is
inside. Position p of the shuffled order lies in shard p mod n, slot p div n, so shard and slot of any row number can
be computed without looking at the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_total, stash

ROUNDS = 6
#: Steps of a cycle walk. Up to a*b - rows < sqrt(rows) + 1 steps can be needed; each ends it with odds above 1 - 1/sqrt(rows).
WALK = 64


def _sides(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def _scramble(half: Column, seed: int, turn: int, below: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(seed), F.lit(turn)), F.lit(below))


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """Where row `number` of 0..rows-1 stands in the shuffled order: a bijection for each seed."""
    a, b = _sides(rows)

    def once(x: Column) -> Column:
        left, right = ((x - x % b) / b).cast("long"), x % b
        for r in range(0, ROUNDS, 2):
            left = (left + _scramble(right, seed, r, a)) % a
            right = (right + _scramble(left, seed, r + 1, b)) % b
        return left * b + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda at, _: F.when(at < rows, at).otherwise(once(at)))


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with their global number in the given order, and how many there are.

    A range partitioning sorts them; a row's number is its place in its partition plus the rows of earlier ones.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), local.alias("__at")), "numbered")
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    parts = stash(parts.withColumn("__before", running_total(parts, ["__part"], "__n")), "offsets")  # a row for each partition
    total = parts.agg(F.sum("__n")).first()[0] or 0
    out = placed.join(F.broadcast(parts.select("__part", "__before")), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before"), total


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Follows the law `rows`: shards hold equally many rows, give or take one, whatever the texts are. size is the
    text's UTF-8 bytes plus 8, text_crc32 the unsigned CRC-32 of those bytes; a null text has no bytes. Rows with
    equal id are ordered by checksum and size; rows equal in all three are interchangeable. Null ids come first.
    grown_shard is null under this law. Empty input gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), "sizes")
    placed, total = numbered(rows, ["doc_id", "text_crc32", "size"], "number")
    at = placed.withColumn("at", permuted(F.col("number"), total, seed))
    at = at.withColumn("at", F.when(F.col("at") < total, F.col("at")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % shards).cast("int").alias("shard"),
                     ((F.col("at") - F.col("at") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None  # the oracle engine has no CRC-32
