"""Importance resampling towards a target distribution, over hashed bags of n-grams.

Each n-gram falls into one of a fixed number of buckets. A bucket's gain is the log ratio of its smoothed shares in the
target and in the raw texts; a document weighs the sum of its features' gains. Gumbel noise, drawn from the id, turns
"take the highest scores" into sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, stash
from .interning import Spans, Table, batches_of, byte_map
from .sharding import numbered

BUCKETS = 10_000
ORDER = 1
SEED = 2024
#: Bytes of words: digits, letters of ASCII, and all of other characters.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _tables(texts: pa.Array, order: int, buckets: int) -> Iterator[tuple[int, Spans, list[tuple[Spans, Table, np.ndarray]]]]:
    """For each batch of texts: its first text's number, its words and, for runs of 1 to `order` words, the table and each used slot's bucket."""
    table = byte_map(WORD_BYTES)
    for at, raw, offsets in batches_of(texts):
        words = Spans(raw, offsets, table)
        found = []
        for n in range(1, order + 1):
            grams = words.grams(n)
            known = Table(grams)
            found.append((grams, known, np.fromiter((zlib.crc32(grams.text(j)) % buckets for j in known.holder), np.int64, len(known.holder))))
        yield at, words, found


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds. A task sends one row a bucket, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in _tables(b.column("text"), order, buckets):
                for _, known, bucket in found:
                    np.add.at(held, bucket, known.count)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["bucket", "n"])

    bound_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share in the raw texts, add-one smoothed, rounded down."""
    many, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + many) / ((float(x) + 1) * (t + many)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each of docs."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for at, words, found in _tables(b.column("text"), order, buckets):
                to = at + len(words.first) - 1
                out[0, at:to] = np.diff(words.first)
                for grams, known, bucket in found:
                    upto = np.concatenate([[0], np.cumsum(known.spread(gain[bucket]))])
                    out[1, at:to] += np.diff(grams.first)
                    out[2, at:to] += np.diff(upto[grams.first])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable made from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank; rank is null where the row isn't drawn.

    Of the rows with at least least_words words, percent / 100 (rounded down) with the highest scores are drawn, ties to
    the smaller id. A null or empty text has no features and weight 0; a null id takes the noise of an empty one and
    comes before other ids; rows with one id are ordered by features and weight, and equal rows are interchangeable.
    Without target texts, or where target has none, all gains come from the smoothing. Empty docs give an empty result.
    Other columns are not read. The texts are read twice; what is counted is a number for each bucket.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_col, order, buckets))
    rows = weights(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stash(rows.withColumns({"few": F.col("n_words") < least_words, "down": -F.col("score")}), "weights")
    draw = rows.where("not few").count() * percent // 100
    placed, _ = numbered(rows, ["few", "down", "doc_id", "n_features", "weight"], "at")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") < draw, F.col("at") + 1).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Rows need ids of their own; of equal ids all or none go by the best rank."""
    taken = resample(docs, target, id_col=id_col, **settings).where("rank is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(stash(taken, "drawn"), id_col, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range({n}), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes, for DuckDB, which has none."""
    return f"xor({_CRC.format(n=f'octet_length(encode({text}))', x=f'encode({text})')}, 4294967295)"


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS f FROM d),
v AS (SELECT f, {crc32_sql('f')} % 10000 AS bucket FROM (SELECT f FROM o UNION SELECT f FROM b)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN v USING (f) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
       (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nr FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nr <= (SELECT count(*) FROM c WHERE n_features >= 20) * 10 // 100 THEN nr END AS rank FROM r
"""
