"""Helpers shared by the training-data operators: shared storage, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word rule in this subpackage, as a regular-expression class body.
WS = r"\x20\x09-\x0D"

#: Rows of an Arrow batch that carries texts.
TEXT_ROWS = 2_000

#: Most rows of narrow ids that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, one machine may take a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dataloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dataloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "cut", compression: str = "snappy", file_rows: int = 0) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a lineage cut that outlives lost executors.

    Unlike a cached or checkpointed frame the result carries no partitioning, so a later join shuffles both of its
    sides and adaptive execution may split skewed keys. Where rows are large, file_rows bounds those of a file: a task
    writes and reads a file by hundreds or thousands of rows at a time, however large they are.
    """
    path = fresh_path(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver collect garbage: Spark deletes the shuffle files of writes that are over once their plans are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks ids for a broadcast join if it is proven to be small, and leaves it to a shuffled join otherwise."""
    return F.broadcast(ids) if (ids.count() if rows is None else rows) <= BROADCAST_ROWS else ids


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """docs with a column of a long that names each row, the name of that column, and whether it isn't the id.

    The id is taken if no row lacks or repeats it. Otherwise rows get numbers, and are written with them so that every
    read has the same.
    """
    tag = f"__row_{uuid.uuid4().hex[:8]}"
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if ids.where("id is null or n > 1").limit(1).count():
        return stash(docs.withColumn(tag, F.monotonically_increasing_id()), "rows"), tag, True
    return docs.withColumn(tag, F.col(id_col).cast("long")), tag, False


def without(rows: DataFrame, key: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows whose key isn't in dropped, a stashed table of the one column that names the key."""
    return rows.join(small_side(dropped), key, "left_anti").select(*[rows[c] for c in columns])


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, f"[{WS}]+", " ")


def mix31(x: Column, salt: int) -> Column:
    """A pseudo-random number below 2^31 - 1 from a non-negative one below 2^32, in plain arithmetic any SQL has."""
    t = (x + F.lit(1_000_003 * (salt + 1))) % 2147483647
    t = (t * 1103515245 + 12345) % 2147483647
    t = t.bitwiseXOR(F.shiftright(t, 13))
    t = (t * 1812433253) % 2147483647
    return t.bitwiseXOR(F.shiftright(t, 11)) % 2147483647


def mix31_sql(x: str, salt: int) -> str:
    """mix31 for DuckDB."""
    t = f"((({x}) + {1_000_003 * (salt + 1)}) % 2147483647)"
    t = f"(({t} * 1103515245 + 12345) % 2147483647)"
    t = f"xor({t}, {t} >> 13)"
    t = f"(({t} * 1812433253) % 2147483647)"
    return f"(xor({t}, {t} >> 11) % 2147483647)"


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges: (node, component), component the smallest node that is reachable.

    Alternates the large-star and small-star steps; each halves what is left of long paths, so few rounds are
    needed. Every round is written to the shared folder. Edges with a null end are ignored. An empty input gives an
    empty result.
    """
    now = stash(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        now = stash(both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct(), "edges")
        least = stash(now.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "small")
        linked = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        now = stash(
            linked.select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi")
            .unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct(), "edges",
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def running_total(parts: DataFrame, order: list, value: str, within: list[str] | None = None) -> Column:
    """The sum of value over the rows before this one; for tables of one row a bucket, not of one row a record."""
    w = Window.partitionBy(*(within or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's Arrow batches to so many rows, where they are larger.

    Rows here carry whole texts, and a batch stands in the memory of the JVM and of the Python worker. The setting holds
    for the session, since frames are evaluated after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: int) -> Iterator[None]:
    """The session's settings of spark.sql that are named, with _ for the dot, while frames are written."""
    keys = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_pairs(pairs: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id_col): the rows of keys that two different ids have, each once; both columns are longs without nulls.

    One shuffle by key and a sort that may spill; a task holds a batch. Keys that very many rows have are to be kept
    out beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None  # the last row seen; it is out already if its key is known to be shared
        known = False
        for b in batches:
            k, d = b.column(key).to_numpy(), b.column(id_col).to_numpy()
            if not len(k):
                continue
            lead = last is not None
            if lead:
                k, d = np.append(last[0], k), np.append(last[1], d)
            same = k[1:] == k[:-1]
            repeated = same & (d[1:] == d[:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            shared = np.bincount(group, np.concatenate([[lead and known], same & ~repeated]), group[-1] + 1) > 0
            keep = shared[group]
            keep[1:] &= ~repeated
            if lead and known:
                keep[0] = False
            known = bool(shared[group[-1]])
            last = k[-1:], d[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(d[keep])], [key, id_col])

    return pairs.select(key, id_col).repartition(key).sortWithinPartitions(key, id_col).mapInArrow(run, f"{key} long, {id_col} long")


def frequent_keys(pairs: DataFrame, key: str, least: int, most: int) -> np.ndarray:
    """The keys that more than `least` rows of pairs have, sorted; those with most rows if there are more than `most`."""
    often = pairs.groupBy(key).count().where(F.col("count") > least).orderBy(F.desc("count"), key).limit(most)
    return np.array(sorted(r[key] for r in often.collect()), np.int64)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
