"""Exact top-k search by inner product with a pivot table.

For every vector the distances to many pivots are computed once. By the triangle inequality the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound on d(q, x), and so

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2  <=  (|q|^2 + |x|^2 - bound^2) / 2.

1. Vectors are cut into blocks by their nearest pivot; a block knows its least and greatest distance to every pivot.
2. Queries are held against one block of their own nearest pivot, which gives each a k-th score to beat.
3. A block of candidates is sent to those blocks of queries only which its bound reaches.
4. A task runs a block of queries along its candidate blocks, highest bound first. Inside a block candidates are
   scored in the order of their bounds until the bound falls below every query's k-th score. Each query leaves at most
   k rows a lane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, stash

PIVOTS = 64
#: Rows, those with the smallest hashes, from which pivots are picked.
PIVOT_SAMPLE = 4_096
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 2_048
LANES = 8
#: Candidates scored between two looks at the bound.
CHUNK = 512
#: Pivots by which a block's candidates are bounded first; the others are used if these exclude a share of SPARED.
PROBE, SPARED = 4, 0.02
#: Blocks whose summaries travel together.
SUMMARIES = 512
PACKED = "dim int, block long, ids binary, vectors binary, width int, pivots binary, low binary, high binary, most double"
NONE = -(1 << 63)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component. Null vectors, null or non-finite components, null ids: left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def pick_pivots(sample: list[list[int]], most: int) -> np.ndarray:
    """Pivots far from each other: each is the sampled vector with the greatest distance to those picked before."""
    x = np.asarray(sample, float)
    picked, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(most, len(x)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


class Block:
    """Vectors of one length with their distances to the pivots."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(len(self.ids), row["dim"])
        self.f = self.x.astype(float)
        self.norm = np.einsum("ij,ij->i", self.f, self.f)
        self.table = np.frombuffer(row["pivots"], np.float32).reshape(-1, len(self.ids))  # a row for each pivot
        self.low, self.high = np.frombuffer(row["low"]), np.frombuffer(row["high"])


class Best:
    """The k best (score, id) of each of n queries so far; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.n, self.k = n, k
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(n, NONE) if floors is None else floors.copy()  # a score that k candidates reach is never below it

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, np.arange(self.n))
        keep = np.arange(len(row)) - first[row] < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        count = np.bincount(self.row, minlength=self.n)
        full = np.flatnonzero(count == self.k)
        last = np.searchsorted(self.row, full, "right") - 1
        self.worst[full] = np.maximum(self.worst[full], self.score[last])


def upper_bounds(norms: np.ndarray, gaps: np.ndarray, slack: float) -> np.ndarray:
    """The largest inner products that sums of squared norms and lower bounds on distances allow."""
    low = np.maximum(gaps - slack, 0)
    return np.floor((norms - low * low) / 2 * (1 + 1e-12) + 1e-3)


def search_block(queries: Block, c: Block, best: Best) -> int:
    """Improves best by the candidates of c; returns how many pairs were scored."""
    if not len(c.ids) or not len(queries.ids):
        return 0
    small = max(np.abs(queries.f).max(initial=0), 1) * max(np.abs(c.f).max(initial=0), 1) * max(1, c.x.shape[1]) < 2**52
    slack = 1e-4 * (math.sqrt(queries.norm.max()) + math.sqrt(c.norm.max()) + 1)  # the table holds single-precision numbers
    n_pivots = len(c.table)
    gap = np.zeros(len(queries.ids))
    for p in range(n_pivots):
        np.maximum(gap, np.maximum(c.low[p] - queries.table[p], queries.table[p] - c.high[p]), out=gap)
    rows = np.flatnonzero(upper_bounds(queries.norm + c.norm.max(), gap, slack) >= best.worst)
    if not len(rows):
        return 0
    gaps = np.zeros((len(rows), len(c.ids)), np.float32)
    by_spread = np.argsort(c.low - c.high, kind="stable")  # the widest first
    for part in (by_spread[:PROBE], by_spread[PROBE:]):
        for p in part:
            np.maximum(gaps, np.abs(queries.table[p][rows][:, None] - c.table[p]), out=gaps)
        bound = upper_bounds(queries.norm[rows][:, None] + c.norm, gaps, slack)
        keep = bound >= best.worst[rows][:, None]
        if keep.mean() > 1 - SPARED:  # further pivots would cost more than they spare
            break
    highest = bound.max(axis=0)
    order = np.argsort(-highest, kind="stable")
    scored = 0
    for at in range(0, len(order), CHUNK):
        part = order[at:at + CHUNK]
        if highest[part[0]] < best.worst[rows].min():
            break
        live = (bound[:, part] >= best.worst[rows][:, None]) & (queries.ids[rows][:, None] != c.ids[part])
        use = np.flatnonzero(live.any(axis=1))
        if not len(use):
            continue
        q = rows[use]
        got = np.rint(queries.f[q] @ c.f[part].T).astype(np.int64) if small else queries.x[q].astype(np.int64) @ c.x[part].astype(np.int64).T
        live = live[use]
        scored += int(live.sum())
        got = np.where(live, got, NONE)
        least = best.worst[q]
        if got.shape[1] > best.k:
            least = np.maximum(least, np.partition(got, -best.k, axis=1)[:, -best.k])
        i, j = np.nonzero(live & (got >= least[:, None]))
        best.add(q[i], got[i, j], c.ids[part[j]])
    return scored


def _place(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                p = pivots.get(int(dim))
                if p is not None:
                    at = np.flatnonzero(dims == dim)
                    x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
                    cell[at] = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "v", "dim", "is_query")), pa.array(cell)], ["vec_id", "v", "dim", "is_query", "cell"])

    return run


def _pack(pivots: dict[int, np.ndarray]):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, block = key[0].as_py(), key[1].as_py()
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids)
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)[order]
        top = np.abs(x.astype(float)).max(initial=0)
        width = next(w for w in (1, 2, 4, 8) if w == 8 or top < 2 ** (8 * w - 1))
        p = pivots.get(dim, np.zeros((0, dim)))
        gaps = np.stack([np.linalg.norm(x - q, axis=1) for q in p]) if len(p) else np.zeros((0, len(ids)))
        norm = float((x.astype(float) ** 2).sum(axis=1).max(initial=0))
        row = {"dim": dim, "block": block, "ids": ids[order].tobytes(), "vectors": x.astype(f"i{width}").tobytes(), "width": width,
               "pivots": gaps.astype(np.float32).tobytes(), "low": gaps.min(axis=1, initial=np.inf).tobytes(), "high": gaps.max(axis=1, initial=-np.inf).tobytes(), "most": norm}
        kinds = {"dim": pa.int32(), "block": pa.int64(), "width": pa.int32(), "most": pa.float64()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    return pack


def chain(pivots: np.ndarray) -> list[int]:
    """The place of each pivot on a walk from the first one that always goes on to the nearest pivot not yet met."""
    left, at, place = set(range(1, len(pivots))), 0, [0] * len(pivots)
    while left:
        near = min(left, key=lambda j: (float(np.linalg.norm(pivots[j] - pivots[at])), j))
        place[near], at = place[at] + 1, near
        left.remove(near)
    return place


def cut_blocks(counts: list[tuple[int, int]], most: int, first: int = 0) -> tuple[dict[int, tuple[int, int]], int]:
    """For (cell, rows) in order: cell -> (first block, number of blocks), and the next free block number.

    Cells one after the other share a block while they fit into it; a larger cell is cut into several.
    """
    out, at, room = {}, first - 1, 0
    for cell, n in counts:
        blocks = -(-n // most)
        if not n:
            continue
        if n <= room:
            out[cell], room = (at, 1), room - n
        else:
            out[cell] = (at + 1, blocks)
            at, room = at + blocks, most - n if blocks == 1 else 0
    return out, at + 1


def _search(rows: DataFrame, keys: list[str], k: int, schema: str, result) -> DataFrame:
    """Runs each query block (role 0) along the candidate blocks sorted behind it; keys name what stays together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = best = at = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                key = tuple(row[c] for c in keys)
                if row["role"] == 0:
                    if queries is not None:
                        yield result(at, queries, best)
                    queries, at = Block(row), key
                    best = Best(len(queries.ids), k, None if row["floors"] is None else np.frombuffer(row["floors"], np.int64))
                elif key == at:
                    search_block(queries, Block(row), best)
                else:
                    raise ValueError(f"candidates without queries: {key}")
        if queries is not None:
            yield result(at, queries, best)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "role", F.col("bound").desc(), "block").mapInArrow(run, schema)


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(dim, query_block, block, bound): the pairs of blocks whose bound reaches a query's floor; from (dim, block, low, high, most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q = {c: b.column(c)[i].as_py() for c in ("dim", "query_block", "low", "high", "most", "floor")}
                low, high, many = np.frombuffer(q["low"]), np.frombuffer(q["high"]), b.column("blocks")[i].as_py()
                c_low, c_high = (np.stack([np.frombuffer(x[c]) for x in many]) for c in ("low", "high"))
                gap = np.maximum(np.maximum(c_low - high, low - c_high).max(axis=1, initial=0), 0)
                most = np.array([x["most"] for x in many])
                bound = upper_bounds(q["most"] + most, gap, 1e-4 * (math.sqrt(q["most"]) + np.sqrt(most) + 1))
                keep = np.flatnonzero(bound >= q["floor"])
                yield pa.RecordBatch.from_arrays([pa.array([q["dim"]] * len(keep), pa.int32()), pa.array([q["query_block"]] * len(keep), pa.int64()), pa.array([many[j]["block"] for j in keep], pa.int64()), pa.array(bound[keep], pa.float64())],
                                                 ["dim", "query_block", "block", "bound"])

    many = candidates.groupBy("dim", F.floor(F.col("block") / SUMMARIES).alias("part")).agg(F.collect_list(F.struct("block", "low", "high", "most")).alias("blocks"))
    return queries.join(many, "dim").select("dim", "query_block", "low", "high", "most", "floor", "blocks").mapInArrow(run, "dim int, query_block long, block long, bound double")


def top_k(rows: DataFrame, is_query, k: int = 20, scale: float = 64.0, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner products for every row that is_query marks.

    Scores are exact integers of the floored, scaled vectors; ties go to the smaller vec_id. Candidates are all rows
    but those with the query's own id, of vectors of the query's length (others have no inner product with it). Where
    ids repeat, the smallest vector in array order stands for the id. Rows with null id or vector, or a null or
    non-finite component, take no part. A query with fewer than k candidates gets them all, with none no row. Scores
    must fit 64 bits. Empty input gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    vectors = stash(integer_vectors(rows, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors")
    picks: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect():
        picks.setdefault(r["dim"], []).append(r["v"])
    table = {dim: pick_pivots(sample, pivots) for dim, sample in picks.items() if dim}
    placed = vectors.select("vec_id", "v", "dim", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    placed = stash(placed.mapInArrow(_place(table), "vec_id long, v array<long>, dim int, is_query boolean, cell int"), "placed")
    # A row for each cell. Cells are taken in an order in which neighbours follow each other.
    ranks = {dim: chain(p) for dim, p in table.items()}
    counts: dict[int, list] = {}
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries")).collect():
        rank = ranks[r["dim"]][r["cell"]] if r["dim"] in ranks else 0
        counts.setdefault(r["dim"], []).append((rank, r["cell"], r["n"], r["queries"]))
    cells, q_at, c_at = [], 0, 0
    for dim, found in counts.items():
        found.sort()
        of_q, q_at = cut_blocks([(cell, q) for _, cell, _, q in found], QUERY_BLOCK, q_at)
        of_c, c_at = cut_blocks([(cell, n) for _, cell, n, _ in found], CANDIDATE_BLOCK, c_at)
        cells += [(dim, cell, *of_q.get(cell, (0, 0)), *of_c[cell]) for _, cell, _, _ in found]
    cells = spark.createDataFrame(cells, "dim int, cell int, q_first long, q_blocks long, c_first long, c_blocks long")
    known = placed.join(F.broadcast(cells), ["dim", "cell"])
    spread = lambda first, n: F.col(first) + F.pmod(F.xxhash64("vec_id"), F.greatest(F.col(n), F.lit(1)))
    packed_q = stash(known.where("is_query").withColumn("block", spread("q_first", "q_blocks")).groupBy("dim", "block").applyInArrow(_pack(table), PACKED).withColumnRenamed("block", "query_block"), "queries")
    packed_c = stash(known.withColumn("block", spread("c_first", "c_blocks")).groupBy("dim", "block").applyInArrow(_pack(table), PACKED), "candidates")

    columns = ["role", "dim", "query_block", "lane", "block", "bound", "ids", "vectors", "width", "pivots", "low", "high", "floors"]
    none = F.lit(None)
    as_query = lambda df: df.withColumn("role", F.lit(0)).withColumn("block", none.cast("long")).withColumn("bound", none.cast("double")).select(columns)
    as_candidate = lambda df: df.withColumn("role", F.lit(1)).withColumn("floors", none.cast("binary")).select(columns)

    def floors(at, queries, best):
        full = np.bincount(best.row, minlength=best.n) == k
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([best.worst.tobytes()], pa.binary()), pa.array([int(best.worst.min()) if full.all() else NONE], pa.int64())],
                                          ["dim", "query_block", "floors", "floor"])

    own = cells.where("q_blocks > 0").select("dim", F.explode(F.sequence(F.col("q_first"), F.col("q_first") + F.col("q_blocks") - 1)).alias("query_block"), F.col("c_first").alias("block")).distinct()
    own = own.join(packed_q.select("dim", "query_block"), ["dim", "query_block"], "left_semi")  # the hash may leave a block empty
    lane0 = F.lit(0).alias("lane")
    seeds = as_query(packed_q.select("*", lane0, none.cast("binary").alias("floors"))).unionByName(as_candidate(packed_c.join(small_side(own), ["dim", "block"]).select("*", lane0, F.lit(0.0).alias("bound"))))
    seeds = stash(_search(seeds, ["dim", "query_block"], k, "dim int, query_block long, floors binary, floor long", floors), "floors")
    packed_q = stash(packed_q.join(small_side(seeds), ["dim", "query_block"]), "seeded")
    pairs = stash(block_pairs(packed_q.select("dim", "query_block", "low", "high", "most", "floor"), packed_c.select("dim", "block", "low", "high", "most")), "pairs")
    sent = as_query(packed_q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))))
    met = as_candidate(packed_c.join(small_side(pairs), ["dim", "block"]).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(LANES)).cast("int")))

    def best_rows(_, queries, best):
        return pa.RecordBatch.from_arrays([pa.array(queries.ids[best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], ["query_id", "vec_id", "score"])

    found = _search(sent.unionByName(met), ["dim", "query_block", "lane"], k, "query_id long, vec_id long, score long", best_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
