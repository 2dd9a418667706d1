"""Quality classifier with hierarchical empirical Bayes.

1. A logistic model on surface features of the whole text, fitted on a bounded sample of the labelled documents, gives
   each document's own evidence.
2. Grouped sums of that evidence give every host and every path of a host a posterior share of good documents. A host is
   shrunk towards the global share, a path towards its host's, by as many pseudo-documents as the spread between hosts
   (between paths) calls for; a sparse site so keeps close to what is known above it.
3. The document's log odds are its own plus those of its path's posterior over the global share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, keyed, small_side, stash, without
from .words import Words, chunks

#: Most labelled documents the model is fitted on.
FIT_ROWS = 20_000
#: A document goes if its posterior probability of being good is below this.
THRESHOLD = 0.5
FEATURES = ("log_words", "upper_share", "symbol_share", "odd_word_share", "bar_share", "distinct_share", "repeat_share", "digit_share", "word_length", "stop_share", "space_share", "worst_upper", "worst_symbol", "worst_repeat")
#: Words looked at together for the worst stretch of a document.
STRETCH = 32

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "letter", "symbol", "digit", "stop", "space")}
_CLASS["upper"][65:91] = True
_CLASS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS["symbol"][[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = True
_CLASS["digit"][48:58] = True
_CLASS["stop"][[ord(c) for c in ".,;:"]] = True
_CLASS["space"][[9, 10, 11, 12, 13, 32]] = True


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the values before each place; a text is shorter than 2^31 bytes."""
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, dtype=np.int32, out=out[1:])
    return out


def features(words: Words) -> np.ndarray:
    """A row of FEATURES for each text of words; an empty text is all zero."""
    data, n = words.data, len(words.first) - 1
    first = words.first
    count = np.diff(first).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(words.start):
        return out
    sums = {k: _running(v[data]) for k, v in _CLASS.items()}
    # A text's bytes run from its first word to its last; what surrounds them is white space.
    has = np.flatnonzero(count)
    begin, end = words.start[first[:-1][has]], words.end[first[1:][has] - 1]
    total = {k: (s[end] - s[begin]).astype(float) for k, s in sums.items()}
    size, m = (end - begin).astype(float), count[has]
    odd = _CLASS["symbol"][data[words.end - 1]]
    bar = (words.end - words.start == 1) & (data[words.start] == ord("|"))
    same = np.zeros(len(words.hash), bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[first[:-1][has]] = False
    per_word = {"odd": odd, "bar": bar, "same": same, "upper": sums["upper"][words.end] - sums["upper"][words.start], "letter": sums["letter"][words.end] - sums["letter"][words.start]}
    run = {k: _running(v) for k, v in per_word.items()}
    of = lambda k: (run[k][first[1:][has]] - run[k][first[:-1][has]]).astype(float)
    distinct = np.array([len(np.unique(words.hash[first[i]:first[i + 1]])) for i in has], float)
    worst = np.zeros((len(has), 3))
    for j, i in enumerate(has):
        a, b = int(first[i]), int(first[i + 1])
        at = np.append(np.arange(a, max(a + 1, b - STRETCH + 1), STRETCH // 2), max(a, b - STRETCH))  # the last one ends with the text
        to = np.minimum(at + STRETCH, b)
        width = to - at
        worst[j] = ((run["upper"][to] - run["upper"][at]) / (run["letter"][to] - run["letter"][at] + 8)).max(), ((run["odd"][to] - run["odd"][at]) / (width + 4)).max(), ((run["same"][to] - run["same"][at]) / (width + 4)).max()
    out[has] = np.column_stack([
        np.log1p(m), total["upper"] / (total["letter"] + 1), total["symbol"] / size, of("odd") / m, of("bar") / m, distinct / m, of("same") / m,
        total["digit"] / size, np.minimum(size / m, 40), total["stop"] / m, total["space"] / size, worst])
    return out


@dataclass(frozen=True)
class Model:
    """Log odds of a good document: weights on standardised features, their squares and a constant."""

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_design((x - np.array(self.centre)) / np.array(self.spread)) @ np.array(self.weights), -30, 30)


def _design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.column_stack([np.ones(len(z)), z, z * z])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Model:
    """Ridge logistic regression by Newton's method. Without rows of both kinds every document counts as what the labels say, or as good."""
    if not len(y) or y.min() == y.max():
        k = x.shape[1] if x.ndim == 2 else len(FEATURES)
        return Model((0.0,) * k, (1.0,) * k, (2.0 if not len(y) or y.min() else -2.0,) + (0.0,) * (2 * k))
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    d = _design((x - centre) / spread)
    w, penalty = np.zeros(d.shape[1]), np.full(d.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(tuple(centre), tuple(spread), tuple(w))


def feature_rows(docs: DataFrame) -> DataFrame:
    """rows (doc_id, text) to (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(words) for _, words in chunks(b.column("text"))]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from at most most_rows labelled documents, those with the smallest hashes of their ids.

    labels has doc_id and quality (0 or 1); rows with a null in either, or an id that docs lack, are not used. Of rows
    that repeat an id the one with the least features stands for it.
    """
    bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = stash(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    got = feature_rows(rows).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(known), "doc_id").orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r["quality"]) for r in got]))


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-documents that the parent's share is worth: share * (1 - share) over the variance between groups, less 1."""
    mean = F.col("s") / F.col("n")
    noise = F.sum(F.col(parent) * (1 - F.col(parent)))
    r = groups.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (mean - F.col(parent)) ** 2).alias("between"), noise.alias("noise"),
                                  F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("v")).first()
    if not r["n"]:
        return 1.0
    variance = max((r["between"] - r["noise"]) / r["n"], 1e-9)
    return min(max(r["v"] / r["n"] / variance - 1, 2.0), 1e6)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, host, path, evidence, host_posterior, path_posterior, p_good, keep.

    host and path are any two columns of which the second divides the first; nulls are a group of their own. An empty
    or null text has all features zero and is judged like that. Rows with equal ids are judged one by one. Empty
    input gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [model.log_odds(features(words)) for _, words in chunks(b.column("text"))]
            odds = np.concatenate(odds) if odds else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(odds, pa.float64())], ["doc_id", "host", "path", "odds"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = stash(rows.mapInArrow(run, "doc_id long, host string, path string, odds double"), "evidence")
    p = 1 / (1 + F.exp(-F.col("odds")))
    paths = stash(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(p, 6).cast("decimal(20,6)")).cast("double").alias("s")), "paths")
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    share = min(max((total[0] or 0.0) / total[1], 1e-3), 1 - 1e-3) if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("global", F.lit(share))
    k = _strength(hosts, "global")
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("s") + k * share) / (F.col("n") + k)).alias("host_posterior"))
    paths = stash(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "hosts")
    k = _strength(paths, "host_posterior")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("d"), "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))
    known = rows.join(small_side(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("d")))
    prior = lambda c: F.log(c / (1 - c))
    near = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = F.col("odds") + prior(near) - math.log(share / (1 - share))
    good = 1 / (1 + F.exp(-odds))
    return known.select("doc_id", "host", "path", p.alias("evidence"), "host_posterior", "path_posterior", good.alias("p_good"), (good >= threshold).alias("keep"))


def drop_rejected(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", **cols: str) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay. Rows without id or with equal ids go one by one."""
    rows, key, _ = keyed(docs, id_col)
    rejected = classify(rows, model, threshold, key, **cols).where("not keep").select(F.col("doc_id").alias(key))
    return without(rows, key, stash(rejected, "rejected"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
