"""Removal of passages that documents with smaller ids have too, with suffix automata over shards of the corpus.

A window is `length` consecutive words. Broadcasting automata of the whole corpus to every document would take as many
passes as there are shards, so shards are made such that a passage meets only the one that can match it:

1. The minimizer of a window is the least hash of its GRAM-word grams, or of longer ones where that is frequent in a
   sample. Windows in a row with one minimizer form a run. Equal windows have equal minimizers, so only runs whose
   minimizer two documents have go on; for all others nothing but (minimizer, row) is moved. Longer minimizers that are
   frequent in the sample are known to be shared and not moved at all.
2. Runs of equal words form a class, with the first and the last document that has it. Classes are dealt into shards by
   minimizer. The classes of a minimizer that have more than MOST_WORDS words are cut into windows first, which are dealt by
   the hash of their words.
3. A task builds a shard's suffix automaton and streams every class through it for matching statistics: for each window
   the first document that has it, wherever it stands there. No hash decides that; words do.
4. Each run takes what its class was told, by 128 bits that name the class's words, and each document loses the words of
   its covered windows.

Texts are shuffled once: they are written in buckets of their row, and what is found for them is joined to the buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bound_batches, frequent_keys, fresh_path, keyed, release, shared_pairs, small_side, stash
from .suffix_automaton import SuffixAutomaton
from .words import Words, chunks, mix

GRAM = 5
#: Words by which a shard is full, and most words of one minimizer's classes; a task holds one automaton at a time.
SHARD_WORDS, MOST_WORDS = 50_000, 200_000
#: Documents sampled to find frequent minimizers, the number of them by which one counts as frequent, and most of those.
#: Which minimizers those are changes no result.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 20_000, 20, 50_000
ROWS_OUT = 100_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


class Runs:
    """The runs of some texts: text of, first word, number of windows, minimizer of each."""

    def __init__(self, words: Words, length: int, common: np.ndarray):
        gram = min(GRAM, length)
        self.words, self.length = words, length
        least = _sliding_min(words.grams(gram), length - gram + 1)
        if len(common) and len(least):
            longer = (gram + length + 1) // 2
            is_common = among(least.view(np.int64), common)
            least = np.where(is_common, _sliding_min(words.grams(longer), length - longer + 1), least)
        counts = np.diff(words.first)
        text = np.repeat(np.arange(len(counts)), counts)[:len(least)]
        starts = np.arange(len(least))
        fits = starts + length <= words.first[1:][text] if len(least) else np.zeros(0, bool)
        windows = np.flatnonzero(fits)
        value, text = least[windows], text[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (np.diff(windows) != 1) | (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.text, self.start, self.minimizer = text[at], windows[at], value[at].view(np.int64)
        self.windows = np.diff(np.append(at, len(windows)))


def _batches(columns: list[str], types: list[pa.DataType], parts: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for part in parts:
        if not len(part[0]):
            continue
        held.append(part)
        rows += len(part[0])
        if rows >= ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)], columns)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)], columns)


def _in_buckets(rows: DataFrame, key: str) -> DataFrame:
    """rows as a table in buckets of key, so that a join by key shuffles only the other side."""
    spark = rows.sparkSession
    name, n = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", fresh_path(spark, "texts")).bucketBy(n, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue forgets it; its files and the frame stay
    release(spark)
    return table


def _minimizers(rows: DataFrame, length: int, common: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """(minimizer, row): each row's minimizers but the frequent ones. In place of common ones stand longer ones."""
    names, types = ["minimizer", "row"], [pa.int64(), pa.int64()]

    def parts(batches):
        for b in batches:
            ids = b.column("row").to_numpy()
            for at, words in chunks(b.column("text")):
                runs = Runs(words, length, common)
                m, text = runs.minimizer, runs.text
                if len(frequent):
                    rare = ~among(m, frequent)
                    m, text = m[rare], text[rare]
                yield [m, ids[at + text]]

    return rows.mapInArrow(lambda it: _batches(names, types, parts(it)), "minimizer long, row long")


def _flat(lists: pa.Array, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of n lists from number `at` on, and which of these lists, counted from 0, each is in; a null list has none."""
    part = lists.slice(at, n)
    size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), size)


def _shared_runs(texts: DataFrame, length: int) -> DataFrame:
    """(minimizer, row, doc_id, start, words): the runs whose minimizer two rows have."""
    total = texts.count()
    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    none = np.zeros(0, np.int64)
    common = frequent_keys(_minimizers(sample, length, none, none).distinct(), "minimizer", FREQUENT, MOST_FREQUENT)
    frequent = frequent_keys(_minimizers(sample, length, common, none).distinct(), "minimizer", FREQUENT, MOST_FREQUENT)
    lists = shared_pairs(_minimizers(texts, length, common, frequent), "minimizer", "row").groupBy("row").agg(F.collect_list("minimizer").alias("minimizers"))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["minimizer", "row", "doc_id", "start", "words"]
        for b in batches:
            ids, docs, lists_ = b.column("row").to_numpy(), b.column("doc_id").to_numpy(), b.column("minimizers")
            for at, words in chunks(b.column("text")):
                runs = Runs(words, length, common)
                if not len(runs.text):
                    continue
                own, text = _flat(lists_, at, len(words.first) - 1)
                # Of a text and a minimizer one number; two that have the same only send a run that isn't shared.
                keep = among(runs.minimizer, frequent) | np.isin(mix(runs.minimizer) + mix(runs.text), mix(own) + mix(text))
                data, begin, end = words.joined()
                for part in np.array_split(np.flatnonzero(keep), max(1, int(keep.sum()) // ROWS_OUT + 1)):
                    text, start = runs.text[part], runs.start[part]
                    first, last = begin[start].tolist(), end[start + runs.windows[part] + length - 2].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs.minimizer[part]), pa.array(ids[at + text]), pa.array(docs[at + text]), pa.array(start - words.first[text]),
                         pa.array([data[a:z] for a, z in zip(first, last, strict=True)], pa.binary()).cast(pa.string())], columns)

    return stash(texts.join(lists, "row", "left").select("row", "doc_id", "text", "minimizers").mapInArrow(runs_of, "minimizer long, row long, doc_id long, start long, words string"), "runs", "zstd")


def _in_windows(runs: DataFrame, length: int) -> DataFrame:
    """Each run as its single windows, dealt by the hash of their words: (route, words) and the other columns; start, where given, moves on."""
    kept = [c for c in runs.columns if c not in ("minimizer", "words", "start")]
    start = "start" in runs.columns
    schema = ", ".join(["route long", *(f"{c} long" for c in kept), *(["start long"] if start else []), "words string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("words")[i].as_py().split(" ")
                for at in range(0, len(words) - length + 1, ROWS_OUT // 10):
                    n = min(ROWS_OUT // 10, len(words) - length + 1 - at)
                    texts = [" ".join(words[k:k + length]) for k in range(at, at + n)]
                    route = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route, pa.int64()), *(pa.array([b.column(c)[i].as_py()] * n, pa.int64()) for c in kept),
                         *([pa.array(range(b.column("start")[i].as_py() + at, b.column("start")[i].as_py() + at + n), pa.int64())] if start else []), pa.array(texts, pa.string())],
                        [x.split()[0] for x in schema.split(", ")])

    return runs.mapInArrow(run, schema)


def match_shards(classes: DataFrame, length: int, shard_words: int | None = None) -> DataFrame:
    """(route, words, firsts) for classes (route, words, first_id, last_id) with a window that a document before last_id has.

    firsts has the first document of each window of the class. Sorted by route, a shard is as many whole routes as have
    shard_words words; it is put into a suffix automaton, and all its classes are streamed through that.
    """
    most = shard_words or SHARD_WORDS

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            automaton = SuffixAutomaton((words, first) for _, _, words, first, _ in shard)
            routes, texts, firsts, ends = [], [], [], [0]
            for route, text, words, _, last in shard:
                least = [at for _, at in automaton.statistics(words, length)][length - 1:]
                if min(least) < last:
                    routes.append(route)
                    texts.append(text)
                    firsts += least
                    ends.append(len(firsts))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(firsts, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(texts, pa.string()), lists], ["route", "words", "firsts"])

        shard, size, at = [], 0, None
        for b in batches:
            for route, text, first, last in zip(*(b.column(x).to_numpy(zero_copy_only=False).tolist() for x in ("route", "words", "first_id", "last_id")), strict=True):
                if route != at and size >= most:
                    yield out()
                    shard, size = [], 0
                words = text.split(" ")
                shard.append((route, text, words, first, last))
                size, at = size + len(words), route
        if shard:
            yield out()

    dealt = classes.select("route", "words", "first_id", "last_id").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(match, "route long, words string, firsts array<long>")


def _named(words: str = "words") -> list:
    """128 bits that stand for the words of a run."""
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2")]


def covered_windows(texts: DataFrame, length: int) -> DataFrame:
    """(row, start): the windows of texts (row, doc_id, text) that a smaller doc_id has; rows are unique."""
    runs = _shared_runs(texts, length)
    release(texts.sparkSession)
    span = [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")]
    classes = stash(runs.groupBy("minimizer", "words").agg(*span), "classes", "zstd")
    release(texts.sparkSession)
    size = F.length("words") - F.length(F.translate("words", " ", "")) + 1
    wide = stash(classes.groupBy("minimizer").agg(F.sum(size).alias("size")).where(F.col("size") > MOST_WORDS).select("minimizer"), "wide")
    named = runs.select("minimizer", "row", "doc_id", "start", *_named())
    if wide.limit(1).count():
        side = small_side(wide)
        parts = _in_windows(classes.join(side, "minimizer", "left_semi"), length)
        parts = parts.groupBy("route", "words").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
        classes = classes.join(side, "minimizer", "left_anti").withColumnRenamed("minimizer", "route").unionByName(parts)
        cut = _in_windows(runs.join(side, "minimizer", "left_semi"), length).select("route", "row", "doc_id", "start", *_named())
        named = stash(named.join(side, "minimizer", "left_anti").withColumnRenamed("minimizer", "route").unionByName(cut), "routed")
    else:
        classes, named = (x.withColumnRenamed("minimizer", "route") for x in (classes, named))
    matched = stash(match_shards(classes, length).select("route", *_named(), "firsts"), "matched", "zstd")
    release(texts.sparkSession)
    hits = named.join(matched, ["route", "h1", "h2"]).select("row", "doc_id", "start", F.posexplode("firsts").alias("k", "first_id"))
    return hits.where("first_id < doc_id").select("row", (F.col("start") + F.col("k")).alias("start"))


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of non-white-space, unchanged. A word goes if a window of `length` words that covers it also starts
    in a document with a smaller doc_id; windows are judged on the input. kept_text joins the words that stay by one
    space. A null text has no words. Rows with null id are no one's source and lose nothing; rows with equal ids are
    not each other's source, and each loses what smaller ids have. Texts may be of any length. Empty input gives an
    empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    own, key, _ = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "doc_id")
    texts = _in_buckets(own.select(F.col(key).alias("row"), "doc_id", "text"), "row")
    spans = covered_windows(texts.where("doc_id is not null"), length)
    spans = stash(spans.groupBy("row").agg(F.collect_list("start").alias("starts")), "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, digest, kept = [], [], [], []
            for at, words in chunks(b.column("text")):
                start, text = _flat(b.column("starts"), at, len(words.first) - 1)
                start = start + words.first[text]
                n = len(words.start)
                stays = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1))[:-1] == 0
                data, begin, end = words.joined()
                for i in range(len(words.first) - 1):
                    a, z = int(words.first[i]), int(words.first[i + 1])
                    own = np.flatnonzero(stays[a:z]) + a
                    cut = np.flatnonzero(np.diff(own) != 1)
                    opens, closes = own[np.append(0, cut + 1)[:len(own)]], own[np.append(cut, len(own) - 1)[:len(own)]]
                    left = b" ".join([data[p:q] for p, q in zip(begin[opens].tolist(), end[closes].tolist(), strict=True)])
                    total.append(z - a)
                    gone.append(z - a - len(own))
                    digest.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return texts.join(spans, "row", "left").select("doc_id", "text", "starts").mapInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM x),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (g) WHERE doc_id > first_id),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, t.w, l.gone, list_filter(t.w, lambda v, i: l.gone IS NULL OR NOT list_contains(l.gone, i)) AS kept FROM t LEFT JOIN l ON l.doc_id = t.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
