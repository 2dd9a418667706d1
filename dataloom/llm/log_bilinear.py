"""Language-model scores from a log-bilinear model, trained with noise-contrastive estimation on Spark.

1. Texts are cut into words once and kept as batches: the distinct words of about two megabytes of text, how often the
   training documents among it hold them, and the text as numbers of these words.
2. Spark adds the counts up to the vocabulary of all training documents. Batches get their words' counts back: those of
   the most frequent words by a broadcast of bounded size, those of the rest by a shuffled join.
3. The most frequent words are symbols of their own, the others fall into classes by their last two bytes. A model
   predicts a symbol from the two before it: logit(w | a, b) = (r_a C_1 + r_b C_2) . q_w + bias_w. Every training document
   takes part in one of a few rounds; in each, tasks go on from the same parameters by noise-contrastive estimation over
   all their documents, and Spark averages what they arrive at, weighted by tokens.
4. Scores are normalised: each distinct context's logits over all symbols come from one matrix product, and a word of a
   class has the smoothed share of its class, in which all unknown words are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, settings, stash
from .interning import Spans, Table, batches_of, byte_map

#: Words that are symbols of their own, classes of the others, and numbers a vector has.
WORDS, CLASSES, WIDTH = 895, 128, 16
END, SYMBOLS = WORDS, WORDS + 1 + CLASSES
BEGIN = SYMBOLS
ROUNDS = 4
#: Tokens of a step of training, noise symbols drawn for it, and tokens shuffled together.
STEP, NOISE, SHUFFLED = 1024, 32, 1 << 18
RATE = 0.02
#: Bytes of text whose words are kept together.
BATCH_BYTES = 2 << 20
#: Most batches of a file and of an Arrow batch, and how many a task of the join has on average: these are rows of megabytes.
FILE_ROWS, ARROW_ROWS, TASK_ROWS = 8, 2, 8
#: Most words whose counts are broadcast, and the longest of them in bytes.
HEAD, HEAD_BYTES = 100_000, 64
#: Tokens scored together, and contexts of one matrix product.
SCORED, CONTEXTS = 1 << 21, 2048

_TABLE = byte_map(bytes(b for b in range(256) if b not in (0x20, *range(0x09, 0x0E))))


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo parts; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def class_of(tail: np.ndarray) -> np.ndarray:
    """The class of a word whose last two bytes are this number."""
    return (tail * 40503 >> 4) % CLASSES


def _class_of(word: str) -> Column:
    tail = F.conv(F.hex(F.substring(F.encode(F.col(word), "UTF-8"), -2, 2)), 16, 10).cast("long")
    return (F.shiftright(tail * 40503, 4) % CLASSES).cast("int")


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits with their lowest bytes first, then the next ones: frequent words have small numbers, so this packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _tails(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The last two bytes of each word as a number."""
    last = start + length - 1
    return data[last].astype(np.int64) + np.where(length > 1, data[np.maximum(last - 1, 0)].astype(np.int64) << 8, 0)


def word_batches(docs: DataFrame) -> DataFrame:
    """(batch, doc_id, held, ends, words, trained, kinds, codes) of docs (doc_id, text, held).

    words are the distinct words of a batch of texts, lower-cased in A-Z, most frequent first, trained how often training
    documents have each, kinds their classes; codes holds the words of the texts one after the other, as places in words,
    ends where each text ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = b.column("doc_id"), b.column("held").to_numpy(zero_copy_only=False)
            for at, raw, offsets in batches_of(b.column("text"), BATCH_BYTES):
                spans = Spans(raw, offsets, _TABLE)
                known = Table(spans)
                order = np.argsort(-known.count, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                code, holder = known.spread(place), known.holder[order]
                to = at + len(spans.first) - 1
                trains = np.repeat(~held[at:to], np.diff(spans.first))
                words = pa.array([spans.text(j) for j in holder], pa.binary()).cast(pa.string())
                kinds = class_of(_tails(spans.data, spans.start[holder], spans.length[holder])).astype(np.uint8)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([
                    one(ids.slice(at, to - at).to_pylist(), pa.int64()), one(held[at:to], pa.bool_()), one(spans.first[1:], pa.int64()), pa.ListArray.from_arrays([0, len(words)], words),
                    one(np.bincount(code[trains], minlength=len(words)), pa.int64()), pa.array([kinds.tobytes()], pa.binary()), pa.array([_planes(code)], pa.binary())],
                    ["doc_id", "held", "ends", "words", "trained", "kinds", "codes"])

    bound_batches(docs.sparkSession)
    kind = "doc_id array<long>, held array<boolean>, ends array<long>, words array<string>, trained array<long>, kinds binary, codes binary"
    return stash(docs.mapInArrow(run, kind).withColumn("batch", F.monotonically_increasing_id()), "words", "zstd", FILE_ROWS)


@dataclass(frozen=True)
class Counts:
    """What the training documents hold: tokens with ends, distinct tokens, documents, and by symbol and class."""

    tokens: int
    distinct: int
    documents: int
    symbols: np.ndarray  # tokens of each symbol
    kinds: np.ndarray  # words of each class


def count(batches: DataFrame) -> tuple[Counts, DataFrame, DataFrame]:
    """(Counts, vocabulary (word, n), head (word, n, rank)): vocabulary has every word of a training document."""
    entries = batches.select(F.inline(F.arrays_zip("words", "trained")).alias("word", "n")).where("n > 0")
    vocabulary = stash(entries.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary", "zstd")
    head = vocabulary.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD)
    head = stash(head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1), "head")  # bounded by HEAD
    by_class = vocabulary.groupBy(_class_of("word").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    documents = batches.select(F.explode("held").alias("held")).where("not held").count()
    symbols, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        symbols[END + 1 + r["c"]], kinds[r["c"]] = r["n"], r["kinds"]
    total, distinct = int(symbols.sum()) + documents, int(kinds.sum()) + (documents > 0)
    symbols[END] = documents
    for r in head.where(F.col("rank") < WORDS).withColumn("c", _class_of("word")).collect():
        symbols[r["rank"]] = r["n"]
        symbols[END + 1 + r["c"]] -= r["n"]
        kinds[r["c"]] -= 1
    return Counts(total, distinct, documents, symbols, kinds), vocabulary, head


def symbol_rows(batches: DataFrame, counts: Counts, vocabulary: DataFrame, head: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base_score, tail_score, symbols), a row a document.

    base_score is the unigram score, tail_score that of the words of classes inside their class; symbols holds the
    text's symbols and its end as unsigned numbers of 16 bits.
    """
    entries = batches.select("batch", F.posexplode("words").alias("code", "word"))
    spark = batches.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-batches.count() // TASK_ROWS))
    rest = entries.join(F.broadcast(head.select("word")), "word", "left_anti").join(vocabulary, "word")
    # Dealt before they are grouped: a task that has some words of every batch would sort them to group them.
    found = rest.select("batch", "code", "n").repartition(parts, "batch").groupBy("batch").agg(F.collect_list(F.struct("code", "n")).alias("found"))
    first = head.orderBy("rank").select("word", "n").toPandas()  # bounded by HEAD
    rank = {w: i for i, w in enumerate(first["word"])}
    head_n = np.append(first["n"].to_numpy(np.int64), 0)

    def look_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                ranks = np.fromiter((rank.get(w, -1) for w in b.column("words")[i].as_py()), np.int32, len(b.column("words")[i]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("batch", "doc_id", "held", "ends", "kinds", "codes")), pa.array([_planes(ranks)], pa.binary())],
                                                 ["batch", "doc_id", "held", "ends", "kinds", "codes", "ranks"])

    kind = "batch long, doc_id array<long>, held array<boolean>, ends array<long>, kinds binary, codes binary, ranks binary"
    ranked = batches.select("batch", "doc_id", "held", "ends", "kinds", "codes", "words").mapInArrow(look_up, kind)
    whole = counts.tokens + counts.distinct + 1
    inside = np.maximum(counts.symbols[END + 1:] + counts.kinds + 1, 1)
    ends, end_known = np.log10((counts.documents + 1) / whole), int(counts.documents > 0)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                of_head = _unplanes(b.column("ranks")[i].as_py()).view(np.int32)
                n = head_n[of_head]
                if b.column("found")[i].is_valid:
                    got = b.column("found")[i].values
                    n[got.field("code").to_numpy()] = got.field("n").to_numpy()
                rare = (of_head < 0) | (of_head >= WORDS)
                kinds = np.frombuffer(b.column("kinds")[i].as_py(), np.uint8).astype(np.int64)
                symbol = np.where(rare, END + 1 + kinds, of_head)
                base = np.log10((n + 1) / whole)
                within = np.where(rare, np.log10((n + 1) / inside[kinds]), 0.0)
                codes, to = _unplanes(b.column("codes")[i].as_py()), b.column("ends")[i].values.to_numpy()
                size = np.diff(to, prepend=0)
                of = np.repeat(np.arange(len(to)), size)
                add = lambda x: np.bincount(of, x[codes], len(to))
                text = np.insert(symbol[codes], to, END).astype("<u2")
                at = np.concatenate([[0], to + np.arange(1, len(to) + 1)])
                symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(to), [None, pa.py_buffer((at * 2).astype(np.int64)), pa.py_buffer(text.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id")[i].values, b.column("held")[i].values, pa.array(size + 1), pa.array(add(n > 0).astype(np.int64) + end_known), pa.array(add(base) + ends), pa.array(add(within)), symbols],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail_score", "symbols"])

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail_score double, symbols binary"
    with settings(spark, execution_arrow_maxRecordsPerBatch=ARROW_ROWS):
        return stash(ranked.repartition(parts, "batch").join(found, "batch", "left").mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "symbols", "zstd")


@dataclass
class Model:
    """Context vectors, one matrix for each of the two places before, target vectors and their biases."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Model:
        """Small vectors and the biases of a unigram model; a symbol without tokens counts as seen half."""
        r = np.random.default_rng(seed)
        share = np.maximum(counts, 0.5)
        eye = np.eye(WIDTH)
        return cls(r.normal(0, 0.1, (SYMBOLS + 1, WIDTH)), eye.copy(), eye * 0.5, r.normal(0, 0.1, (SYMBOLS, WIDTH)), np.log(share / share.sum()))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Model(*(x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), self.parts(), strict=True)))

    def log10(self, far: np.ndarray, near: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 P(symbol | far, near), normalised over all symbols; a context's logits are made once."""
        context = far * np.int64(SYMBOLS + 1) + near
        number = np.zeros((SYMBOLS + 1) ** 2, np.int32)  # a number for each context that is there, without a sort
        number[context] = 1
        pair = np.flatnonzero(number)
        number[pair] = np.arange(len(pair))
        of = number[context]
        ahead = (self.context @ self.near).astype(np.float32)[pair % (SYMBOLS + 1)] + (self.context @ self.far).astype(np.float32)[pair // (SYMBOLS + 1)]
        target, bias = self.target.T.astype(np.float32), self.bias.astype(np.float32)
        block = (of // CONTEXTS).astype(np.uint16)  # sorted by radix
        order = np.argsort(block, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=-(-len(pair) // CONTEXTS)))])
        out = np.empty(len(symbol))
        for k in range(len(edges) - 1):
            logits = ahead[k * CONTEXTS:(k + 1) * CONTEXTS] @ target
            logits += bias
            logits -= logits.max(axis=1, keepdims=True)
            mine = order[edges[k]:edges[k + 1]]
            picked = logits[of[mine] - k * CONTEXTS, symbol[mine]]
            np.exp(logits, out=logits)
            out[mine] = picked - np.log(logits.sum(axis=1))[of[mine] - k * CONTEXTS]
        return out / np.log(10)


def tokens_of(symbols: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, text of each token, symbol two before, symbol before, symbol) over stretches of texts of about `most` tokens."""
    symbols = symbols.cast(pa.large_binary())
    _, where, data = symbols.buffers()
    where = np.frombuffer(where, np.int64)[symbols.offset:symbols.offset + len(symbols) + 1] // 2
    data = np.frombuffer(data, "<u2") if data is not None else np.zeros(0, "<u2")
    at = 0
    while at < len(symbols):
        to = max(at + 1, int(np.searchsorted(where, where[at] + most, "right")) - 1)
        text, first = data[where[at]:where[to]].astype(np.int64), where[at:to] - where[at]
        near, far = np.roll(text, 1), np.roll(text, 2)
        near[first] = far[first] = BEGIN
        second = first[np.diff(where[at:to + 1]) > 1] + 1
        far[second] = BEGIN
        yield at, to, np.repeat(np.arange(to - at), np.diff(where[at:to + 1])), far, near, text
        at = to


class Trainer:
    """Noise-contrastive estimation by steps of Adagrad from a model on; every step's tokens share its noise symbols."""

    def __init__(self, model: Model, noise: np.ndarray, rate: float = RATE, seed: int = 1):
        self.parts = [p.astype(np.float32) for p in model.parts()]
        self.model = Model(*self.parts)
        self.sums = [np.full(p.shape, 1e-6, np.float32) for p in self.parts]
        self.rate, self.random = np.float32(rate), np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.upto = np.cumsum(noise)

    def learn(self, far: np.ndarray, near: np.ndarray, symbol: np.ndarray) -> None:
        order = self.random.permutation(len(symbol))
        far, near, symbol = (x[order].astype(np.uint16) for x in (far, near, symbol))  # sorted by radix
        for k in range(0, len(order), STEP):
            self._step(far[k:k + STEP], near[k:k + STEP], symbol[k:k + STEP])

    def _step(self, far: np.ndarray, near: np.ndarray, symbol: np.ndarray) -> None:
        m, n = self.model, np.float32(len(symbol))
        a, b = m.context[near], m.context[far]
        ahead = a @ m.near + b @ m.far
        drawn = np.minimum(np.searchsorted(self.upto, self.random.random(NOISE) * self.upto[-1], "right"), SYMBOLS - 1)
        mine, other = m.target[symbol], m.target[drawn]
        true = np.einsum("ij,ij->i", ahead, mine) + (m.bias - self.log_noise)[symbol]
        true = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        false = ahead @ other.T
        false += (m.bias - self.log_noise)[drawn]
        np.negative(false, out=false)
        with np.errstate(over="ignore"):  # the reciprocal of infinity is the 0 meant
            np.exp(false, out=false)
        false += 1
        np.divide(-1, false, out=false)
        up = true[:, None] * mine + false @ other
        d_context, d_target = np.zeros_like(m.context), np.zeros_like(m.target)
        self._scatter(d_context, np.concatenate([near, far]), np.concatenate([up @ m.near.T, up @ m.far.T]))
        self._scatter(d_target, symbol, true[:, None] * ahead)
        np.add.at(d_target, drawn, false.T @ ahead)
        d_bias = (np.bincount(symbol, true, SYMBOLS) + np.bincount(drawn, false.sum(axis=0), SYMBOLS)).astype(np.float32)
        for p, s, g in zip(self.parts, self.sums, (d_context, a.T @ up, b.T @ up, d_target, d_bias), strict=True):
            g /= n
            s += g * g
            g /= np.sqrt(s)
            g *= self.rate
            p += g

    @staticmethod
    def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def train(rows: DataFrame, counts: Counts, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model of the rows that aren't held out, each of which is in one round."""
    model = Model.start(counts.symbols)
    noise = np.exp(model.bias)

    for turn in range(rounds):
        now, speed = model, rate / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], now: Model = now, speed: float = speed) -> Iterator[pa.RecordBatch]:
            trainer, seen = Trainer(now, noise, speed), 0
            for b in batches:
                for _, _, _, far, near, symbol in tokens_of(b.column("symbols"), SHUFFLED):
                    trainer.learn(far, near, symbol)
                    seen += len(symbol)
            if seen:
                flat = np.append(trainer.model.flat().astype(np.float64), 1.0) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

        mine = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)).select("symbols")
        sums = mine.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum(F.col("value").cast("decimal(32,12)")).cast("double").alias("value"))  # the same in any order
        got = {r["place"]: r["value"] for r in sums.collect()}  # a row a parameter
        if got:
            flat = np.array([got[k] for k in range(len(got))])
            model = model.like(flat[:-1] / flat[-1])
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of symbol rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column("tail_score").to_numpy().copy()
            for at, to, of, far, near, symbol in tokens_of(b.column("symbols"), SCORED):
                out[at:to] += np.bincount(of, model.log10(far, near, symbol), to - at)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(out)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kept = rows.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail_score", "symbols")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words and one end; a null or empty one is an end alone. Rows with equal or null ids are scored one by
    one. Where no document trains, every token is unknown, base_score is 0 and score that of the untrained model. Empty
    docs give an empty result; other columns are not read. Scores may differ in the last digits where Spark cuts the
    input into other partitions, since tasks train on what they hold.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col).cast("long")).alias("held"))
    batches = word_batches(rows)
    counts, vocabulary, head = count(batches)
    symbols = symbol_rows(batches, counts, vocabulary, head)
    return scored(symbols, train(symbols, counts, rounds, rate)).withColumn("train_tokens", F.lit(counts.tokens).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
