"""Importance resampling, language-model scores, Merkle manifest."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dataloom.llm import interning, log_bilinear, manifest, resampling
from tests.llm import brute

ODD = [(5, "Ab c-D é9 ab"), (3, None), (4, ""), (-2, " \t\n!!"), (7, "x" * 50 + " " + "y" * 40 + " x"), (8, "the cat " * 30_000), (None, "the cat sat"), (9, "w " * 19), (10, "w " * 20)]


def frame(spark, rows):
    """Columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "s", "en", "k", 1) for i, t in rows], "doc_id long, text string, source string, lang string, score string, rank int").withColumn("row", F.lit("x"))


def test_xxhash64_is_the_librarys():
    r = random.Random(4)
    texts = [bytes(r.randrange(33, 127) for _ in range(n)) for n in [*range(1, 70), 500]]
    data, length = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts)))
    got = interning.xxhash64(data, np.cumsum(length) - length, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_slots_are_one_for_each_string(monkeypatch, n):
    r = random.Random(n)
    texts = [None, "", "a", *(" ".join(r.choice(["a", "bb", "é", "q" * 33, "r" * 33, "q" * 32 + "r"]) for _ in range(r.randrange(60))) for _ in range(40))]
    # Hashes that collide: bytes decide.
    monkeypatch.setattr(interning, "xxhash64", lambda data, start, length: (length % 3).astype(np.uint64))
    table = interning.byte_map(resampling.WORD_BYTES)
    seen = []
    for at, raw, offsets in interning.batches_of(pa.array(texts), 300):
        words = interning.Spans(raw, offsets, table)
        grams = words.grams(n)
        known = interning.Table(grams)
        by_slot = {}
        for j, s in enumerate(known.slot):
            assert by_slot.setdefault(s, grams.text(j)) == grams.text(j)
        assert len(set(by_slot.values())) == len(by_slot) == len(known.used)
        assert dict(zip((grams.text(j) for j in known.holder), known.count)) == Counter(grams.text(j) for j in range(len(grams.start)))
        for i in range(len(words.first) - 1):
            seen.append((at + i, [grams.text(j).decode() for j in range(grams.first[i], grams.first[i + 1])]))
    assert seen == [(i, [" ".join((t or "").split()[k:k + n]) for k in range(len((t or "").split()) - n + 1)]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("order", [1, 2])
def test_resampling_of_odd_rows(spark, order):
    r = random.Random(2)
    docs = ODD + [(20 + i, " ".join(r.choice(["the", "cat", "sat", "Über", "on", "mat"]) for _ in range(30))) for i in range(25)]
    target = ["the cat the cat", None, "mat é"]
    got = resampling.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, order=order)
    assert {x["doc_id"]: tuple(x)[1:] for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()} == brute.resample(docs, target, percent=30, order=order)


def test_resampling_of_repeats_and_nothing(spark):
    same = [(1, "w " * 25), (1, "w " * 25), (2, "v " * 25), (2, "w " * 25)] * 5
    target = spark.createDataFrame([], "text string")
    got = resampling.resample(frame(spark, same), target, percent=50).collect()
    assert len(got) == 20 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 11))
    assert resampling.resample(frame(spark, []), target).count() == 0
    kept = resampling.drawn(frame(spark, same), target, percent=50)
    assert kept.columns == frame(spark, []).columns and kept.count() > 0


def test_resampling_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = resampling.query(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert {x[0]: tuple(x)[1:] for x in got} == brute.resample(docs, target)


def leaves():
    r = random.Random(1)
    rows = [(i * r.choice([1, 1, 1, 70001]), "s", r.choice(["en", "de", None, "é", "z"]), 5, f"t{i}") for i in range(60)]
    return rows + [(-5, "s", "en", None, None), (1 << 62, "a", "en", 3, ""), (-(1 << 62), "a", "en", 3, ""), (None, None, None, None, None), (None, "q", "en", 1, "x"), (None, "q", "en", 1, "x"),
                   (7, "s", "en", 5, "dup"), (7, "s", "en", 5, "dup"), (7, "s", "en", 5, "dup2"), (8, "s", "solo", 4, "x" * 100_000)]


@pytest.mark.parametrize("rows, levels", [(leaves(), 2), (leaves(), 10), (leaves()[:1], 3), ([], 3)])
def test_manifest_of_odd_rows(spark, monkeypatch, rows, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("row", F.lit("x")).withColumn("idx", F.lit(1)).withColumn("grp", F.lit("y"))
    got = manifest.manifest(d, changed={"n_chars": d["n_chars"] + 1}, tampered=F.crc32(d["doc_id"].cast("string")) % 7 == 0)
    assert Counter(map(tuple, got.collect())) == Counter(brute.manifest(rows))


def test_ranks_are_places_in_the_sorted_order(spark):
    r = random.Random(3)
    ids = sorted({r.choice([r.randrange(-300, 9000), r.randrange(-(1 << 63), 1 << 63), r.randrange(1 << 33)]) for _ in range(3000)})
    rows = spark.createDataFrame([(i, "g", x, "l") for i, x in enumerate(r.sample(ids, len(ids)))], "row long, grp string, doc_id long, leaf string")
    assert [x["doc_id"] for x in sorted(manifest.ranked(rows).collect(), key=lambda x: x["idx"])] == ids
    assert sorted(x["idx"] for x in manifest.ranked(rows).collect()) == list(range(len(ids)))


def test_manifest_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest.query(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(brute.manifest(rows)) and 0 < sum(not r["verified"] for r in got) < len(got)


def parts(spark, docs):
    rows = frame(spark, docs).select("doc_id", "text", log_bilinear.held_out(F.col("doc_id")).alias("held"))
    batches = log_bilinear.word_batches(rows)
    counts, vocabulary, head = log_bilinear.count(batches)
    return counts, vocabulary, log_bilinear.symbol_rows(batches, counts, vocabulary, head)


def plain_scores(spark, docs, counts, vocabulary, model):
    """log10 P of each text by one softmax a token, in double precision."""
    known = {r["word"]: r["n"] for r in vocabulary.collect()}
    first = sorted((w for w in known if len(w.encode()) <= log_bilinear.HEAD_BYTES), key=lambda w: (-known[w], w.encode()))[:log_bilinear.WORDS]
    symbol = {w: k for k, w in enumerate(first)}
    out = {}
    for i, t in docs:
        far = near = log_bilinear.BEGIN
        total = 0.0
        for w in [*(x.lower() for x in brute.words(t)), None]:
            s = log_bilinear.END if w is None else symbol.get(w)
            if s is None:
                tail = w.encode()[-2:]
                kind = int(log_bilinear.class_of(np.array([int.from_bytes(tail, "big")]))[0])
                s = log_bilinear.END + 1 + kind
                total += np.log10((known.get(w, 0) + 1) / (counts.symbols[s] + counts.kinds[kind] + 1))
            logits = (model.context[near] @ model.near + model.context[far] @ model.far) @ model.target.T + model.bias
            total += (logits[s] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / np.log(10)
            far, near = near, s
        out[i] = total
    return out


def test_scores_are_a_normalised_model(spark, monkeypatch):
    """Shares of a class's words and of its one unknown add up to 1, and a text's score is the product of softmax and share."""
    monkeypatch.setattr(log_bilinear, "HEAD", log_bilinear.WORDS + 5)  # so that the other words take the shuffled join
    r = random.Random(5)
    docs = [x for x in ODD if x[0] != 8] + [(20 + i, " ".join(r.choice(["the", "cat", "SAT", "é", "on", "q", *(f"w{r.randrange(3000)}" for k in range(40))]) for _ in range(r.randrange(200)))) for i in range(60)]
    counts, vocabulary, rows = parts(spark, docs)
    want, n = brute.unigram(docs)
    assert counts.tokens == n
    words = {x["word"]: x["n"] for x in vocabulary.collect()}
    assert sum(words.values()) + counts.documents == n == counts.symbols.sum() and len(words) + 1 == counts.distinct
    assert counts.symbols[:log_bilinear.WORDS].tolist() == sorted(words.values(), reverse=True)[:log_bilinear.WORDS] and len(words) > log_bilinear.WORDS + 300
    assert counts.kinds.sum() == len(words) - log_bilinear.WORDS
    model = log_bilinear.Model.start(counts.symbols, 3)
    model.target[:] *= 9
    got = {x["doc_id"]: x for x in log_bilinear.scored(rows, model).collect()}
    assert {i: (x["held_out"], x["n_tokens"], x["n_known"]) for i, x in got.items()} == {i: w[:3] for i, w in want.items()}
    assert {i: x["base_score"] for i, x in got.items()} == pytest.approx({i: w[3] for i, w in want.items()}, rel=1e-9)
    assert {i: x["score"] for i, x in got.items()} == pytest.approx(plain_scores(spark, docs, counts, vocabulary, model), rel=1e-4)
    assert got[None]["held_out"] is False


def test_batches_are_few_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "BATCH_BYTES", 100)
    docs = [(i, f"w{i} the cat sat {'long ' * 20}") for i in range(300)]
    rows = frame(spark, docs).coalesce(1).select("doc_id", "text", log_bilinear.held_out(F.col("doc_id")).alias("held"))
    batches = log_bilinear.word_batches(rows)
    files = batches.groupBy(F.input_file_name()).count().toDF("file", "n").collect()
    assert sum(x["n"] for x in files) == 300 and max(x["n"] for x in files) <= log_bilinear.FILE_ROWS
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = log_bilinear.symbol_rows(batches, *log_bilinear.count(batches))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted(tuple(x) for x in got.select("doc_id", "n_tokens").collect()) == [(i, 25) for i in range(300)]


def test_training_learns_what_follows_what(spark):
    """Texts that alternate between few words: the noise-contrastive model comes near their entropy, the unigram one doesn't."""
    r = random.Random(6)
    def text():
        out, w = [], r.randrange(4)
        for _ in range(60):
            out.append("abcd"[w])
            w = (w + (1 if r.random() < 0.9 else 2)) % 4
        return " ".join(out)
    docs = [(i, text()) for i in range(700)]
    got = log_bilinear.score(frame(spark, docs), rate=0.1).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[1] < -0.6 and got[0] > -0.35  # 0.9 of the steps are certain: 0.16 a token with the ends


def test_scores_of_held_out_documents_beat_the_unigram_ones(spark, sf):
    got = log_bilinear.query(spark, sf)
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(got.columns)
    rows = got.collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, n = brute.unigram(docs)
    assert {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"]) for r in rows} == {i: w[:3] for i, w in want.items()} and {r["train_tokens"] for r in rows} == {n}
    assert {r["doc_id"]: r["base_score"] for r in rows} == pytest.approx({i: w[3] for i, w in want.items()}, rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_nothing(spark):
    assert log_bilinear.score(frame(spark, [])).count() == 0
    one = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    got = log_bilinear.score(frame(spark, [(one, "only held out")])).first()
    assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (True, 4, 0, 0, 0.0) and got["score"] < 0
