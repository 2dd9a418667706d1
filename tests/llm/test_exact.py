"""Exact dedup, sharding, mixing, BPE, search."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from dataloom.llm import bpe, exact_dedup, mixing, sharding, topk
from tests.llm import brute

DOCS = "doc_id long, text string, source string, lang string, keep_id string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, columns whose names clash with results."""
    rows = [(5, "a  b", "s1"), (3, "a b", "s1"), (9, "a\nb", None), (4, None, "s2"), (6, "", "s2"), (7, "z " * 40_000, "s3"), (8, "c", "é"), (8, "c", "é"), (None, "a b", "s1"), (10, "only", None), (11, "A b", "s2")]
    return docs(spark, rows)


def test_exact_dedup_of_odd_rows(spark, odd):
    got = [tuple(r) for r in exact_dedup.DigestIndex(spark).add(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert Counter(got) == Counter([(5, 3, 4, False), (3, 3, 4, True), (9, 3, 4, False), (None, 3, 4, False), (4, 4, 2, True), (6, 4, 2, False), (7, 7, 1, True), (8, 8, 2, True), (8, 8, 2, False), (10, 10, 1, True), (11, 11, 1, True)])


def test_exact_dedup_is_incremental(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(docs(spark, [(1, "x", "s"), (2, "y", "s")])).collect()
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(docs(spark, [(0, "x", "s"), (3, "z", "s"), (4, "z ", "s")])).collect()}
    assert got == {0: (1, False), 3: (3, True), 4: (4, True)}
    assert index.rows().count() == 4
    plan = index.rows().join(spark.table(index.table).hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the index is bucketed by digest


def test_a_batch_added_again_gives_the_same_answer(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_test", buckets=4)
    first, second = docs(spark, [(1, "x", "s"), (2, "y", "s"), (3, "x ", "s")]), docs(spark, [(4, "y", "s"), (5, "z", "s")])
    answer = lambda d, b: sorted(map(tuple, index.add(d, batch=b).select("doc_id", "keep_id", "group_size", "kept").collect()))
    a, b = answer(first, "1"), answer(second, "2")
    assert b == [(4, 2, 1, False), (5, 5, 1, True)]
    index = exact_dedup.DigestIndex(spark, "digests_of_test")  # opened again
    assert index.buckets == 4 and answer(first, "1") == a and answer(second, "2") == b and index.rows().count() == 4
    index.compact()
    files = [f for f in index.rows().inputFiles() if "part-" in f]
    assert len(files) <= 4 and answer(second, "2") == b and answer(docs(spark, [(9, "x", "s")]), "3") == [(9, 1, 1, False)]
    plan = docs(spark, [(1, "x", "s")]).select(exact_dedup.text_digest().alias("text_sha256")).join(index.rows().hint("merge"), "text_sha256", "left_anti")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the new rows', not the index's
    index.drop()
    assert not spark.catalog.tableExists("digests_of_test")


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_by_id_give_the_answer_of_one(spark, odd, batches):
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    one = Counter(map(tuple, exact_dedup.DigestIndex(spark).add(odd).select(key).collect()))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert Counter(map(tuple, exact_dedup.dedup_in_batches(odd, index, batches).select(key).collect())) == one
    assert exact_dedup.dedup_in_batches(odd.limit(0), exact_dedup.DigestIndex(spark), batches).count() == 0


def test_exact_dedup_of_nothing(spark, odd):
    assert exact_dedup.DigestIndex(spark).add(odd.limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark, odd):
    got = exact_dedup.drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 4, 7, 8, 8, 10, 11]


def test_digest_is_of_squeezed_text(spark):
    r = exact_dedup.DigestIndex(spark).add(docs(spark, [(1, "\t a \n\r b ", "s")])).first()
    assert r["text_sha256"] == hashlib.sha256(b" a b ").hexdigest()


def test_shards_are_even_and_slots_gapless(spark, odd):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == 11 and {r["law"] for r in rows} == {"rows"}
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    null = next(r for r in rows if r["doc_id"] == 4)
    assert (null["size"], null["text_crc32"], null["grown_shard"]) == (8, 0, None)


def test_shards_match_a_walk_in_plain_python(spark, sf):
    """Size and checksum by zlib, shard and slot by Feistel rounds on the row's number; the round function is Spark's hash."""
    import zlib

    from pyspark.sql import functions as F
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8) for r in table.collect())
    n, seed = len(rows), 5
    a, b = sharding._sides(n)
    keys = spark.range(max(a, b)).select("id", *[sharding._scramble(F.col("id"), seed, k, (a, b)[k % 2]).alias(str(k)) for k in range(sharding.ROUNDS)])
    by = {r["id"]: [r[str(k)] for k in range(sharding.ROUNDS)] for r in keys.collect()}

    def walk(x):
        while True:
            left, right = divmod(x, b)
            for k in range(0, sharding.ROUNDS, 2):
                left = (left + by[right][k]) % a
                right = (right + by[left][k + 1]) % b
            x = left * b + right
            if x < n:
                return x

    want = {d: (size, crc, walk(i) % 24, walk(i) // 24) for i, (d, crc, size) in enumerate(rows)}
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.assign_shards(table, 24, seed).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 101, 1000])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))


def test_shards_repeat_and_depend_on_seed(spark, odd):
    a, b = (sorted(map(str, sharding.assign_shards(odd.repartition(k), 3).collect())) for k in (1, 5))
    assert a == b and a != sorted(map(str, sharding.assign_shards(odd, 3, seed=1).collect()))
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(0, 30), s) for i, s in enumerate(random.Random(2).choices(["b", "a", "é", None, "c", "tiny"], [40, 20, 10, 10, 18, 1], k=1500))]
    got = mixing.mix(docs(spark, rows)).collect()
    size = {i: len(brute.words(t)) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    want = brute.mix_targets(total)
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for x in got:
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == total[source[x["doc_id"]]]
        assert abs(x["target"] - want[source[x["doc_id"]]]) < 1e-6 and x["taken"] in {k * x["size"] for k in range(4)}
        taken[source[x["doc_id"]]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= sum(total.values())


def test_mix_of_odd_rows_and_reruns(spark, odd):
    a, b = (sorted(map(str, mixing.mix(odd.repartition(k)).collect())) for k in (1, 4))
    assert a == b and len(a) == 11
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd.where("text is null")).count() == 1
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns
    counts = Counter(r["doc_id"] for r in whole.collect())
    assert all(counts[r["doc_id"]] % r["times"] == 0 if r["times"] else True for r in mixing.mix(odd).collect())
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("weights,repeats", [((1.0, 2.0, 3.0), 3), ((1.0, 50.0), 2), ((5.0,), 1)])
def test_mixed_documents_stand_as_often_as_the_mix_takes_them(spark, weights, repeats):
    r = random.Random(3)
    rows = [(i // 2 if i < 40 else i, "w " * r.randrange(0, 6), r.choice(["a", "a", "a", "b", None, "c"])) for i in range(600)]
    rows += [(None, "w w", "a"), (-5, "w", "b"), (2**40, None, None)]
    table = docs(spark, rows)
    want = {(x["doc_id"], x["source_size"], x["size"]): x["times"] for x in mixing.mix(table, weights, repeats).collect()}
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(brute.words(t))
    held = Counter((i, size[s], len(brute.words(t))) for i, t, s in rows)
    got = Counter((x["doc_id"], size[x["source"]], len(brute.words(x["text"]))) for x in mixing.mixed_documents(table, weights, repeats).collect())
    assert got == Counter({k: n * want[k] for k, n in held.items() if want[k]})


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    texts = ["", None, "a", "<|endoftext|>", "don't  \n\n stop", "é😀 　x y", "x" * 5000, " \t\n" * 3000, "word. " * 30_000, "日本語" * 30_000, "a1 b2\r\n" * 20_000 + "   "]
    enc = plain_encoding()
    rows = {r["doc_id"]: r for r in bpe.digests(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs(spark, [(1, "héllo wörld", "s"), (None, None, "s")]))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(encoded).collect()} == {1: "héllo wörld".encode(), None: b""}
    assert bpe.digests(docs(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_long_texts_are_cut_only_where_it_is_safe():
    enc, r = plain_encoding(), random.Random(5)
    for _ in range(30):
        text = "".join(r.choice(["a", " ", "\n", "  ", "1", ".", "é", "'s", " ", "\x1c", "word"]) for _ in range(400))
        assert [i for p in bpe.pieces(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_top_k_is_exact(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(6, 16))
    rows = [(int(i), [float(x) for x in (centre[i % 6] + 0.3 * r.normal(size=16)).astype(np.float32)]) for i in range(600)]
    rows += [(i, rows[1][1]) for i in range(600, 640)]  # ties
    rows += [(640, None), (660, [None] * 16), (680, [float("nan")] + [0.0] * 15), (700, [float("inf")] * 16), (720, []), (740, [1.0, 2.0]), (741, [3.0, -1.0]), (None, [1.0] * 16), (760, [1e6] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    from pyspark.sql import functions as F
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    want = {k: v for k, v in brute.top_k(rows).items() if v}
    assert dict(got) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def clustered(seed=1, clusters=8, each=200):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, 8)) * 40
    return np.floor(np.concatenate([c + r.normal(size=(each, 8)) for c in centre])).astype(np.int64)


def test_pivot_bounds_spare_work():
    import pyarrow as pa
    x = clustered()
    p = {8: topk.pick_pivots(x.tolist(), 16)}
    pack = topk._pack(p)

    def block(ids):
        t = pack((pa.scalar(8), pa.scalar(0)), pa.table({"vec_id": pa.array(ids), "v": pa.array(x[ids].tolist(), pa.list_(pa.int64()))}))
        return topk.Block(t.to_pylist()[0])

    queries, everything = block(np.arange(10)), block(np.arange(len(x)))
    best = topk.Best(10, 5)
    topk.search_block(queries, block(np.arange(200)), best)
    scored = topk.search_block(queries, everything, topk.Best(10, 5, best.worst))
    assert scored < 0.3 * 10 * len(x)
    score = x[:10] @ x.T
    for i in range(10):
        want = sorted((-int(score[i, j]), j) for j in range(len(x)) if j != i)[:5]
        whole = topk.Best(10, 5)
        topk.search_block(queries, everything, whole)
        assert list(zip(-whole.score[whole.row == i], whole.id[whole.row == i], strict=True)) == want


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 12)
    x = clustered(3)
    pairs, real = [], topk.block_pairs

    def watched(queries, candidates):
        out = real(queries, candidates)
        pairs.append((out.count(), queries.count() * candidates.count()))
        return out

    monkeypatch.setattr(topk, "block_pairs", watched)
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, -s) for s, i in sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:5]] for q in range(0, len(x), 20)}
    assert pairs[0][0] < 0.6 * pairs[0][1]


def test_search_with_repeated_ids(spark):
    from pyspark.sql import functions as F
    rows = [(20, [1.0, 2.0]), (20, [0.5, 9.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (2, [2.0, 0.0]), (3, [1.0]), (40, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("cell", F.lit(1))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 32 * 192 + 576 * 192), (20, 2, 2, 32 * 128)]
