"""Similarity join of documents on word shingles with signature trees.

1. Each text becomes its set of shingle hashes; texts with equal sets form a class and its smallest id stands for it.
2. Keys bring together what can link. Two linked sets differ in few tokens, so if tokens are dealt into more parts than
   that, some part is the same in both. Every class has a key for each part (part, tokens in it); keys of one class are
   dropped. The members of a key are compared by trees over bitmaps, and what may link is joined into candidate groups.
   No link is missed, whatever the size of the sets.
3. The sets of a candidate group meet in one task. A group of more than a block is first held against one of its sets,
   the pivot; what links with it needs no comparison with each other. The others are cut into blocks by size, and so are
   those that link, and each pair of blocks of near sizes with an unlinked set in it meets in a task. There signature
   trees are walked and what they cannot exclude is compared token by token.
4. Links give components, and every document gets that of its class.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bound_batches, components, frequent_keys, keyed, shared_pairs, small_side, stash, without
from .signature_tree import bitmap, link, linked, may_link, small_bits
from .words import chunks, mix, shingle_sets

#: Least and most sets of a candidate group that make a block; between them, a quarter of a partition's even share.
LEAST_BLOCK, MOST_BLOCK = 64, 2_000
#: Most members of a key that are compared by bitmaps; more are all kept.
CROWD = 1_000
#: Bytes of pivots, each a set, that may be broadcast; more are joined.
PIVOT_BYTES = 16 << 20
#: Ids sampled to find frequent keys, the number of them by which a key counts as frequent, and most such keys. Rows of
#: frequent keys are aggregated before they are shuffled; which keys those are changes no result.
SAMPLE_IDS, FREQUENT, MOST_FREQUENT = 10_000, 10, 50_000
ROWS_OUT = 100_000


class Band:
    """How sets with low to high - 1 tokens, and larger partners of theirs, are dealt into parts."""

    def __init__(self, number: int, low: int, high: int, num: int, den: int):
        self.number, self.low, self.high = number, low, high
        self.largest_partner = (high - 1) * den // num
        apart = (high - 1) * (den - num) // num  # most tokens by which two linked sets differ, the smaller in this band
        self.spare = 0
        for _ in range(20):  # room for parts that are empty in both
            empty = (apart + 1 + self.spare) * math.exp(-low / (apart + 1 + self.spare))
            self.spare = max(self.spare, math.ceil(empty + 2 * math.sqrt(empty)))
        self.parts = apart + 1 + self.spare

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        part = ((tokens >> np.uint64(20)) % np.uint64(self.parts)).astype(np.int64)
        low = np.bincount(part, (tokens & np.uint64(0xFFFFFFFF)).astype(float), self.parts).astype(np.uint64)
        high = np.bincount(part, (tokens >> np.uint64(32)).astype(float), self.parts).astype(np.uint64)
        filled = np.bincount(part, minlength=self.parts) > 0
        name = np.arange(self.parts, dtype=np.uint64) + np.uint64((self.number + 1) << 32)
        keys = mix(mix(mix(name) + low) + high)
        if self.parts - int(filled.sum()) > self.spare:
            return keys  # so many empty parts that two such sets may have nothing but empty parts in common
        return keys[filled]


@functools.lru_cache(maxsize=8)
def bands(num: int, den: int) -> tuple[list[int], list[Band]]:
    """Size bands from the least size at which different sets can link on; no partner is more than one band away."""
    low, out = -(-num // (den - num)), []
    while low < 1 << 40:
        high = max(low * 3 // 2, low * den // num + 2)
        out.append(Band(len(out), low, high, num, den))
        low = high
    return [b.low for b in out], out


def candidate_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Two different sets that link share a key."""
    lows, all_bands = bands(num, den)
    at = bisect.bisect_right(lows, len(tokens)) - 1
    if at < 0:
        return np.zeros(0, np.uint64)
    out = [all_bands[at].keys(tokens)]
    if at and len(tokens) <= all_bands[at - 1].largest_partner:
        out.append(all_bands[at - 1].keys(tokens))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, words in chunks(batch.column("text"), lower=True):
        for i, tokens in enumerate(shingle_sets(words, n)):
            yield at + i, tokens


def set_digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): size and a 128-bit digest of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(t), int(t.sum(dtype=np.uint64)), int(mix(t).sum(dtype=np.uint64))) for _, t in _sets(b, n)]
            size, d1, d2 = (np.array(x, np.uint64).astype(np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(d1), pa.array(d2)], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def set_keys(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray | None = None, only: bool = False) -> DataFrame:
    """(key, doc_id): the candidate keys of each row's shingle set, without those in `frequent`, or only those."""
    frequent = np.zeros(0, np.int64) if frequent is None else frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            ids = np.repeat(np.array([d for d, _ in held], np.int64), [len(k) for _, k in held])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, k in held])), pa.array(ids)], ["key", "doc_id"])

        held: list[tuple[int, np.ndarray]] = []
        rows = 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, tokens in _sets(b, n):
                keys = candidate_keys(tokens, num, den).view(np.int64)
                if len(frequent):
                    keys = keys[among(keys, frequent) == only]
                if len(keys):
                    held.append((int(ids[i]), keys))
                    rows += len(keys)
                if rows >= ROWS_OUT:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "key long, doc_id long")


def _met(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, doc_id): the candidate keys that two rows have."""
    total = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLE_IDS))) == 0)
    frequent = frequent_keys(set_keys(sample, n, num, den), "key", FREQUENT, MOST_FREQUENT)
    met = shared_pairs(set_keys(rows, n, num, den, frequent), "key", "doc_id")
    if len(frequent):  # in the sample already two rows have each
        met = met.unionByName(set_keys(rows, n, num, den, frequent, only=True))
    return stash(met, "met")


def _candidates(met: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component): groups of ids such that no link leads from one to another.

    Keys with the same members count once. The members of a key meet with bitmaps of their sets, and the trees over those
    leave only pairs that may link; their spanning edges join ids. A key of more than CROWD ids joins all of them.
    """
    members = [F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.bit_xor(F.xxhash64("doc_id")).alias("mark")]
    shared = stash(met.groupBy("key").agg(*members).groupBy("n", "owner", "last", "mark").agg(F.min("key").alias("key")), "shared")
    named = shared.select("key", "n", "owner")
    met = stash(met.join(small_side(named), "key"), "met")
    star = met.where((F.col("n") > CROWD) & (F.col("doc_id") != F.col("owner"))).select(F.col("owner").alias("a"), F.col("doc_id").alias("b"))
    few = met.where(F.col("n") <= CROWD).select("key", "doc_id")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, maps = [], []
            for _, tokens in _sets(b, n):
                size.append(len(tokens))
                maps.append(bitmap(tokens, small_bits(len(tokens))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "size", "bits"])

    ids = stash(few.select("doc_id").distinct(), "met-ids")
    marks = stash(rows.join(small_side(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(bitmaps, "doc_id long, size long, bits binary"), "bitmaps")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            if len(group) > 1:
                first = may_link([i[1] for i in group], [i[2] for i in group], num, den)
                pairs.extend((group[first[k]][0], i[0]) for k, i in enumerate(group) if first[k] != k)

        group, at, pairs = [], None, []
        for b in batches:
            for key, doc, size, bits in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "size", "bits")), strict=True):
                if key != at:
                    close()
                    group, at = [], key
                group.append((doc, size, bits))
            if pairs:
                yield _edges(pairs)
                pairs.clear()
        close()
        if pairs:
            yield _edges(pairs)

    near = few.join(marks, "doc_id").select("key", "doc_id", "size", "bits").repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(prune, "a long, b long")
    return stash(components(stash(near.unionByName(star).distinct(), "links")), "groups")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _link_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges that join what links, from rows (comp, i, j, block, doc_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            if len(group) < 2:
                return
            ids, sets_ = [d for _, d, _ in group], [t for _, _, t in group]
            split = None if at[1] == at[2] else sum(k == at[1] for k, _, _ in group)
            found = link(sets_, num, den, split)
            least: dict[int, int] = {}
            for k, d in enumerate(ids):
                r = found.root(k)
                least[r] = min(least.get(r, d), d)
            pairs.extend((least[found.root(k)], d) for k, d in enumerate(ids) if least[found.root(k)] != d)

        group, at, pairs = [], None, []
        for b in batches:
            comp, i, j, block, ids = (b.column(c).to_pylist() for c in ("comp", "i", "j", "block", "doc_id"))
            tokens = b.column("tokens")
            for k in range(b.num_rows):
                key = comp[k], i[k], j[k]
                if key != at:
                    close()
                    group, at = [], key
                group.append((block[k], ids[k], np.frombuffer(tokens[k].as_py(), np.uint64)))
            if pairs:
                yield _edges(pairs)
                pairs.clear()
        close()
        if pairs:
            yield _edges(pairs)

    where = ["comp", "i", "j"]
    return sets.repartition(*where).sortWithinPartitions(*where, "block", "doc_id").mapInArrow(run, "a long, b long")


def _large_groups(sets: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """(a, b) edges that join what links within groups of more than a block."""
    sets = stash(sets, "large-sets")
    pivots = sets.where("doc_id = comp").groupBy("comp").agg(F.min("tokens").alias("pivot"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [linked(np.frombuffer(t.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint64), num, den) for t, p in zip(b.column("tokens"), b.column("pivot"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("comp", "doc_id", "tokens")), pa.array(near, pa.bool_())], ["comp", "doc_id", "tokens", "near"])

    sided = F.broadcast(pivots) if (pivots.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) <= PIVOT_BYTES else stash(pivots, "pivots")
    held = sets.join(sided, "comp").mapInArrow(compare, "comp long, doc_id long, tokens binary, near boolean")
    # Sets that link are of one class of sizes or of classes next to each other.
    step = max(1.0001 * math.log(den / num), 0.05)
    held = stash(held.withColumn("size_class", F.floor(F.log(F.octet_length("tokens") / 8) / step).cast("long")), "compared")
    counts = held.groupBy("comp", "near", "size_class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    open_ = counts.groupBy("comp").agg(F.collect_list(F.struct("near", "size_class", "blocks")).alias("kinds")).where(F.exists("kinds", lambda k: ~k["near"]))
    dealt = held.join(small_side(stash(open_, "blocks")), "comp")
    # Every pair of blocks of a group that isn't two near ones is a task, if their sizes allow a link.
    code = lambda near, size_class, at: near.cast("long") * (1 << 50) + size_class * (1 << 32) + at
    own = F.filter("kinds", lambda k: (k["near"] == F.col("near")) & (k["size_class"] == F.col("size_class")))[0]["blocks"]
    dealt = dealt.withColumn("block", code(F.col("near"), F.col("size_class"), F.pmod(F.xxhash64("doc_id"), own)))
    others = F.filter("kinds", lambda k: ~(k["near"] & F.col("near")) & (F.abs(k["size_class"] - F.col("size_class")) <= 1))
    all_blocks = F.flatten(F.transform(others, lambda k: F.transform(F.sequence(F.lit(0), k["blocks"] - 1), lambda at: code(k["near"], k["size_class"], at))))
    dealt = dealt.withColumn("other", F.explode(all_blocks))
    pairs = _link_groups(dealt.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "tokens"), num, den)
    return pairs.unionByName(held.where("near and doc_id <> comp").select(F.col("comp").alias("a"), F.col("doc_id").alias("b")))


def shingle_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are runs of non-white-space with A-Z in lower case, a set holds the distinct n-word shingles of the whole
    text, and two documents link when den * intersection >= num * union. A text of fewer words is one shingle; one
    without words, or null, has an empty set and links with nothing. component_id is the smallest doc_id that chains
    of links reach. Rows that repeat an id with other text are documents of their own; a row with null id links only
    with equal sets and is no one's smallest id unless all are null. Empty input gives an empty result; other columns
    are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = ["n_shingles", "d1", "d2"]
    seen = stash(set_digests(rows, n), "digests")
    classes = stash(seen.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    never = stash(
        seen.join(classes.where("members > 1"), digest, "left").groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(True))).alias("is_rep")).where("not is_rep").select("doc_id"), "copies")
    reps = rows.where("doc_id is not null").join(small_side(never), "doc_id", "left_anti")
    groups = _candidates(_met(reps, n, num, den), reps, n, num, den)
    share = groups.count() // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = max(LEAST_BLOCK, min(MOST_BLOCK, share))
    sizes = stash(groups.groupBy("component").agg(F.count("*").alias("members")), "sizes")
    placed = stash(groups.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("comp"), (F.col("members") > block).alias("large")), "placed")

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("comp"), pa.array([t.tobytes() for _, t in _sets(part, n)], pa.binary())], ["doc_id", "comp", "tokens"])

    def sets_of(which: DataFrame) -> DataFrame:
        ids = which.select("doc_id", "comp")
        return rows.join(small_side(ids), "doc_id").select("doc_id", "comp", "text").mapInArrow(read_sets, "doc_id long, comp long, tokens binary")

    zero = F.lit(0).cast("long")
    links = _link_groups(sets_of(placed.where("not large")).select("comp", zero.alias("i"), zero.alias("j"), zero.alias("block"), "doc_id", "tokens"), num, den)
    if placed.where("large").limit(1).count():
        labels = components(stash(links.unionByName(_large_groups(sets_of(placed.where("large")), block, num, den)), "linked"))
    else:  # every group was compared in one task
        labels = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    labels = labels.groupBy("node").agg(F.min("component").alias("component"))
    named = stash(classes.join(stash(labels, "labels"), classes["rep"] == F.col("node"), "left").select(*digest, F.coalesce("component", "rep").alias("component_id")), "named")
    return seen.join(named, digest, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that with the smallest id; all columns stay.

    Rows are documents of their own even if they repeat an id or have none; null ids come last, and of equal ids one stays.
    """
    rows, key, numbered = keyed(docs, id_col)
    found = shingle_components(rows, n, num, den, key, text_col)
    if numbered:
        ids = rows.select(F.col(key).alias("doc_id"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col(key).alias("row")).alias("place"))
        placed = stash(found.join(ids, "doc_id").select("doc_id", "component_id", "place"), "near-places")
        stay = placed.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.row").alias("doc_id"))
        dropped = placed.join(stay, "doc_id", "left_anti")
    else:
        dropped = found.where("doc_id <> component_id")
    return without(rows, key, stash(dropped.select(F.col("doc_id").alias(key)), "near-copies"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(reached) FROM r WHERE r.node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
