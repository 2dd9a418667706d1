"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels reduced in slot arrays.

1. Every row is a leaf, the SHA-256 of its columns.
2. A group's ids lie in a compressed bitmap: a container spans 4,096 ids as one word of 64 bits that says which of its
   64 words are in use, those words, and a popcount directory of the rows before each. Tasks build words that Spark
   merges by OR; the rows before each container come from sums over a trie of the id's upper bits. The rank of an id,
   which is its leaf's place, is looked up there: rows are never sorted.
3. Leaves are put into blocks of 1,024 places, each a slot array that is reduced to one node. The nodes are the leaves of
   the next round, until a group has one left; the groups' roots go through the same rounds.
4. The siblings above a block are handed down from round to round, and every block folds its leaves' proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, stash
from .resampling import crc32_sql
from .sharding import numbered

#: Levels that one slot array reduces: blocks have 2 ** LEVELS places.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A column's part of a leaf: its UTF-8 byte count, a colon and its text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _containers(words: DataFrame) -> DataFrame:
    """(grp, hi, top, words, ahead, base) of (grp, hi, wi, bits, n): the words of each 4,096 ids in use, the rows before
    each inside its container, and the rows of the group before the container."""
    each = words.groupBy("grp", "hi").agg(F.array_sort(F.collect_list(F.struct("wi", "bits", "n"))).alias("w"), F.sum("n").alias("n"))  # at most 64
    ahead = F.transform("w", lambda x, i: F.aggregate(F.slice("w", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["n"]))
    top = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["wi"])))
    each = each.select("grp", "hi", "n", top.alias("top"), F.transform("w", lambda x: x["bits"]).alias("words"), ahead.alias("ahead"))
    each = stash(each.withColumns({"up1": F.shiftright("hi", 16), "up2": F.shiftright("hi", 32)}), "containers")
    # Rows before, by the trie of upper bits: no window has more than 65,536 containers, or 2^20 of the highest level.
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ups1 = each.groupBy("grp", "up2", "up1").agg(F.sum("n").alias("n"))
    ups2 = ups1.groupBy("grp", "up2").agg(F.sum("n").alias("n"))
    ups2 = stash(ups2.select(F.col("grp").alias("g"), F.col("up2").alias("u2"), before(["grp"], "up2").alias("base2")), "trie")
    ups1 = ups1.withColumn("base1", before(["grp", "up2"], "up1")).join(small_side(ups2), (F.col("grp") == F.col("g")) & (F.col("up2") == F.col("u2")))
    ups1 = stash(ups1.select(F.col("grp").alias("g"), F.col("up1").alias("u1"), (F.col("base1") + F.col("base2")).alias("base1")), "trie")
    each = each.withColumn("base", before(["grp", "up1"], "hi")).join(small_side(ups1), (F.col("grp") == F.col("g")) & (F.col("up1") == F.col("u1")))
    return each.select("grp", "hi", "top", "words", "ahead", (F.col("base") + F.col("base1")).alias("base"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds idx to rows (row, grp, doc_id, leaf, ...): the place among the rows of its grp by (doc_id, leaf), null ids first.

    grp has no nulls and row names each row. Ids that are repeated, or null, stand in the bitmap once (null ids before
    it); rows of one id are told apart by a distributed sort of those rows alone.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    hi, wi = F.shiftright("doc_id", 12), F.shiftright("doc_id", 6).bitwiseAND(63).cast("int")
    known = rows.where("doc_id is not null")
    words = stash(known.groupBy("grp", hi.alias("hi"), wi.alias("wi")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")), "bitmaps")
    holders = stash(_containers(words), "ranks")
    nulls = stash(rows.where("doc_id is null").groupBy("grp").agg(F.count("*").alias("n")), "null-ids")
    odd = stash(words.where("n > bit_count(bits)").select("grp", "hi", "wi"), "repeated")
    some = odd.limit(1).count() > 0 or nulls.limit(1).count() > 0
    key = {"hi": hi, "wi": wi}
    # Containers have at most 64 words, 1,100 bytes with their directory: broadcast while that is under 10 MB.
    sides = F.broadcast(holders) if holders.count() <= 10_000 else holders
    at = known.withColumns(key).join(sides, ["grp", "hi"])
    low = lambda n: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n))
    k = F.bit_count(F.col("top").bitwiseAND(low(F.col("wi")))).cast("int") + 1
    under = F.bit_count(F.element_at("words", k).bitwiseAND(low(F.col("doc_id").bitwiseAND(63).cast("int"))))
    at = at.select(*rows.columns, "hi", "wi", (F.col("base") + F.element_at("ahead", k) + under).cast("long").alias("idx"))
    if not some:
        return at.select(*rows.columns, "idx")
    at = at.unionByName(rows.where("doc_id is null").select("*", F.lit(None).cast("long").alias("hi"), F.lit(None).cast("int").alias("wi"), F.lit(0).cast("long").alias("idx")))
    # Repeats: a word's rows are counted by id, at most 64 ids a word; rows of smaller ids move the later ones up.
    many = known.withColumns(key).join(small_side(odd), ["grp", "hi", "wi"], "left_semi").groupBy("grp", "hi", "wi", "doc_id").agg(F.count("*").alias("m")).where("m > 1")
    many = stash(many, "repeats")
    extra = many.groupBy("grp", "hi", "wi").agg(F.collect_list(F.struct("doc_id", "m")).alias("extra"))
    same = many.select("grp", "doc_id").unionByName(nulls.select("grp", F.lit(None).cast("long").alias("doc_id")))
    more = F.aggregate("extra", F.lit(0).cast("long"), lambda s, x: s + F.when(x["doc_id"] < F.col("doc_id"), x["m"] - 1).otherwise(0))
    at = at.join(small_side(extra), ["grp", "hi", "wi"], "left").withColumn("idx", F.col("idx") + F.coalesce(more, F.lit(0)))
    at = at.join(small_side(nulls.withColumnRenamed("n", "nulls")), "grp", "left")
    at = at.withColumn("idx", F.col("idx") + F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("nulls", F.lit(0)))).select(*rows.columns, "idx")
    alias = same.select(F.col("grp").alias("g"), F.col("doc_id").alias("d"))
    again = rows.select("row", "grp", "doc_id", "leaf").join(small_side(alias), (F.col("grp") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    placed, _ = numbered(again, ["grp", "doc_id", "leaf", "row"], "number")
    placed = stash(placed, "placed")
    least = stash(placed.groupBy("grp", "doc_id").agg(F.min("number").alias("least")), "least").select(F.col("grp").alias("g"), F.col("doc_id").alias("d"), "least")
    placed = placed.join(small_side(least), (F.col("grp") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("row", (F.col("number") - F.col("least")).alias("turn"))
    return at.join(placed, "row", "left").withColumn("idx", F.col("idx") + F.coalesce("turn", F.lit(0))).drop("turn").select(*rows.columns, "idx")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], height: int) -> list[list[str]]:
    """nodes and the levels above them, `height` in all: two consecutive nodes become one, and so does a last single one."""
    out = [nodes]
    for _ in range(height):
        last = out[-1]
        out.append([digest("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[str]:
    """The sibling of place i on each level but the last, bottom up; empty where there is none."""
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else "")
        i >>= 1
    return out


def fold(node: str, i: int, path: list[str]) -> str:
    """What place i becomes at the end of a path of siblings."""
    for sibling in path:
        node = digest(sibling + node if i & 1 else node + sibling)
        i >>= 1
    return node


_PAYLOAD = "struct<doc_id:long,changed:string>"
_SLOTS = f"array<struct<idx:long,node:string,payload:{_PAYLOAD}>>"


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, height, slots): the nodes of each block in their places; height is how many levels the block has to climb.

    nodes: grp, idx, node, payload, total, where total is how many nodes the grp has.
    """
    height = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    found = nodes.groupBy("grp", F.shiftright("idx", LEVELS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "node", "payload"))).cast(_SLOTS).alias("slots"), F.max("total").alias("total"))
    return stash(found.select("grp", "block", F.least(height, F.lit(LEVELS)).alias("height"), "slots"), "blocks")


def _tops(blocks: DataFrame) -> DataFrame:
    """(grp, idx, node): what each block becomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [levels_of([x["node"] for x in cell.as_py()], h.as_py())[-1][0] for cell, h in zip(b.column("slots"), b.column("height"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("block"), pa.array(nodes, pa.string())], ["grp", "idx", "node"])

    return stash(blocks.select("grp", "block", "height", "slots").mapInArrow(run, "grp string, idx long, node string"), "nodes")


def _climb(leaves: DataFrame, deepest: int) -> list[DataFrame]:
    """The blocks of every round; the last round's have one block a grp, and its node is the grp's root.

    deepest is the largest number of nodes that a grp has.
    """
    rounds = [_blocks(leaves)]
    while deepest > 1 << LEVELS:
        blocks = rounds[-1]
        above = _tops(blocks).join(small_side(stash(blocks.groupBy("grp").agg(F.count("*").alias("total")), "totals")), "grp")
        rounds.append(_blocks(above.withColumn("payload", F.lit(None).cast(_PAYLOAD))))
        deepest = -(-deepest >> LEVELS)
    return rounds


def _member_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, block, path, turns) for the blocks below: the siblings of each member, then those above its own block.

    above: grp, block, path (array of text), turns (array of 0 and 1: which side the node is on).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for cells in zip(*(b.column(c) for c in ("grp", "slots", "height", "path", "turns")), strict=True):
                grp, cell, h, path, turns = (x.as_py() for x in cells)
                levels = levels_of([x["node"] for x in cell], h)
                for i, x in enumerate(cell):
                    for o, v in zip(out, (grp, x["idx"], path_of(levels, i) + path, [i >> k & 1 for k in range(h)] + turns), strict=True):
                        o.append(v)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["grp", "block", "path", "turns"])

    joined = blocks.select("grp", "block", "height", "slots").join(above, ["grp", "block"])
    return stash(joined.mapInArrow(run, "grp string, block long, path array<string>, turns array<int>"), "paths")


def _turned(node: str, path: list[str], turns: list[int]) -> str:
    for sibling, right in zip(path, turns, strict=True):
        node = digest(sibling + node if right else node + sibling)
    return node


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, block, path, turns) of the first round's blocks; above has the paths of the last round's only blocks (grp, path, turns)."""
    path = above.select("grp", F.lit(0).cast("long").alias("block"), "path", "turns")
    for blocks in reversed(rounds[1:]):
        path = _member_paths(blocks, path)
    return path


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, tampered: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    fields go into the leaf in that order. Leaves of a group ascend by id; null ids come first, and rows of one id ascend
    by leaf. A null group is the first of the groups, which are ordered by their UTF-8 bytes. `changed` replaces columns
    where `tampered` holds; folded_root is then folded from the leaf of the changed row with the original siblings.
    Rows equal in all fields are interchangeable. Empty docs give an empty result; other columns are not read, and the
    names of columns don't matter.
    """
    value = {c: docs[c] for c in fields}
    other = leaf_of([(changed or {}).get(c, value[c]) for c in fields])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    grp = docs[group_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), grp), F.lit("")).alias("grp"), leaf_of(list(value.values())).alias("leaf"), F.when(hit, other).alias("changed"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    totals = stash(rows.groupBy("grp").agg(F.count("*").alias("total")), "totals")
    size = totals.agg(F.max("total"), F.count("*")).first()
    leaves = ranked(rows).join(small_side(totals, size[1]), "grp").select("grp", "idx", F.col("leaf").alias("node"), F.struct("doc_id", "changed").alias("payload"), "total")
    rounds = _climb(leaves, size[0] or 0)
    subroots = _tops(rounds[-1]).select(F.col("grp").alias("name"), F.col("node").alias("subroot"))
    order, _ = numbered(subroots, ["name"], "idx")
    order = stash(order, "order")
    heads = order.select(F.lit("").alias("grp"), "idx", F.col("subroot").alias("node"), F.lit(None).cast(_PAYLOAD).alias("payload"), F.lit(size[1]).cast("long").alias("total"))
    over = _climb(heads, size[1])
    root = _tops(over[-1]).first()
    root = root["node"] if root else None
    none = docs.sparkSession.range(1).select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("turns"))
    of_group = _member_paths(over[0], _down(over, none)).withColumnRenamed("block", "idx").drop("grp")
    above = stash(order.join(of_group, "idx").select(F.col("name").alias("grp"), "path", "turns"), "above")
    last = _down(rounds, above).join(small_side(order.select(F.col("name").alias("grp"), "subroot"), size[1]), "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for cells in zip(*(b.column(c) for c in ("slots", "height", "path", "turns", "subroot")), strict=True):
                cell, h, path, turns, subroot = (x.as_py() for x in cells)
                levels = levels_of([x["node"] for x in cell], h)
                for i, x in enumerate(cell):
                    own = path_of(levels, i)
                    top = _turned(fold(x["payload"]["changed"] or x["node"], i, own), path, turns)
                    for o, v in zip(out, (x["payload"]["doc_id"], x["node"], subroot, digest("".join(own + path)), top), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(o, pa.string()) for o in out[1:])], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    found = rounds[0].select("grp", "block", "height", "slots").join(last, ["grp", "block"])
    found = found.mapInArrow(run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, changed={"n_chars": docs["n_chars"] + 1}, tampered=F.crc32(docs["doc_id"].cast("string")) % 7 == 0)


_FIELD = "coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


_UP = "sha256(CASE WHEN {x}.idx % 2 = 1 THEN o.h || {x}.h ELSE {x}.h || coalesce(o.h, '') END), {x}.proof || coalesce(o.h, ''), ({x}.n + 1) // 2"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents),
l AS (SELECT lang, idx, 0 AS lvl, leaf AS h, n FROM d
      UNION ALL SELECT lang, idx // 2, lvl + 1, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM l WHERE n > 1 GROUP BY lang, idx // 2, lvl, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, lang COLLATE "binary") - 1 AS idx, count(*) OVER () AS n FROM l WHERE n = 1),
g AS (SELECT idx, 0 AS lvl, subroot AS h, n FROM s
      UNION ALL SELECT idx // 2, lvl + 1, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM g WHERE n > 1 GROUP BY idx // 2, lvl, n),
f AS (SELECT doc_id, lang, idx, 0 AS lvl, coalesce(changed, leaf) AS h, '' AS proof, n FROM d
      UNION ALL SELECT f.doc_id, f.lang, f.idx // 2, f.lvl + 1, {_UP.format(x='f')}
      FROM f LEFT JOIN l o ON o.lang IS NOT DISTINCT FROM f.lang AND o.lvl = f.lvl AND o.idx = xor(f.idx, 1) WHERE f.n > 1),
t AS (SELECT f.doc_id, s.subroot, s.idx, 0 AS lvl, f.h, f.proof, s.n FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
      UNION ALL SELECT t.doc_id, t.subroot, t.idx // 2, t.lvl + 1, {_UP.format(x='t')}
      FROM t LEFT JOIN g o ON o.lvl = t.lvl AND o.idx = xor(t.idx, 1) WHERE t.n > 1)
SELECT d.doc_id, d.leaf, t.subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified
FROM t JOIN d USING (doc_id), (SELECT h FROM g WHERE n = 1) r WHERE t.n = 1
"""
