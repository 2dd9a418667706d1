"""Schema validation: names, types, nullability, redundant columns, catalogue matching and retrieval."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.values import col, columns_of, text
from . import nearest
from .completeness import SPARSE, fill_rates, violation_rows
from .profile import castable

CONVENTION = r"[a-z][a-z0-9_]*(_[A-Z]{2,})?"


def names_frame(df: DataFrame, row_id: str) -> DataFrame:
    """(column, position) of the columns of df."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(i).alias("position")) for i, n in enumerate(columns_of(df, row_id))])
    return df.sparkSession.range(1).select(F.inline(cells))


def conforms(name: Column, convention: str = CONVENTION) -> Column:
    return name.rlike(rf"\A(?:{convention})\z")


def normal_name(name: Column) -> Column:
    """A snake-case form of a name."""
    n = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    n = F.lower(F.regexp_replace(n, "[^0-9a-zA-Z]+", "_"))
    n = F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_+|_+$", "")
    return F.when(n == "", "col").when(n.rlike("^[0-9]"), F.concat(F.lit("col_"), n)).otherwise(n)


def validate_names(names: DataFrame, convention: str = CONVENTION) -> DataFrame:
    """(column, position, suggestion) of names against the convention; suggestions are unique among themselves and all good names.

    In column order a taken suggestion gets the first of _2, _3, … that is free. Names are a row for each column of a
    table, so they are few and are gone through on the driver.
    """
    marked = names.select("column", "position", conforms(F.col("column"), convention).alias("good"), normal_name(F.col("column")).alias("base")).orderBy("position", "column").collect()
    taken, next_of, out = {r["column"] for r in marked if r["good"]}, {}, []
    for r in marked:
        if r["good"]:
            continue
        name, n = r["base"], next_of.get(r["base"], 2)
        while name in taken:
            name, n = f"{r['base']}_{n}", n + 1
        next_of[r["base"]] = n
        taken.add(name)
        out.append((r["column"], r["position"], name))
    kinds = dict(names.dtypes)
    return names.sparkSession.createDataFrame(out, f"column string, position {kinds['position']}, suggestion string")


def naming_violations(names: DataFrame) -> DataFrame:
    return violation_rows(validate_names(names), "column", F.lit(-1), F.col("column"), F.concat(F.lit("column name: "), "suggestion"), "schema", F.lit(1))


def naming_flags(names: DataFrame) -> DataFrame:
    """(column, flags): what is wrong with a name, joined by commas; good names are left out."""
    c = F.col("column")
    flags = F.array_compact(F.array(F.when(c.rlike("^[0-9]"), F.lit("leading_digit")), F.when(c.contains(" "), F.lit("embedded_space")), F.when(c.rlike("[^0-9a-zA-Z_ ]"), F.lit("special_char")), F.when(c != F.lower(c), F.lit("not_snake_lower"))))
    return names.select("column", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def sparse_violations(df: DataFrame, row_id: str, least: float = SPARSE) -> DataFrame:
    rates = fill_rates(df, row_id).where((F.col("total") > 0) & (F.col("nulls") >= least * F.col("total")))
    return violation_rows(rates, "column", F.lit(-1), F.lit(None), F.lit("sparse column"), "schema", F.col("nulls"))


def cast_violations(df: DataFrame, row_id: str, dtypes: dict[str, str]) -> DataFrame:
    """The rows that a declared cast would lose, all columns in one scan."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), text(col(n)).alias("value"), F.lit(t).alias("dtype"), castable(text(col(n)), F.lit(t)).alias("fits")) for n, t in dtypes.items() if n in df.columns])
    lost = df.select(col(row_id).alias("row_id"), F.inline(cells)).where("value is not null and not coalesce(fits, false)")
    return violation_rows(lost, "column", F.col("row_id"), F.col("value"), F.concat(F.lit("not coercible to "), "dtype"), "schema", F.lit(1))


def nullability_violations(df: DataFrame, row_id: str, not_nullable: list[str]) -> DataFrame:
    bad = fill_rates(df, row_id).where((F.col("nulls") > 0) & F.col("column").isin(*not_nullable))
    return violation_rows(bad, "column", F.lit(-1), F.lit(None), F.lit("not nullable"), "schema", F.col("nulls"))


def fingerprints(df: DataFrame, row_id: str) -> DataFrame:
    """(column, position, fingerprint): a 128-bit sum over rows of hashes of row and text; equal for equal columns, in one pass, in any row order."""
    names = columns_of(df, row_id)
    part = lambda n, seed: F.sum(F.xxhash64(col(row_id), F.coalesce(text(col(n)), F.lit("\0")), F.lit(seed)).cast("decimal(38,0)"))
    one = df.agg(*[F.concat_ws(":", part(n, 1), part(n, 2)).alias(f"f{i}") for i, n in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.col(f"f{i}").alias("fingerprint")) for i, n in enumerate(names)])))


def redundant_columns(df: DataFrame, row_id: str) -> DataFrame:
    """(column, same_as): columns whose text equals an earlier column's in every row."""
    f = fingerprints(df, row_id)
    first = f.groupBy("fingerprint").agg(F.min(F.struct("position", "column")).alias("first"))
    return f.join(first, "fingerprint").where("position > first.position").select("column", F.col("first.column").alias("same_as"))


def structural_defects(df: DataFrame, row_id: str, dtypes: dict[str, str] | None = None) -> DataFrame:
    """(column, defects): naming, sparse, untyped (a value doesn't cast to the declared type), redundant, joined by commas."""
    names = names_frame(df, row_id)
    rates = fill_rates(df, row_id).select("column", (F.col("nulls") >= SPARSE * F.col("total")).alias("sparse"))
    wanted = {n: t for n, t in (dtypes or {}).items() if n in df.columns}
    out = names.join(rates, "column").join(redundant_columns(df, row_id).withColumn("redundant", F.lit(True)), "column", "left")
    if wanted:
        bad = cast_violations(df, row_id, wanted).groupBy(F.col("column_name").alias("column")).agg(F.lit(True).alias("untyped"))
        out = out.join(bad, "column", "left")
    else:
        out = out.withColumn("untyped", F.lit(False))
    d = F.array_compact(F.array(F.when(~conforms(F.col("column")), F.lit("naming")), F.when(F.col("sparse"), F.lit("sparse")), F.when(F.col("untyped"), F.lit("untyped")), F.when(F.col("redundant"), F.lit("redundant"))))
    return out.select("column", F.array_join(d, ",").alias("defects")).where("defects <> ''")


@functools.lru_cache(maxsize=65_536)
def _folded(c: str) -> str:
    """A character without its marks: decomposed, or by its name where it is a letter WITH something that has no decomposition."""
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
    named = re.match(r"LATIN (?:SMALL|CAPITAL) LETTER ([A-Z]) WITH ", unicodedata.name(base, "")) if len(base) == 1 else None
    return named[1].lower() if named else base


@F.pandas_udf(StringType())
def bare_name(names: pd.Series) -> pd.Series:
    """Lower case, letters of any script without their marks, other characters as one underscore: 'Citt\u00e0 (IT)' as 'citta_it', '\u0141\u00f3d\u017a' as 'lodz'."""
    def bare(name: str | None) -> str | None:
        if name is None:
            return None
        kept = "".join(map(_folded, name.casefold()))
        return "_".join("".join(x if unicodedata.category(x)[0] in "LNM" else " " for x in unicodedata.normalize("NFC", kept)).split())
    return names.map(bare)


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def canonical_match(names: DataFrame, catalogue: DataFrame, least: float = 0.85) -> DataFrame:
    """(column, canonical_id, how): by exact name, alias, bare name (unless nothing of it is left), then the most alike bare name from `least` on.

    names: (column); catalogue: (canonical_id, name, alias). Fuzzy matches are those of a comparison of all pairs, sought
    by an exact filter: a likeness of least bounds the edits, so of one more segments of the catalogue's name than there
    may be edits, one stands unchanged in the other name, moved no further than the edits allow. Ties go to the smaller
    canonical_id.
    """
    n = names.select("column", bare_name(F.col("column")).alias("bare"))
    c = catalogue.select("canonical_id", "name", "alias", bare_name(F.col("name")).alias("c_bare"))
    hits = n.join(c, n["column"] == c["name"]).select("column", "canonical_id", F.lit(1).alias("how"), F.lit(1.0).alias("score"))
    hits = hits.unionByName(n.join(c, n["column"] == c["alias"]).select("column", "canonical_id", F.lit(2).alias("how"), F.lit(1.0).alias("score")))
    hits = hits.unionByName(n.join(c, (n["bare"] == c["c_bare"]) & (n["bare"] != "")).select("column", "canonical_id", F.lit(3).alias("how"), F.lit(1.0).alias("score")))
    slack = 1e-9  # floating-point bounds include their end
    lengths = lambda size: F.sequence(F.ceil(size * least - slack).cast("int"), F.floor(size / least + slack).cast("int"))
    edits = lambda x, y: F.floor(F.greatest(x, y) * (1 - least) + slack).cast("int")
    cut = lambda part: F.floor(part * F.col("len") / (F.col("edits") + 1)).cast("int")
    parts = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), "edits"))).withColumn("start", cut(F.col("part"))).withColumn("long", cut(F.col("part") + 1) - F.col("start"))
    size = F.length("bare")
    near = n.where("bare <> ''").withColumn("len", F.explode(lengths(size))).withColumn("edits", edits(size, F.col("len")))
    more = size - F.col("len")
    moved = F.sequence(F.ceil((more - F.col("edits")) / 2).cast("int"), F.floor((more + F.col("edits")) / 2).cast("int"))
    near = parts(near).withColumn("at", F.explode(moved)).withColumn("at", F.col("start") + F.col("at")).where((F.col("at") >= 0) & (F.col("at") + F.col("long") <= size))
    near = near.select("column", "bare", "len", "edits", "part", F.substring("bare", F.col("at") + 1, F.col("long")).alias("segment"))
    known = c.where("c_bare <> ''").withColumn("len", F.length("c_bare"))
    known = parts(known.withColumn("edits", F.explode(F.array_distinct(F.transform(lengths(F.col("len")), lambda x: edits(x, F.col("len")))))))
    known = known.select("canonical_id", "c_bare", "len", "edits", "part", F.substring("c_bare", F.col("start") + 1, F.col("long")).alias("segment"))
    fuzzy = near.join(known, ["len", "edits", "part", "segment"]).select("column", "canonical_id", "bare", "c_bare").distinct().withColumn("score", likeness(F.col("bare"), F.col("c_bare"))).where(F.col("score") >= least)
    hits = hits.unionByName(fuzzy.select("column", "canonical_id", F.lit(4).alias("how"), "score"))
    w = Window.partitionBy("column").orderBy("how", F.desc("score"), "canonical_id")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("column", "canonical_id", F.element_at(F.array(*[F.lit(x) for x in ("exact", "alias", "bare", "fuzzy")]), F.col("how")).alias("how"))


#: Queries of a block, entries that a task lets stream by it, and fewer ones where cores would stay idle.
QUERY_BLOCK, LANE, SHORT = 8_192, 32_768, 4_096


def retrieve_top_k(queries: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """(query, rank, entry, score) of the k best catalogue entries for each query: cosine + 0.3 * shared samples / samples + 0.1 for the same type family.

    queries and catalogue: (id, vector, samples, dtype). Blocks of queries meet lanes of entries, each pair of which keeps
    the k best of a query before the final ranking (see `nearest`). A null sample is shared with none. A null vector or
    component, or another length, gives a null score, which ranks last; the cosine of a vector of zeros is NaN, which
    ranks first. Rows with a null id take no part.
    """
    blocks, entries = max(1, -(-queries.count() // QUERY_BLOCK)), catalogue.count()
    lanes = max(1, -(-entries // LANE), min(-(-entries // SHORT), 2 * catalogue.sparkSession.sparkContext.defaultParallelism))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = [F.col("block") * lanes + F.col("lane"), "role", "id", "vector", F.array_compact(F.array_distinct("samples")), F.coalesce(F.size("samples"), F.lit(0)), "dtype"]
    shape = lambda df, role: df.where("id is not null").withColumn("role", F.lit(role))
    names = ["task", "role", "id", "vector", "samples", "many", "dtype"]
    q = shape(queries, 0).withColumn("block", deal(blocks)).withColumn("lane", each(lanes)).select(columns).toDF(*names)
    e = shape(catalogue, 1).withColumn("lane", deal(lanes)).withColumn("block", each(blocks)).select(columns).toDF(*names)
    both = q.unionByName(e).repartition(2 * blocks * lanes, "task").sortWithinPartitions("task", "role", "id")
    kind = both.schema["id"].dataType.simpleString()
    scored = both.mapInArrow(nearest.search(k), f"query {kind}, entry {kind}, raw double")
    w = Window.partitionBy("query").orderBy(F.desc("raw"), "entry")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    types = queries.schema["id"].dataType, catalogue.schema["id"].dataType
    return best.select(F.col("query").cast(types[0]).alias("query"), "rank", F.col("entry").cast(types[1]).alias("entry"), F.round("raw", 3).alias("score"))


def detect_domain(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(domain, dataset, matched) by how many of the names each dataset of the catalogue has, the best first in `rank`."""
    hits = catalogue.join(names.select(F.col("column").alias("column_name")), "column_name").groupBy("domain", "dataset").agg(F.count_distinct("column_name").alias("matched"))
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matched"), "domain", "dataset")))  # a row for each dataset
