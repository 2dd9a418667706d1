"""Scans and sinks: CSV and Parquet in, row identity, cleaned data and change logs out, JSON catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import col
from .shared import cut

#: Texts that a CSV scan reads as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def nulls_from_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Text columns with the tokens as null, floating columns with NaN as null."""
    def clean(f):
        c = col(f.name)
        if f.dataType.typeName() == "string":
            return F.when(~c.isin(*tokens), c).alias(f.name)
        return F.when(~F.isnan(c), c).alias(f.name) if f.dataType.typeName() in ("double", "float") else c
    return df.select(*[clean(f) for f in df.schema])


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV with a header, all columns text, so that no inference pass reads it twice."""
    frame = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=options.pop("multiLine", False), **options).csv(path)
    return nulls_from_tokens(frame)


def with_row_id(df: DataFrame, name: str = "_row_id", order: list[str] | None = None) -> DataFrame:
    """A dense, stable row number. By the given columns if there are any, which must identify rows; else by position in the input.

    Rows are written with their partition and place in it; a row's number is its place plus the rows of earlier partitions.
    """
    placed = df.repartitionByRange(*[col(c) for c in order]).sortWithinPartitions(*[col(c) for c in order]) if order else df
    at = F.monotonically_increasing_id()
    placed = cut(placed.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(parts.select("__part", before.alias("__before"))), "__part").select(*[col(c) for c in df.columns], (F.col("__before") + F.col("__at")).alias(name))


def write_cleaned(df: DataFrame, folder: str, stem: str, fixes_applied: bool, fmt: str = "csv") -> str:
    """Writes the dataset as <stem>.cleaned if a fix was applied, else <stem>.processed; returns the path."""
    path = f"{folder}/{stem}.{'cleaned' if fixes_applied else 'processed'}.{fmt}"
    writer = df.write.mode("overwrite")
    (writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def write_changes(changes: DataFrame, folder: str, stem: str) -> str:
    """Writes the change log, a folder for each source of changes."""
    path = f"{folder}/{stem}.changes"
    changes.write.mode("overwrite").partitionBy("source").parquet(path)
    return path


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The flat column catalogue of JSON documents {domain, dataset, columns: [{column_name, ref | dtype...}], shared: [{ref, ...}]}.

    A column that refers to a shared definition takes it; a reference without one, and an unknown format type, is an error.
    """
    docs = spark.read.schema("domain string, dataset string, columns array<struct<column_name string, ref string, dtype string, format_type string, pattern string>>, "
                             "shared array<struct<ref string, dtype string, format_type string, pattern string>>").json(path)
    columns = docs.select("domain", "dataset", F.inline("columns"))
    shared = docs.select(F.inline("shared")).select("ref", *[F.col(c).alias(f"s_{c}") for c in ("dtype", "format_type", "pattern")]).distinct()
    joined = columns.join(shared, "ref", "left")
    dangling = F.col("ref").isNotNull() & F.col("s_dtype").isNull()
    kind = F.coalesce("format_type", "s_format_type")
    checked = F.when(dangling, F.raise_error(F.concat(F.lit("unknown $ref "), "ref"))).when(kind.isNotNull() & ~kind.isin("enum", "regex", "range", "date"), F.raise_error(F.concat(F.lit("unknown format type "), kind))).otherwise(kind)
    return joined.select("domain", "dataset", "column_name", F.coalesce("dtype", "s_dtype").alias("dtype"), checked.alias("format_type"), F.coalesce("pattern", "s_pattern").alias("pattern"))


FORMAT = "struct<type: string, pattern: string, values: array<string>, min: double, max: double>"
DEFINITION = f"`$ref` string, dtype string, format {FORMAT}, case_convention string, is_nullable boolean"


def read_registry(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The flat catalogue of a nested registry: {root: {domains: {name: {datasets: {name: {columns: {name: definition}}}}}, shared_column_definitions: {name: definition}}}.

    A definition has dtype (object without one), format, case_convention and is_nullable (true without one), or is a $ref to
    a shared one, which it then takes with its name as canonical_id. Shared names that begin with _ are remarks. A reference
    to what isn't there, and a format that is no enum, regex or range, is an error.
    """
    top = "domains: map<string, struct<datasets: map<string, struct<columns: map<string, string>>>>>, shared_column_definitions: map<string, string>"
    r = spark.read.option("multiLine", True).schema(f"`{root}` struct<{top}>").json(path).select(f"`{root}`.*")
    domains = r.select(F.explode("domains").alias("domain", "d")).select("domain", F.explode("d.datasets").alias("dataset", "t")).select("domain", "dataset", F.explode("t.columns").alias("column_name", "raw"))
    own = domains.select("domain", "dataset", "column_name", F.from_json("raw", DEFINITION).alias("own"))
    own = own.withColumn("canonical_id", F.substring_index("own.$ref", "/", -1))
    shared = r.select(F.explode("shared_column_definitions").alias("name", "raw")).where(~F.col("name").startswith("_"))
    shared = shared.select(F.col("name").alias("canonical_id"), F.from_json("raw", DEFINITION).alias("common"))
    j = own.join(shared, "canonical_id", "left").withColumn("use", F.when(F.col("canonical_id").isNull(), F.col("own")).otherwise(F.col("common")))
    kind = F.col("use.format.type")
    dangling = F.when(F.col("canonical_id").isNotNull() & F.col("common").isNull(), F.raise_error(F.concat(F.lit("unresolved $ref of column "), "column_name")).cast("string"))
    unknown = F.when(F.col("use.format").isNotNull() & ~F.coalesce(kind.isin("enum", "regex", "range"), F.lit(False)), F.raise_error(F.concat(F.lit("unknown format type of column "), "column_name")).cast("string"))
    return j.select("domain", "dataset", "column_name", F.coalesce(dangling, "use.dtype", F.lit("object")).alias("dtype"), F.coalesce(unknown, kind).alias("format_type"), F.col("use.format.pattern").alias("pattern"),
                    F.col("use.format.values").alias("allowed"), F.col("use.format.min").alias("least"), F.col("use.format.max").alias("greatest"), F.col("use.case_convention").alias("case_convention"),
                    F.coalesce("use.is_nullable", F.lit(True)).alias("is_nullable"), "canonical_id")


def first_definitions(catalogue: DataFrame) -> DataFrame:
    """One definition a column name over all domains: the first by domain and dataset."""
    w = Window.partitionBy("column_name").orderBy("domain", "dataset", "dtype", "pattern")
    return catalogue.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def signatures(catalogue: DataFrame) -> DataFrame:
    """(domain, columns): the sorted column names of each domain."""
    return catalogue.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(column_name, description, sample, dtype) of a JSON list."""
    return spark.read.schema("column_name string, description string, sample array<string>, dtype string").json(path)
