"""Streaming queries: the events table read as a stream, one file a trigger, drained into Parquet and returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.formats import Spec
from ..operators.repair import apply_function, replace_from_table
from ..sources.shared import scratch
from ..streaming import validate as st
from .registry import query

SPECS = {"event_type": Spec("enum", values=("click", "view", "purchase", "login")), "value": Spec("range", low=0, high=50)}


def events(s, d):
    path = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")


def drain(s, stream, mode: str = "append"):
    out = scratch(s, "stream")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/data").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{out}/data")


BAD = "event_type NOT IN ('click', 'view', 'purchase', 'login')"


@query("st_01_violations", f"SELECT 'event_type' AS column_name, event_id AS row_id, event_type AS value, 'click|view|purchase|login' AS expected_pattern, 'format' AS kind, 1::BIGINT AS affected_rows FROM events WHERE {BAD}")
def _(s, d):
    return drain(s, st.violations(events(s, d), "event_id", {"event_type": SPECS["event_type"]}))


@query("st_02_quarantine", f"SELECT event_id, array_to_string(list_filter([CASE WHEN {BAD} THEN 'event_type' END, CASE WHEN NOT (value BETWEEN 0 AND 50) THEN 'value' END], lambda v: v IS NOT NULL), ',') AS failed FROM events WHERE {BAD} OR NOT (value BETWEEN 0 AND 50)")
def _(s, d):
    return drain(s, st.split(events(s, d), SPECS)[1].select("event_id", F.array_join("failed", ",").alias("failed")))


@query("st_03_dedup", "SELECT DISTINCT event_type FROM events")
def _(s, d):
    return drain(s, st.deduplicate(events(s, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", ["event_type"], "3650 days").select("event_type"))


@query("st_04_function", "SELECT event_id, upper(event_type) AS event_type FROM events")
def _(s, d):
    return drain(s, apply_function(events(s, d), "event_type", str.upper).select("event_id", "event_type"))


@query("st_05_mapping", "SELECT event_id, CASE WHEN event_type LIKE '%i%' THEN upper(event_type) ELSE event_type END AS event_type FROM events")
def _(s, d):
    """A mapping table of any size: the stream's rows meet the table as it is when their micro-batch starts."""
    known = s.read.parquet(f"{d}/events.parquet").select("event_type").where("event_type like '%i%'").distinct()
    return drain(s, replace_from_table(events(s, d), "event_type", known.select(F.col("event_type").alias("old"), F.upper("event_type").alias("new"))).select("event_id", "event_type"))
