"""Queries that drive a stream to its end over the events (extensions; the reference has no streams)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.plans.registry import query
from claimweave.sources.log import read_log
from claimweave.streaming.events import windowed


@query("select time_bucket(interval 6 hours, ts) as start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's complete result equals the batch's, as the one file comes in one batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windows_{uuid.uuid4().hex}"
    q = windowed(rows).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select event_id as seq, event_type as kind, cast(json_extract_string(props, '$.k') as bigint) as k, event_id % 500 = 0 as corrupt from (select event_id, case when event_id % 500 = 0 then null else event_type end as event_type, case when event_id % 500 = 0 then null else props end as props from events)")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with their numbers; every five-hundredth is cut short and is reported, not dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    lines = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 500 == 0, F.substring(line, 1, 9)).otherwise(line).alias("line"))
    return read_log(lines, "kind string, k long").select("seq", "kind", "k", "corrupt")
