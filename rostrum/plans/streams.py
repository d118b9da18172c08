"""Checked queries over streams: each replays the events table as a stream, and must give what SQL gives over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.plans.analytics import USAGE_SQL
from rostrum.plans.registry import checkpoint_folder, query, table
from rostrum.plans.sources import written_log
from rostrum.plans.standins import LIMITS, TRACE, trace, trace_of
from rostrum.streaming import logs as L


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of trace() as a stream over the events table. Streams read folders or patterns, so the table's path is a pattern."""
    return trace_of(L.parquet_tail(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema))


def run(stream: DataFrame, mode: str) -> DataFrame:
    return L.to_completion(stream, f"s{uuid.uuid4().hex}", mode, checkpoint_folder(stream.sparkSession))


@query("stream_token_usage", f"WITH {USAGE_SQL} SELECT * FROM usa")
def stream_token_usage(spark, sf_dir):
    return run(L.running_usage(replay(spark, sf_dir), "workflow"), "complete")


@query("tailed_token_usage", f"WITH {USAGE_SQL} SELECT * FROM usa")
def tailed_token_usage(spark, sf_dir):
    """Usage of the log as JSON lines, tailed by byte offsets."""
    records = trace(spark, sf_dir)
    path = written_log(records.select(F.to_json(F.struct(*records.columns)).alias("value")))
    return run(L.running_usage(L.tail(spark, path, split_bytes=100_000), "workflow"), "complete")


@query("stream_active_requests", f"WITH {TRACE} SELECT workflow, count(DISTINCT exchange_id) FILTER (event = 'request' AND NOT done) AS active FROM (SELECT *, bool_or(event IN ('completion', 'failure')) OVER (PARTITION BY workflow, exchange_id) AS done FROM tra WHERE event IN ('request', 'completion', 'failure')) GROUP BY 1")
def stream_active_requests(spark, sf_dir):
    return run(L.active_requests(replay(spark, sf_dir)), "update")


#: Secrets that overlap one another and span two or three chunks.
SECRETS = ["kview", "viewclick", "clickview", "nuppurchase", "errorviewview"]


@query("stream_redacted_chunks", "SELECT user_id AS stream, regexp_replace(string_agg(event_type, '' ORDER BY event_id), 'errorviewview|nuppurchase|viewclick|clickview|kview', '<REDACTED>', 'g') AS text FROM events GROUP BY 1")
def stream_redacted_chunks(spark, sf_dir):
    """A user's events as chunks of one text, as a stream; the last of each user is known from the table."""
    events = table(spark, sf_dir, "events")
    chunks = L.parquet_tail(spark, f"{sf_dir}/events.parque[t]", events.schema).select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"))
    ends = events.groupBy(F.col("user_id").alias("stream")).agg(F.max("event_id").alias("end"))
    out = run(L.redacted(chunks.join(ends, "stream").withColumn("last", F.col("pos") == F.col("end")), SECRETS), "append")
    return out.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


@query("stream_admission")
def stream_admission(spark, sf_dir):
    """Equals adaptive_admission row by row; a test compares them."""
    return run(L.admission(replay(spark, sf_dir), limits=LIMITS), "append")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return L.event_windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM n GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return L.event_sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
