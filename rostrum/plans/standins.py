"""The relational tables that stand in for lectures, decks, logs and passages in checked queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.plans.registry import table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a lecture; its turns are untimed transcript segments."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lecture_id"), place.cast("long").alias("id"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "role", "text")


SEGMENTS = "seg AS (SELECT conv_id AS lecture_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS id, role, text FROM conversations)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are timed tokens: each lasts until the next."""
    # the window goes by the name that leaves, so that what is grouped by lecture later needs no other shuffle
    own = Window.partitionBy("lecture_id").orderBy("ts", "event_id")
    ms = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("lecture_id"), "ts", "event_type", "value", ms)
    at = F.floor(F.col("us") / 1000)
    return rows.select("lecture_id", (F.row_number().over(own) - 1).cast("long").alias("pos"), "event_id", "event_type", "value", at.alias("start_ms"), F.coalesce(F.lead(at).over(own), at + 1000).alias("end_ms"))


TIMED = """tok AS (SELECT user_id AS lecture_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, event_id, event_type, value, epoch_us(ts) // 1000 AS start_ms,
  coalesce(lead(epoch_us(ts) // 1000) OVER w, epoch_us(ts) // 1000 + 1000) AS end_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents are a deck."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select(F.col("source").alias("deck"), place.cast("long").alias("slide_id"), "doc_id", "text", "lang", "n_chars")


SLIDES = "sli AS (SELECT source AS deck, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS slide_id, doc_id, text, lang, n_chars FROM documents)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring turns are passages, with scores derived from their texts."""
    own = segments(spark, sf_dir).withColumn("passage_id", F.floor(F.col("id") / 2))
    grouped = own.groupBy("lecture_id", "passage_id").agg(
        F.min("id").alias("source_start"), F.max("id").alias("source_end"), F.sum(F.char_length("text")).alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return grouped.withColumn("importance", F.col("chars") % 6).withColumn("novelty", F.floor(F.col("chars") / 7) % 6).withColumn("slide_position", F.col("chars") % 12)


PASSAGES = f"""{SEGMENTS}, pas AS (SELECT lecture_id, id // 2 AS passage_id, min(id) AS source_start, max(id) AS source_end, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(text, '' ORDER BY id) AS text,
  CAST(sum(length(text)) % 6 AS BIGINT) AS importance, CAST((sum(length(text)) // 7) % 6 AS BIGINT) AS novelty, CAST(sum(length(text)) % 12 AS BIGINT) AS slide_position FROM seg GROUP BY lecture_id, id // 2)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are a model-exchange log: types are event kinds, users are workflows, keys in props are windows."""
    return trace_of(table(spark, sf_dir, "events"))


def trace_of(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TRACE_KINDS.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        F.col("event_id").alias("record_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), F.floor(F.col("event_id") / 3).alias("exchange_id"), F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string")).alias("workflow"),
        (k % 12).alias("window_index"), (k % 3).alias("repair_turn"), (k % 4).alias("provider_attempt"), (k % 5 == 0).alias("hedge"), kind[F.col("event_type")].alias("event"), F.when(k % 6 != 0, F.floor(F.col("value") * 10)).alias("input_tokens"),
        F.when(k % 7 != 0, F.floor(F.col("value") * 3)).alias("output_tokens"), F.when(k % 8 != 0, F.floor(F.col("value") * 4)).alias("cached_tokens"), F.floor(F.col("value") * 100).alias("latency_ms"), F.when(F.col("event_type") == "error", F.concat(F.lit("c"), (k % 4).cast("string"))).alias("category"),
    )


#: The categories that stand for rate limits.
LIMITS = ("c0",)

TRACE_KINDS = {"view": "request", "click": "attempt", "purchase": "completion", "signup": "validation", "error": "failure"}

TRACE = """tra AS (SELECT event_id AS record_id, epoch_us(ts) // 1000 AS at_ms, event_id // 3 AS exchange_id, 'w' || (user_id % 7) AS workflow, k % 12 AS window_index, k % 3 AS repair_turn, k % 4 AS provider_attempt, k % 5 = 0 AS hedge,
  CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'attempt' WHEN 'purchase' THEN 'completion' WHEN 'signup' THEN 'validation' ELSE 'failure' END AS event,
  CASE WHEN k % 6 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens, CASE WHEN k % 7 <> 0 THEN CAST(floor(value * 3) AS BIGINT) END AS output_tokens, CASE WHEN k % 8 <> 0 THEN CAST(floor(value * 4) AS BIGINT) END AS cached_tokens,
  CAST(floor(value * 100) AS BIGINT) AS latency_ms, CASE WHEN event_type = 'error' THEN 'c' || (k % 4) END AS category FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


#: Width and height of the pictures that stand for pages and frames.
PICTURE = (24, 20)


def _picture(texts: pd.Series) -> pd.Series:
    size = PICTURE[0] * PICTURE[1]

    def folded(text: str | None) -> bytes:
        body = np.frombuffer((text or "").encode(), np.uint8)
        rows = np.pad(body, (0, -len(body) % size or (0 if len(body) else size))).reshape(-1, size)
        return (rows.sum(0, dtype=np.int64) % 256).astype(np.uint8).tobytes()

    return texts.map(folded)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures: the bytes of the whole text, folded by adding. Sixty-four neighbouring ones are a deck."""
    draw = F.pandas_udf(_picture, "binary")
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 64).alias("lecture_id"), (F.col("doc_id") % 64).alias("slide_id"), draw("text").alias("pixels"))


def brighter_below(pixels: pd.Series) -> pd.Series:
    """Pictures whose lower half is nine steps brighter, as far as that goes."""

    def lit(body: bytes) -> bytes:
        own = np.frombuffer(body, np.uint8).astype(int)
        own[len(own) // 2 :] += 9
        return np.minimum(own, 255).astype(np.uint8).tobytes()

    return pixels.map(lit)
