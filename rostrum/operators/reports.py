"""The tables behind reports: passage views, review lists, heat maps, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import BLANK, clock, is_blank, trimmed
from rostrum.operators.intervals import coarse_times, segment_texts


def passage_view(passages: DataFrame, segments: DataFrame, playback: DataFrame) -> DataFrame:
    """Passages with times to play them at: those found by playback, else those of their segments; labels null without times."""
    timed = coarse_times(passages.drop("start_ms", "end_ms"), segments.select("lecture_id", "id", "start_ms", "end_ms"))
    found = playback.select("lecture_id", "passage_id", F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"), "basis")
    both = timed.join(found, ["lecture_id", "passage_id"], "left")
    start, end = F.coalesce("p_start", "start_ms"), F.coalesce("p_end", "end_ms")
    return both.select("lecture_id", "passage_id", start.alias("start_ms"), end.alias("end_ms"), F.coalesce("basis", F.lit("segments")).alias("basis"), clock(start).alias("start_label"), clock(end).alias("end_label"))


def titled(passages: DataFrame, segments: DataFrame) -> DataFrame:
    """Passages with a title: the summary if it isn't blank, else the text of their segments."""
    texts = segment_texts(passages, segments, " ")
    return passages.join(texts.withColumnRenamed("text", "source_text"), ["lecture_id", "passage_id"]).withColumn("title", F.when(F.col("summary").isNull() | is_blank(F.col("summary")), F.col("source_text")).otherwise(F.col("summary")))


def heat_map(scores: DataFrame) -> DataFrame:
    """One cell per query and slide with its strength in percent, halves away from zero."""
    own = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    strength = F.when(hi == lo, 0.0).otherwise((F.col("score") - lo) / (hi - lo))
    return scores.select("query_id", "slide_id", F.round(strength * 100).cast("long").alias("percent"))


def markdown(passages: DataFrame) -> DataFrame:
    """lecture_id, value: a lecture's passages as one Markdown text, by percentile then place."""
    order = F.struct((-F.col("percentile")).alias("o"), F.col("passage_id").alias("p"), F.concat(F.lit("## "), F.col("passage_id").cast("string"), F.lit("\n\n"), trimmed(F.col("text"))).alias("t"))
    return passages.groupBy("lecture_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), "\n\n").alias("value"))


def ranked_titles(passages: DataFrame) -> DataFrame:
    """A newest-first or best-first list needs an explicit order; this one is by created_ms, newest first."""
    minute = F.coalesce(F.floor(F.col("created_ms") / 60_000), F.lit(-(1 << 60)))
    return numbered(passages, [(-minute).alias("__minute")], F.col("created_ms").desc(), "item")


def numbered(rows: DataFrame, groups: list, *order) -> DataFrame:
    """Adds place, from 1, in the order of groups (named columns), then of ``order`` within one.

    Only the sizes of groups are ordered in one task, so groups should be few beside the rows, and none of them most of the rows.
    """
    known = rows.columns
    rows = rows.select("*", *groups)
    names = [c for c in rows.columns if c not in known]
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*names).agg(F.count("*").alias("__n")).select(*names, before.alias("__before"))
    own = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return own.join(sizes, names).withColumn("place", F.col("__before") + F.col("__place")).select(*known, "place")


def without_blank_lines(text):
    return F.regexp_replace(text, f"\n{BLANK}*\n+", "\n")
