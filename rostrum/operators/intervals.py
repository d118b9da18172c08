"""Joins on ranges, intervals and positions. Every one has an equi-key: the lecture, and buckets of the range where lectures are long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """left (lecture_id, ..., s, e) with every row of right (lecture_id, ..., start_ms, end_ms) that overlaps it, half-open.

    Both meet in buckets of time; a pair is kept in the bucket where its overlap begins, so it comes once. Buckets are ``width``
    wide, or as wide as a lecture's rows are long on average, so that rows come in few of them.
    """
    own, other = left.filter("e > s"), right.filter("end_ms > start_ms")
    means = [df.groupBy("lecture_id").agg(F.avg(size).alias(name)) for df, size, name in ((own, F.col("e") - F.col("s"), "__m"), (other, F.col("end_ms") - F.col("start_ms"), "__n"))]
    widths = means[0].join(means[1], "lecture_id").select("lecture_id", F.ceil(F.greatest(F.lit(float(width)), "__m", "__n")).alias("__w"))
    spans = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / F.col("__w")), F.floor((F.col(e) - 1) / F.col("__w"))))
    a = own.join(widths, "lecture_id").withColumn("b", spans("s", "e"))
    c = other.join(widths, "lecture_id").withColumn("b", spans("start_ms", "end_ms")).drop("__w")
    met = a.join(c, ["lecture_id", "b"]).filter((F.col("end_ms") > F.col("s")) & (F.col("start_ms") < F.col("e")))
    return met.filter(F.col("b") == F.floor(F.greatest("s", "start_ms") / F.col("__w"))).drop("b", "__w")


def playing(heads: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """The span [start_ms, end_ms) that holds each head's at_ms: precise ones first, then the latest start."""
    a = heads.withColumn("b", F.floor(F.col("at_ms") / width))
    c = spans.filter("end_ms > start_ms").withColumn("b", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width))))
    met = a.join(c, ["lecture_id", "b"]).filter((F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") < F.col("end_ms")))
    best = Window.partitionBy("lecture_id", "head").orderBy(F.col("precise").desc(), F.col("start_ms").desc(), "pos")
    return met.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "b")


def coarse_times(passages: DataFrame, segments: DataFrame) -> DataFrame:
    """Passages with the times of their first and last segment; null where a segment has none."""
    first = segments.select("lecture_id", F.col("id").alias("source_start"), "start_ms")
    last = segments.select("lecture_id", F.col("id").alias("source_end"), "end_ms")
    return passages.join(first, ["lecture_id", "source_start"], "left").join(last, ["lecture_id", "source_end"], "left")


def segment_texts(passages: DataFrame, segments: DataFrame, separator: str) -> DataFrame:
    """lecture_id, passage_id, text of the segments source_start to source_end, in order."""
    named = passages.select("lecture_id", "passage_id", F.explode(F.sequence("source_start", "source_end")).alias("id"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), separator)
    return named.join(segments, ["lecture_id", "id"]).groupBy("lecture_id", "passage_id").agg(joined.alias("text"))


def passages_of_slides(passages: DataFrame) -> DataFrame:
    """lecture_id, slide_position, passages in order, first_passage."""
    own = passages.groupBy("lecture_id", "slide_position")
    return own.agg(F.sort_array(F.collect_list("passage_id")).alias("passages"), F.min("passage_id").alias("first_passage"))


def evidence(*sets: DataFrame) -> DataFrame:
    """The distinct union of candidate sets (lecture_id, passage_id, slide_id)."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()


def on_old_edges(passages: DataFrame, old: DataFrame) -> DataFrame:
    """Whether each passage ends where a piece of an older partition (lecture_id, piece, text) of the same text does."""
    edge = lambda df, key: df.withColumn("edge", F.sum(F.char_length("text")).over(Window.partitionBy("lecture_id").orderBy(key)))
    known = edge(old, "piece").select("lecture_id", "edge", F.lit(True).alias("there")).distinct()
    joined = edge(passages, "passage_id").join(known, ["lecture_id", "edge"], "left")
    return joined.select("lecture_id", "passage_id", F.coalesce("there", F.lit(False)).alias("on_old_edge"))


def assembled(passages: DataFrame, importance: DataFrame, novelty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages with both scores, and the keys that one side lacks. The middle of slide_positions is the passage's slide."""
    key = ["lecture_id", "passage_id"]
    whole = passages.join(importance, key).join(novelty, key).withColumn("slide_position", F.element_at("slide_positions", F.expr("cast(size(slide_positions) div 2 + 1 AS int)")))
    gaps = None
    for name, side in (("importance", importance), ("novelty", novelty)):
        lost = passages.join(side, key, "left_anti").select(*key, F.lit(f"{name}_missing").alias("error"))
        extra = side.join(passages, key, "left_anti").select(*key, F.lit(f"{name}_unknown").alias("error"))
        gaps = lost.unionByName(extra) if gaps is None else gaps.unionByName(lost).unionByName(extra)
    return whole, gaps
