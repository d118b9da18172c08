"""Aligning passages with slides: score normalisation, the slide path, matches with their runner-up, frame lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The transition penalty. Near steps cost by distance; far ones a jump and a little more by distance.
NEAR, NEAR_STEP, JUMP, FAR_STEP = 3, 0.05, 0.5, 0.02


def emissions(scores: DataFrame) -> DataFrame:
    """Min-max normalised scores of each query; all equal scores are 0."""
    own = Window.partitionBy("lecture_id", "query_id")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return scores.withColumn("emission", F.when(hi == lo, 0.0).otherwise((F.col("score") - lo) / (hi - lo)))


def penalties(n: int) -> np.ndarray:
    far = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
    return np.where(far <= NEAR, far * NEAR_STEP, JUMP + (far - NEAR - 1) * FAR_STEP)


def best_path(grid: np.ndarray) -> np.ndarray:
    """Slides of the best path through emissions (passages, slides), from slide 0; ties keep the larger slide."""
    steps, n = grid.shape
    cost, back = penalties(n), np.zeros((steps, n), np.int64)
    total = np.full(n, -np.inf)
    total[0] = grid[0, 0]
    for t in range(1, steps):
        reach = total[:, None] - cost
        back[t] = n - 1 - np.argmax(reach[::-1], axis=0)
        total = reach[back[t], np.arange(n)] + grid[t]
    path = np.zeros(steps, np.int64)
    path[-1] = n - 1 - np.argmax(total[::-1])
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def slide_path(scores: DataFrame) -> DataFrame:
    """lecture_id, query_id, slide_position. scores (lecture_id, query_id, slide_id, score) must be whole rows of slides 0..n-1."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        grid = own.pivot(index="query_id", columns="slide_id", values="emission").sort_index()
        if grid.isna().any().any() or list(grid.columns) != list(range(grid.shape[1])) or not np.isfinite(grid.to_numpy()).all():
            raise ValueError(f"scores of lecture {own.lecture_id.iloc[0]} aren't one finite score for each slide")
        return pd.DataFrame({"lecture_id": own.lecture_id.iloc[0], "query_id": grid.index, "slide_position": best_path(grid.to_numpy())})

    kind = scores.schema["lecture_id"].dataType.simpleString()
    return emissions(scores).select("lecture_id", "query_id", "slide_id", "emission").groupBy("lecture_id").applyInPandas(run, f"lecture_id {kind}, query_id long, slide_position long")


def best_and_runner_up(scores: DataFrame) -> DataFrame:
    """query_id, best, best_score, second, second_score; null without a second. Ties go to the lower slide."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "slide_id")
    two = scores.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return two.groupBy("query_id").agg(pick(1, "slide_id").alias("best"), pick(1, "score").alias("best_score"), pick(2, "slide_id").alias("second"), pick(2, "score").alias("second_score"))


def frames_in(intervals: DataFrame, frames: DataFrame, period_ms: int, bucket_ms: int = 60_000) -> DataFrame:
    """Frames of each interval, both ends included; without any, the nearest to its middle within one period.

    intervals (lecture_id, item, start_ms, end_ms), frames (lecture_id, at_ms, ...). Both sides meet on
    buckets of time, so the join is an equi-join. Ties of distance go to the earlier frame.
    """
    placed = frames.withColumn("bucket", F.floor(F.col("at_ms") / bucket_ms))
    span = F.sequence(F.floor((F.col("start_ms") - period_ms) / bucket_ms), F.floor((F.col("end_ms") + period_ms) / bucket_ms))
    near = intervals.withColumn("bucket", F.explode(span)).join(placed, ["lecture_id", "bucket"]).drop("bucket")
    inside = F.col("at_ms").between(F.col("start_ms"), F.col("end_ms"))
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    far = F.abs(F.col("at_ms") - middle)
    near = near.withColumn("inside", inside).withColumn("far", far).filter(F.col("inside") | (F.col("far") <= period_ms))
    own = Window.partitionBy("lecture_id", "item")
    near = near.withColumn("any", F.max("inside").over(own)).withColumn("n", F.row_number().over(own.orderBy("far", "at_ms")))
    return near.filter(F.col("inside") | (~F.col("any") & (F.col("n") == 1))).drop("any", "n", "far")


def majority(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """key, label, n, share of the most frequent label; ties go to the lower one."""
    counted = rows.groupBy(*key, label).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*key)
    counted = counted.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.col("n").desc(), label)))
    return counted.filter("place = 1").drop("place")
