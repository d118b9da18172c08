"""Evaluation of rankings, alignments and segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import places
from rostrum.operators.ranking import average_rank
from rostrum.session import checkpointed


def _ranked_sides(pairs: DataFrame, descending: bool = False) -> DataFrame:
    """Both sides' first and last places over all rows, from counts of values by ranges: no task orders all rows."""
    held = checkpointed(pairs)
    for side in ("left", "right"):
        held = places.ranked(held, side, (f"__{side}_lo", f"__{side}_hi"), descending)
    return held


def spearman(pairs: DataFrame, *key: str, zero_variance_is_null: bool = True) -> DataFrame:
    """key, rho of (left, right): Pearson correlation of average ranks. Without variance null, or 0 if asked."""
    if key:
        ranked = pairs.withColumn("a", average_rank(F.col("left"), *key)).withColumn("b", average_rank(F.col("right"), *key))
    else:
        mean = lambda side: (F.col(f"__{side}_lo") + F.col(f"__{side}_hi")) / 2
        ranked = _ranked_sides(pairs).withColumn("a", mean("left")).withColumn("b", mean("right"))
    flat = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0)
    rho = F.when(flat, None if zero_variance_is_null else 0.0).otherwise(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")))
    return (ranked.groupBy(*key) if key else ranked.groupBy()).agg(F.count("*").alias("n"), rho.alias("rho"))


def ranking_comparison(pairs: DataFrame) -> DataFrame:
    """One row over items with two levels and two percentiles (basis points): agreement, flips, swaps, changes, overlap of top levels."""
    a, b = F.col("left_level"), F.col("right_level")
    flips = [F.count_if((a >= k) != (b >= k)).alias(f"flips_at_{k}") for k in range(2, 6)]
    change = F.abs(F.col("left_points") - F.col("right_points"))
    both, either = F.count_if((a >= 4) & (b >= 4)), F.count_if((a >= 4) | (b >= 4))
    (median,) = places.percentiles(pairs.select(change.alias("change")), "change", [0.5])
    return pairs.agg(
        F.count("*").alias("items"), F.count_if(a == b).alias("same_level"), F.count_if(F.abs(a - b) <= 1).alias("within_one"), *flips, F.count_if(((a == 1) & (b == 5)) | ((a == 5) & (b == 1))).alias("extreme_swaps"),
        F.when(either == 0, None).otherwise(both / either).alias("jaccard"), F.lit(median).cast("double").alias("median_change"), F.max(change).alias("max_change"),
    )


def fractional_top(value: Column, k: int, *partition: str) -> Column:
    """The weight of an item among the k highest: those tied at the edge share what is left."""
    above = F.rank().over(Window.partitionBy(*partition).orderBy(value.desc())) - 1
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - above) / ties))


def top_k_overlap(pairs: DataFrame, k: int, *key: str) -> DataFrame:
    """key, overlap of the k highest on both sides, with ties in part."""
    if key:
        weighed = pairs.withColumn("a", fractional_top(F.col("left"), k, *key)).withColumn("b", fractional_top(F.col("right"), k, *key))
    else:
        lo, hi = (lambda side: F.col(f"__{side}_lo")), (lambda side: F.col(f"__{side}_hi"))
        part = lambda side: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - (lo(side) - 1)) / (hi(side) - lo(side) + 1)))
        weighed = _ranked_sides(pairs, descending=True).withColumn("a", part("left")).withColumn("b", part("right"))
    return (weighed.groupBy(*key) if key else weighed.groupBy()).agg((F.sum(F.least("a", "b")) / k).alias("overlap"))


def position_bias(choices: DataFrame) -> DataFrame:
    """slot, share of most and of least choices. choices (slot, most, least) are one row per candidate."""
    total = Window.partitionBy()
    counted = choices.groupBy("slot").agg(F.count_if("most").alias("most"), F.count_if("least").alias("least"))
    return counted.select("slot", (F.col("most") / F.sum("most").over(total)).alias("most_share"), (F.col("least") / F.sum("least").over(total)).alias("least_share"))


def level_statistics(rows: DataFrame) -> DataFrame:
    """level, n and mean, median, least and largest value."""
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.min("value").alias("least"), F.max("value").alias("largest"))


def choice_agreement(choices: DataFrame) -> DataFrame:
    """left, right, n, same: how often two variants chose alike in a comparison. choices (variant, comparison_id, choice)."""
    right = choices.select(F.col("variant").alias("right"), "comparison_id", F.col("choice").alias("other"))
    met = choices.withColumnRenamed("variant", "left").join(right, "comparison_id").filter(F.col("left") < F.col("right"))
    return met.groupBy("left", "right").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col("other")).alias("same"))


def passage_statistics(passages: DataFrame, short: int = 40, long: int = 450) -> DataFrame:
    """n, median, least and largest length, short, long, and those that don't end a sentence."""
    n = F.char_length("text")
    (median,) = places.percentiles(passages.select(n.alias("n")), "n", [0.5])
    return passages.agg(F.count("*").alias("passages"), F.lit(median).cast("double").alias("median"), F.min(n).alias("least"), F.max(n).alias("largest"), F.count_if(n < short).alias("short"), F.count_if(n > long).alias("long"), F.count_if(~F.rtrim("text").rlike("[。！？!?.…]$")).alias("nonterminal"))


def alignment_agreement(windows: DataFrame) -> DataFrame:
    """One row over windows (rank, distance, frames, share, margin): hits, distances, weighted and stable hits, margins.

    The tenth percentile of margins is the sorted one at n div 10.
    """
    windows = checkpointed(windows)
    (median,), tenth = places.percentiles(windows, "margin", [0.5]), places.nth_of(windows, "margin", 1, 10)
    hit = lambda k: F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False)))
    stable = F.col("share") >= 0.8
    return windows.agg(
        F.count("*").alias("windows"), hit(1).alias("top1"), hit(3).alias("top3"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *[F.count_if(F.col("distance") <= d).alias(f"within_{d}") for d in (0, 1, 3)],
        (F.sum(F.when(F.col("rank") == 1, F.col("frames")).otherwise(0)) / F.sum("frames")).alias("frame_weighted"), F.count_if(stable).alias("stable"), F.count_if(stable & (F.col("rank") == 1)).alias("stable_top1"),
        F.lit(median).cast("double").alias("median_margin"), F.lit(tenth).cast("double").alias("p10_margin"),
    )


def transitions(path: DataFrame, far: int = 3) -> DataFrame:
    """lecture_id, backward and distant steps of a slide path."""
    step = F.col("slide_position") - F.lag("slide_position").over(Window.partitionBy("lecture_id").orderBy("query_id"))
    return path.withColumn("step", step).groupBy("lecture_id").agg(F.count_if(F.col("step") < 0).alias("backward"), F.count_if(F.abs(F.col("step")) > far).alias("distant"))


def mismatches(windows: DataFrame, limit: int) -> DataFrame:
    """The windows that disagree most clearly: a report of the top ``limit``."""
    return windows.filter("NOT agrees").orderBy(F.col("share").desc(), "window_index").limit(limit)


def ticks(n: Column, at: Column) -> Column:
    """Whether a place of n is marked on an axis of about ten marks, the last included."""
    return (at % F.ceil(n / 10) == 0) | (at == n - 1)


def systematic_sample(rows: DataFrame, stratum: str, order: list[str], size: int = 12) -> DataFrame:
    """Evenly spaced rows of each stratum, at round(i * (n - 1) / (size - 1)) with halves to even; a sampling operator."""
    own = Window.partitionBy(stratum)
    placed = rows.withColumn("__at", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(own))
    spots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (size - 1)).cast("int"))
    return placed.filter(F.array_contains(F.array_distinct(spots), F.col("__at"))).drop("__at", "__n")


def probe_summary(rows: DataFrame) -> DataFrame:
    """By mode, size and category: validity, label matches, median time, tokens."""
    return rows.groupBy("mode", "size", "category").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if("matches").alias("matches"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("median_ms"), F.sum("tokens").alias("tokens"))
