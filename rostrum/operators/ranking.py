"""Best-worst ranking: comparison plans, checks on choices, scores, percentiles, levels, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import places
from rostrum.session import checkpointed, free

#: Fixed values of the plan and the report.
GROUP, IMPORTANCE_BATCH, NOVELTY_BATCH = 4, 16, 8
MIN_IMPORTANCE, MIN_NOVELTY = 3, 2
_MASK = (1 << 64) - 1


def split_mix(seed: int) -> Iterator[int]:
    """The SplitMix64 sequence; 64-bit wrapping needs Python integers, as SQL's raise on overflow."""
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def shuffled(n: int, seed: int) -> list[int]:
    """0..n-1 by Fisher-Yates from the end, drawing from SplitMix64."""
    out, draw = list(range(n)), split_mix(seed)
    for end in range(n - 1, 0, -1):
        at = next(draw) % (end + 1)
        out[end], out[at] = out[at], out[end]
    return out


def comparisons(n: int, rounds: int, seed: int) -> list[list[int]]:
    """Groups of four (fewer if there are fewer) per round; the last of a round is filled from its start."""
    if n < 2:
        return []
    size, out = min(GROUP, n), []
    for k in range(rounds):
        order = shuffled(n, (seed + k) & _MASK)
        for i in range(0, n, size):
            group = order[i : i + size]
            out.append(group + [x for x in order if x not in group][: size - len(group)])
    return out


def plan(counts: DataFrame, rounds: int = 8, seed: int = 42) -> DataFrame:
    """lecture_id, comparison_id, slot, passage_id of every lecture in counts (lecture_id, n)."""
    if rounds < 2 or rounds % 2:
        raise ValueError("rounds must be even and at least 2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lecture, k, slot, passage) for lecture, n in batch.itertuples(index=False) for k, group in enumerate(comparisons(int(n), rounds, seed)) for slot, passage in enumerate(group)]
            yield pd.DataFrame(rows, columns=["lecture_id", "comparison_id", "slot", "passage_id"])

    return counts.select("lecture_id", "n").mapInPandas(run, "lecture_id long, comparison_id long, slot long, passage_id long")


def batches(members: DataFrame, size: int) -> DataFrame:
    return members.withColumn("batch", F.expr(f"comparison_id div {size}"))


def decision_errors(planned: DataFrame, decisions: DataFrame) -> DataFrame:
    """comparison_id, error: unknown, duplicate and missing comparisons, equal choices, and choices that weren't candidates."""
    wanted = planned.select("comparison_id").distinct().withColumn("planned", F.lit(1))
    got = decisions.groupBy("comparison_id").agg(F.count("*").alias("n"))
    joined = wanted.join(got, "comparison_id", "full_outer")
    cover = joined.select("comparison_id", F.when(F.col("planned").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").alias("error")).filter("error IS NOT NULL")
    same = decisions.filter("most = least").select("comparison_id", F.lit("same_choice").alias("error"))
    chosen = decisions.select("comparison_id", F.explode(F.array("most", "least")).alias("passage_id"))
    foreign = chosen.join(wanted.select("comparison_id"), "comparison_id", "left_semi").join(planned, ["comparison_id", "passage_id"], "left_anti").select("comparison_id", F.lit("not_a_candidate").alias("error")).distinct()
    return cover.unionByName(same).unionByName(foreign)


def resolve_label(label: Column, members: Column) -> Column:
    """The passage that a letter A, B, ... names in a group; null past the group's end."""
    return F.try_element_at(members, (F.ascii(label) - 64).cast("int"))


def pending(planned: DataFrame, completed: DataFrame, key: str = "batch") -> DataFrame:
    """What is planned and not yet completed."""
    return planned.join(completed.select(key), key, "left_anti")


def counts(members: DataFrame, decisions: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """key, passage_id, comparisons, most, least: one pass over memberships with their comparison's choices."""
    joined = members.join(decisions, [*key, "comparison_id"])
    return joined.groupBy(*key, "passage_id").agg(F.count("*").alias("comparisons"), F.count_if(F.col("most") == F.col("passage_id")).alias("most"), F.count_if(F.col("least") == F.col("passage_id")).alias("least"))


def best_worst(most: Column, least: Column, n: Column) -> Column:
    """(most - least) / comparisons, 0 without comparisons."""
    return F.when(n == 0, 0.0).otherwise((most - least) / n)


def percentile_points(score: Column, *partition: str) -> Column:
    """Average-rank percentile in basis points, in whole numbers; a single row is 5000."""
    r = F.rank().over(Window.partitionBy(*partition).orderBy(score))
    ties, n = F.count("*").over(Window.partitionBy(*partition, score)), F.count("*").over(Window.partitionBy(*partition))
    return F.when(n == 1, 5000).otherwise(F.floor(((2 * r + ties - 3) * 5000 + F.floor((n - 1) / 2)) / (n - 1))).cast("long")


def with_percentile_points(rows: DataFrame, score: str, name: str = "points") -> DataFrame:
    """Adds the percentile points of a score among all rows: ``percentile_points`` without a task that orders them all."""
    low, high, n = free(rows, "__low"), free(rows, "__high"), free(rows, "__n")
    held = checkpointed(rows)
    ranked = places.ranked(held, score, (low, high)).withColumn(n, F.lit(held.count()))
    points = F.floor(((F.col(low) + F.col(high) - 2) * 5000 + F.floor((F.col(n) - 1) / 2)) / (F.col(n) - 1))
    return ranked.withColumn(name, F.when(F.col(n) == 1, 5000).otherwise(points).cast("long")).drop(low, high, n)


def level(points: Column) -> Column:
    return F.least(F.floor(points / 2000) + 1, F.lit(5)).cast("long")


def average_rank(value: Column, *partition: str, base: int = 1) -> Column:
    """Fractional rank of ties, counted from ``base``."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) - 1 + base + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def real_percentile(rank: Column, *partition: str) -> Column:
    """A 0-based rank as a share of 100."""
    return rank * 100 / F.greatest(F.count("*").over(Window.partitionBy(*partition)) - 1, F.lit(1))


def score_errors(scores: DataFrame) -> DataFrame:
    """passage_id, error of comparative scores that contradict themselves."""
    error = (
        F.when(F.col("most") + F.col("least") > F.col("comparisons"), "too_many_choices")
        .when(~F.col("points").between(0, 10000), "percentile_out_of_range")
        .when(F.col("display_level") != level(F.col("points")), "level_mismatch")
    )
    return scores.select("passage_id", error.alias("error")).filter("error IS NOT NULL")


def oral_additions(passages: DataFrame) -> DataFrame:
    """Passages of importance 3 and novelty 2 at least, the most important first; ties in lecture order."""
    return passages.filter((F.col("importance") >= MIN_IMPORTANCE) & (F.col("novelty") >= MIN_NOVELTY)).orderBy(F.col("importance").desc(), F.col("novelty").desc(), "lecture_id", "passage_id")


def shown_percentile(percentile: Column, level: Column) -> Column:
    """The percentile, or what a level stands for."""
    return F.coalesce(percentile, F.greatest(F.lit(0.0), F.least((level - 1) * 20.0, F.lit(100.0))))


def above_threshold(passages: DataFrame, top_percent: float) -> DataFrame:
    """Passages in the top share by percentile; ties at the cutoff stay; none for a share of 0."""
    return passages.filter(F.lit(top_percent > 0) & (F.col("percentile") >= 100 - top_percent)).orderBy(F.col("percentile").desc(), "passage_id")


def tie_at_cutoff(passages: DataFrame, top_percent: float) -> DataFrame:
    """One row: how many are in, and whether the lowest of them shares its percentile with others."""
    kept = above_threshold(passages, top_percent)
    lowest = kept.agg(F.min("percentile").alias("lowest"), F.count("*").alias("kept"))
    return kept.join(F.broadcast(lowest), F.col("percentile") == F.col("lowest")).agg(F.max("kept").alias("kept"), F.max("lowest").alias("lowest"), (F.count("*") > 1).alias("tied"))


def emphasis(importance: Column, novelty: Column) -> Column:
    """important, novel, both or neither, from two flags."""
    return F.when(importance & novelty, "both").when(importance, "important").when(novelty, "novel").otherwise("neither")
