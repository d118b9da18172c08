"""Places, ranks and percentiles against sorted lists, with nulls, ties and empty tables."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.operators import evaluation, places, ranking


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return [(k, rng.choice([None, 1.5, 2.0, 2.0, 7.25]) if k % 3 else rng.random()) for k in range(500)] + [(3, 2.0)] * 200


def frame(spark, values):
    return spark.createDataFrame([(k, v, "x", "y") for k, v in values], "id long, value double, __at string, __row string").repartition(5)


def test_places_are_those_of_a_sorted_list(spark, values):
    got = places.placed(frame(spark, values), [F.col("value").desc_nulls_last(), "id"]).collect()
    assert sorted(r.place for r in got) == list(range(1, len(values) + 1))
    assert [(r.id, r.value) for r in sorted(got, key=lambda r: r.place)] == sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert places.placed(frame(spark, []), ["value"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_ties(spark, values, descending):
    got = places.ranked(frame(spark, values), "value", descending=descending).collect()
    order = sorted((v for _, v in values), key=(lambda v: (v is None, -(v or 0))) if descending else (lambda v: (v is not None, v or 0)))
    for r in got:
        assert r.lowest == order.index(r.value) + 1 and r.highest == len(order) - order[::-1].index(r.value)
    assert Counter((r.id, r.value) for r in got) == Counter(values)


def test_percentiles_are_exact(spark, values):
    got = places.percentiles(frame(spark, values), "value", [0.0, 0.1, 0.5, 0.9, 1.0])
    held = sorted(v for _, v in values if v is not None)
    cuts = statistics.quantiles(held, n=10, method="inclusive")
    assert got == pytest.approx([held[0], cuts[0], cuts[4], cuts[8], held[-1]])
    assert places.percentiles(frame(spark, []), "value", [0.5]) == [None]


def test_running_sums(spark):
    rows = [(k, k % 7) for k in range(300)]
    got = places.running(spark.createDataFrame(rows, "id long, n long").repartition(4), ["id"], "n", "upto").collect()
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = total
    assert {r.id: r.upto for r in got} == want


def test_ranks_without_a_key_are_those_of_one_group(spark, values):
    pairs = frame(spark, values).select("id", F.col("value").alias("left"), ((F.col("id") * 7) % 5).cast("double").alias("right")).filter("left IS NOT NULL")
    keyed = pairs.withColumn("k", F.lit(1))
    assert evaluation.spearman(pairs).first().rho == pytest.approx(evaluation.spearman(keyed, "k").first().rho)
    for k in (1, 100, 650):
        assert evaluation.top_k_overlap(pairs, k).first().overlap == pytest.approx(evaluation.top_k_overlap(keyed, k, "k").first().overlap)
    window = pairs.withColumn("points", ranking.percentile_points(F.col("left")))
    assert Counter(map(tuple, ranking.with_percentile_points(pairs, "left").select(*window.columns).collect())) == Counter(map(tuple, window.collect()))
    assert ranking.with_percentile_points(pairs.limit(1), "left").first().points == 5000
    assert evaluation.spearman(pairs.limit(0)).first().n == 0 and ranking.with_percentile_points(pairs.limit(0), "left").count() == 0


def test_nth_value_counts_nulls_first(spark, values):
    order = sorted((v for _, v in values), key=lambda v: (v is not None, v or 0))
    for part in range(10):
        assert places.nth_of(frame(spark, values), "value", part, 10) == order[len(order) * part // 10]
    assert places.nth_of(frame(spark, []), "value", 1, 2) is None
