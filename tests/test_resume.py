"""Resuming from stored slots, and artifacts that are replaced whole."""

import pytest
from pyspark.sql import functions as F

from rostrum.operators import resume
from rostrum.sources import artifacts


def slots(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "slot long")


def test_only_missing_slots_are_computed(spark, tmp_path):
    seen = []

    def work(rows):
        seen.append(sorted(r.slot for r in rows.collect()))
        return rows.withColumn("out", F.col("slot") * 2)

    resume.resumed(slots(spark, 1, 2), work, str(tmp_path), {"a": 1})
    got = resume.resumed(slots(spark, 1, 2, 3, 4), work, str(tmp_path), {"a": 1})
    assert seen == [[1, 2], [3, 4]]
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 4), (3, 6), (4, 8)]
    resume.resumed(slots(spark, 1), work, str(tmp_path), {"a": 2})
    assert seen[2] == [1], "another manifest starts anew"


def test_rounds_keep_what_was_written(spark, tmp_path):
    calls = []

    def breaks(rows):
        calls.append(rows)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return rows

    plan = slots(spark, *range(40))
    with pytest.raises(RuntimeError):
        resume.resumed(plan, breaks, str(tmp_path), {}, rounds=4)
    kept = spark.read.parquet(f"{tmp_path}/{resume.identity({})}").count()
    assert 0 < kept < 40
    assert resume.resumed(plan, lambda rows: rows, str(tmp_path), {}, rounds=4).count() == 40


def test_stored_slots_are_checked(spark, tmp_path):
    same = lambda rows: rows.withColumn("out", F.col("slot"))
    resume.resumed(slots(spark, 1, 2, 2), same, str(tmp_path), {"a": 1})
    stored = spark.read.parquet(f"{tmp_path}/{resume.identity({'a': 1})}")
    found = resume.slot_errors(slots(spark, 2), stored, invalid=F.col("out") == 1)
    assert sorted(map(tuple, found.collect())) == [(1, "invalid_result"), (1, "unknown_slot"), (2, "repeated_slot")]
    with pytest.raises(resume.ResumeError, match="unknown_slot"):
        resume.resumed(slots(spark, 2), same, str(tmp_path), {"a": 1})


def test_identity_is_of_the_content():
    assert resume.identity({"a": 1, "b": 2}) == resume.identity({"b": 2, "a": 1}) != resume.identity({"a": 1, "b": 3})


def test_artifacts_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/a"
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_artifact(spark, path, ("x",))
    artifacts.write_artifact({"x": slots(spark, 1), "y": slots(spark, 2)}, path)
    broken = slots(spark, 5).withColumn("slot", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        artifacts.write_artifact({"x": slots(spark, 7), "y": broken}, path)
    got = artifacts.read_artifact(spark, path, ("x", "y"))
    assert [got[k].first().slot for k in ("x", "y")] == [1, 2], "a write that fails changes nothing"
    artifacts.write_artifact({"x": slots(spark, 8), "y": slots(spark, 9)}, path)
    assert artifacts.read_artifact(spark, path, ("x",))["x"].first().slot == 8
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_artifact(spark, path, ("x", "z"))


def test_appended_numbers_follow_time_across_minutes(spark, tmp_path):
    times = [130_000, 5, 61_000, None, 59_999, 130_000, 5]
    rows = spark.createDataFrame([(t, k, "request") for k, t in enumerate(times)], "at_ms long, exchange_id long, event string").repartition(3)
    for _ in range(2):
        artifacts.append_trace(rows, f"{tmp_path}/t")
    got = [(r.at_ms, r.exchange_id) for r in artifacts.read_trace(spark, f"{tmp_path}/t").orderBy("record_id").collect()]
    want = sorted(((t, k) for k, t in enumerate(times)), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    assert got == want * 2
    assert [r.record_id for r in artifacts.read_trace(spark, f"{tmp_path}/t").orderBy("record_id").collect()] == list(range(14))
