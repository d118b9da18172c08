"""The JSON-lines source: ranges, tails of growing and cut files, appends with torn tails, failing tasks and rival writers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rostrum.sources import artifacts, lines
from rostrum.streaming import logs


@pytest.fixture
def log(tmp_path):
    return tmp_path / "log"


def record(k, event="request", **more):
    return json.dumps({"record_id": k, "event": event, "exchange_id": k, "workflow": "w", **more}) + "\n"


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_give_every_whole_line_once(log, split):
    rng = random.Random(split)
    log.mkdir()
    want = []
    for name in ("a", "b", "c"):
        own = ["x" * rng.choice([0, 1, 5, 63, 64, 300]) + rng.choice(["", "é", "\r"]) for _ in range(25)]
        body = "".join(line + "\n" for line in own).encode()
        (log / f"{name}.jsonl").write_bytes(body + b"half a line")
        at = 0
        for k, line in enumerate(own, 1):
            want.append((f"{name}.jsonl", at, k, line.removesuffix("\r")))
            at += len(line.encode()) + 1
    (log / "empty.jsonl").touch()
    (log / "_hidden").write_text("no\n")
    reader = lines.Reader({"path": str(log), "split_bytes": str(split)})
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["file"].rpartition("/")[2], r["at"], r["value"]) for r in got] == [(f, at, v) for f, at, _, v in want]


def test_no_log_is_an_empty_one(spark, log):
    spark.dataSource.register(lines.JsonLines)
    assert spark.read.format("json_lines").load(str(log)).count() == 0
    assert artifacts.append_trace(rows_of(spark, [4]), str(log)) == 1


def test_numbers_of_bad_lines_are_true_in_small_ranges(spark, log):
    log.mkdir()
    (log / "t.jsonl").write_text("".join("{broken\n" if k % 50 == 7 else record(k, category="c" * 20) for k in range(200)))
    assert (log / "t.jsonl").stat().st_size > 10 * 1024
    _, bad = artifacts.parse_trace(artifacts.numbered_lines(spark, str(log), split_bytes=1024))
    assert sorted(r.line for r in bad.collect()) == [8, 58, 108, 158]


class Following:
    """A tail whose triggers are run one by one, each as a query of its own that goes on from the checkpoint."""

    def __init__(self, spark, log, folder, **options):
        self.spark, self.log, self.folder, self.options = spark, log, folder, options

    def trigger(self):
        out = f"{self.folder}/rows"
        stream = logs.tail(self.spark, str(self.log), split_bytes=100, **self.options)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.record_id for r in self.spark.read.schema(stream.schema).parquet(out).collect())


def test_tail_of_a_log_that_grows_inside_a_line_is_cut_and_restarts(spark, log, tmp_path):
    tail = Following(spark, log, tmp_path / "s")
    assert tail.trigger() == []
    log.mkdir()
    path, second = log / "a.jsonl", record(2)
    path.write_text(record(0) + record(1) + second[:9])
    assert tail.trigger() == [0, 1]
    assert tail.trigger() == [0, 1], "nothing is repeated"
    path.write_text(record(0) + record(1) + second + "\n" + "not a record\n" + record(3) + '{"record')
    assert tail.trigger() == [0, 1, 2, 3]
    (log / "b.jsonl").write_text(record(10))
    assert tail.trigger() == [0, 1, 2, 3, 10]
    path.write_text(record(20))
    assert tail.trigger() == [0, 1, 2, 3, 10, 20], "a shorter file is read from its start"
    path.write_text("")
    assert tail.trigger() == [0, 1, 2, 3, 10, 20]
    path.write_text(record(30) + record(31) * 4)
    assert tail.trigger() == [0, 1, 2, 3, 10, 20, 30, 31, 31, 31, 31]
    path.write_text(record(40) + record(41) * 9)
    assert tail.trigger()[-10:] == [40] + [41] * 9, "a longer file with another first line is a new one"
    path.unlink()
    assert len(tail.trigger()) == 21


def test_running_usage_over_a_growing_log_equals_the_batch(spark, log, tmp_path):
    log.mkdir()
    rows = [record(k, "completion", input_tokens=k, output_tokens=None if k % 3 else k, cached_tokens=0) for k in range(30)]
    body, state = "".join(rows), f"{tmp_path}/state"
    for cut in (0, 500, 777, len(body)):
        (log / "a.jsonl").write_text(body[:cut])
        usage = logs.running_usage(logs.tail(spark, str(log)), "workflow")
        usage.writeStream.format("memory").queryName(f"u{cut}").outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.table(f"u{cut}").collect()]
        whole = body[: body[:cut].rfind("\n") + 1].splitlines()
        batch = logs.running_usage(spark.read.schema(artifacts.TRACE).json(spark.sparkContext.parallelize(whole, 1)), "workflow") if whole else None
        assert got == ([tuple(r) for r in batch.collect()] if whole else [])


def test_range_that_is_gone_fails_unless_told_otherwise(log):
    log.mkdir()
    path = log / "a.jsonl"
    path.write_text(record(0) * 3)
    tail = lines.Tail({"path": str(log)})
    planned = tail.partitions(tail.initialOffset(), tail.latestOffset())
    path.write_text(record(0))
    with pytest.raises(lines.LogError, match="no longer holds"):
        list(tail.read(planned[0]))
    lossy = lines.Tail({"path": str(log), "fail_on_data_loss": "false"})
    assert list(lossy.read(lossy.partitions({}, tail.latestOffset())[0]))[0].num_rows == 1


def rows_of(spark, times):
    return spark.createDataFrame([(t, k, "request") for k, t in enumerate(times)], "at_ms long, exchange_id long, event string").repartition(3)


def test_torn_tails_are_cut_or_completed(spark, log):
    log.mkdir()
    (log / "a.jsonl").write_text(record(0) + record(5) + record(6)[:-7])
    (log / "b.jsonl").write_text(record(3) + record(4)[:-1])
    (log / "c.jsonl").write_text('{"rec')
    assert artifacts.append_trace(rows_of(spark, [9, 8]), str(log)) == 2
    got = artifacts.read_trace(spark, str(log)).orderBy("record_id").collect()
    assert [r.record_id for r in got] == [0, 3, 4, 5, 6, 7]
    assert [(r.at_ms, r.exchange_id) for r in got[-2:]] == [(8, 1), (9, 0)]
    assert (log / "a.jsonl").read_text() == record(0) + record(5) and (log / "c.jsonl").read_text() == ""


def test_bad_line_with_an_end_stops_an_append(spark, log):
    log.mkdir()
    (log / "a.jsonl").write_text(record(0) + "{broken\n" + record(1))
    with pytest.raises(lines.LogError, match="line 2"):
        artifacts.append_trace(rows_of(spark, [1]), str(log))
    assert [p.name for p in log.iterdir() if p.suffix == ".jsonl"] == ["a.jsonl"]


def test_aborted_task_leaves_nothing_and_a_retry_numbers_on(spark, log):
    artifacts.append_trace(rows_of(spark, [1, 2]), str(log))
    failing = rows_of(spark, range(40)).withColumn("workflow", F.when(F.col("exchange_id") == 33, F.raise_error(F.lit("lost"))).otherwise("w"))
    with pytest.raises(Exception, match="lost"):
        spark.dataSource.register(lines.JsonLines)
        failing.select(F.to_json(F.struct("*")).alias("value")).write.format("json_lines").mode("append").save(str(log))
    assert not list((log / "_staged").iterdir())
    assert artifacts.read_trace(spark, str(log)).count() == 2
    artifacts.append_trace(rows_of(spark, range(40)), str(log))
    assert sorted(r.record_id for r in artifacts.read_trace(spark, str(log)).collect()) == list(range(42))


def test_second_writer_of_the_same_number_fails(spark, log):
    spark.dataSource.register(lines.JsonLines)
    number = lines.prepared(str(log))
    one, two = (spark.createDataFrame([(record(k)[:-1],)], "value string") for k in (0, 1))
    one.write.format("json_lines").option("expected", number).mode("append").save(str(log))
    with pytest.raises(Exception, match="another writer"):
        two.write.format("json_lines").option("expected", number).mode("append").save(str(log))
    assert [r.record_id for r in artifacts.read_trace(spark, str(log)).collect()] == [0]
    with pytest.raises(Exception, match="appended to"):
        two.write.format("json_lines").mode("overwrite").save(str(log))


def test_commit_that_a_lost_driver_left_undone_is_finished(spark, log):
    lines.prepared(str(log))
    (log / "_staged").mkdir()
    (log / "_staged" / "j-1.jsonl").write_text(record(0))
    (log / "_staged" / "j-2.jsonl").write_text(record(99))
    (log / "_commits" / "0000000000.json").write_text(json.dumps({"files": ["j-1.jsonl"], "rows": 1}))
    artifacts.append_trace(rows_of(spark, [5]), str(log))
    assert sorted(r.record_id for r in artifacts.read_trace(spark, str(log)).collect()) == [0, 1]


def test_many_ranges_become_wider(tmp_path):
    """A long log has no more tasks for being read in narrow ranges, and the same lines."""
    log = tmp_path / "log.jsonl"
    log.write_text("".join(f"{k}\n" for k in range(20_000)))
    reader, tail = lines.Reader({"path": str(log), "split_bytes": "50"}), lines.Tail({"path": str(log), "split_bytes": "50"})
    for parts in (reader.partitions(), tail.partitions({}, tail.latestOffset())):
        assert 64 < len(parts) <= lines.RANGES
        assert [v for part in parts for batch in reader.read(part) for v in batch.column(3).to_pylist()] == [str(k) for k in range(20_000)]
    assert len(lines.Reader({"path": str(log), "split_bytes": "5000"}).partitions()) > 20
