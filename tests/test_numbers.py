"""Numbers at their limits, midpoints, half-up quotients, and whole files against a plain digest."""

import hashlib

from pyspark.sql import functions as F

from rostrum.functions import numbers, text
from rostrum.sources import artifacts

MOST = (1 << 63) - 1


def test_numbers_stop_at_their_limits(spark):
    pairs = [(0, 0), (1, 2), (MOST, 0), (MOST, 1), (MOST, MOST), (3, 5), (None, 1), (1, None)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select(numbers.saturating_add(a, b), numbers.saturating_sub(a, b), numbers.checked_add(a, b)).collect()
    want = [(min(x + y, MOST), max(x - y, 0), x + y if x + y <= MOST else None) if x is not None and y is not None else (None, None, None) for x, y in pairs]
    assert list(map(tuple, got)) == want
    assert df.agg(numbers.saturating_sum(a)).first()[0] == MOST and df.filter("a < 9").agg(numbers.saturating_sum(a)).first()[0] == 5
    assert df.limit(0).agg(numbers.saturating_sum(a)).first()[0] is None


def test_midpoints_and_half_up_quotients(spark):
    rows = [(a, b) for a in range(12) for b in range(1, 6)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", text.half_up_div(F.col("a"), F.col("b")).alias("d"), text.half_up_div(F.col("a"), 4).alias("q"), text.midpoint(F.col("a"), F.col("b")).alias("m")).collect()
    assert all((r.d, r.q, r.m) == ((r.a + r.b // 2) // r.b, (r.a + 2) // 4, (r.a + r.b + 1) // 2) for r in got)


def test_texts_with_a_letter_or_digit(spark):
    texts = ["", " .,", "a", "é", "中", "٣", "_", "—x—", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.has_alphanumeric(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else any(c.isalnum() for c in t) for t in texts]


def test_whole_files_are_hashed(spark, tmp_path):
    bodies = {"a.json": b'{"x": 1}', "b.json": "é\n\n".encode() * 5_000, "c.json": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rpartition("/")[2]: (r.text, r.sha256) for r in artifacts.hashed_files(spark, str(tmp_path)).collect()}
    assert got == {k: (b.decode(), hashlib.sha256(b).hexdigest()) for k, b in bodies.items() if b}


def test_texts_of_a_batch_are_not_all_held():
    """A kernel over a batch makes strings of a few texts at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["Ａé b" * 2_500, None] * 1_000)
    for udf in (text.comparable, text.alphanumeric, text.nfkc):
        tracemalloc.start()
        found = udf.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8e6 and len(found) == 2_000 and found.null_count == 1_000
    assert text.comparable.func(texts)[0].as_py() == "aéb" * 2_500
