"""Alignment in linear space and what stands on it, against plain tables and walks token by token."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from rostrum.operators import projection
from rostrum.plans.catalog import QUERIES

SMOKE = "/root/testdata/sf0.001"


def table_matches(old, new):
    """Followed from the end over the whole table of common lengths: skip a character of new where that loses nothing, else one of old."""
    common = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for x in range(1, len(old) + 1):
        for y in range(1, len(new) + 1):
            common[x][y] = common[x - 1][y - 1] + 1 if old[x - 1] == new[y - 1] else max(common[x - 1][y], common[x][y - 1])
    out, x, y = [], len(old), len(new)
    while x and y:
        if common[x][y - 1] == common[x][y]:
            y -= 1
        elif common[x - 1][y] == common[x][y]:
            x -= 1
        else:
            x, y = x - 1, y - 1
            out.append((x, y))
    return out[::-1]


def words(rng, most, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


def test_paths_and_bits_give_the_script_of_the_table():
    rng = random.Random(1)
    for _ in range(800):
        letters = "abcd"[: rng.randrange(1, 5)]
        old, new = words(rng, 40, letters), words(rng, 40, letters)
        want = table_matches(old, new)
        edits = len(old) + len(new) - 2 * len(want)
        assert projection._by_paths(old, new, edits) == projection._by_bits(old, new, edits) == want
        if edits:
            assert projection._by_paths(old, new, edits - 1) is None and projection._by_bits(old, new, edits - 1) is None


def test_unlike_texts_of_20_000_characters_take_little():
    rng = random.Random(2)
    old, new = ("".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(2))
    begun = time.perf_counter()
    script = projection.edits(old, new)
    assert time.perf_counter() - begun < 10
    tracemalloc.start()
    assert projection.edits(old, new) == script
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert "".join(old[e.a : e.b] if e.equal else new[e.c : e.d] for e in script) == new


def plain_island(texts, coarse, tokens):
    """Character by character, over the whole table."""
    lo, hi = min(s for s, _ in coarse), max(e for _, e in coarse)
    within = [(projection._solid(t), s, e) for t, s, e in tokens if s < hi and e > lo and projection._solid(t)]
    parts = [projection._solid(t) for t in texts]
    if not within or not all(parts):
        return None
    heard, wanted, times = "".join(t for t, _, _ in within), "".join(parts), []
    for k, (t, s, e) in enumerate(within):
        for i in range(len(t)):
            times.append(s + (e - s) * i // len(t) if i or not k else (within[k - 1][2] + s + 1) // 2)
    times.append(within[-1][2])
    matched = dict((j, i) for i, j in table_matches(heard, wanted))
    cuts, at = [0], 0
    for part in parts:
        if sum(j in matched for j in range(at, at + len(part))) < 0.6 * len(part):
            return None
        at += len(part)
        cuts.append(at)
    script = projection.edits(heard, wanted)
    spots = []
    for cut in cuts:
        e = [e for e in script if e.c <= cut <= e.d and e.d > e.c][-1]
        spots.append(e.a + ((cut - e.c) * (e.b - e.a) + (e.d - e.c) // 2) // (e.d - e.c))
    spans = [(max(times[a], s), min(times[b], e)) for a, b, (s, e) in zip(spots, spots[1:], coarse, strict=False)]
    return spans if all(a < b for a, b in spans) else None


def test_islands_are_those_of_a_walk_by_characters():
    rng, found = random.Random(3), 0
    for _ in range(1_500):
        tokens, at = [], rng.randrange(50)
        for _ in range(rng.randrange(12)):
            start = at + rng.randrange(-3, 9)
            at = start + rng.randrange(40)
            tokens.append((words(rng, 6, "abc .é"), start, at))
        texts = [words(rng, 9, "abc .") for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.7:
            heard = "".join(t for t, _, _ in tokens)
            size = len(heard) // len(texts) + 1
            texts = [heard[k * size : (k + 1) * size] + rng.choice(["", "", "z"]) for k in range(len(texts))]
        coarse = [(rng.randrange(60), rng.randrange(60, 400)) for _ in texts]
        want = plain_island(texts, coarse, tokens)
        assert projection.timed_island(texts, coarse, tokens) == want
        found += want is not None
    assert found > 100


def plain_tokens(tokens, starts, durations, begin, stop, owned):
    out, last = [], begin
    for k, word in enumerate(tokens):
        if word.strip() and last < stop:
            start = min(max(begin + int(starts[k] * 1000 + 0.5), last), stop - 1)
            nxt = begin + int(starts[k + 1] * 1000 + 0.5) if k + 1 < len(starts) else stop
            end = start + int(durations[k] * 1000 + 0.5) if k < len(durations) else nxt
            end = min(max(end, start + 1), stop)
            last, middle = end, start + (end - start) // 2
            if owned[0] <= middle < owned[1] and max(start, owned[0]) < min(end, owned[1]):
                out.append((k, word, max(start, owned[0]), min(end, owned[1])))
    return out


def test_region_tokens_are_those_of_a_walk_by_tokens():
    rng = random.Random(4)
    for _ in range(2_000):
        n = rng.randrange(1, 9)
        starts = [round(rng.random() * 2, 3) for _ in range(n)]
        starts = sorted(starts) if rng.random() < 0.7 else starts
        durations = [round(rng.random() * 0.5 - 0.05, 3) for _ in range(rng.choice([0, n, n // 2, n + 2]))]
        spoken = [rng.choice(["a", " ", "", "bc"]) for _ in range(n)]
        begin = rng.randrange(100)
        stop = begin + rng.randrange(1, 2500)
        owned = (begin + rng.randrange(300), stop - rng.randrange(300))
        assert projection.region_tokens(spoken, np.array(starts), np.array(durations), begin, stop, owned) == plain_tokens(spoken, starts, durations, begin, stop, owned)


def test_carried_places_take_the_later_stretch():
    script = projection.edits("abXXcd", "abYcd")
    assert projection.carried(script, np.array([0, 2, 3, 5])).tolist() == [0, 2, 4, 6]


@pytest.mark.parametrize("name", ["playback_projection"])
def test_playback_query_has_a_plain_twin(spark, name, monkeypatch):
    want = sorted(map(tuple, QUERIES[name](spark, SMOKE).collect()))
    monkeypatch.setattr(projection, "_by_bits", lambda old, new, edge: table_matches(old, new) if len(old) + len(new) - 2 * len(table_matches(old, new)) <= edge else None)
    monkeypatch.setattr(projection, "timed_island", plain_island)
    assert sorted(map(tuple, QUERIES[name](spark, SMOKE).collect())) == want


def test_long_texts_with_few_mistakes_take_little():
    """A copy of 130,000 characters with a mistake in each hundred words: more edits than paths are kept for in short texts."""
    rng = random.Random(6)
    source = [words(rng, 9, "abcdefgh") + " " for _ in range(26_000)]
    proposed = ["".join(source[k : k + 100]) + "x" for k in range(0, len(source), 100)]
    begun = time.perf_counter()
    found = projection.project("".join(source), proposed)
    assert time.perf_counter() - begun < 0.5
    assert found.changed == len(proposed) and ["".join(source)[a:b] + "x" for a, b in found.ranges[:3]] == proposed[:3]


def test_long_lectures_meet_only_near_tokens(spark, monkeypatch):
    """An island gets the tokens around it, not the lecture's, with the results of the whole; lectures are no pandas group each."""
    from pyspark.sql import functions as F

    tokens = spark.range(1200).select((F.col("id") % 3).alias("lecture_id"), F.floor(F.col("id") / 3).alias("pos"))
    tokens = tokens.withColumns({"text": F.concat(F.lit("word"), F.col("pos").cast("string")), "start_ms": F.col("pos") * 10, "end_ms": F.col("pos") * 10 + 9 + F.col("lecture_id") * 7})
    own = tokens.groupBy("lecture_id", F.floor(F.col("pos") / 4).alias("passage_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    own = own.withColumn("source_start", F.col("passage_id")).withColumn("source_end", F.col("passage_id"))
    kernel, seen = projection.timed_island, spark.sparkContext.accumulator(0)

    def counted(texts, coarse, spoken):
        seen.add(len(spoken))
        return kernel(texts, coarse, spoken)

    monkeypatch.setattr(projection, "timed_island", counted)
    found = projection.playback(own, tokens)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.lecture_id, r.passage_id): (r.start_ms, r.end_ms, r.basis) for r in found.collect()}
    assert len(got) == 300 and got[0, 1] == (40, 80, "timed_tokens")
    assert seen.value <= 300 * 8
