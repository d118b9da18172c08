"""Adaptive admission and hedging: what changes the cap and the spacing, and which hedges start."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from rostrum.operators import admission as A

LOG = "workflow string, record_id long, at_ms long, event string, category string, exchange_id long, latency_ms long, hedge boolean"


def log(spark, rows):
    return spark.createDataFrame([r if len(r) == 8 else (*r, None, None, False) for r in rows], LOG)


def test_only_rate_limits_halve_the_cap(spark):
    rows = [("w", 0, 10, "failure", "timeout"), ("w", 1, 20, "failure", None), ("w", 2, 30, "failure", "rate_limited"), ("w", 3, 40, "completion", None), ("w", 4, 50, "failure", "rate_limited")]
    got = A.admission(log(spark, rows), start=8).collect()
    assert [r.cap for r in sorted(got, key=lambda r: r.record_id)] == [8, 8, 4, 4, 2]


def test_other_failures_reset_health():
    gate = A.Gate(2, 7).failed(5000)
    assert (gate.cap, gate.good, gate.healthy_ms, gate.generation) == (2, 0, 5000, 0)
    for k in range(7):
        gate = gate.succeeded(7000 + k, 100, 8)
    assert gate.cap == 2 and gate.succeeded(7007, 100, 8).cap == 3


def test_limits_slow_even_at_cap_one():
    gate = A.Gate(1)
    spacings = []
    for k in range(9):
        gate = gate.failed(100 * k, limited=True)
        spacings.append(gate.spacing_ms)
    assert gate.cap == 1 and spacings == [1000.0 * 2**k for k in range(7)] + [120_000.0] * 2


def test_earlier_generations_say_nothing():
    gate = A.Gate(8).failed(10, limited=True)
    assert (gate.cap, gate.generation) == (4, 1)
    late = gate.failed(20, delay=5000, limited=True, current=False)
    assert (late.cap, late.generation, late.spacing_ms) == (4, 1, gate.spacing_ms)
    assert (late.cooldown_ms, late.healthy_ms) == (5020, 5020)
    assert late.succeeded(9000, 50, 8, current=False) == late


def test_successes_relieve_what_requests_waited_for():
    ready = A.Gate(4, 7, 0, 0, 1000.0, 800.0)
    assert ready.succeeded(5000, 800, 8, "cap").cap == 5
    assert ready.succeeded(5000, 800, 8, "pace").spacing_ms == 800.0
    both = ready.succeeded(5000, 800, 8, "both")
    assert (both.cap, both.spacing_ms) == (4, 800.0)
    slack = A.Gate(4, 7, 0, 0, 100.0, 800.0).succeeded(5000, 800, 8, "both")
    assert (slack.cap, slack.spacing_ms) == (5, 100.0)
    idle = ready.succeeded(5000, 800, 8, "none")
    assert (idle.cap, idle.spacing_ms, idle.good) == (4, 1000.0, 0)
    assert ready.succeeded(900, 800, 8).good == 8, "not before a second in health"
    assert A.Gate(4, 7, 0, 6000).succeeded(5000, 800, 8).good == 8, "not within the cooldown"
    assert A.Gate(8, 15).succeeded(5000, 800, 8).cap == 8, "never above the largest"
    assert A.Gate(4, 7, 0, 0, 12.0, 1.0).succeeded(5000, 1, 8, "pace").spacing_ms == 0.0


def test_state_survives_batches():
    rng = random.Random(3)
    rows = pd.DataFrame([("w", i, 300 * i, rng.choice(["request", "completion", "failure", "completion"]), rng.choice(["rate_limited", "x", None]), rng.randrange(40), rng.randrange(900), rng.choice([None, 400]), rng.choice(["cap", "pace", "both", "none"])) for i in range(400)], columns=A.READ)
    whole = A.replayed(A.Gate(4), {}, rows, 8, ("rate_limited",))[1]
    state, parts = A.packed(A.Gate(4), {}), []
    for k in range(0, 400, 37):
        gate, begun = A.unpacked(state)
        gate, out = A.replayed(gate, begun, rows[k : k + 37], 8, ("rate_limited",))
        state = A.packed(gate, begun)
        parts.append(out)
    assert pd.concat(parts).values.tolist() == whole.values.tolist()
    assert whole.cap.nunique() > 2


def test_empty_log(spark):
    assert A.admission(log(spark, [])).count() == 0
    assert A.response_times(log(spark, []), "workflow").count() == 0
    assert A.hedges(A.due_hedges(log(spark, []), "workflow"), "workflow").count() == 0


def by_events(due, active, total):
    """Which hedges start, moment by moment."""
    waiting, running, out, number = [], [], {}, 0
    for now in sorted({t for a, e in due for t in (a, e) if t < math.inf}):
        running = [e for e in running if e > now]
        waiting += [k for k, (a, _) in enumerate(due) if a == now]
        waiting = [k for k in waiting if due[k][1] > now]
        while waiting and len(running) < active and number < total:
            k = waiting.pop(0)
            number += 1
            out[k] = (now, number)
            running.append(due[k][1])
    return [out.get(k) for k in range(len(due))]


@pytest.mark.parametrize("seed", range(30))
def test_hedges_wait_for_slots(seed):
    rng = random.Random(seed)
    due = sorted((rng.randrange(60), 0) for _ in range(rng.randrange(40)))
    due = [(a, a + rng.randrange(1, 30) if rng.random() < 0.95 else math.inf) for a, _ in due]
    assert A.started_hedges(due, 3, 20) == by_events(due, 3, 20)


def test_three_at_a_time_and_twenty_a_run():
    assert A.started_hedges([(0, 10)] * 5) == [(0, 1), (0, 2), (0, 3), None, None]
    assert A.started_hedges([(0, 10), (0, 10), (0, 10), (0, 15)])[3] == (10, 4)
    assert sum(x is not None for x in A.started_hedges([(20 * k, 20 * k + 5) for k in range(50)])) == 20


def test_due_hedges(spark):
    done = [("w", i, 100 + i, "completion", None, i, 1000, False) for i in range(10)]
    open_ = [("w", 20, 200, "request", None, 20, None, False), ("w", 21, 210, "request", None, 21, None, False), ("w", 22, 220, "request", None, 22, None, True), ("w", 30, 8300, "completion", None, 21, 9, False)]
    early = [("w", 40, 105, "request", None, 40, None, False)]
    found = A.due_hedges(log(spark, done + open_ + early), "workflow").collect()
    assert sorted((r.exchange_id, r.p80, r.threshold_ms, r.due_ms, r.end_ms) for r in found) == [(20, 1000, 8000, 8200, None), (21, 1000, 8000, 8210, 8300)]


def test_last_fifty_response_times(spark):
    rows = [("w", i, i, "completion", None, i, i, False) for i in range(60)] + [("w", 99, 99, "request", None, 70, None, True), ("v", 1, 1, "request", None, 3, None, False)]
    got = {r.workflow: r for r in A.response_times(log(spark, rows), "workflow").collect()}
    assert got["w"].latencies == list(range(10, 60)) and (got["w"].hedges, got["w"].next_exchange) == (1, 71)
    assert got["v"].latencies is None and (got["v"].hedges, got["v"].next_exchange) == (0, 4)


def test_replay_holds_columns_of_numbers(spark):
    """Batches of a long workflow are not kept as frames, results leave in parts, and both are those of one frame."""
    import tracemalloc

    def batches():
        for k in range(60):
            i = np.arange(k * 2000, (k + 1) * 2000)[::-1]
            yield pd.DataFrame({"workflow": "w" * 5, "record_id": i, "at_ms": 300 * i, "event": np.where(i % 3 == 0, "request", np.where(i % 7 == 1, "failure", "completion")), "category": np.where(i % 14 == 1, "rate_limited", None), "exchange_id": np.where(i % 11 == 0, np.nan, i // 5), "latency_ms": np.where(i % 5 == 0, np.nan, i % 900), "retry_after_ms": np.nan, "waited": "both"})

    whole = A.replayed(A.Gate(2), {}, pd.concat(list(batches())), 8, ("rate_limited",))[1]
    parts = [out for _, out in A.replayed_in_parts(A.Gate(2), {}, batches(), 8, ("rate_limited",), "wwwww")]
    assert len(parts) > 1 and pd.concat(parts).values.tolist() == whole.values.tolist()
    tracemalloc.start()
    next(A.in_order(batches(), ("rate_limited",)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * 120_000
