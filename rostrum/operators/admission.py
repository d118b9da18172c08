"""Adaptive admission and hedging, replayed from logs of model exchanges.

A rate limit halves the cap and widens the spacing of requests; failures of other kinds only end the health of a
workflow; enough successes in good health narrow the spacing or raise the cap. What a request answers to counts only
if it began in the present generation: after a rate limit the requests already under way say nothing of the new cap.

A replay is sequential within a workflow, so a workflow is one task; its state is a few numbers and the open requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Admission.
SMOOTHING, GROW_MIN, GROW_AFTER_MS = 0.8, 8, 1_000
LATENCY_MS, LEAST_SPACING_MS, MOST_SPACING_MS, FORGOTTEN_MS = 1_000.0, 250.0, 120_000.0, 10.0
#: Hedging.
RECENT, MIN_SAMPLES, HEDGE_FACTOR, HEDGE_BASE_MS, MAX_ACTIVE, MAX_PER_RUN = 50, 10, 3, 5_000, 3, 20
#: The category of failures by a rate limit (status 429).
RATE_LIMITED = "rate_limited"
#: What a replay reads: waited ('cap', 'pace', 'both' or 'none') and retry_after_ms may be missing from a log.
READ = ("workflow", "record_id", "at_ms", "event", "category", "exchange_id", "latency_ms", "retry_after_ms", "waited")
CAPS = "workflow string, record_id long, cap long, spacing_ms double, cooldown_ms long, generation long"
STATE = "cap long, good long, healthy_ms long, cooldown_ms long, spacing_ms double, latency_ms double, generation long"


@dataclass(frozen=True)
class Gate:
    """The cap, the successes in good health and since when, the end of the cooldown, the learned spacing, the smoothed latency, the generation."""

    cap: int = 2
    good: int = 0
    healthy_ms: int = 0
    cooldown_ms: int = 0
    spacing_ms: float = 0.0
    latency_ms: float = LATENCY_MS
    generation: int = 0

    def unhealthy(self, at: int) -> Gate:
        return replace(self, good=0, healthy_ms=max(at, self.cooldown_ms))

    def failed(self, at: int, delay: int = 0, limited: bool = False, current: bool = True) -> Gate:
        """After a failure: every one may ask for a delay; a rate limit of the present generation also halves and slows."""
        own = replace(self, cooldown_ms=max(self.cooldown_ms, at + delay)) if delay or limited else self
        own = own.unhealthy(at)
        if not (limited and current):
            return own
        cap = max(own.cap // 2, 1)
        spacing = min(max(2 * own.spacing_ms, own.latency_ms / cap, LEAST_SPACING_MS), MOST_SPACING_MS)
        return replace(own, cap=cap, spacing_ms=spacing, generation=own.generation + 1)

    def succeeded(self, at: int, took: float, largest: int, waited: str = "both", current: bool = True) -> Gate:
        """After a success: those of the present generation count, and enough of them relieve what requests waited for."""
        if not current:
            return self
        own = replace(self, latency_ms=SMOOTHING * self.latency_ms + (1 - SMOOTHING) * took, good=self.good + 1)
        ready = own.good >= max(GROW_MIN, 2 * own.cap) and at - own.healthy_ms >= GROW_AFTER_MS and at >= own.cooldown_ms
        if not ready:
            return own
        binding = own.spacing_ms > own.latency_ms / own.cap
        if waited == "pace" or waited == "both" and binding:
            narrower = SMOOTHING * own.spacing_ms
            own = replace(own, spacing_ms=narrower if narrower >= FORGOTTEN_MS else 0.0)
        elif waited in ("cap", "both"):
            own = replace(own, cap=min(own.cap + 1, largest))
        return own.unhealthy(at)


def replayed(gate: Gate, begun: dict[int, int], rows: pd.DataFrame, largest: int, limits: tuple[str, ...]) -> tuple[Gate, pd.DataFrame]:
    """The gate after rows, and its state at each end of a request. ``begun`` keeps the generation in which open requests began.

    An end whose request the log doesn't hold counts as of the present generation. Requests of earlier
    generations stay in ``begun`` until they end.
    """
    found = Ends()
    for row in in_order([rows], limits):
        gate = stepped(gate, begun, row, largest, found)
    workflow = rows.workflow.iloc[0] if len(rows) else None
    return gate, found.frame(workflow)


def stepped(gate: Gate, begun: dict[int, int], row: tuple, largest: int, found: Ends) -> Gate:
    """The gate after a row of ``in_order``; an end's state is added to ``found``."""
    at, record, key, event, limited, latency, delay, waited = row
    if event == REQUEST:
        begun.setdefault(key, gate.generation)
        return gate
    current = begun.pop(key, gate.generation) == gate.generation
    if event == FAILURE:
        gate = gate.failed(at, max(delay, 0), limited, current)
    else:
        gate = gate.succeeded(at, latency, largest, WAITS[waited], current)
    found.add(record, gate)
    return gate


#: Events and waits as small numbers; other events are completions, other waits are none.
REQUEST, FAILURE, COMPLETION, WAITS = 0, 1, 2, ("none", "cap", "pace", "both")
#: Rows that are numbers of Python at a time, and rows of results that are held before they are given away.
ROWS = 50_000


def in_order(batches: Iterable[pd.DataFrame], limits: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a workflow by time and record id, out of batches in any order: at_ms, record_id, exchange_id (or None), event, whether a rate
    limit, latency_ms, retry_after_ms, wait. Held as columns of numbers, forty-odd bytes a row, without texts or frames.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    for rows in batches:
        keys, event = rows.exchange_id, rows.event
        number = lambda c, kind: rows[c].fillna(0).to_numpy(kind)  # noqa: B023, E731
        codes = np.where(event == "request", REQUEST, np.where(event == "failure", FAILURE, COMPLETION)).astype(np.int8)
        waits = np.select([rows.waited == name for name in WAITS], range(len(WAITS)), 0).astype(np.int8)
        parts.append((number("at_ms", np.int64), number("record_id", np.int64), number("exchange_id", np.int64), keys.isna().to_numpy(bool), codes, rows.category.isin(limits).to_numpy(bool), number("latency_ms", np.float64), number("retry_after_ms", np.int64), waits))
    if not parts:
        return
    columns = []
    for k in range(len(parts[0])):
        columns.append(np.concatenate([part[k] for part in parts]))
        parts = [(*part[:k], None, *part[k + 1 :]) for part in parts]
    order = np.lexsort((columns[1], columns[0]))
    for start in range(0, len(order), ROWS):
        here = order[start : start + ROWS]
        at, record, key, unknown, event, limited, latency, delay, waited = (column[here].tolist() for column in columns)
        keys = [None if gone else x for x, gone in zip(key, unknown, strict=True)]
        yield from zip(at, record, keys, event, limited, latency, delay, waited, strict=True)


class Ends:
    """States of the gate at ends of requests, until they are given away."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, record: int, gate: Gate) -> None:
        self.rows.append((record, gate.cap, gate.spacing_ms, gate.cooldown_ms, gate.generation))

    def frame(self, workflow: str | None) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["record_id", "cap", "spacing_ms", "cooldown_ms", "generation"])
        out.insert(0, "workflow", workflow)
        self.rows = []
        return out


def replayed_in_parts(gate: Gate, begun: dict[int, int], batches: Iterable[pd.DataFrame], largest: int, limits: tuple[str, ...], workflow: str | None) -> Iterator[tuple[Gate, pd.DataFrame]]:
    """What ``replayed`` gives over all batches, some rows at a time, each with the gate by then."""
    found = Ends()
    for row in in_order(batches, limits):
        gate = stepped(gate, begun, row, largest, found)
        if len(found.rows) >= ROWS:
            yield gate, found.frame(workflow)
    yield gate, found.frame(workflow)


def admission_rows(trace: DataFrame) -> DataFrame:
    """The columns that a replay reads. A log without waits is one of full demand: requests wait for cap and spacing alike."""
    extra = {"retry_after_ms": F.lit(None).cast("long"), "waited": F.lit("both")}
    own = trace.withColumns({k: v for k, v in extra.items() if k not in trace.columns})
    return own.filter("event IN ('request', 'completion', 'failure')").select(*READ)


def admission(trace: DataFrame, start: int = 2, largest: int = 8, limits: tuple[str, ...] = (RATE_LIMITED,)) -> DataFrame:
    """Cap, spacing, cooldown and generation after every completion or failure of each workflow, in order of time. ``limits`` are the categories of rate limits."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, out in replayed_in_parts(Gate(start), {}, batches, largest, limits, key[0]):
            yield out

    return admission_rows(trace).groupBy("workflow").applyInPandas(run, CAPS)


def unpacked(state: tuple) -> tuple[Gate, dict[int, int]]:
    """Of a stored state the gate and the open requests."""
    *own, keys, generations = state
    return Gate(*own), dict(zip(keys, generations, strict=True))


def packed(gate: Gate, begun: dict[int, int]) -> tuple:
    known = [k for k in begun if k is not None]
    return (*astuple(gate), known, [begun[k] for k in known])


def response_times(trace: DataFrame, *key: str) -> DataFrame:
    """What a scheduler restarts from, per class: the last fifty latencies of completions in order of time, hedges so far, the next exchange id."""
    last = Window.partitionBy(*key).orderBy(F.col("at_ms").desc(), F.col("record_id").desc())
    done = trace.filter("event = 'completion' AND latency_ms IS NOT NULL").withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= RECENT)
    kept = done.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("__n"), "latency_ms"))), lambda x: x["latency_ms"]).alias("latencies"))
    began = trace.filter("event = 'request'").groupBy(*key).agg(F.count_if("hedge").alias("hedges"), (F.max("exchange_id") + 1).alias("next_exchange"))
    return kept.join(began, list(key), "full_outer")


def due_hedges(trace: DataFrame, *key: str) -> DataFrame:
    """Requests (not hedges themselves) that were still open when their class's threshold ran out.

    Per class the threshold is three times the 80th percentile of the fifty latencies before the request, and five
    seconds, from ten latencies on. Gives key, exchange_id, record_id, at_ms, p80, threshold_ms, due_ms, end_ms (null: still open).
    """
    order = Window.partitionBy(*key).orderBy("at_ms", "record_id")
    done = trace.filter("event = 'completion' AND latency_ms IS NOT NULL").withColumn("__l", F.collect_list("latency_ms").over(order.rowsBetween(-RECENT + 1, 0)))
    size = F.size("__l")
    p80 = F.when(size >= MIN_SAMPLES, F.element_at(F.sort_array("__l"), F.expr("(size(__l) * 4 + 4) div 5").cast("int")))
    marks = done.select(*key, "at_ms", "record_id", p80.alias("__p80"), F.lit(None).cast("long").alias("exchange_id"))
    asked = trace.filter("event = 'request' AND NOT coalesce(hedge, false)").select(*key, "at_ms", "record_id", F.lit(None).cast("long").alias("__p80"), "exchange_id")
    as_of = marks.withColumn("__p80", F.col("__p80").cast("long")).unionByName(asked).withColumn("p80", F.last("__p80", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_ = as_of.filter(F.col("exchange_id").isNotNull() & F.col("p80").isNotNull()).drop("__p80")
    ends = trace.filter("event IN ('completion', 'failure')").groupBy("exchange_id").agg(F.min("at_ms").alias("end_ms"))
    timed = open_.withColumn("threshold_ms", HEDGE_FACTOR * F.col("p80") + HEDGE_BASE_MS).withColumn("due_ms", F.col("at_ms") + F.col("threshold_ms"))
    return timed.join(ends, "exchange_id", "left").filter(F.col("end_ms").isNull() | (F.col("end_ms") > F.col("due_ms")))


def started_hedges(due: Iterable[tuple[int, float]], active: int = MAX_ACTIVE, total: int = MAX_PER_RUN) -> list[tuple[int, int] | None]:
    """Of (due, end) in order of due times when each hedge starts and its number; None if it never does.

    At most ``active`` run at a time: another waits for one to end, and starts only if its request is still open
    then. A hedge lasts until its request's end. No more than ``total`` start.
    """
    running, out, started = [], [], 0
    for at, end in due:
        running = sorted(e for e in running if e > at)
        begin = at if len(running) < active else running[len(running) - active]
        if started == total or begin >= end or begin == math.inf:
            out.append(None)
            continue
        started += 1
        running.append(end)
        out.append((int(begin), started))
    return out


def hedges(due: DataFrame, run: str, active: int = MAX_ACTIVE, total: int = MAX_PER_RUN) -> DataFrame:
    """Hedges that start, of due ones (run, record_id, due_ms, end_ms): run, record_id, start_ms, number. A run is one task."""

    def step(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["due_ms", "record_id"])
        ends = [math.inf if pd.isna(e) else e for e in own.end_ms]
        found = started_hedges(zip(own.due_ms, ends, strict=True), active, total)
        rows = [(r, i, *s) for r, i, s in zip(own.run, own.record_id, found, strict=True) if s is not None]
        return pd.DataFrame(rows, columns=["run", "record_id", "start_ms", "number"])

    kind = due.schema[run].dataType.simpleString()
    return due.select(F.col(run).alias("run"), "record_id", "due_ms", "end_ms").groupBy("run").applyInPandas(step, f"run {kind}, record_id long, start_ms long, number long")
