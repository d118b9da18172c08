"""Streams over model-exchange logs: running usage, active requests, adaptive admission, windows as an extension.

A growing log is followed by byte offsets (sources.lines), so a half-written last
line is seen once it is whole. State is kept by Spark's checkpoint, and batch and
stream share their kernels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rostrum.functions.redaction import Redactor
from rostrum.operators import admission as A
from rostrum.operators import trace as T
from rostrum.sources.artifacts import TRACE
from rostrum.sources.lines import JsonLines


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of a growing JSON-lines log as its lines are completed, with file and head; lines that aren't records are dropped, blank ones too.

    A file that was cut and begun anew has another head, so consumers can tell its records from those before.
    """
    spark.dataSource.register(JsonLines)
    lines = spark.readStream.format("json_lines").options(**options).load(path)
    parsed = lines.select("file", "head", F.from_json("value", TRACE).alias("r")).select("file", "head", "r.*")
    return parsed.filter(F.col("record_id").isNotNull() & F.col("event").isNotNull())


def parquet_tail(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_usage(records: DataFrame, *key: str) -> DataFrame:
    """Usage so far; for the complete output mode. Counts of missing values stay beside the sums."""
    return T.usage(records, *key)


def active_requests(records: DataFrame) -> DataFrame:
    """workflow, active: requests without a completion or failure so far, after each batch; for the update mode.

    Only open exchange ids are kept as state. Exchanges that end before they begin, as files may come out of order, are kept as ended.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, ended = (set(state.get[0]), set(state.get[1])) if state.exists else (set(), set())
        for batch in batches:
            opened |= set(batch.exchange_id[batch.event == "request"])
            ended |= set(batch.exchange_id[batch.event != "request"])
        both = opened & ended
        opened, ended = opened - both, ended - both
        state.update((sorted(int(x) for x in opened), sorted(int(x) for x in ended)))
        yield pd.DataFrame({"workflow": [key[0]], "active": [len(opened)]})

    rows = records.filter("event IN ('request', 'completion', 'failure')").select("workflow", "exchange_id", "event")
    return rows.groupBy("workflow").applyInPandasWithState(step, "workflow string, active long", "opened array<bigint>, ended array<bigint>", "update", GroupStateTimeout.NoTimeout)


def admission(records: DataFrame, start: int = 2, largest: int = 8, limits: tuple[str, ...] = (A.RATE_LIMITED,)) -> DataFrame:
    """What operators.admission gives, after every completion or failure; for the append mode. Records of a batch are put in order of time.

    Beside the gate's numbers the state holds the requests still open, with the generation in which they began.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, begun = A.unpacked(state.get) if state.exists else (A.Gate(start), {})
        for gate, out in A.replayed_in_parts(gate, begun, batches, largest, limits, key[0]):
            yield out
        state.update(A.packed(gate, begun))

    kind = f"{A.STATE}, open array<bigint>, begun array<bigint>"
    return A.admission_rows(records).groupBy("workflow").applyInPandasWithState(step, A.CAPS, kind, "append", GroupStateTimeout.NoTimeout)


def redacted(chunks: DataFrame, secrets: list[str]) -> DataFrame:
    """stream, pos, text of chunks (stream, pos, text, last), for the append mode: what redaction.redacted_chunks gives, over any number of triggers.

    A stream's state is what is held back, no more than the longest secret has; it goes with the chunk that is ``last``.
    Chunks of a trigger are put in order of ``pos``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values("pos")
        redactor = Redactor(secrets, state.get[0] if state.exists else "")
        texts = [redactor.feed(text or "", bool(last)) for text, last in zip(own.text, own["last"], strict=True)]
        if redactor.held:
            state.update((redactor.held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream": own.stream, "pos": own.pos, "text": texts})

    return chunks.select("stream", "pos", "text", "last").groupBy("stream").applyInPandasWithState(step, "stream long, pos long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window of event time: an extension, with late rows dropped after the watermark."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users with a gap of inactivity; an extension like event_windows."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_completion(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and gives its result table: for replays and tests.

    Appended rows go to Parquet beside the checkpoint; only tables of a row per key, in the other modes, are held in memory.
    """
    if mode == "append":
        out = f"{checkpoint}-rows"
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(out)
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
