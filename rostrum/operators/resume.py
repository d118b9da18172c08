"""Resuming work from checked slots: results lie in a folder named by what they depend on, and only what is missing is computed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.ranking import pending


class ResumeError(ValueError):
    """Stored results that don't fit the plan."""


def identity(manifest: dict) -> str:
    """SHA-256 of a manifest as JSON with sorted keys: other settings have another folder."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def slot_errors(planned: DataFrame, results: DataFrame, key: str = "slot", invalid: Column | None = None) -> DataFrame:
    """Of stored results (key, error): slots that aren't planned, slots stored twice, results that ``invalid`` is true for."""
    stored = results.withColumn("__bad", F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False)))
    slots = stored.groupBy(key).agg(F.count("*").alias("n"), F.bool_or("__bad").alias("bad"))
    marked = slots.join(planned.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    kinds = {"unknown_slot": F.col("known").isNull(), "repeated_slot": F.col("n") > 1, "invalid_result": F.col("bad")}
    return marked.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("error"))


def resumed(planned: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, manifest: dict, key: str = "slot", invalid: Column | None = None, rounds: int = 1) -> DataFrame:
    """The results of all planned slots, of which those stored under the manifest's identity aren't computed again.

    ``work`` gives one row per slot. A write is kept whole or not at all, so ``rounds`` of slots, dealt by hash, are
    written one after the other: a run that breaks off loses the round it was in. One run at a time writes a folder.
    Stored results that aren't planned, are there twice or are invalid raise ResumeError.
    """
    spark, path = planned.sparkSession, f"{folder}/{identity(manifest)}"

    def stored() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            return None

    done = stored()
    if done is not None:
        wrong = slot_errors(planned, done, key, invalid).orderBy(key, "error").limit(1).collect()
        if wrong:
            raise ResumeError(str(wrong[0].asDict()))
    for k in range(rounds):
        part = planned.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k)
        missing = part if done is None else pending(part, done, key)
        work(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)
