"""Analytics of model-exchange logs: summaries, usage and its gaps, cost, latency, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hedging and smoothing.
RECENT, MIN_SAMPLES, HEDGE_FACTOR, HEDGE_BASE_MS = 50, 10, 3, 5_000
SMOOTHING = 0.8


def summary(trace: DataFrame) -> DataFrame:
    """One row: counts by event and workflow, failures by category and by workflow and window, repairs, retries."""
    counts = lambda key, df: df.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("value"))))).alias(f"by_{key}"))
    failed = trace.filter("event = 'failure'")
    per = failed.groupBy("workflow", "window_index").agg(F.count("*").alias("n"))
    inner = per.groupBy("workflow").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("window_index", "n")))).alias("windows"))
    nested = inner.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("workflow", F.to_json("windows").alias("windows"))))).alias("failures_by_window"))
    whole = trace.agg(F.count("*").alias("records"), repair_turns().alias("repair_turns"), scheduled_retries().alias("scheduled_retries"))
    out = whole
    for part in (counts("event", trace), counts("workflow", trace), counts("category", failed), nested):
        out = out.crossJoin(part)
    return out


def repair_turns() -> Column:
    """Distinct (workflow, window, turn) of repairs."""
    return F.count_distinct(F.when(F.col("repair_turn") > 0, F.struct("workflow", "window_index", "repair_turn")))


def scheduled_retries() -> Column:
    return F.count_if((F.col("event") == "request") & (F.col("provider_attempt") > 0) & ~F.col("hedge"))


def incomplete(trace: DataFrame) -> DataFrame:
    """Exchanges with a request and no completion."""
    return trace.filter("event = 'request'").select("exchange_id").distinct().join(trace.filter("event = 'completion'").select("exchange_id"), "exchange_id", "left_anti")


def usage(trace: DataFrame, *key: str) -> DataFrame:
    """Totals of completions with what is missing counted, and totals that are null if anything is missing."""
    done = F.col("event") == "completion"
    cells = []
    for name in ("input_tokens", "output_tokens", "cached_tokens"):
        own = F.when(done, F.col(name))
        cells += [F.coalesce(F.sum(own), F.lit(0)).alias(name), F.count_if(done & F.col(name).isNull()).alias(f"missing_{name}"), known_total(own, done).alias(f"known_{name}")]
    grouped = trace.groupBy(*key) if key else trace.groupBy()
    return grouped.agg(F.count_if(done).alias("completions"), *cells)


def known_total(value: Column, among: Column | None = None) -> Column:
    """The sum, or null if any value is missing."""
    n = F.count("*") if among is None else F.count_if(among)
    return F.when(F.count(value) == n, F.coalesce(F.sum(value), F.lit(0)))


def cost(usage: DataFrame, input_price: float, cached_price: float, output_price: float) -> DataFrame:
    """Adds cost (prices are per million tokens) and whether it is incomplete. Cached tokens are part of the input."""
    cached = F.least("cached_tokens", "input_tokens")
    spent = ((F.col("input_tokens") - cached) * input_price + cached * cached_price + F.col("output_tokens") * output_price) / 1_000_000
    short = (F.col("missing_input_tokens") > 0) | (F.col("missing_output_tokens") > 0) | (F.col("missing_cached_tokens") > 0)
    return usage.withColumn("cost", spent).withColumn("incomplete", short)


def recent_p80(latencies: DataFrame, *key: str) -> DataFrame:
    """Nearest-rank 80th percentile of the last fifty latencies of each class with ten at least, and its hedge delay."""
    order = Window.partitionBy(*key).orderBy(F.col("at_ms").desc(), F.col("record_id").desc())
    last = latencies.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= RECENT)
    out = last.groupBy(*key).agg(F.count("*").alias("samples"), F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY latency_ms)").alias("p80"))
    return out.filter(F.col("samples") >= MIN_SAMPLES).withColumn("hedge_ms", (HEDGE_FACTOR * F.col("p80") + HEDGE_BASE_MS).cast("long"))


def smoothed(latencies: DataFrame, *key: str) -> DataFrame:
    """Exponentially weighted latency, in order of time: 0.8 of what was and 0.2 of what comes.

    As a sum over ranks from the last: what comes k later weighs 0.8 to the k less, so no class is collected.
    """
    order = Window.partitionBy(*key).orderBy(F.col("at_ms").desc(), F.col("record_id").desc(), F.col("latency_ms").desc())
    later = (F.row_number().over(order) - 1).cast("double")
    first = F.lead("at_ms").over(order).isNull()
    weight = F.pow(F.lit(SMOOTHING), later) * F.when(first, 1.0).otherwise(1 - SMOOTHING)
    return latencies.withColumn("__part", F.col("latency_ms") * weight).groupBy(*key).agg(F.sum("__part").alias("ewma"))


def budget_gate(trace: DataFrame, budget: int, *key: str) -> DataFrame:
    """Each completion with the tokens used so far: open, reached, or unavailable from the first missing count on."""
    order = Window.partitionBy(*key).orderBy("at_ms", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    done = trace.filter("event = 'completion'").withColumn("missing", (F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).cast("int"))
    used = F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).over(order)
    gate = F.when(F.max("missing").over(order) > 0, "unavailable").when(used >= budget, "reached").otherwise("open")
    return done.select(*key, "record_id", used.alias("used"), gate.alias("gate"))


def replayed_state(trace: DataFrame) -> DataFrame:
    """What a scheduler restarts from: the next id, tokens so far, completions and failures."""
    return trace.agg((F.max("record_id") + 1).alias("next_id"), F.sum(F.when(F.col("event") == "completion", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))).alias("tokens"), F.count_if(F.col("event") == "completion").alias("completions"), F.count_if(F.col("event") == "failure").alias("failures"))


def annotation_quality(windows: DataFrame) -> DataFrame:
    """Of windows (changed, compared, rejected): exact, fuzzy and rejected ones with percentages, 0 of none."""
    share = lambda n: F.when(F.count("*") == 0, 0.0).otherwise(n * 100.0 / F.count("*"))
    exact, fuzzy, rejected = F.count_if(~F.col("rejected") & (F.col("changed") == 0)), F.count_if(~F.col("rejected") & (F.col("changed") > 0)), F.count_if("rejected")
    return windows.agg(F.count("*").alias("windows"), exact.alias("exact"), fuzzy.alias("fuzzy"), rejected.alias("rejected"), share(exact).alias("exact_percent"), share(fuzzy).alias("fuzzy_percent"), share(rejected).alias("rejected_percent"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def restoration_review(spans: DataFrame, repairs: DataFrame) -> DataFrame:
    """Characters before and after, omitted segments and repaired windows. spans (kind, source_text, text), repairs (window_index, turns)."""
    own = spans.agg(F.sum(F.char_length("source_text")).alias("source_chars"), F.coalesce(F.sum(F.when(F.col("kind") == "text", F.char_length("text"))), F.lit(0)).alias("restored_chars"), F.count_if(F.col("kind") != "text").alias("omitted"))
    return own.crossJoin(repairs.agg(F.count_if(F.col("turns") > 0).alias("repaired_windows")))


def import_warnings(pages: DataFrame) -> DataFrame:
    """deck, place, message: sparse pages in one leading message, glyph warnings one per page."""
    sparse = pages.filter("sparse").groupBy("deck").agg(F.array_join(F.transform(F.sort_array(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("list"))
    lead = sparse.select("deck", F.lit(0).cast("long").alias("place"), F.concat(F.lit("sparse pages: "), "list").alias("message"))
    odd = pages.filter(F.size("glyphs") > 0).select("deck", (F.col("page") + 1).alias("place"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), F.array_join("glyphs", " ")).alias("message"))
    return lead.unionByName(odd)
