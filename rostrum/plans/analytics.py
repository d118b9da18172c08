"""Checked queries over logs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import admission as A
from rostrum.operators import evaluation as E
from rostrum.operators import trace as T
from rostrum.plans.ranking import COUNTS_SQL, DECIDED_SQL, MEMBERS_SQL, decisions, members
from rostrum.plans.registry import query, table
from rostrum.plans.standins import LIMITS, PASSAGES, SEGMENTS, TRACE, passages, segments, trace


@query("trace_event_counts", f"WITH {TRACE} SELECT workflow, event, count(*) AS n, count(DISTINCT CASE WHEN repair_turn > 0 THEN window_index * 10 + repair_turn END) AS repair_turns, count(*) FILTER (event = 'request' AND provider_attempt > 0 AND NOT hedge) AS retries FROM tra GROUP BY ALL")
def trace_event_counts(spark, sf_dir):
    return trace(spark, sf_dir).groupBy("workflow", "event").agg(F.count("*").alias("n"), T.repair_turns().alias("repair_turns"), T.scheduled_retries().alias("retries"))


@query("trace_summary", f"""WITH {TRACE}, w AS (SELECT workflow, '{{' || string_agg('"' || window_index || '":' || n, ',' ORDER BY window_index) || '}}' AS j FROM (SELECT workflow, window_index, count(*) AS n FROM tra WHERE event = 'failure' GROUP BY ALL) GROUP BY 1)
SELECT (SELECT count(*) FROM tra) AS records, (SELECT count(DISTINCT (workflow, window_index, repair_turn)) FROM tra WHERE repair_turn > 0) AS repair_turns, (SELECT count(*) FROM tra WHERE event = 'request' AND provider_attempt > 0 AND NOT hedge) AS scheduled_retries,
  (SELECT string_agg(event || '=' || n, ',' ORDER BY event) FROM (SELECT event, count(*) AS n FROM tra GROUP BY 1)) AS by_event, (SELECT string_agg(workflow || '=' || n, ',' ORDER BY workflow) FROM (SELECT workflow, count(*) AS n FROM tra GROUP BY 1)) AS by_workflow,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM tra WHERE event = 'failure' GROUP BY 1)) AS by_category, (SELECT string_agg(workflow || '=' || j, ',' ORDER BY workflow) FROM w) AS failures_by_window""")
def trace_summary(spark, sf_dir):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(c)
    return T.summary(trace(spark, sf_dir)).select("records", "repair_turns", "scheduled_retries", *[flat(c) for c in ("by_event", "by_workflow", "by_category", "failures_by_window")])


@query("incomplete_exchanges", f"WITH {TRACE} SELECT DISTINCT exchange_id FROM tra WHERE event = 'request' AND exchange_id NOT IN (SELECT exchange_id FROM tra WHERE event = 'completion')")
def incomplete_exchanges(spark, sf_dir):
    return T.incomplete(trace(spark, sf_dir))


USAGE_SQL = f"""{TRACE}, usa AS (SELECT workflow, count(*) AS completions, {', '.join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}, count(*) FILTER ({c} IS NULL) AS missing_{c}, CASE WHEN count({c}) = count(*) THEN CAST(coalesce(sum({c}), 0) AS BIGINT) END AS known_{c}" for c in ("input_tokens", "output_tokens", "cached_tokens"))}
FROM tra WHERE event = 'completion' GROUP BY workflow)"""


@query("token_usage", f"WITH {USAGE_SQL} SELECT * FROM usa")
def token_usage(spark, sf_dir):
    return T.usage(trace(spark, sf_dir), "workflow")


@query("token_usage_cost", f"WITH {USAGE_SQL} SELECT workflow, round(((input_tokens - least(cached_tokens, input_tokens)) * 2.5 + least(cached_tokens, input_tokens) * 0.5 + output_tokens * 10) / 1000000.0, 6) AS cost, missing_input_tokens > 0 OR missing_output_tokens > 0 OR missing_cached_tokens > 0 AS incomplete FROM usa")
def token_usage_cost(spark, sf_dir):
    return T.cost(token_usage(spark, sf_dir), 2.5, 0.5, 10.0).select("workflow", F.round("cost", 6).alias("cost"), "incomplete")


@query("latency_p80_last50", f"""WITH {TRACE}, l AS (SELECT workflow, event, latency_ms, row_number() OVER (PARTITION BY workflow, event ORDER BY at_ms DESC, record_id DESC) AS n FROM tra)
SELECT workflow, event, count(*) AS samples, percentile_disc(0.8) WITHIN GROUP (ORDER BY latency_ms) AS p80, 3 * percentile_disc(0.8) WITHIN GROUP (ORDER BY latency_ms) + 5000 AS hedge_ms FROM l WHERE n <= 50 GROUP BY ALL HAVING count(*) >= 10""")
def latency_p80_last50(spark, sf_dir):
    return T.recent_p80(trace(spark, sf_dir), "workflow", "event").withColumn("p80", F.col("p80").cast("long"))


@query("latency_ewma", f"""WITH RECURSIVE {TRACE}, o AS (SELECT workflow, latency_ms, row_number() OVER (PARTITION BY workflow ORDER BY at_ms, record_id) AS n FROM tra),
r AS (SELECT workflow, n, CAST(latency_ms AS DOUBLE) AS ewma FROM o WHERE n = 1 UNION ALL SELECT o.workflow, o.n, r.ewma * 0.8 + o.latency_ms * 0.2 FROM r JOIN o ON o.workflow = r.workflow AND o.n = r.n + 1)
SELECT workflow, round(arg_max(ewma, n), 4) AS ewma FROM r GROUP BY 1""")
def latency_ewma(spark, sf_dir):
    return T.smoothed(trace(spark, sf_dir), "workflow").withColumn("ewma", F.round("ewma", 4))


@query("token_budget_gate", f"""WITH {TRACE}, d AS (SELECT workflow, record_id, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS t, input_tokens IS NULL OR output_tokens IS NULL AS m, at_ms FROM tra WHERE event = 'completion')
SELECT workflow, record_id, CAST(sum(t) OVER w AS BIGINT) AS used, CASE WHEN bool_or(m) OVER w THEN 'unavailable' WHEN sum(t) OVER w >= 600 THEN 'reached' ELSE 'open' END AS gate FROM d WINDOW w AS (PARTITION BY workflow ORDER BY at_ms, record_id)""")
def token_budget_gate(spark, sf_dir):
    return T.budget_gate(trace(spark, sf_dir), 600, "workflow")


@query("history_replay", f"WITH {TRACE} SELECT max(record_id) + 1 AS next_id, CAST(sum(CASE WHEN event = 'completion' THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END) AS BIGINT) AS tokens, count(*) FILTER (event = 'completion') AS completions, count(*) FILTER (event = 'failure') AS failures FROM tra")
def history_replay(spark, sf_dir):
    return T.replayed_state(trace(spark, sf_dir))


@query("adaptive_admission")
def adaptive_admission(spark, sf_dir):
    """Caps replayed over the log; the tests compare with a plain replay and with the streaming form."""
    return A.admission(trace(spark, sf_dir), limits=LIMITS)


@query("response_times", f"""WITH {TRACE}, d AS (SELECT workflow, latency_ms, row_number() OVER (PARTITION BY workflow ORDER BY at_ms DESC, record_id DESC) AS n FROM tra WHERE event = 'completion' AND latency_ms IS NOT NULL),
k AS (SELECT workflow, string_agg(latency_ms, ',' ORDER BY n DESC) AS latencies FROM d WHERE n <= 50 GROUP BY 1), b AS (SELECT workflow, count(*) FILTER (hedge) AS hedges, max(exchange_id) + 1 AS next_exchange FROM tra WHERE event = 'request' GROUP BY 1)
SELECT workflow, latencies, hedges, next_exchange FROM k FULL JOIN b USING (workflow)""")
def response_times(spark, sf_dir):
    return A.response_times(trace(spark, sf_dir), "workflow").withColumn("latencies", F.array_join(F.transform("latencies", lambda x: x.cast("string")), ","))


@query("due_hedges", f"""WITH {TRACE}, l AS (SELECT workflow, at_ms, record_id, row_number() OVER (PARTITION BY workflow ORDER BY at_ms, record_id) AS n, latency_ms FROM tra WHERE event = 'completion' AND latency_ms IS NOT NULL),
p AS (SELECT workflow, at_ms, record_id, CASE WHEN n >= 10 THEN list_sort(list(latency_ms) OVER w)[(len(list(latency_ms) OVER w) * 4 + 4) // 5] END AS p80 FROM l WINDOW w AS (PARTITION BY workflow ORDER BY n ROWS 49 PRECEDING)),
u AS (SELECT workflow, at_ms, record_id, p80, NULL AS exchange_id FROM p UNION ALL SELECT workflow, at_ms, record_id, NULL, exchange_id FROM tra WHERE event = 'request' AND NOT hedge),
f AS (SELECT workflow, at_ms, record_id, exchange_id, last_value(p80 IGNORE NULLS) OVER (PARTITION BY workflow ORDER BY at_ms, record_id ROWS UNBOUNDED PRECEDING) AS p80 FROM u),
e AS (SELECT exchange_id, min(at_ms) AS end_ms FROM tra WHERE event IN ('completion', 'failure') GROUP BY 1)
SELECT f.workflow, f.exchange_id, record_id, at_ms, p80, 3 * p80 + 5000 AS threshold_ms, at_ms + 3 * p80 + 5000 AS due_ms, end_ms FROM f LEFT JOIN e ON e.exchange_id = f.exchange_id WHERE f.exchange_id IS NOT NULL AND p80 IS NOT NULL AND (end_ms IS NULL OR end_ms > at_ms + 3 * p80 + 5000)""")
def due_hedges(spark, sf_dir):
    return A.due_hedges(trace(spark, sf_dir), "workflow")


@query("started_hedges")
def started_hedges(spark, sf_dir):
    """Three at a time and twenty a run, of those due; the tests compare with a replay by events."""
    return A.hedges(A.due_hedges(trace(spark, sf_dir), "workflow"), "workflow")


@query("annotation_quality", f"WITH {PASSAGES}, q AS (SELECT novelty % 3 AS changed, chars AS compared, importance = 5 AS rejected FROM pas) SELECT count(*) AS windows, count(*) FILTER (NOT rejected AND changed = 0) AS exact, count(*) FILTER (NOT rejected AND changed > 0) AS fuzzy, count(*) FILTER (rejected) AS rejected, round(count(*) FILTER (NOT rejected AND changed = 0) * 100.0 / count(*), 6) AS exact_percent, round(count(*) FILTER (NOT rejected AND changed > 0) * 100.0 / count(*), 6) AS fuzzy_percent, round(count(*) FILTER (rejected) * 100.0 / count(*), 6) AS rejected_percent, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(compared) AS BIGINT) AS compared FROM q")
def annotation_quality(spark, sf_dir):
    own = passages(spark, sf_dir).select((F.col("novelty") % 3).alias("changed"), F.col("chars").alias("compared"), (F.col("importance") == 5).alias("rejected"))
    out = T.annotation_quality(own)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("percent")})


@query("restoration_review", f"WITH {SEGMENTS}, {TRACE} SELECT CAST(sum(length(text)) AS BIGINT) AS source_chars, CAST(sum(CASE WHEN role <> 'system' THEN length(text) END) AS BIGINT) AS restored_chars, count(*) FILTER (role = 'system') AS omitted, (SELECT count(*) FROM (SELECT window_index FROM tra GROUP BY 1 HAVING max(repair_turn) > 0)) AS repaired_windows FROM seg")
def restoration_review(spark, sf_dir):
    spans = segments(spark, sf_dir).select(F.when(F.col("role") == "system", "omitted_disfluency").otherwise("text").alias("kind"), F.col("text").alias("source_text"), "text")
    return T.restoration_review(spans, trace(spark, sf_dir).groupBy("window_index").agg(F.max("repair_turn").alias("turns")))


PARTS = "prt AS (SELECT p_brand, p_partkey, p_size AS l, CAST(floor(p_retailprice) AS BIGINT) % 40 AS r FROM part)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("left"), (F.floor("p_retailprice") % 40).alias("right"))


@query("spearman_agreement", f"WITH {PARTS}, k AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY l) + (count(*) OVER (PARTITION BY p_brand, l) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY r) + (count(*) OVER (PARTITION BY p_brand, r) - 1) / 2 AS b FROM prt) SELECT p_brand, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY 1")
def spearman_agreement(spark, sf_dir):
    return E.spearman(parts(spark, sf_dir), "p_brand").withColumn("rho", F.round("rho", 6))


@query("fractional_topk_overlap", f"""WITH {PARTS}, w AS (SELECT p_brand, greatest(0, least(1, (5 - (rank() OVER (PARTITION BY p_brand ORDER BY l DESC) - 1)) / count(*) OVER (PARTITION BY p_brand, l))) AS a, greatest(0, least(1, (5 - (rank() OVER (PARTITION BY p_brand ORDER BY r DESC) - 1)) / count(*) OVER (PARTITION BY p_brand, r))) AS b FROM prt)
SELECT p_brand, round(sum(least(a, b)) / 5, 6) AS overlap FROM w GROUP BY 1""")
def fractional_topk_overlap(spark, sf_dir):
    return E.top_k_overlap(parts(spark, sf_dir), 5, "p_brand").withColumn("overlap", F.round("overlap", 6))


COMPARED = "cmp AS (SELECT 1 + p_size % 5 AS a, 1 + p_partkey % 5 AS b, p_size * 200 AS x, CAST(floor(p_retailprice) AS BIGINT) % 10001 AS y FROM part)"


@query("ranking_comparison", f"""WITH {COMPARED} SELECT count(*) AS items, count(*) FILTER (a = b) AS same_level, count(*) FILTER (abs(a - b) <= 1) AS within_one, {', '.join(f'count(*) FILTER ((a >= {k}) <> (b >= {k})) AS flips_at_{k}' for k in range(2, 6))}, count(*) FILTER (a = 1 AND b = 5 OR a = 5 AND b = 1) AS extreme_swaps,
round(count(*) FILTER (a >= 4 AND b >= 4) / count(*) FILTER (a >= 4 OR b >= 4), 6) AS jaccard, quantile_cont(abs(x - y), 0.5) AS median_change, max(abs(x - y)) AS max_change FROM cmp""")
def ranking_comparison(spark, sf_dir):
    own = table(spark, sf_dir, "part").select((1 + F.col("p_size") % 5).alias("left_level"), (1 + F.col("p_partkey") % 5).alias("right_level"), (F.col("p_size") * 200).alias("left_points"), (F.floor("p_retailprice") % 10001).alias("right_points"))
    return E.ranking_comparison(own).withColumn("jaccard", F.round("jaccard", 6))


@query("position_bias", f"WITH {DECIDED_SQL}, c AS (SELECT slot, count(*) FILTER (most = passage_id) AS m, count(*) FILTER (least = passage_id) AS l FROM mem JOIN dec USING (comparison_id) GROUP BY slot) SELECT slot, round(m / sum(m) OVER (), 6) AS most_share, round(l / sum(l) OVER (), 6) AS least_share FROM c")
def position_bias(spark, sf_dir):
    joined = members(spark, sf_dir).join(decisions(spark, sf_dir), "comparison_id")
    own = joined.select("slot", (F.col("most") == F.col("passage_id")).alias("most"), (F.col("least") == F.col("passage_id")).alias("least"))
    return E.position_bias(own).select("slot", F.round("most_share", 6).alias("most_share"), F.round("least_share", 6).alias("least_share"))


@query("split_half_stability", f"""WITH {DECIDED_SQL}, h AS (SELECT comparison_id % 2 AS half, passage_id, (count(*) FILTER (most = passage_id) - count(*) FILTER (least = passage_id)) / count(*) AS s FROM mem JOIN dec USING (comparison_id) GROUP BY ALL),
p AS (SELECT a.passage_id, a.s AS l, b.s AS r FROM h a JOIN h b USING (passage_id) WHERE a.half = 0 AND b.half = 1), k AS (SELECT rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2 AS x, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS y FROM p) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM k""")
def split_half_stability(spark, sf_dir):
    """The score of even comparisons against that of odd ones."""
    from rostrum.operators.ranking import best_worst, counts

    half = members(spark, sf_dir).withColumn("half", F.col("comparison_id") % 2)
    own = counts(half, decisions(spark, sf_dir).withColumn("half", F.col("comparison_id") % 2), ("half",)).withColumn("s", best_worst(F.col("most"), F.col("least"), F.col("comparisons")))
    pairs = own.groupBy("passage_id").agg(F.max(F.when(F.col("half") == 0, F.col("s"))).alias("left"), F.max(F.when(F.col("half") == 1, F.col("s"))).alias("right")).filter("left IS NOT NULL AND right IS NOT NULL")
    return E.spearman(pairs).withColumn("rho", F.round("rho", 6))


@query("level_statistics", f"WITH {COUNTS_SQL} SELECT most % 5 AS level, count(*) AS n, round(avg(comparisons), 6) AS mean, quantile_cont(comparisons, 0.5) AS median, min(comparisons) AS least, max(comparisons) AS largest FROM cnt GROUP BY 1")
def level_statistics(spark, sf_dir):
    from rostrum.plans.ranking import bws_counts

    return E.level_statistics(bws_counts(spark, sf_dir).select((F.col("most") % 5).alias("level"), F.col("comparisons").alias("value"))).withColumn("mean", F.round("mean", 6))


@query("choice_agreement", "WITH c AS (SELECT l_linenumber AS variant, l_orderkey AS comparison_id, l_partkey % 4 AS choice FROM lineitem) SELECT a.variant AS \"left\", b.variant AS \"right\", count(*) AS n, count(*) FILTER (a.choice = b.choice) AS same FROM c a JOIN c b ON a.comparison_id = b.comparison_id AND a.variant < b.variant GROUP BY ALL")
def choice_agreement(spark, sf_dir):
    return E.choice_agreement(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("variant"), F.col("l_orderkey").alias("comparison_id"), (F.col("l_partkey") % 4).alias("choice")))


@query("passage_stats", f"WITH {PASSAGES} SELECT count(*) AS passages, quantile_cont(length(text), 0.5) AS median, min(length(text)) AS least, max(length(text)) AS largest, count(*) FILTER (length(text) < 40) AS short, count(*) FILTER (length(text) > 450) AS long, count(*) FILTER (NOT regexp_matches(rtrim(text), '[。！？!?.…]$')) AS nonterminal FROM pas")
def passage_stats(spark, sf_dir):
    return E.passage_statistics(passages(spark, sf_dir))


AGREED = "agr AS (SELECT p_partkey AS window_index, CASE WHEN p_size % 7 > 0 THEN p_size % 7 END AS rank, p_size % 6 AS distance, 1 + p_partkey % 9 AS frames, (p_size % 10) / 10 AS share, p_retailprice / 1000 AS margin FROM part)"


def agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("window_index"), F.when(s % 7 > 0, s % 7).alias("rank"), (s % 6).alias("distance"), (1 + F.col("p_partkey") % 9).alias("frames"), ((s % 10) / 10).alias("share"), (F.col("p_retailprice") / 1000).alias("margin"))


@query("alignment_agreement", f"""WITH {AGREED}, o AS (SELECT *, row_number() OVER (ORDER BY margin) - 1 AS place, count(*) OVER () AS n FROM agr)
SELECT count(*) AS windows, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, {', '.join(f'count(*) FILTER (distance <= {d}) AS within_{d}' for d in (0, 1, 3))}, round(sum(CASE WHEN rank = 1 THEN frames ELSE 0 END) / sum(frames), 6) AS frame_weighted,
count(*) FILTER (share >= 0.8) AS stable, count(*) FILTER (share >= 0.8 AND rank = 1) AS stable_top1, round(quantile_cont(margin, 0.5), 6) AS median_margin, round(max(margin) FILTER (place = n // 10), 6) AS p10_margin FROM o""")
def alignment_agreement(spark, sf_dir):
    out = E.alignment_agreement(agreed(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mrr", "frame_weighted", "median_margin", "p10_margin")})


@query("strongest_mismatches", f"WITH {AGREED} SELECT window_index, share FROM agr WHERE coalesce(rank, 0) <> 1 ORDER BY share DESC, window_index LIMIT 10")
def strongest_mismatches(spark, sf_dir):
    return E.mismatches(agreed(spark, sf_dir).withColumn("agrees", F.coalesce(F.col("rank") == 1, F.lit(False))), 10).select("window_index", "share")


@query("transition_counts", f"WITH {PASSAGES}, s AS (SELECT lecture_id, slide_position - lag(slide_position) OVER (PARTITION BY lecture_id ORDER BY passage_id) AS step FROM pas) SELECT lecture_id, count(*) FILTER (step < 0) AS backward, count(*) FILTER (abs(step) > 3) AS distant FROM s GROUP BY 1")
def transition_counts(spark, sf_dir):
    return E.transitions(passages(spark, sf_dir).withColumnRenamed("passage_id", "query_id"))


@query("axis_ticks", f"WITH {PASSAGES}, p AS (SELECT lecture_id, passage_id, count(*) OVER (PARTITION BY lecture_id) * 7 AS n FROM pas) SELECT lecture_id, passage_id FROM p WHERE passage_id % CAST(ceil(n / 10) AS BIGINT) = 0 OR passage_id = n - 1")
def axis_ticks(spark, sf_dir):
    from pyspark.sql import Window

    own = passages(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("lecture_id")) * 7)
    return own.filter(E.ticks(F.col("n"), F.col("passage_id"))).select("lecture_id", "passage_id")


@query("systematic_sample", "WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM p WHERE k IN (SELECT round_even(i * (n - 1) / 11, 0) FROM range(12) t(i))")
def systematic_sample(spark, sf_dir):
    return E.systematic_sample(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"])


@query("probe_summary", f"WITH {TRACE} SELECT event AS mode, repair_turn AS size, workflow AS category, count(*) AS n, count(*) FILTER (provider_attempt > 0) AS valid, count(*) FILTER (hedge) AS matches, quantile_cont(latency_ms, 0.5) AS median_ms, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM tra GROUP BY ALL")
def probe_summary(spark, sf_dir):
    rows = trace(spark, sf_dir).select(F.col("event").alias("mode"), F.col("repair_turn").alias("size"), F.col("workflow").alias("category"), (F.col("provider_attempt") > 0).alias("valid"), F.col("hedge").alias("matches"), "latency_ms", F.col("input_tokens").alias("tokens"))
    return E.probe_summary(rows)


@query("comparison_member_counts", f"WITH {MEMBERS_SQL} SELECT lecture_id, count(DISTINCT comparison_id) AS comparisons, count(*) AS candidates FROM mem GROUP BY 1")
def comparison_member_counts(spark, sf_dir):
    return members(spark, sf_dir).groupBy("lecture_id").agg(F.count_distinct("comparison_id").alias("comparisons"), F.count("*").alias("candidates"))
