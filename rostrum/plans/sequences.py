"""Checked queries over alignment, segmentation, projection and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import clock
from rostrum.operators import alignment as A
from rostrum.operators import frames as V
from rostrum.operators import intervals as I
from rostrum.operators import projection as P
from rostrum.operators import segmentation as S
from rostrum.operators import windows as W
from rostrum.plans.registry import query, table
from rostrum.plans.standins import PASSAGES, PICTURE, SEGMENTS, TIMED, brighter_below, passages, pictures, segments, timed
from rostrum.plans.windows import ATOMS_SQL, atomize_text

#: Orders give score rows: a customer is a lecture, blocks of ten orders are passages, places in a block are slides.
SCORES_SQL = "sco AS (SELECT (o_orderkey // 100) AS lecture_id, (o_orderkey // 10) % 10 AS query_id, o_orderkey % 10 AS slide_id, o_totalprice AS score FROM orders)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(o / 100).alias("lecture_id"), (F.floor(o / 10) % 10).alias("query_id"), (o % 10).alias("slide_id"), F.col("o_totalprice").alias("score"))
    return rows


@query("minmax_emissions", f"WITH {SCORES_SQL} SELECT lecture_id, query_id, slide_id, score, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS emission FROM sco WINDOW w AS (PARTITION BY lecture_id, query_id)")
def minmax_emissions(spark, sf_dir):
    return A.emissions(scores(spark, sf_dir)).withColumn("emission", F.round("emission", 6))


@query("slide_path_dp", f"""WITH RECURSIVE {SCORES_SQL}, e AS (SELECT *, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS x FROM sco WINDOW w AS (PARTITION BY lecture_id, query_id)),
em AS (SELECT lecture_id, query_id, slide_id, coalesce(x, 0) AS x FROM e),
p AS (SELECT lecture_id, query_id, slide_id, x AS total, [slide_id] AS path FROM em WHERE query_id = 0 AND slide_id = 0 UNION ALL
  SELECT lecture_id, query_id, slide_id, total, path FROM (SELECT em.lecture_id, em.query_id, em.slide_id, p.total - CASE WHEN abs(p.slide_id - em.slide_id) <= 3 THEN abs(p.slide_id - em.slide_id) * 0.05 ELSE 0.5 + (abs(p.slide_id - em.slide_id) - 4) * 0.02 END + em.x AS total,
    list_append(p.path, em.slide_id) AS path, row_number() OVER (PARTITION BY em.lecture_id, em.query_id, em.slide_id ORDER BY p.total - CASE WHEN abs(p.slide_id - em.slide_id) <= 3 THEN abs(p.slide_id - em.slide_id) * 0.05 ELSE 0.5 + (abs(p.slide_id - em.slide_id) - 4) * 0.02 END DESC, p.slide_id DESC) AS n
    FROM p JOIN em ON em.lecture_id = p.lecture_id AND em.query_id = p.query_id + 1) WHERE n = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY query_id DESC, total DESC, slide_id DESC) AS n FROM p)
SELECT lecture_id, CAST(i - 1 AS BIGINT) AS query_id, path[i] AS slide_position FROM (SELECT lecture_id, path, unnest(range(1, len(path) + 1)) AS i FROM b WHERE n = 1)""")
def slide_path_dp(spark, sf_dir):
    return A.slide_path(scores(spark, sf_dir))


@query("best_and_runner_up", f"WITH {SCORES_SQL}, r AS (SELECT lecture_id * 10 + query_id AS query_id, slide_id, score, row_number() OVER (PARTITION BY lecture_id, query_id ORDER BY score DESC, slide_id) AS n FROM sco) SELECT query_id, max(slide_id) FILTER (n = 1) AS best, max(score) FILTER (n = 1) AS best_score, max(slide_id) FILTER (n = 2) AS second, max(score) FILTER (n = 2) AS second_score FROM r GROUP BY 1")
def best_and_runner_up(spark, sf_dir):
    return A.best_and_runner_up(scores(spark, sf_dir).withColumn("query_id", F.col("lecture_id") * 10 + F.col("query_id")))


@query("frame_matches")
def frame_matches(spark, sf_dir):
    """Frames are pages whose lower half is a little brighter; each finds its page, and one that looks like it. Tested window by window."""
    pages = pictures(spark, sf_dir)
    frames = pages.select("lecture_id", (F.col("slide_id") * 1000).alias("at_ms"), F.pandas_udf(brighter_below, "binary")("pixels").alias("pixels"))
    return V.matched(frames, pages, *PICTURE).select("lecture_id", "at_ms", "best", F.round("best_score", 6).alias("best_score"), "second", F.round("second_score", 6).alias("second_score"), "error")


FRAMES_SQL = f"""{TIMED}, itv AS (SELECT lecture_id, pos AS item, start_ms, start_ms + 60000 * (pos % 40) AS end_ms FROM tok), fra AS (SELECT lecture_id, start_ms + 1800000 AS at_ms, event_type AS label FROM tok),
nea AS (SELECT i.lecture_id, item, at_ms, label, at_ms BETWEEN start_ms AND end_ms AS inside, abs(at_ms - (start_ms + end_ms) // 2) AS far FROM itv i JOIN fra f ON f.lecture_id = i.lecture_id AND (at_ms BETWEEN start_ms AND end_ms OR abs(at_ms - (start_ms + end_ms) // 2) <= 7200000)),
cho AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY lecture_id, item) AS any_in, row_number() OVER (PARTITION BY lecture_id, item ORDER BY far, at_ms) AS n FROM nea) WHERE inside OR (NOT any_in AND n = 1))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir)
    intervals = rows.select("lecture_id", F.col("pos").alias("item"), "start_ms", (F.col("start_ms") + 60000 * (F.col("pos") % 40)).alias("end_ms"))
    return A.frames_in(intervals, rows.select("lecture_id", (F.col("start_ms") + 1_800_000).alias("at_ms"), F.col("event_type").alias("label")), 7_200_000, 3_600_000)


@query("nearest_within_tolerance", f"WITH {FRAMES_SQL} SELECT lecture_id, item, at_ms, label, inside FROM cho")
def nearest_within_tolerance(spark, sf_dir):
    return frames(spark, sf_dir).select("lecture_id", "item", "at_ms", "label", "inside")


@query("majority_label_tiebreak", f"WITH {FRAMES_SQL}, c AS (SELECT lecture_id, item, label, count(*) AS n FROM cho GROUP BY ALL) SELECT lecture_id, item, label, n, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY lecture_id, item) AS share, row_number() OVER (PARTITION BY lecture_id, item ORDER BY n DESC, label) AS p FROM c) WHERE p = 1")
def majority_label_tiebreak(spark, sf_dir):
    return A.majority(frames(spark, sf_dir), ["lecture_id", "item"], "label").withColumn("share", F.round("share", 6))


@query("segmentation_dp")
def segmentation_dp(spark, sf_dir):
    """Passages of every document from costs by its gaps' numbers; the tests compare small ones with exhaustive search."""
    return S.partition(atomize_text(spark, sf_dir).withColumn("cut", (F.col("atom_id") * 7 + F.char_length("text")) % 6))


@query("segmentation_prototype")
def segmentation_prototype(spark, sf_dir):
    return S.partition(S.boundary_labels(atomize_text(spark, sf_dir)).withColumnRenamed("label", "cut"), prototype=True)


@query("heuristic_boundaries", f"""WITH {ATOMS_SQL}, l AS (SELECT *, regexp_replace(lead(text) OVER (PARTITION BY lecture_id ORDER BY atom_id), '^[\\s\\p{{Z}}\\x{{85}}\\x{{1C}}-\\x{{1F}}\\x{{0B}}]+', '') AS f FROM ato)
SELECT lecture_id, atom_id, CASE WHEN f IS NULL THEN NULL WHEN regexp_matches(f, '^(好，那么接下来|好，我们接下来|下面我们|最后我们)') THEN 'required_break' WHEN regexp_matches(f, '^(那么|首先|其次|另外|还有一种|举个例子|比如说|所以大家可以看到)') THEN 'preferred_break'
  WHEN regexp_matches(text, '[。！？!?\\n][^。！？!?\\n；;：:，,]*\\z') THEN 'possible_break' ELSE 'continue' END AS label FROM l""")
def heuristic_boundaries(spark, sf_dir):
    return S.boundary_labels(atomize_text(spark, sf_dir)).select("lecture_id", "atom_id", "label")


@query("boundary_coverage", f"""WITH {ATOMS_SQL}, g AS (SELECT lecture_id, unnest(range(0, count(*) - 1)) AS gap FROM ato GROUP BY 1),
d AS (SELECT lecture_id, gap + CASE WHEN gap % 31 = 7 THEN 100000 ELSE 0 END AS gap, CASE WHEN gap % 29 = 4 THEN 6 ELSE gap % 6 END AS cost FROM g WHERE gap % 37 <> 5 UNION ALL SELECT lecture_id, gap, 1 FROM g WHERE gap % 41 = 9)
SELECT coalesce(g.lecture_id, x.lecture_id) AS lecture_id, coalesce(g.gap, x.gap) AS gap, CASE WHEN g.gap IS NULL THEN 'unknown_gap' WHEN n IS NULL THEN 'missing_gap' WHEN n > 1 THEN 'duplicate_gap' ELSE 'cost_out_of_range' END AS error
FROM g FULL JOIN (SELECT lecture_id, gap, count(*) AS n, min(cost) AS lo, max(cost) AS hi FROM d GROUP BY ALL) x ON g.lecture_id = x.lecture_id AND g.gap = x.gap WHERE g.gap IS NULL OR n IS NULL OR n > 1 OR lo < 0 OR hi > 5""")
def boundary_coverage(spark, sf_dir):
    windows = W.boundary_windows(atomize_text(spark, sf_dir).groupBy("lecture_id").agg(F.count("*").alias("atoms")))
    gaps = windows.select("lecture_id", F.explode(F.sequence(F.col("gap_start"), F.col("gap_end") - 1)).alias("gap"))
    g = F.col("gap")
    got = gaps.filter(g % 37 != 5).select("lecture_id", (g + F.when(g % 31 == 7, 100000).otherwise(0)).alias("gap"), F.when(g % 29 == 4, 6).otherwise(g % 6).alias("cut_cost"))
    return S.gap_errors(windows, got.unionByName(gaps.filter(g % 41 == 9).select("lecture_id", "gap", F.lit(1).cast("long").alias("cut_cost"))))


@query("sentence_segmentation", f"""WITH {TIMED}, t AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM tok)
SELECT lecture_id, CAST(sentence AS BIGINT) AS sentence, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(CASE WHEN event_type = 'purchase' THEN 'buy!' ELSE event_type END, '' ORDER BY pos) AS text FROM t GROUP BY ALL""")
def sentence_segmentation(spark, sf_dir):
    words = F.when(F.col("event_type") == "purchase", "buy!").otherwise(F.col("event_type"))
    return S.sentences(timed(spark, sf_dir).withColumn("text", words))


@query("region_fallback", f"""WITH {TIMED}, w AS (SELECT lecture_id, bool_and(pos < 9) AS ok FROM tok GROUP BY 1)
SELECT lecture_id, pos AS sentence, start_ms, end_ms, CASE WHEN ok THEN event_type || '!' ELSE event_type END AS text FROM tok JOIN w USING (lecture_id)""")
def region_fallback(spark, sf_dir):
    """Lectures of at most nine events have token times everywhere; others fall back to their regions."""
    own = timed(spark, sf_dir)
    whole = S.sentences(own.withColumn("text", F.concat("event_type", F.lit("!"))))
    return S.with_region_fallback(whole, own.select("lecture_id", F.col("pos").alias("region"), "start_ms", "end_ms", F.col("event_type").alias("text"), (F.col("pos") < 9).alias("complete")))


@query("stitched_windows", f"""WITH {SEGMENTS}, p AS (SELECT lecture_id, id // 2 AS w, id % 2 AS pos, text, length(text) % 5 AS slide, length(text) % 3 = 0 AS continues FROM seg),
n AS (SELECT *, CAST(sum(CASE WHEN NOT continues OR pos > 0 OR (w = 0 AND pos = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY w, pos) - 1 AS BIGINT) AS passage_id FROM p)
SELECT lecture_id, passage_id, string_agg(text, '' ORDER BY w, pos) AS text, len(list_distinct(list(slide))) AS slides FROM n GROUP BY ALL""")
def stitched_windows(spark, sf_dir):
    k, n = F.col("id"), F.char_length("text")
    pieces = segments(spark, sf_dir).select("lecture_id", F.floor(k / 2).alias("window_index"), (k % 2).alias("pos"), (n % 3 == 0).alias("continues"), "text", (n % 5).alias("slide"))
    return S.stitched(pieces).withColumn("slides", F.size("slides").cast("long"))


@query("passage_projection")
def passage_projection(spark, sf_dir):
    """Every document's words in proposed passages of forty, each third copied with a mistake; the tests hold golden values."""
    words = F.split("text", "(?<= )")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 40)), lambda k: F.array_join(F.slice("w", (k * 40 + 1).cast("int"), 40), ""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("window_id"), F.col("text").alias("source"), words.alias("w"))
    proposed = rows.select("window_id", "source", F.transform(cut, lambda p, k: F.when(k % 3 == 2, F.concat(p, F.lit("x"))).otherwise(p)).alias("proposed"))
    return P.project_passages(proposed)


@query("source_provenance", f"""WITH {PASSAGES}, s AS (SELECT lecture_id, id, role, strlen(text) AS n, sum(CASE WHEN role = 'system' THEN 0 ELSE strlen(text) END) OVER (PARTITION BY lecture_id ORDER BY id) AS e FROM seg),
b AS (SELECT lecture_id, passage_id, passage_id * 700 AS byte_start, passage_id * 700 + 700 AS byte_end FROM pas)
SELECT b.lecture_id, passage_id, min(id) AS source_start, max(id) AS source_end FROM b JOIN s ON s.lecture_id = b.lecture_id AND role <> 'system' AND byte_start < e AND byte_end > e - n GROUP BY ALL""")
def source_provenance(spark, sf_dir):
    spans = segments(spark, sf_dir).select("lecture_id", F.col("id").alias("pos"), F.when(F.col("role") == "system", "omitted_disfluency").otherwise("text").alias("kind"), F.col("id").alias("source_start"), F.col("id").alias("source_end"), "text")
    own = passages(spark, sf_dir).select("lecture_id", "passage_id", (F.col("passage_id") * 700).alias("byte_start"), (F.col("passage_id") * 700 + 700).alias("byte_end"))
    return P.provenance(own, spans)


@query("islands_by_overlap", f"""WITH {TIMED}, p AS (SELECT lecture_id, pos AS passage_id, pos * 3 AS source_start, pos * 3 + event_id % 7 AS source_end FROM tok),
m AS (SELECT *, max(source_end) OVER (PARTITION BY lecture_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM p)
SELECT lecture_id, passage_id, source_start, source_end, CAST(sum(CASE WHEN f IS NULL OR source_start > f THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY passage_id) - 1 AS BIGINT) AS island FROM m""")
def islands_by_overlap(spark, sf_dir):
    k = F.col("pos")
    return P.islands(timed(spark, sf_dir).select("lecture_id", k.alias("passage_id"), (k * 3).alias("source_start"), (k * 3 + F.col("event_id") % 7).alias("source_end")))


@query("playback_projection")
def playback_projection(spark, sf_dir):
    """Events as spoken tokens, groups of four as passages; the tests hold golden values."""
    tokens = timed(spark, sf_dir).withColumn("text", F.concat("event_type", F.col("event_id").cast("string")))
    group = F.floor(F.col("pos") / 4)
    own = tokens.groupBy("lecture_id", group.alias("passage_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return P.playback(own.withColumn("source_start", F.col("passage_id")).withColumn("source_end", F.col("passage_id")), tokens)


@query("asr_token_normalisation")
def asr_token_normalisation(spark, sf_dir):
    """A user's events within a day as a region's tokens; the tests hold golden values."""
    own = timed(spark, sf_dir).withColumn("region", F.floor(F.col("start_ms") / 86_400_000))
    begin = F.col("region") * 86_400_000
    items = F.sort_array(F.collect_list(F.struct("pos", "event_type", ((F.col("start_ms") - begin) / 1000).alias("at"))))
    grouped = own.groupBy("lecture_id", "region").agg(items.alias("i"))
    return P.normalized_tokens(grouped.select("lecture_id", "region", begin.alias("input_start"), (begin + 86_400_000).alias("input_end"), (begin + 3_600_000).alias("owned_start"), (begin + 80_000_000).alias("owned_end"), F.transform("i", lambda x: x["event_type"]).alias("tokens"), F.transform("i", lambda x: x["at"]).alias("starts"), F.array().cast("array<double>").alias("durations")))


@query("interval_overlap_join", f"WITH {TIMED}, g AS (SELECT lecture_id, pos // 10 AS grp, min(start_ms) AS s, max(end_ms) AS e FROM tok GROUP BY ALL) SELECT g.lecture_id, grp, count(*) AS tokens, min(t.pos) AS first, max(t.pos) AS last FROM g JOIN tok t ON t.lecture_id = g.lecture_id AND t.end_ms > s AND t.start_ms < e GROUP BY ALL")
def interval_overlap_join(spark, sf_dir):
    rows = timed(spark, sf_dir)
    groups = rows.groupBy("lecture_id", F.floor(F.col("pos") / 10).alias("grp")).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    return I.overlapping(groups, rows.select("lecture_id", "pos", "start_ms", "end_ms"), 3_600_000).groupBy("lecture_id", "grp").agg(F.count("*").alias("tokens"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("playhead_lookup", f"""WITH {TIMED}, h AS (SELECT lecture_id, pos AS head, start_ms + 500 AS at_ms FROM tok), i AS (SELECT lecture_id, pos, start_ms - 100000 * (pos % 4) AS s, end_ms + 1000 AS e, pos % 3 = 0 AS precise FROM tok)
SELECT lecture_id, head, pos FROM (SELECT h.lecture_id, head, pos, row_number() OVER (PARTITION BY h.lecture_id, head ORDER BY precise DESC, s DESC, pos) AS n FROM h JOIN i ON i.lecture_id = h.lecture_id AND at_ms >= s AND at_ms < e) WHERE n = 1""")
def playhead_lookup(spark, sf_dir):
    k = F.col("pos")
    rows = timed(spark, sf_dir)
    heads = rows.select("lecture_id", k.alias("head"), (F.col("start_ms") + 500).alias("at_ms"))
    spans = rows.select("lecture_id", "pos", (F.col("start_ms") - 100000 * (k % 4)).alias("start_ms"), (F.col("end_ms") + 1000).alias("end_ms"), (k % 3 == 0).alias("precise"))
    return I.playing(heads, spans, 3_600_000).select("lecture_id", "head", "pos")


@query("passage_timestamps", f"WITH {TIMED}, p AS (SELECT lecture_id, pos // 5 AS passage_id, min(pos) AS a, max(pos) AS b FROM tok GROUP BY ALL) SELECT p.lecture_id, passage_id, s.start_ms, e.end_ms FROM p JOIN tok s ON s.lecture_id = p.lecture_id AND s.pos = a JOIN tok e ON e.lecture_id = p.lecture_id AND e.pos = b")
def passage_timestamps(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumnRenamed("pos", "id")
    own = rows.groupBy("lecture_id", F.floor(F.col("id") / 5).alias("passage_id")).agg(F.min("id").alias("source_start"), F.max("id").alias("source_end"))
    return I.coarse_times(own, rows).select("lecture_id", "passage_id", "start_ms", "end_ms")


@query("passage_segments", f"WITH {PASSAGES} SELECT p.lecture_id, passage_id, string_agg(s.text, ' ' ORDER BY s.id) AS text FROM pas p JOIN seg s ON s.lecture_id = p.lecture_id AND s.id BETWEEN source_start AND source_end GROUP BY ALL")
def passage_segments(spark, sf_dir):
    return I.segment_texts(passages(spark, sf_dir).drop("text"), segments(spark, sf_dir), " ")


@query("slide_to_passages", f"WITH {PASSAGES} SELECT lecture_id, slide_position, min(passage_id) AS first_passage, len(list(passage_id)) AS passages FROM pas GROUP BY ALL")
def slide_to_passages(spark, sf_dir):
    return I.passages_of_slides(passages(spark, sf_dir)).select("lecture_id", "slide_position", "first_passage", F.size("passages").cast("long").alias("passages"))


@query("formatted_clock", f"""WITH {TIMED}, m AS (SELECT lecture_id, pos, (start_ms - 1704067200000) % 9000000 AS ms FROM tok)
SELECT lecture_id, pos, CASE WHEN ms // 1000 >= 3600 THEN lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST((ms // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((ms // 1000) % 60 AS VARCHAR), 2, '0') AS at FROM m""")
def formatted_clock(spark, sf_dir):
    return timed(spark, sf_dir).select("lecture_id", "pos", clock((F.col("start_ms") - 1704067200000) % 9000000).alias("at"))


@query("passage_novel_evidence", f"""WITH {PASSAGES}, u AS (SELECT lecture_id, passage_id, unnest(range(greatest(slide_position - 3, 0), slide_position + 4)) AS slide_id FROM pas UNION SELECT lecture_id, passage_id, novelty * 2 FROM pas UNION SELECT lecture_id, passage_id, importance + 20 FROM pas) SELECT lecture_id, passage_id, slide_id FROM u""")
def passage_novel_evidence(spark, sf_dir):
    p = passages(spark, sf_dir)
    near = p.select("lecture_id", "passage_id", F.explode(F.sequence(F.greatest(F.col("slide_position") - 3, F.lit(0)), F.col("slide_position") + 3)).alias("slide_id"))
    return I.evidence(near, p.select("lecture_id", "passage_id", (F.col("novelty") * 2).alias("slide_id")), p.select("lecture_id", "passage_id", (F.col("importance") + 20).alias("slide_id")))


@query("old_edge_cuts", f"""WITH {PASSAGES}, n AS (SELECT lecture_id, passage_id, sum(length(text)) OVER (PARTITION BY lecture_id ORDER BY passage_id) AS edge FROM pas), o AS (SELECT lecture_id, sum(n) OVER (PARTITION BY lecture_id ORDER BY piece) AS edge FROM (SELECT lecture_id, id // 3 AS piece, sum(length(text)) AS n FROM seg GROUP BY ALL))
SELECT lecture_id, passage_id, EXISTS (SELECT 1 FROM o WHERE o.lecture_id = n.lecture_id AND o.edge = n.edge) AS on_old_edge FROM n""")
def old_edge_cuts(spark, sf_dir):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "")
    old = segments(spark, sf_dir).groupBy("lecture_id", F.floor(F.col("id") / 3).alias("piece")).agg(joined.alias("text"))
    return I.on_old_edges(passages(spark, sf_dir).select("lecture_id", "passage_id", "text"), old)
