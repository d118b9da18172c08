"""Checked queries over windows, atoms and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.operators import validation as V
from rostrum.operators import windows as W
from rostrum.plans.registry import checkpoint_folder, query, table
from rostrum.plans.standins import PASSAGES, SEGMENTS, TIMED, passages, segments, timed
from rostrum.sources.artifacts import read_artifact, write_artifact

GREEDY_SQL = f"""{SEGMENTS}, gre AS (SELECT lecture_id, id, length(text) AS used, 0 AS w FROM seg WHERE id = 0 UNION ALL
  SELECT s.lecture_id, s.id, length(s.text) + CASE WHEN g.used + length(s.text) > 400 THEN 0 ELSE g.used END, g.w + CASE WHEN g.used + length(s.text) > 400 THEN 1 ELSE 0 END FROM gre g JOIN seg s ON s.lecture_id = g.lecture_id AND s.id = g.id + 1),
win AS (SELECT lecture_id, CAST(w AS BIGINT) AS window_index, min(id) AS owned_start, max(id) AS owned_end FROM gre GROUP BY ALL)"""


@query("greedy_windows", f"WITH RECURSIVE {GREEDY_SQL} SELECT * FROM win")
def greedy_windows(spark, sf_dir):
    return W.greedy_windows(segments(spark, sf_dir))


@query("greedy_windows_timed", f"""WITH RECURSIVE {TIMED}, g AS (SELECT lecture_id, pos, length(event_type) AS used, start_ms AS began, 0 AS w FROM tok WHERE pos = 0 UNION ALL
  SELECT t.lecture_id, t.pos, length(t.event_type) + CASE WHEN x THEN 0 ELSE used END, CASE WHEN x THEN t.start_ms ELSE began END, w + CASE WHEN x THEN 1 ELSE 0 END
  FROM (SELECT t.*, g.used, g.began, g.w, g.used + length(t.event_type) > 30 OR t.end_ms - g.began > 86400000 AS x FROM g JOIN tok t ON t.lecture_id = g.lecture_id AND t.pos = g.pos + 1) t)
SELECT lecture_id, CAST(w AS BIGINT) AS window_index, min(pos) AS owned_start, max(pos) AS owned_end FROM g GROUP BY ALL""")
def greedy_windows_timed(spark, sf_dir):
    rows = timed(spark, sf_dir).select("lecture_id", F.col("pos").alias("id"), "start_ms", "end_ms", F.col("event_type").alias("text"))
    return W.greedy_windows(rows, 30, 86_400_000)


@query("window_context", f"""WITH RECURSIVE {GREEDY_SQL}, s AS (SELECT lecture_id, id, length(text) AS c, sum(length(text)) OVER (PARTITION BY lecture_id ORDER BY id) AS upto FROM seg)
SELECT w.*, coalesce((SELECT min(l.id) FROM s l, s f WHERE l.lecture_id = w.lecture_id AND f.lecture_id = w.lecture_id AND f.id = w.owned_start AND l.id < w.owned_start AND f.upto - f.c - l.upto + l.c <= 150), owned_start) AS visible_start,
  coalesce((SELECT max(r.id) FROM s r, s e WHERE r.lecture_id = w.lecture_id AND e.lecture_id = w.lecture_id AND e.id = w.owned_end AND r.id > w.owned_end AND r.upto - e.upto <= 150), owned_end) AS visible_end FROM win w""")
def window_context(spark, sf_dir):
    own = segments(spark, sf_dir)
    return W.with_context(W.greedy_windows(own), own)


@query("restored_windows")
def restored_windows(spark, sf_dir):
    """Windows in which system turns are omissions; the tests compare the kernel with a plain loop."""
    return W.greedy_windows(segments(spark, sf_dir).withColumn("text", F.when(F.col("role") != "system", F.col("text"))))


def lecture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lecture_id"), "text")


ATOMS_SQL = """s1 AS (SELECT doc_id AS lecture_id, i, s FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;\\n]*[。！？!?；;\\n]|[^。！？!?；;\\n]+') AS ps FROM documents)) WHERE s <> ''),
s2 AS (SELECT lecture_id, i, j, c FROM (SELECT lecture_id, i, generate_subscripts(cs, 1) AS j, unnest(cs) AS c FROM (SELECT *, CASE WHEN length(s) > 180 THEN regexp_extract_all(s, '[^，,]*[，,]|[^，,]+') ELSE [s] END AS cs FROM s1))),
s3 AS (SELECT *, length(c) AS n, CAST(ceil(length(c) / 150.0) AS BIGINT) AS parts FROM s2),
s4 AS (SELECT lecture_id, i, j, k, substr(c, k * (n // parts) + least(k, n % parts) + 1, n // parts + CASE WHEN k < n % parts THEN 1 ELSE 0 END) AS text FROM (SELECT *, unnest(range(0, parts)) AS k FROM s3)),
ato AS (SELECT lecture_id, CAST(row_number() OVER (PARTITION BY lecture_id ORDER BY i, j, k) - 1 AS BIGINT) AS atom_id, text FROM s4)"""


@query("atomize_text", f"WITH {ATOMS_SQL} SELECT * FROM ato")
def atomize_text(spark, sf_dir):
    return W.atom_table(lecture_texts(spark, sf_dir))


@query("boundary_windows", f"""WITH {ATOMS_SQL}, n AS (SELECT lecture_id, count(*) AS atoms FROM ato GROUP BY 1 HAVING count(*) > 1), w AS (SELECT lecture_id, atoms, unnest(range(0, (atoms - 2) // 48 + 1)) AS window_index FROM n)
SELECT lecture_id, window_index, window_index // 2 AS batch_index, window_index * 48 AS gap_start, least((window_index + 1) * 48, atoms - 1) AS gap_end, greatest(window_index * 48 - 8, 0) AS atom_start, least(least((window_index + 1) * 48, atoms - 1) + 9, atoms) AS atom_end FROM w""")
def boundary_windows(spark, sf_dir):
    return W.boundary_windows(atomize_text(spark, sf_dir).groupBy("lecture_id").agg(F.count("*").alias("atoms")))


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lecture's deck: documents are dealt to conversations by number."""
    lectures = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("n"))
    return table(spark, sf_dir, "documents").crossJoin(F.broadcast(lectures)).select(F.expr("pmod(doc_id, n)").alias("lecture_id"), F.expr("doc_id div n").alias("slide_id"), "text")


DECKS = "dck AS (SELECT doc_id % n AS lecture_id, doc_id // n AS slide_id, text FROM documents, (SELECT count(DISTINCT conv_id) AS n FROM conversations))"


@query("neighbourhood_evidence", f"WITH {PASSAGES}, {DECKS} SELECT p.lecture_id, passage_id, slide_position, d.slide_id FROM pas p JOIN dck d ON d.lecture_id = p.lecture_id AND abs(d.slide_id - slide_position) <= 3")
def neighbourhood_evidence(spark, sf_dir):
    return W.neighbourhood(passages(spark, sf_dir).select("lecture_id", "passage_id", "slide_position"), decks(spark, sf_dir)).select("lecture_id", "passage_id", "slide_position", "slide_id")


@query("padded_regions", f"WITH {TIMED} SELECT lecture_id, pos, greatest(start_ms - 1000, 0) AS input_start, least(end_ms + 1000, 1706000000000) AS input_end FROM tok")
def padded_regions(spark, sf_dir):
    rows = timed(spark, sf_dir).select("lecture_id", "pos", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return W.padded_regions(rows, 1000, F.lit(1706000000000)).select("lecture_id", "pos", "input_start", "input_end")


@query("coalesced_windows", f"""WITH {SEGMENTS}, r AS (SELECT lecture_id, id // 3 AS region, string_agg(text, '' ORDER BY id) AS text FROM seg GROUP BY ALL)
SELECT *, right(lag(text) OVER w, 150) AS left_context, left(lead(text) OVER w, 150) AS right_context FROM r WINDOW w AS (PARTITION BY lecture_id ORDER BY region)""")
def coalesced_windows(spark, sf_dir):
    return W.coalesced(segments(spark, sf_dir).select("lecture_id", F.col("id").alias("window_index"), "text"), 3)


@query("lecture_context", f"WITH {DECKS}, f AS (SELECT lecture_id, slide_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM dck WHERE slide_id < 2) SELECT lecture_id, left(string_agg(t, chr(10) || chr(10) ORDER BY slide_id), 3000) AS context FROM f WHERE t <> '' GROUP BY 1")
def lecture_context(spark, sf_dir):
    return W.lecture_context(decks(spark, sf_dir))


@query("window_tasks", f"""WITH {PASSAGES}, {DECKS}, e AS (SELECT p.lecture_id, p.passage_id, count(*) AS n, min(d.slide_id) AS lo FROM pas p JOIN dck d ON d.lecture_id = p.lecture_id AND abs(d.slide_id - slide_position) <= 3 GROUP BY ALL)
SELECT p.lecture_id, p.passage_id AS window_index, coalesce(n, -1) AS slides, lo AS first_slide FROM pas p LEFT JOIN e ON e.lecture_id = p.lecture_id AND e.passage_id = p.passage_id""")
def window_tasks(spark, sf_dir):
    own = passages(spark, sf_dir).withColumnRenamed("passage_id", "window_index")
    found = W.tasks(own.select("lecture_id", "window_index", "text"), own.select("lecture_id", "window_index", "slide_position"), decks(spark, sf_dir))
    return found.select("lecture_id", "window_index", F.coalesce(F.size("slides"), F.lit(-1)).cast("long").alias("slides"), F.col("slides")[0]["slide_id"].alias("first_slide"))


@query("task_errors", f"""WITH {PASSAGES}, {DECKS} SELECT lecture_id, passage_id AS window_index, 'window_without_position' AS error FROM pas WHERE passage_id % 3 = 1
UNION ALL SELECT lecture_id, passage_id + 100, 'position_without_window' FROM pas WHERE passage_id % 3 = 2
UNION ALL SELECT p.lecture_id, passage_id, 'unknown_slide' FROM pas p LEFT JOIN dck d ON d.lecture_id = p.lecture_id AND d.slide_id = p.slide_position WHERE passage_id % 3 = 0 AND d.slide_id IS NULL
UNION ALL SELECT lecture_id, passage_id, 'window_without_position' FROM pas WHERE passage_id % 3 = 2""")
def task_errors(spark, sf_dir):
    own, k = passages(spark, sf_dir), F.col("passage_id")
    positions = own.filter(k % 3 != 1).select("lecture_id", (k + F.when(k % 3 == 2, 100).otherwise(0)).alias("window_index"), "slide_position")
    return W.task_errors(own.select("lecture_id", k.alias("window_index")), positions, decks(spark, sf_dir))


@query("source_validation", f"""WITH {SEGMENTS}, b AS (SELECT lecture_id, CASE WHEN lecture_id % 10 = 3 THEN id + 1 ELSE id END AS id, CASE WHEN id = 1 AND lecture_id % 4 = 0 THEN ' ' || chr(9) ELSE text END AS text, id AS place,
  CASE WHEN lecture_id % 5 = 0 AND id = 2 THEN NULL ELSE id * 100 END AS start_ms, CASE WHEN lecture_id % 5 = 0 AND id = 2 THEN NULL WHEN lecture_id % 6 = 1 AND id = 3 THEN 10 ELSE id * 100 + 100 END AS end_ms FROM seg)
SELECT lecture_id, 'id_not_position' AS error, id AS position FROM b WHERE id <> place UNION ALL SELECT lecture_id, 'blank_text', id FROM b WHERE trim(text, ' ' || chr(9)) = ''
UNION ALL SELECT lecture_id, 'partial_timing', id FROM b WHERE start_ms IS NULL UNION ALL SELECT lecture_id, 'reversed_times', id FROM b WHERE start_ms > end_ms UNION ALL SELECT lecture_id, 'out_of_order', id FROM b WHERE end_ms = 10 AND lecture_id % 5 <> 0""")
def source_validation(spark, sf_dir):
    """Segments spoilt by their numbers."""
    lecture, k = F.col("lecture_id"), F.col("id")
    gone = (lecture % 5 == 0) & (k == 2)
    own = segments(spark, sf_dir).withColumns({
        "start_ms": F.when(~gone, k * 100), "end_ms": F.when(~gone, F.when((lecture % 6 == 1) & (k == 3), 10).otherwise(k * 100 + 100)),
        "text": F.when((k == 1) & (lecture % 4 == 0), " \t").otherwise(F.col("text")),
    })
    return V.source_errors(own.withColumn("id", F.when(lecture % 10 == 3, k + 1).otherwise(k)))


@query("partition_validation", f"""WITH {PASSAGES}, b AS (SELECT lecture_id, min(source_start) AS lo, max(source_end) AS hi FROM pas GROUP BY 1),
r AS (SELECT p.lecture_id, passage_id AS range_id, source_start + CASE WHEN p.lecture_id % 4 = 1 AND passage_id = 1 THEN 1 WHEN p.lecture_id % 4 = 2 AND passage_id = 1 THEN -1 ELSE 0 END AS first, source_end - CASE WHEN p.lecture_id % 4 = 3 AND source_end = hi THEN 1 ELSE 0 END AS last, lo, hi FROM pas p JOIN b USING (lecture_id)),
x AS (SELECT *, coalesce(lag(last) OVER w + 1, lo) AS want, lead(first) OVER w AS after FROM r WINDOW w AS (PARTITION BY lecture_id ORDER BY range_id))
SELECT lecture_id, 'reversed_range' AS error, range_id AS position FROM x WHERE first > last UNION ALL SELECT lecture_id, 'outside', range_id FROM x WHERE NOT (first BETWEEN lo AND hi AND last BETWEEN lo AND hi)
UNION ALL SELECT lecture_id, 'gap', range_id FROM x WHERE first > want UNION ALL SELECT lecture_id, 'overlap', range_id FROM x WHERE first < want UNION ALL SELECT lecture_id, 'missing_tail', range_id FROM x WHERE after IS NULL AND last < hi""")
def partition_validation(spark, sf_dir):
    own = passages(spark, sf_dir)
    bounds = own.groupBy("lecture_id").agg(F.min("source_start").alias("lo"), F.max("source_end").alias("hi"))
    lecture, second = F.col("lecture_id") % 4, F.col("passage_id") == 1
    spoilt = own.join(bounds.select("lecture_id", F.col("hi").alias("top")), "lecture_id").select(
        "lecture_id", F.col("passage_id").alias("range_id"), (F.col("source_start") + F.when((lecture == 1) & second, 1).when((lecture == 2) & second, -1).otherwise(0)).alias("first"),
        (F.col("source_end") - F.when((lecture == 3) & (F.col("source_end") == F.col("top")), 1).otherwise(0)).alias("last"),
    )
    return V.partition_errors(spoilt, bounds)


@query("restored_validation", f"""WITH {PASSAGES}, z AS (SELECT lecture_id, count(*) AS n FROM seg GROUP BY 1),
r AS (SELECT lecture_id, passage_id AS i, source_start + CASE WHEN lecture_id % 7 = 1 AND passage_id = 1 THEN 1 ELSE 0 END AS a, source_end + CASE WHEN lecture_id % 7 = 2 AND passage_id = 0 THEN -2 WHEN lecture_id % 7 = 3 THEN 3 ELSE 0 END AS b,
  CASE WHEN passage_id % 4 = 3 THEN NULL WHEN passage_id % 5 = 2 THEN ' ' ELSE text END AS text FROM pas WHERE NOT (lecture_id % 7 = 4 AND passage_id > 1)),
x AS (SELECT r.*, n, coalesce(lag(b) OVER (PARTITION BY lecture_id ORDER BY i) + 1, 0) AS w FROM r JOIN z USING (lecture_id))
SELECT lecture_id, 'end_before_start' AS error, i AS position FROM x WHERE b < a UNION ALL SELECT lecture_id, 'outside_transcript', i FROM x WHERE a >= n OR b >= n UNION ALL SELECT lecture_id, 'unexpected_span', i FROM x WHERE w >= n
UNION ALL SELECT lecture_id, 'coverage_mismatch', i FROM x WHERE w < n AND a <> w UNION ALL SELECT lecture_id, 'empty_text', i FROM x WHERE text = ' '
UNION ALL SELECT lecture_id, 'uncovered_tail', e + 1 FROM (SELECT lecture_id, any_value(n) AS n, max_by(b, i) AS e FROM x GROUP BY 1) WHERE e + 1 < n""")
def restored_validation(spark, sf_dir):
    """Passages as restored spans, spoilt by their numbers."""
    lecture, k = F.col("lecture_id") % 7, F.col("passage_id")
    spans = passages(spark, sf_dir).filter(~((lecture == 4) & (k > 1))).select(
        "lecture_id", k.alias("span_index"), (F.col("source_start") + F.when((lecture == 1) & (k == 1), 1).otherwise(0)).alias("source_start"),
        (F.col("source_end") + F.when((lecture == 2) & (k == 0), -2).when(lecture == 3, 3).otherwise(0)).alias("source_end"), F.when(k % 4 == 3, F.lit(None).cast("string")).when(k % 5 == 2, " ").otherwise(F.col("text")).alias("text"),
    )
    return V.restored_errors(spans, segments(spark, sf_dir))


@query("passage_text_validation", f"WITH {PASSAGES} SELECT lecture_id, 'text_differs' AS error, CAST(sum(strlen(text)) AS BIGINT) AS position FROM pas WHERE lecture_id % 3 = 0 GROUP BY 1")
def passage_text_validation(spark, sf_dir):
    own = segments(spark, sf_dir)
    whole = own.groupBy("lecture_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "").alias("text"))
    return V.passage_text_errors(passages(spark, sf_dir), whole.withColumn("text", F.when(F.col("lecture_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))


@query("provenance_validation", f"""WITH {PASSAGES} SELECT lecture_id, 'provenance_differs' AS error, passage_id AS position FROM pas WHERE passage_id % 3 = 1 OR (passage_id % 3 = 2 AND source_start <> source_end)""")
def provenance_validation(spark, sf_dir):
    """Passages whose first or last segment is named wrongly."""
    k = F.col("passage_id")
    own = passages(spark, sf_dir).withColumns({"source_end": F.when(k % 3 == 2, F.col("source_start")).otherwise(F.col("source_end")), "source_start": F.when(k % 3 == 1, F.col("source_start") - 1).otherwise(F.col("source_start"))})
    spans = segments(spark, sf_dir).select("lecture_id", F.col("id").alias("pos"), F.lit("text").alias("kind"), F.col("id").alias("source_start"), F.col("id").alias("source_end"), "text")
    return V.provenance_errors(own, spans)


@query("related_slide_validation", f"""WITH {PASSAGES}, {DECKS}, r AS (SELECT lecture_id, passage_id, [slide_position, novelty * 11, slide_position % 3] AS s FROM pas)
SELECT lecture_id, 'duplicate_slide' AS error, passage_id AS position FROM r WHERE len(s) <> len(list_distinct(s))
UNION ALL SELECT u.lecture_id, 'unknown_slide', passage_id FROM (SELECT lecture_id, passage_id, unnest(list_distinct(s)) AS slide_id FROM r) u LEFT JOIN dck USING (lecture_id, slide_id) WHERE dck.slide_id IS NULL""")
def related_slide_validation(spark, sf_dir):
    own = passages(spark, sf_dir).withColumn("related_slides", F.array("slide_position", F.col("novelty") * 11, F.col("slide_position") % 3))
    return V.related_slide_errors(own, decks(spark, sf_dir))


@query("score_validation", f"WITH {PASSAGES}, s AS (SELECT lecture_id, passage_id, importance + 3 AS i, novelty - 1 AS n FROM pas) SELECT lecture_id, 'importance_out_of_range' AS error, passage_id AS position FROM s WHERE i > 5 UNION ALL SELECT lecture_id, 'novelty_out_of_range', passage_id FROM s WHERE n < 0")
def score_validation(spark, sf_dir):
    return V.score5_errors(passages(spark, sf_dir).withColumns({"importance": F.col("importance") + 3, "novelty": F.col("novelty") - 1}))


@query("comparative_validation", f"""WITH {PASSAGES}, s AS (SELECT *, lecture_id % 3 > 0 AND chars % 17 <> 0 AS has_i, lecture_id % 3 > 0 AND chars % 13 <> 0 AS has_n, (chars * 37) % 10500 AS points FROM pas),
v AS (SELECT *, least(points // 2000 + 1, 5) AS lev, least(points // 2000 + 1, 5) + CASE WHEN chars % 19 = 0 THEN 1 ELSE 0 END AS shown, chars % 4 + chars % 3 > 4 AS crowded FROM s),
e AS (SELECT lecture_id, passage_id, m, has_i AND has_n AS own, crowded, points, lev, shown, m = 'importance' AND chars % 7 = 0 AS other FROM v, (SELECT unnest(['importance', 'novelty']) AS m))
SELECT lecture_id, 'incomplete_pair' AS error, passage_id AS position FROM v WHERE has_i <> has_n
UNION ALL SELECT lecture_id, m || '_too_many_choices', passage_id FROM e WHERE own AND crowded
UNION ALL SELECT lecture_id, m || '_percentile_out_of_range', passage_id FROM e WHERE own AND NOT crowded AND points > 10000
UNION ALL SELECT lecture_id, m || '_level_mismatch', passage_id FROM e WHERE own AND NOT crowded AND points <= 10000 AND shown <> lev
UNION ALL SELECT lecture_id, m || '_not_the_level_shown', passage_id FROM e WHERE own AND NOT crowded AND points <= 10000 AND shown = lev AND other
UNION ALL SELECT lecture_id, 'incomplete_ranking', NULL FROM v GROUP BY lecture_id HAVING count(*) FILTER (has_i AND has_n) BETWEEN 1 AND count(*) - 1""")
def comparative_validation(spark, sf_dir):
    """Scores spoilt by the length of the passage; every third lecture has none."""
    c, some = F.col("chars"), F.col("lecture_id") % 3 > 0
    shown = F.least(F.floor(c * 37 % 10500 / 2000) + 1, F.lit(5)) + (c % 19 == 0).cast("long")
    score = F.struct(F.lit(4).alias("comparisons"), (c % 4).alias("most"), (c % 3).alias("least"), (c * 37 % 10500).alias("points"), shown.alias("display_level"))
    rows = passages(spark, sf_dir).withColumns({"comparative_importance": F.when(some & (c % 17 != 0), score), "comparative_novelty": F.when(some & (c % 13 != 0), score), "importance": shown + (c % 7 == 0).cast("long"), "novelty": shown})
    return V.comparative_errors(rows)


@query("token_validation", f"""WITH {TIMED}, t AS (SELECT lecture_id, pos, CASE WHEN pos % 17 = 3 THEN '' ELSE event_type END AS text, start_ms, CASE WHEN pos % 13 = 5 THEN start_ms WHEN pos % 11 = 2 THEN end_ms + 1 ELSE end_ms END AS end_ms FROM tok),
l AS (SELECT *, lag(end_ms) OVER (PARTITION BY lecture_id ORDER BY pos) AS last_end FROM t)
SELECT lecture_id, 'empty_token' AS error, pos AS position FROM l WHERE text = '' UNION ALL SELECT lecture_id, 'no_duration', pos FROM l WHERE end_ms <= start_ms UNION ALL SELECT lecture_id, 'overlap', pos FROM l WHERE start_ms < last_end""")
def token_validation(spark, sf_dir):
    k = F.col("pos")
    own = timed(spark, sf_dir).select("lecture_id", "pos", F.when(k % 17 == 3, "").otherwise(F.col("event_type")).alias("text"), "start_ms", F.when(k % 13 == 5, F.col("start_ms")).when(k % 11 == 2, F.col("end_ms") + 1).otherwise(F.col("end_ms")).alias("end_ms"))
    return V.token_errors(own)


@query("artifact_revalidation", f"""WITH {PASSAGES} SELECT lecture_id, 'window_count_mismatch' AS error, count(*) - 1 AS position FROM pas WHERE lecture_id % 5 = 1 GROUP BY 1
UNION ALL SELECT lecture_id, 'empty_projection', passage_id FROM pas WHERE lecture_id % 5 = 2 AND passage_id = 0
UNION ALL SELECT lecture_id, 'uncovered_tail', max(id) FROM seg WHERE lecture_id % 5 = 3 GROUP BY 1
UNION ALL SELECT lecture_id, 'overlap', passage_id FROM pas WHERE lecture_id % 5 = 4 AND passage_id = 1""")
def artifact_revalidation(spark, sf_dir):
    """Stored tables of which some lectures lack a projection or a span, hold an empty projection, or passages that overlap."""
    own, kind, path = passages(spark, sf_dir), F.col("lecture_id") % 5, f"{checkpoint_folder(spark)}-artifact"
    windows = own.select("lecture_id", F.col("passage_id").alias("window_index"), F.when((kind == 2) & (F.col("passage_id") == 0), 0).otherwise(F.col("chars")).alias("compared_characters"))
    rows = segments(spark, sf_dir)
    tail = F.col("id") == F.max("id").over(Window.partitionBy("lecture_id"))
    spans = rows.withColumn("tail", tail).filter(~((kind == 3) & F.col("tail"))).select("lecture_id", F.col("id").alias("span_index"), F.col("id").alias("source_start"), F.col("id").alias("source_end"), "text")
    tables = {
        "spans": spans, "passages": own.withColumn("source_start", F.col("source_start") - F.when((kind == 4) & (F.col("passage_id") == 1), 1).otherwise(0)),
        "window_diagnostics": windows.select("lecture_id", "window_index"), "window_projections": windows.filter(~((kind == 1) & (F.col("window_index") == 0))),
    }
    write_artifact(tables, path)
    return V.artifact_errors(read_artifact(spark, path, tuple(tables)), rows)
