"""Checked queries over compositions of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import assembly as Y
from rostrum.operators import intervals as I
from rostrum.operators import ranking as R
from rostrum.plans.registry import query
from rostrum.plans.sequences import passage_novel_evidence
from rostrum.plans.standins import PASSAGES, passages, segments
from rostrum.plans.windows import decks

#: Passages of a lecture are compared in fours of neighbours, once.
GROUPED = f"{PASSAGES}, gro AS (SELECT lecture_id, passage_id // 4 AS comparison_id, passage_id % 4 AS slot, passage_id, text FROM pas)"
EVIDENCE = "evi AS (SELECT lecture_id, passage_id, unnest(range(greatest(slide_position - 3, 0), slide_position + 4)) AS slide_id FROM pas UNION SELECT lecture_id, passage_id, novelty * 2 FROM pas UNION SELECT lecture_id, passage_id, importance + 20 FROM pas)"


@query("comparison_tasks", f"""WITH {GROUPED}, {EVIDENCE}, s AS (SELECT lecture_id, comparison_id // 2 AS batch, list_sort(list_distinct(list(slide_id))) AS slides FROM gro JOIN evi USING (lecture_id, passage_id) GROUP BY ALL)
SELECT g.lecture_id, g.comparison_id // 2 AS batch, count(DISTINCT comparison_id) AS comparisons, count(*) AS candidates, array_to_string(any_value(slides), ' ') AS slides FROM gro g JOIN s ON s.lecture_id = g.lecture_id AND s.batch = g.comparison_id // 2 GROUP BY ALL""")
def comparison_tasks(spark, sf_dir):
    k, own = F.col("passage_id"), passages(spark, sf_dir)
    members = own.select("lecture_id", F.floor(k / 4).alias("comparison_id"), (k % 4).alias("slot"), "passage_id")
    out = Y.comparison_tasks(members, own, passage_novel_evidence(spark, sf_dir), 2)
    return out.select("lecture_id", "batch", "comparisons", F.size("candidates").cast("long").alias("candidates"), F.array_join(F.transform("slides", lambda s: s.cast("string")), " ").alias("slides"))


@query("rankings_attached", f"""WITH {PASSAGES} SELECT lecture_id, passage_id, 'importance_missing' AS error FROM pas WHERE importance = 5 UNION ALL SELECT lecture_id, passage_id + 1000, 'novelty_unknown' FROM pas WHERE novelty = 4
UNION ALL SELECT lecture_id, passage_id, 'novelty_missing' FROM pas WHERE novelty = 4 UNION ALL SELECT lecture_id, passage_id, 'importance_level_mismatch' FROM pas WHERE importance = 3""")
def rankings_attached(spark, sf_dir):
    """The errors of rankings spoilt by the scores of their passages."""
    own = passages(spark, sf_dir)
    points = (F.col("chars") % 10001).alias("points")
    scores = own.select("lecture_id", "passage_id", "importance", "novelty", points).withColumn("display_level", R.level(F.col("points")))
    importance = scores.filter("importance <> 5").withColumn("display_level", F.col("display_level") + F.when(F.col("importance") == 3, 1).otherwise(0))
    novelty = scores.withColumn("passage_id", F.col("passage_id") + F.when(F.col("novelty") == 4, 1000).otherwise(0))
    keep = ["lecture_id", "passage_id", "points", "display_level"]
    return Y.with_rankings(own, importance.select(*keep), novelty.select(*keep))[1]


@query("separated_assembly", f"WITH {PASSAGES} SELECT lecture_id, passage_id, importance, novelty, slide_position + 1 AS slide_position FROM pas")
def separated_assembly(spark, sf_dir):
    own, key, s = passages(spark, sf_dir), ["lecture_id", "passage_id"], F.col("slide_position")
    whole, _ = I.assembled(own.select(*key, F.array(s, s + 1, s + 2).alias("slide_positions")), own.select(*key, "importance"), own.select(*key, "novelty"))
    return whole.select(*key, "importance", "novelty", "slide_position")


@query("assembled_passages")
def assembled_passages(spark, sf_dir):
    """Every conversation from text to passages with sources and slides; parts are checked by their own queries and tests."""
    own = segments(spark, sf_dir)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "")
    texts = own.groupBy("lecture_id").agg(joined.alias("text"))
    from rostrum.operators.windows import atom_table

    costs = atom_table(texts).select("lecture_id", "atom_id", ((F.col("atom_id") * 5 + F.char_length("text")) % 6).alias("cut"))
    spans = own.select("lecture_id", F.col("id").alias("pos"), F.lit("text").alias("kind"), F.col("id").alias("source_start"), F.col("id").alias("source_end"), "text")
    cut = Y.cut_passages(texts, costs)
    scores = cut.select("lecture_id", F.col("passage_id").alias("query_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.char_length("text") * (k + 3)) % 17).cast("double"))).alias("slide_id", "score"))
    return Y.assemble(texts, costs, spans, scores).drop("text", "related_slides")


@query("projected_window_analyses")
def projected_window_analyses(spark, sf_dir):
    """Passages proposed with small mistakes, put back on their text; some name slides that their deck lacks."""
    own = passages(spark, sf_dir)
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = own.select("lecture_id", (F.col("lecture_id") * 1000 + F.col("passage_id")).alias("window_id"), F.col("text").alias("source"), F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1)).alias("proposed"), F.array(F.array("slide_position"), F.array(F.col("slide_position") * 9)).alias("related"))
    return Y.projected_windows(rows, None, decks(spark, sf_dir)).drop("text", "related_slides")
