"""Compositions: passages from cuts, scores and paths; comparison tasks with evidence; rankings attached and revalidated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import alignment, projection, ranking, segmentation, windows


def cut_passages(texts: DataFrame, costs: DataFrame) -> DataFrame:
    """lecture_id, passage_id, text, byte_start, byte_end of texts (lecture_id, text) cut by costs (lecture_id, atom_id, cut) of the gaps after atoms.

    A lecture that can't be cut legally has no passages; ``segmentation.partition`` names it.
    """
    atoms = windows.atom_table(texts)
    parts = segmentation.partition(atoms.join(costs, ["lecture_id", "atom_id"], "left")).filter("error IS NULL")
    named = parts.select("lecture_id", "passage_id", F.explode(F.sequence(F.col("atom_start"), F.col("atom_end") - 1)).alias("atom_id"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom_id", "text"))), lambda x: x["text"]), "")
    grouped = named.join(atoms, ["lecture_id", "atom_id"]).groupBy("lecture_id", "passage_id").agg(joined.alias("text"))
    order = Window.partitionBy("lecture_id").orderBy("passage_id")
    end = F.sum(F.octet_length("text")).over(order)
    return grouped.withColumn("byte_end", end).withColumn("byte_start", F.col("byte_end") - F.octet_length("text"))


def assemble(texts: DataFrame, costs: DataFrame, spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Passages with their source segments and slide positions; scores of importance and novelty start at 0.

    scores (lecture_id, query_id = passage_id, slide_id, score) are whole rows of the lecture's slides.
    """
    passages = cut_passages(texts, costs)
    sourced = passages.join(projection.provenance(passages.select("lecture_id", "passage_id", "byte_start", "byte_end"), spans), ["lecture_id", "passage_id"], "left")
    path = alignment.slide_path(scores).withColumnRenamed("query_id", "passage_id")
    return sourced.join(path, ["lecture_id", "passage_id"], "left").withColumn("importance", F.lit(0)).withColumn("novelty", F.lit(0)).withColumn("related_slides", F.array().cast("array<bigint>"))


def comparison_tasks(members: DataFrame, passages: DataFrame, evidence: DataFrame, batch_size: int) -> DataFrame:
    """lecture_id, batch, comparisons and candidates, and each slide that any candidate's evidence names, once and in order.

    members (lecture_id, comparison_id, slot, passage_id), passages (lecture_id, passage_id, text), evidence (lecture_id, passage_id, slide_id).
    """
    placed = ranking.batches(members, batch_size).join(passages.select("lecture_id", "passage_id", "text"), ["lecture_id", "passage_id"])
    shown = placed.select("lecture_id", "batch", "passage_id").distinct().join(evidence, ["lecture_id", "passage_id"])
    slides = shown.groupBy("lecture_id", "batch").agg(F.sort_array(F.collect_set("slide_id")).alias("slides"))
    items = F.sort_array(F.collect_list(F.struct("comparison_id", "slot", "passage_id", "text")))
    grouped = placed.groupBy("lecture_id", "batch").agg(F.count_distinct("comparison_id").alias("comparisons"), items.alias("candidates"))
    return grouped.join(slides, ["lecture_id", "batch"], "left")


def with_rankings(passages: DataFrame, importance: DataFrame, novelty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages with both comparative scores (lecture_id, passage_id, points, display_level), and the errors that forbid it."""
    key = ["lecture_id", "passage_id"]
    out, errors = passages, None
    for name, scores in (("importance", importance), ("novelty", novelty)):
        missing = passages.join(scores, key, "left_anti").select(*key, F.lit(f"{name}_missing").alias("error"))
        extra = scores.join(passages, key, "left_anti").select(*key, F.lit(f"{name}_unknown").alias("error"))
        wrong = scores.filter(F.col("display_level") != ranking.level(F.col("points"))).select(*key, F.lit(f"{name}_level_mismatch").alias("error"))
        found = missing.unionByName(extra).unionByName(wrong)
        errors = found if errors is None else errors.unionByName(found)
        out = out.join(scores.select(*key, F.struct("points", "display_level").alias(f"comparative_{name}")), key)
    return out, errors


def projected_windows(analyses: DataFrame, spans: DataFrame, slides: DataFrame) -> DataFrame:
    """Window analyses (lecture_id, window_id, source, proposed, related array of arrays) as passages of source text.

    Proposed texts give boundaries only; related slides that the deck lacks make a passage's error.
    """
    cut = projection.project_passages(analyses.select("window_id", "source", "proposed"))
    related = analyses.select("window_id", "lecture_id", F.posexplode("related").alias("passage_id", "related_slides"))
    joined = cut.join(related, ["window_id", "passage_id"], "left")
    known = slides.groupBy("lecture_id").agg(F.collect_set("slide_id").alias("known"))
    checked = joined.join(known, "lecture_id", "left")
    unknown = F.size(F.array_except(F.coalesce("related_slides", F.array().cast("array<bigint>")), F.coalesce("known", F.array().cast("array<bigint>")))) > 0
    return checked.withColumn("error", F.coalesce("error", F.when(unknown, "unknown_slide"))).drop("known")
