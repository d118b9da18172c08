"""Integrity checks. Each gives (lecture_id, error, position): all violations, not the first alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import is_blank
from rostrum.operators.projection import provenance
from rostrum.operators.ranking import level


class ValidationError(ValueError):
    """The first violation of a table, in scan order."""


def demand(errors: DataFrame, order: tuple[str, ...] = ("lecture_id", "position")) -> None:
    first = errors.orderBy(*order).limit(1).collect()
    if first:
        raise ValidationError(str(first[0].asDict()))


def _errors(rows: DataFrame, position: str, **checks) -> DataFrame:
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("lecture_id", F.explode(found).alias("error"), F.col(position).alias("position"))


def source_errors(segments: DataFrame) -> DataFrame:
    """Ids, blank texts, timing of segments (lecture_id, id, start_ms, end_ms, text)."""
    order, whole = Window.partitionBy("lecture_id").orderBy("id"), Window.partitionBy("lecture_id")
    rows = segments.withColumns({
        "place": F.row_number().over(order) - 1, "timed": F.count("start_ms").over(whole), "n": F.count("*").over(whole),
        "last_start": F.lag("start_ms").over(order), "last_end": F.lag("end_ms").over(order),
    })
    return _errors(
        rows, "id",
        id_not_position=F.col("place") != F.col("id"), blank_text=F.coalesce(is_blank(F.col("text")), F.lit(True)),
        partial_timing=(F.col("timed") % F.col("n") != 0) & F.col("start_ms").isNull() | (F.col("start_ms").isNull() != F.col("end_ms").isNull()),
        reversed_times=F.coalesce(F.col("start_ms") > F.col("end_ms"), F.lit(False)),
        out_of_order=F.coalesce((F.col("start_ms") < F.col("last_start")) | (F.col("end_ms") < F.col("last_end")), F.lit(False)),
    )


def partition_errors(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """ranges (lecture_id, range_id, first, last) must cover bounds (lecture_id, lo, hi) once, in order."""
    order = Window.partitionBy("lecture_id").orderBy("range_id")
    rows = ranges.join(bounds, "lecture_id").withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})
    expected = F.coalesce(F.col("before") + 1, F.col("lo"))
    inside = F.col("first").between(F.col("lo"), F.col("hi")) & F.col("last").between(F.col("lo"), F.col("hi"))
    return _errors(rows, "range_id", reversed_range=F.col("first") > F.col("last"), outside=~inside, gap=F.col("first") > expected, overlap=F.col("first") < expected, missing_tail=F.col("after").isNull() & (F.col("last") < F.col("hi")))


def restored_errors(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans (lecture_id, span_index, source_start, source_end, text) of a restored transcript against its segments (lecture_id, id).

    Each must start behind the one before and end inside the transcript; text is null for what was left out on purpose, else
    it has something in it; together they cover every segment. The position is the span's, or the first segment uncovered.
    """
    order = Window.partitionBy("lecture_id").orderBy("span_index")
    sizes = segments.groupBy("lecture_id").agg(F.count("*").alias("n"))
    rows = spans.join(sizes, "lecture_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns({"expected": F.coalesce(F.lag("source_end").over(order) + 1, F.lit(0)), "last": F.lead("span_index").over(order).isNull()})
    found = _errors(
        rows, "span_index",
        end_before_start=F.col("source_end") < F.col("source_start"), outside_transcript=(F.col("source_start") >= F.col("n")) | (F.col("source_end") >= F.col("n")),
        unexpected_span=F.col("expected") >= F.col("n"), coverage_mismatch=(F.col("expected") < F.col("n")) & (F.col("source_start") != F.col("expected")),
        empty_text=F.col("text").isNotNull() & is_blank(F.col("text")),
    )
    reached = spans.groupBy("lecture_id").agg(F.max_by("source_end", "span_index").alias("end"))
    tail = sizes.join(reached, "lecture_id", "left").withColumn("position", F.coalesce(F.col("end") + 1, F.lit(0)).cast("long")).filter(F.col("position") < F.col("n"))
    return found.unionByName(tail.select("lecture_id", F.lit("uncovered_tail").alias("error"), "position"))


def artifact_errors(tables: dict[str, DataFrame], segments: DataFrame) -> DataFrame:
    """A stored analysis against the transcript it was made from.

    tables: spans as of restored_errors, passages (lecture_id, passage_id, source_start, source_end), window_diagnostics (lecture_id,
    window_index) and window_projections (lecture_id, window_index, compared_characters). A lecture has as many projections as
    diagnostics (else the position is the number of projections), none of them empty; spans and passages cover the segments.
    """
    count = lambda name, n: tables[name].groupBy("lecture_id").agg(F.count("*").alias(n))
    both = count("window_diagnostics", "want").join(count("window_projections", "got"), "lecture_id", "full_outer").select("lecture_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("want", "got")])
    uneven = both.filter("want <> got").select("lecture_id", F.lit("window_count_mismatch").alias("error"), F.col("got").alias("position"))
    empty = tables["window_projections"].filter("compared_characters = 0").select("lecture_id", F.lit("empty_projection").alias("error"), F.col("window_index").alias("position"))
    bounds = segments.groupBy("lecture_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    ranges = tables["passages"].select("lecture_id", F.col("passage_id").alias("range_id"), F.col("source_start").alias("first"), F.col("source_end").alias("last"))
    return uneven.unionByName(empty).unionByName(restored_errors(tables["spans"], segments)).unionByName(partition_errors(ranges, bounds))


def passage_text_errors(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages (lecture_id, passage_id, text) must concatenate to their source (lecture_id, text)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage_id", "text"))), lambda x: x["text"]), "")
    both = passages.groupBy("lecture_id").agg(joined.alias("got")).join(sources.select("lecture_id", F.col("text").alias("want")), "lecture_id", "full_outer")
    return both.filter(~F.col("got").eqNullSafe(F.col("want"))).select("lecture_id", F.lit("text_differs").alias("error"), F.octet_length("got").cast("long").alias("position"))


def provenance_errors(passages: DataFrame, spans: DataFrame) -> DataFrame:
    """Passages (lecture_id, passage_id, source_start, source_end, text) must name the segments that their text came from.

    spans as of projection.provenance. The passages of a lecture lie one behind the other in the text of its spans; one without
    text lies nowhere.
    """
    order = Window.partitionBy("lecture_id").orderBy("passage_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    placed = passages.withColumn("byte_end", F.sum(size).over(order)).withColumn("byte_start", F.col("byte_end") - size)
    found = provenance(placed, spans).select("lecture_id", "passage_id", F.col("source_start").alias("want_start"), F.col("source_end").alias("want_end"))
    both = placed.join(found, ["lecture_id", "passage_id"], "left")
    missing = F.col("want_start").isNull()
    differs = ~(F.col("source_start").eqNullSafe(F.col("want_start")) & F.col("source_end").eqNullSafe(F.col("want_end")))
    return _errors(both, "passage_id", empty_passage=size == 0, missing_provenance=(size > 0) & missing, provenance_differs=~missing & differs)


def related_slide_errors(passages: DataFrame, slides: DataFrame) -> DataFrame:
    """related_slides must exist and not repeat."""
    again = passages.filter(F.size("related_slides") != F.size(F.array_distinct("related_slides"))).select("lecture_id", F.lit("duplicate_slide").alias("error"), F.col("passage_id").alias("position"))
    named = passages.select("lecture_id", "passage_id", F.explode(F.array_distinct("related_slides")).alias("slide_id"))
    unknown = named.join(slides.select("lecture_id", "slide_id"), ["lecture_id", "slide_id"], "left_anti").select("lecture_id", F.lit("unknown_slide").alias("error"), F.col("passage_id").alias("position"))
    return again.unionByName(unknown)


def score5_errors(passages: DataFrame) -> DataFrame:
    """importance and novelty must be whole numbers from 0 to 5. comparative_errors checks the scores behind them."""
    return _errors(passages, "passage_id", importance_out_of_range=~F.col("importance").between(0, 5), novelty_out_of_range=~F.col("novelty").between(0, 5))


def comparative_errors(passages: DataFrame) -> DataFrame:
    """lecture_id, error, position of comparative scores: a passage has both or neither, each agrees with itself and with
    the level shown, and in a lecture either all passages have them or none (position null).

    passages (lecture_id, passage_id, importance, novelty, comparative_importance and comparative_novelty, each null or a
    struct of comparisons, most, least, points and display_level).
    """
    metrics = ("importance", "novelty")
    there = {m: F.col(f"comparative_{m}").isNotNull() for m in metrics}
    both, checks = there["importance"] & there["novelty"], {"incomplete_pair": there["importance"] != there["novelty"]}
    for m in metrics:
        own, points = (lambda name, m=m: F.col(f"comparative_{m}.{name}")), F.col(f"comparative_{m}.points")
        crowded, outside = own("most").cast("decimal(20,0)") + own("least") > own("comparisons"), ~points.between(0, 10_000)
        checks[f"{m}_too_many_choices"] = both & crowded
        checks[f"{m}_percentile_out_of_range"] = both & ~crowded & outside
        checks[f"{m}_level_mismatch"] = both & ~crowded & ~outside & (own("display_level") != level(points))
        checks[f"{m}_not_the_level_shown"] = both & ~crowded & ~outside & (own("display_level") == level(points)) & (F.col(m) != own("display_level"))
    ranked = passages.groupBy("lecture_id").agg(F.count_if(both).alias("ranked"), F.count("*").alias("n")).filter("ranked > 0 AND ranked < n")
    lectures = ranked.select("lecture_id", F.lit("incomplete_ranking").alias("error"), F.lit(None).cast(passages.schema["passage_id"].dataType).alias("position"))
    return _errors(passages, "passage_id", **checks).unionByName(lectures)


def token_errors(tokens: DataFrame) -> DataFrame:
    """Timed tokens must have text, end after they start, and not overlap."""
    order = Window.partitionBy("lecture_id").orderBy("pos")
    rows = tokens.withColumn("last_end", F.lag("end_ms").over(order))
    return _errors(rows, "pos", empty_token=F.col("text") == "", no_duration=F.col("end_ms") <= F.col("start_ms"), overlap=F.coalesce(F.col("start_ms") < F.col("last_end"), F.lit(False)))
