"""Ownership windows over ordered text: greedy budgets, context, atoms, boundary windows, neighbourhoods, tasks.

A greedy cut depends on the cut before it, so W1 and its variant for restored
spans run as a kernel per lecture; everything else is prefix sums and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import CLAUSE_ENDS, SENTENCE_ENDS, split_after, trimmed

#: Budgets of windows and atoms.
MAX_CHARS, MAX_MS, CONTEXT_CHARS = 400, 60_000, 150
LONG_ATOM, MAX_ATOM, OWNED_GAPS, CONTEXT_ATOMS, WINDOWS_PER_BATCH = 180, 150, 48, 8, 2
NEIGHBOURS, LECTURE_CONTEXT = 3, 3_000


def greedy_windows(rows: DataFrame, max_chars: int = MAX_CHARS, max_ms: int = MAX_MS) -> DataFrame:
    """lecture_id, window_index, owned_start, owned_end (inclusive ids).

    A window takes rows while its characters and its time stay in budget; its first
    row always fits. rows (lecture_id, id, start_ms, end_ms, text): a row whose text is
    null is an omission, which costs nothing and never starts a new window, so a
    lecture of omissions alone has no window.
    """
    sized = rows.select("lecture_id", F.struct("id", "start_ms", "end_ms", F.char_length("text").alias("chars")).alias("r"))
    own = sized.groupBy("lecture_id").agg(F.sort_array(F.collect_list("r")).alias("r")).select("lecture_id", *(F.col(f"r.{c}").alias(c) for c in ("id", "start_ms", "end_ms", "chars")))

    def cut(ids: list, starts: list, ends: list, chars: list) -> list[list[int]]:
        out, first, used, spoken = [], None, 0, False
        for k, (row, n) in enumerate(zip(ids, chars, strict=True)):
            omitted = n is None
            total = used + (n or 0)
            late = first is not None and starts[first] is not None and ends[k] is not None and max(ends[k] - starts[first], 0) > max_ms
            if first is None or (spoken and not omitted and (total > max_chars or late)):
                first, total, spoken = k, n or 0, False
                out.append([len(out), row, row])
            out[-1][2] = row
            used, spoken = total, spoken or not omitted
        return out if any(n is not None for n in chars) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("lecture_id").type
            found = [(lecture, *window) for lecture, *lists in zip(*(column.to_pylist() for column in batch.columns), strict=True) for window in cut(*lists)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(columns, (kind, *[pa.int64()] * 3), strict=True)], ["lecture_id", "window_index", "owned_start", "owned_end"])

    kind = rows.schema["lecture_id"].dataType.simpleString()
    return own.mapInArrow(run, f"lecture_id {kind}, window_index long, owned_start long, owned_end long")


def with_context(windows: DataFrame, rows: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Adds visible_start and visible_end: whole rows either side of the owned ones within a budget of characters."""
    order = Window.partitionBy("lecture_id").orderBy("id")
    sums = rows.select("lecture_id", "id", F.coalesce(F.char_length("text"), F.lit(0)).alias("c"))
    sums = sums.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("c"))
    at = sums.select("lecture_id", F.col("id").alias("owned_start"), "before")
    end = sums.select("lecture_id", F.col("id").alias("owned_end"), F.col("upto").alias("after"))
    placed = windows.join(at, ["lecture_id", "owned_start"]).join(end, ["lecture_id", "owned_end"])
    # rows and the places that windows may reach to lie on one line of characters: the row next to a place is read in one pass over it
    none = F.lit(None).cast("long")
    window = [F.col(c) for c in ("window_index", "owned_start", "owned_end")]

    def reached(place: Column, row_at: str, ahead: bool) -> DataFrame:
        spots = placed.select("lecture_id", place.cast("long").alias("at"), F.lit(0 if ahead else 1).alias("kind"), none.alias("id"), F.struct(*window).alias("w"))
        own = sums.select("lecture_id", F.col(row_at).cast("long").alias("at"), F.lit(1 if ahead else 0).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast(spots.schema["w"].dataType).alias("w"))
        line = Window.partitionBy("lecture_id").orderBy(*(F.col(c) if not ahead else F.col(c).desc() for c in ("at", "kind", "id")))
        met = F.last("id", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
        return spots.unionByName(own).withColumn("met", met).filter("w IS NOT NULL").select("lecture_id", "w.*", "met")

    keys = ["lecture_id", "window_index", "owned_start", "owned_end"]
    left = reached(F.col("before") - budget, "before", True).withColumnRenamed("met", "l")
    right = reached(F.col("after") + budget, "upto", False).withColumnRenamed("met", "r")
    out = left.join(right, keys)
    return out.select(*keys, F.least("l", "owned_start").alias("visible_start"), F.greatest("r", "owned_end").alias("visible_end"))


def _evenly(piece: Column) -> Column:
    """A piece in parts of at most MAX_ATOM characters whose lengths differ by one at most, longer ones first."""
    n = F.char_length(piece)
    parts = F.ceil(n / MAX_ATOM).cast("int")
    short, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    cut = lambda k: F.substr(piece, k * short + F.least(k, longer) + 1, short + (k < longer).cast("int"))
    return F.when(n <= MAX_ATOM, F.array(piece)).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), cut))


def atoms(text: Column) -> Column:
    """Sentences; long ones cut after clauses; what is still long cut evenly. Concatenated, they are the text."""
    sentences = split_after(text, SENTENCE_ENDS + "\n")
    clauses = F.flatten(F.transform(sentences, lambda s: F.when(F.char_length(s) > LONG_ATOM, split_after(s, CLAUSE_ENDS)).otherwise(F.array(s))))
    return F.flatten(F.transform(clauses, _evenly))


def atom_table(texts: DataFrame) -> DataFrame:
    """lecture_id, atom_id, text."""
    return texts.select("lecture_id", F.posexplode(atoms(F.col("text"))).alias("atom_id", "text")).withColumn("atom_id", F.col("atom_id").cast("long"))


def boundary_windows(counts: DataFrame) -> DataFrame:
    """Windows over the gaps between atoms. counts (lecture_id, atoms): window, batch, owned gaps [first, end), visible atoms [first, end)."""
    gaps = F.col("atoms") - 1
    own = counts.filter("atoms > 1").select("lecture_id", "atoms", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((gaps - 1) / OWNED_GAPS))).alias("window_index"))
    start, end = F.col("window_index") * OWNED_GAPS, F.least((F.col("window_index") + 1) * OWNED_GAPS, F.col("atoms") - 1)
    return own.select("lecture_id", "window_index", F.floor(F.col("window_index") / WINDOWS_PER_BATCH).alias("batch_index"), start.alias("gap_start"), end.alias("gap_end"), F.greatest(start - CONTEXT_ATOMS, F.lit(0)).alias("atom_start"), F.least(end + 1 + CONTEXT_ATOMS, F.col("atoms")).alias("atom_end"))


def neighbourhood(positions: DataFrame, slides: DataFrame, radius: int = NEIGHBOURS) -> DataFrame:
    """positions (lecture_id, item, slide_position) with every slide within the radius: an equi-join on each nearby place."""
    near = positions.withColumn("slide_id", F.explode(F.sequence(F.col("slide_position") - radius, F.col("slide_position") + radius)))
    return near.join(slides, ["lecture_id", "slide_id"])


def padded_regions(regions: DataFrame, pad: int, total: Column) -> DataFrame:
    """Regions widened on both sides and clipped to the recording."""
    return regions.withColumn("input_start", F.greatest(F.col("start") - pad, F.lit(0))).withColumn("input_end", F.least(F.col("end") + pad, total))


def coalesced(windows: DataFrame, per_region: int) -> DataFrame:
    """Neighbouring windows joined into regions, with the ends of the regions around as context."""
    grouped = windows.groupBy("lecture_id", F.expr(f"window_index div {per_region}").alias("region")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window_index", "text"))), lambda x: x["text"]), "").alias("text"))
    order = Window.partitionBy("lecture_id").orderBy("region")
    return grouped.withColumn("left_context", F.right(F.lag("text").over(order), F.lit(CONTEXT_CHARS))).withColumn("right_context", F.left(F.lead("text").over(order), F.lit(CONTEXT_CHARS)))


def lecture_context(slides: DataFrame) -> DataFrame:
    """lecture_id, context: the first two slides, trimmed, without empty ones, within 3,000 characters."""
    first = slides.filter("slide_id < 2").withColumn("text", trimmed(F.col("text"))).filter("text <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slide_id", "text"))), lambda x: x["text"]), "\n\n")
    return first.groupBy("lecture_id").agg(F.left(joined, F.lit(LECTURE_CONTEXT)).alias("context"))


def tasks(windows: DataFrame, positions: DataFrame, slides: DataFrame) -> DataFrame:
    """One task per window with its position and the slides around it in order. windows and positions share (lecture_id, window_index)."""
    near = neighbourhood(positions, slides)
    evidence = near.groupBy("lecture_id", "window_index", "slide_position").agg(F.sort_array(F.collect_list(F.struct("slide_id", "text"))).alias("slides"))
    return windows.join(evidence, ["lecture_id", "window_index"], "left")


def task_errors(windows: DataFrame, positions: DataFrame, slides: DataFrame) -> DataFrame:
    """lecture_id, window_index, error: windows without a position, positions without a window, unknown slides."""
    joined = windows.select("lecture_id", "window_index", F.lit(1).alias("w")).join(positions, ["lecture_id", "window_index"], "full_outer")
    known = slides.select("lecture_id", F.col("slide_id").alias("slide_position"), F.lit(1).alias("s")).distinct()
    checked = joined.join(known, ["lecture_id", "slide_position"], "left")
    error = F.when(F.col("w").isNull(), "position_without_window").when(F.col("slide_position").isNull(), "window_without_position").when(F.col("s").isNull(), "unknown_slide")
    return checked.select("lecture_id", "window_index", error.alias("error")).filter("error IS NOT NULL")
