"""Cutting atoms into passages: the exact lexicographic objective, the additive prototype, heuristics, sentences, stitching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import BLANK

#: The longest passage, and the rewards and lengths of the prototype's objective.
MAX_PASSAGE, PROTOTYPE_MAX = 300, 450
REWARDS = {"continue": -14, "possible_break": -2, "preferred_break": 4, "required_break": 16}
PREFERRED = (80, 280)
#: Openings of the next atom that ask for a break before it, and endings of this one.
REQUIRED_OPENINGS = ("好，那么接下来", "好，我们接下来", "下面我们", "最后我们")
PREFERRED_OPENINGS = ("那么", "首先", "其次", "另外", "还有一种", "举个例子", "比如说", "所以大家可以看到")
ENDINGS, PAUSES = "\n。！？!?", "；;：:，,"
#: White space that is passed over before an opening is looked at, as a class of a regular expression.
LEADING = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}]"


def best_ranges(sizes: list[int], gains: list[int | None], charges: list[int]) -> list[tuple[int, int]] | None:
    """Ranges [start, end) of atoms with the most gain: gains of the cuts behind atoms, less the charge of each range's size.

    A gain that is None forbids the cut; the last atom's counts for the end. Ranges beyond the charges' sizes are not
    allowed; None if nothing is left. Equal totals keep the shorter last range.
    """
    places, totals, starts, came = [0], [0], [0], {}
    upto = low = 0
    for end, (size, gain) in enumerate(zip(sizes, gains, strict=True), 1):
        upto += size
        while low < len(places) and upto - places[low] >= len(charges):
            low += 1
        if gain is None or low == len(places):
            continue
        top, k = max((totals[k] - charges[upto - places[k]], k) for k in range(low, len(places)))
        came[end] = starts[k]
        places.append(upto)
        totals.append(top + gain)
        starts.append(end)
    end, out = len(sizes), []
    while end:
        if end not in came:
            return None
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def best_cuts(lengths: list[int], costs: list[int], limit: int = MAX_PASSAGE) -> list[tuple[int, int]] | None:
    """Atom ranges that minimise cuts of cost 5, then 4, ... then 1, then passages, then squared lengths. None if an atom alone is too long.

    Each of these is a digit of one number, in a base that it can't reach.
    """
    passage = limit * sum(lengths) + limit + 1
    base = len(lengths) + 1
    gains = [-passage * base**cost if cost else 0 for cost in costs[: len(lengths) - 1]]
    return best_ranges(lengths, [*gains, 0][: len(lengths)], [passage + n * n for n in range(limit + 1)])


def prototype_cuts(lengths: list[int], labels: list[str], limit: int = PROTOTYPE_MAX) -> list[tuple[int, int]] | None:
    """Atom ranges that maximise rewards of cuts less an eighth of what a passage lacks, or a twelfth of what it has too much. A gap labelled continue is never cut."""
    gains = [None if label == "continue" else 24 * REWARDS[label] for label in labels[: len(lengths) - 1]]
    charges = [3 * max(PREFERRED[0] - n, 0) + 2 * max(n - PREFERRED[1], 0) for n in range(limit + 1)]
    return best_ranges(lengths, [*gains, 0][: len(lengths)], charges)


def partition(atoms: DataFrame, prototype: bool = False) -> DataFrame:
    """lecture_id, passage_id, atom_start, atom_end (exclusive), chars, error. atoms (lecture_id, atom_id, text, cut): cut is the gap's cost after it, or its label.

    A lecture that can't be cut legally gives one row with error no_partition and nulls. Null costs count as 0, null labels as continue.
    """
    cut = F.coalesce("cut", F.lit("continue")) if prototype else F.coalesce(F.col("cut").cast("long"), F.lit(0).cast("long"))
    items = F.sort_array(F.collect_list(F.struct("atom_id", F.char_length("text").alias("n"), cut.alias("cut"))))
    lectures = atoms.groupBy("lecture_id").agg(items.alias("i")).select("lecture_id", F.transform("i", lambda x: x["n"]).alias("n"), F.transform("i", lambda x: x["cut"]).alias("cut"))
    cuts = prototype_cuts if prototype else best_cuts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = [], []
            for k, (sizes, gaps) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = cuts(sizes, gaps)
                rows += [(p, a, b, sum(sizes[a:b]), None) for p, (a, b) in enumerate(found)] if found is not None else [(None, None, None, None, "no_partition")]
                own += [k] * (len(rows) - len(own))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.record_batch([batch.column(0).take(pa.array(own)), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["lecture_id", "passage_id", "atom_start", "atom_end", "chars", "error"])

    kind = atoms.schema["lecture_id"].dataType.simpleString()
    return lectures.mapInArrow(run, f"lecture_id {kind}, passage_id long, atom_start long, atom_end long, chars long, error string")


def boundary_labels(atoms: DataFrame) -> DataFrame:
    """Adds label, of the gap after each atom but the last: by how the next one opens, and how this one ends."""
    following = F.regexp_replace(F.lead("text").over(Window.partitionBy("lecture_id").orderBy("atom_id")), f"^{LEADING}+", "")
    opens = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: following.startswith(w))
    # of the marks in an atom the last one says how it ends, whatever follows
    ends = F.col("text").rlike(rf"[{ENDINGS}][^{ENDINGS}{PAUSES}]*\z")
    label = F.when(following.isNull(), None).when(opens(REQUIRED_OPENINGS), "required_break").when(opens(PREFERRED_OPENINGS), "preferred_break").when(ends, "possible_break").otherwise("continue")
    return atoms.withColumn("label", label)


def gap_errors(windows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Owned gaps against returned cut costs: missing, unknown and repeated gaps, costs out of 0..5."""
    owned = windows.select("lecture_id", F.explode(F.sequence(F.col("gap_start"), F.col("gap_end") - 1)).alias("gap"), F.lit(1).alias("owned"))
    got = decisions.groupBy("lecture_id", "gap").agg(F.count("*").alias("n"), F.min("cut_cost").alias("lo"), F.max("cut_cost").alias("hi"))
    joined = owned.join(got, ["lecture_id", "gap"], "full_outer")
    error = F.when(F.col("owned").isNull(), "unknown_gap").when(F.col("n").isNull(), "missing_gap").when(F.col("n") > 1, "duplicate_gap").when((F.col("lo") < 0) | (F.col("hi") > 5), "cost_out_of_range")
    return joined.select("lecture_id", "gap", error.alias("error")).filter("error IS NOT NULL")


def sentences(tokens: DataFrame, endings: str = "[。！？；!?;]$") -> DataFrame:
    """lecture_id, sentence, start_ms, end_ms, text: tokens joined up to one that ends a sentence."""
    order = Window.partitionBy("lecture_id").orderBy("pos")
    ends = F.col("text").rlike(endings).cast("long")
    numbered = tokens.withColumn("sentence", F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.groupBy("lecture_id", "sentence").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


def with_region_fallback(sentences: DataFrame, regions: DataFrame) -> DataFrame:
    """Sentences of lectures whose regions all have token times; of others, one segment per region.

    regions (lecture_id, region, start_ms, end_ms, text, complete).
    """
    whole = regions.groupBy("lecture_id").agg(F.bool_and("complete").alias("all"))
    kept = sentences.join(whole.filter("all").select("lecture_id"), "lecture_id", "left_semi")
    coarse = regions.filter(f"text rlike '[^{BLANK.replace(chr(92), chr(92) * 2)}]'").join(whole.filter("NOT all").select("lecture_id"), "lecture_id", "left_semi")
    return kept.unionByName(coarse.select("lecture_id", F.col("region").alias("sentence"), "start_ms", "end_ms", "text"))


def stitched(pieces: DataFrame) -> DataFrame:
    """Pieces (lecture_id, window_index, pos, continues, text, slide) joined where a window's first goes on from the window before.

    Gives lecture_id, passage_id, text, slides in the order first seen. A lecture's first piece never continues.
    """
    order = Window.partitionBy("lecture_id").orderBy("window_index", "pos")
    first = F.row_number().over(order) == 1
    starts = (~F.col("continues") | (F.col("pos") > 0) | first).cast("long")
    numbered = pieces.withColumn("passage_id", F.sum(starts).over(order) - 1)
    items = F.sort_array(F.collect_list(F.struct("window_index", "pos", "text", "slide")))
    grouped = numbered.groupBy("lecture_id", "passage_id").agg(items.alias("i"))
    return grouped.select("lecture_id", "passage_id", F.array_join(F.transform("i", lambda x: x["text"]), "").alias("text"), F.array_distinct(F.transform("i", lambda x: x["slide"])).alias("slides"))


def cut_penalty(costs: Column) -> Column:
    """The share of cuts that damage, for reports."""
    return F.avg((costs > 0).cast("double"))
