"""Projecting proposed passages onto source text and onto time, by a character diff."""

from __future__ import annotations

import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, pairwise
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Changed characters from which a projection is refused, and matched ones that playback needs, in percent.
MAX_CHANGED, MIN_MATCHED = 5, 60


@dataclass(frozen=True)
class Edit:
    """Source range [a, b) against proposed range [c, d); equal or changed."""

    equal: bool
    a: int
    b: int
    c: int
    d: int


def edits(source: str, proposed: str, most: int | None = None) -> list[Edit] | None:
    """The shortest edit script as alternating equal and changed blocks; None if it takes over ``most`` insertions and deletions."""
    n, m = len(source), len(proposed)
    lead = _alike(source, 0, proposed, 0)
    tail = _alike(source[lead:][::-1], 0, proposed[lead:][::-1], 0)
    old, new = source[lead : n - tail], proposed[lead : m - tail]
    # a common beginning and end add nothing to what sets the texts apart
    inner = None if most is not None and apart(old, new) > most else _runs(old, new, most)
    if inner is None:
        return None
    out: list[Edit] = []
    x = y = 0
    for i, j, size in [(0, 0, lead), *((lead + i, lead + j, size) for i, j, size in inner), (n - tail, m - tail, tail)]:
        if i > x or j > y:
            out.append(Edit(False, x, i, y, j))
        elif size and out:
            i, j, size = out[-1].a, out[-1].c, size + out[-1].b - out[-1].a
            out.pop()
        if size:
            out.append(Edit(True, i, i + size, j, j + size))
        x, y = i + size, j + size
    return out


def _alike(a: str, x: int, b: str, y: int) -> int:
    """How many characters are the same from ``x`` and ``y`` on."""
    most, done, size = min(len(a) - x, len(b) - y), 0, 8
    while done < most and a[x + done : x + done + size] == b[y + done : y + done + size]:
        done, size = done + size, 2 * size
    if done >= most:
        return max(most, 0)
    # the first difference lies within the last stretch
    size = min(size, most - done)
    while size > 1:
        half = size // 2
        if a[x + done : x + done + half] == b[y + done : y + done + half]:
            done, size = done + half, size - half
        else:
            size = half
    return done + (a[x + done] == b[y + done])


def apart(a: str, b: str) -> int:
    """Characters, with repeats, that one text has and the other hasn't: every edit script takes so many edits at least."""
    x, y = Counter(a), Counter(b)
    return (x - y).total() + (y - x).total()


#: Edits up to which furthest-reaching paths are kept at least; beyond, rows of bits take less, but in long texts.
NEAR = 128


def _runs(old: str, new: str, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """A longest common subsequence as runs: place in ``old``, place in ``new``, length; None beyond ``most`` edits.

    Of several, both ways give the one that, followed from the end, skips a character of ``new`` where it can, else one of ``old``.
    Paths take the square of the edits, rows of bits the product of the lengths.
    """
    n, m = len(old), len(new)
    edge = n + m if most is None else min(n + m, most)
    near = max(NEAR, isqrt(n * (m // 4096 + 1)))
    found = _path_runs(old, new, min(edge, near))
    if found is not None or edge <= near:
        return found
    pairs = _by_bits(old, new, edge)
    if pairs is None:
        return None
    out: list[tuple[int, int, int]] = []
    for x, y in pairs:
        if out and (x, y) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((x, y, 1))
    return out


def _by_paths(old: str, new: str, edge: int) -> list[tuple[int, int]] | None:
    """Matched positions by ``_path_runs``."""
    runs = _path_runs(old, new, edge)
    return None if runs is None else [(x + k, y + k) for x, y, size in runs for k in range(size)]


def _path_runs(old: str, new: str, edge: int) -> list[tuple[int, int, int]] | None:
    """By the furthest-reaching paths of each distance up to ``edge``; their places are kept, 4 bytes each."""
    n, m = len(old), len(new)
    zero, history = edge + 1, []
    reach = array("i", bytes(4 * (2 * edge + 3)))
    for d in range(edge + 1):
        history.append(reach[zero - d - 1 : zero + d + 2])
        for k in range(-d, d + 1, 2):
            spot = zero + k
            x = reach[spot + 1] if k == -d or (k != d and reach[spot - 1] < reach[spot + 1]) else reach[spot - 1] + 1
            y = x - k
            if x < n and y < m and old[x] == new[y]:
                size = _alike(old, x, new, y)
                x, y = x + size, y + size
            reach[spot] = x
            if x >= n and y >= m:
                return _unwound(history, n, m)
    return None


def _by_bits(old: str, new: str, edge: int) -> list[tuple[int, int]] | None:
    """By rows of bits, one for each character of ``old``: a zero where a row's common length grows with ``new``.

    Only every so manieth row is kept, and the rows between are made again on the way back, so memory is a root of the
    table's rows: linear in ``new`` but for that root. Time is the product of the lengths over the bits of a word.
    """
    n, m = len(old), len(new)
    where: dict[str, int] = {}
    for y, c in enumerate(new):
        where[c] = where.get(c, 0) | 1 << y
    ones = (1 << m) - 1

    def after(row: int, c: str) -> int:
        hits = row & where.get(c, 0)
        return (row + hits | row - hits) & ones

    step = max(isqrt(n), 1)
    kept, row = [ones], ones
    for x in range(n):
        row = after(row, old[x])
        if (x + 1) % step == 0:
            kept.append(row)
    common = m - row.bit_count()
    if n + m - 2 * common > edge:
        return None
    out, x, y = [], n, m
    rows = {n: row}
    while x and y:
        if x - 1 not in rows:
            first = (x - 1) // step * step
            rows = {x: rows[x], first: kept[first // step]}
            for k in range(first, x - 1):
                rows[k + 1] = after(rows[k], old[k])
        if rows[x] >> (y - 1) & 1:
            y -= 1
        elif y - (rows[x - 1] & (1 << y) - 1).bit_count() == common:
            x -= 1
        else:
            x, y, common = x - 1, y - 1, common - 1
            out.append((x, y))
    return out[::-1]


def _unwound(history: list[array], x: int, y: int) -> list[tuple[int, int, int]]:
    out = []
    for d in range(len(history) - 1, -1, -1):
        reach, k = history[d], x - y
        below, above = reach[k + d], reach[k + d + 2]
        before, start = (k + 1, above) if k == -d or (k != d and below < above) else (k - 1, below)
        size = min(x - max(start, 0), y - max(start - before, 0))
        if size > 0:
            x, y = x - size, y - size
            out.append((x, y, size))
        if d:
            x, y = start, start - before
    return out[::-1]


@dataclass(frozen=True)
class Projection:
    ranges: list[tuple[int, int]] | None
    changed: int
    compared: int
    error: str | None


def project(source: str, proposed: list[str]) -> Projection:
    """Character ranges of the source for proposed passages, or why there are none. The proposed text itself is discarded.

    A changed stretch counts by its longer side, which is half its edits or more; so a script of twice the allowed change
    is given up unfinished, and changed is then what it must be at least.
    """
    if not source:
        return Projection(None, 0, 0, "empty_source")
    if not proposed:
        return Projection(None, 0, 0, "no_passages")
    if not all(proposed):
        return Projection(None, 0, 0, "empty_proposed_passage")
    joined = "".join(proposed)
    compared = max(len(source), len(joined))
    allowed = 2 * MAX_CHANGED * compared // 100 + 1
    script = edits(source, joined, allowed)
    if script is None:
        return Projection(None, allowed // 2 + 1, compared, "difference_too_large")
    changed = sum(max(e.b - e.a, e.d - e.c) for e in script if not e.equal)
    if changed * 100 >= MAX_CHANGED * compared:
        return Projection(None, changed, compared, "difference_too_large")
    ends, places, at = [e.d for e in script], [0], 0
    for passage in proposed[:-1]:
        at += len(passage)
        e = script[bisect_left(ends, at)]  # where two stretches meet, the earlier
        places.append(e.a + ((at - e.c) * (e.b - e.a) + (e.d - e.c) // 2) // max(e.d - e.c, 1))
    ranges = list(pairwise([*places, len(source)]))
    if any(a == b for a, b in ranges):
        return Projection(None, changed, compared, "empty_projected_passage")
    if any(a > b for a, b in ranges):
        return Projection(None, changed, compared, "reversed_projection")
    return Projection(ranges, changed, compared, None)


def project_passages(windows: DataFrame) -> DataFrame:
    """windows (window_id, source, proposed array<string>): one row per passage with its text and byte range, or one with the error."""

    def run(batches):
        for batch in batches:
            rows = []
            for window, source, proposed in batch.itertuples(index=False):
                found = project(source or "", list(proposed if proposed is not None else []))
                end = 0
                for k, (a, b) in enumerate(found.ranges or []):
                    start, end = end, end + len(source[a:b].encode())
                    rows.append((window, k, source[a:b], start, end, found.changed, found.compared, None))
                if found.error:
                    rows.append((window, None, None, None, None, found.changed, found.compared, found.error))
            yield pd.DataFrame(rows, columns=["window_id", "passage_id", "text", "byte_start", "byte_end", "changed", "compared", "error"]).astype({"passage_id": "Int64", "byte_start": "Int64", "byte_end": "Int64"})

    return windows.select("window_id", "source", "proposed").mapInPandas(run, "window_id long, passage_id long, text string, byte_start long, byte_end long, changed long, compared long, error string")


#: Bytes of a lecture's text in which passages and spans meet.
BUCKET = 4096


def provenance(passages: DataFrame, spans: DataFrame) -> DataFrame:
    """First and last source segment of each passage: spans of text whose byte range overlaps its own.

    passages (lecture_id, passage_id, byte_start, byte_end), spans (lecture_id, pos, kind, source_start, source_end, text).
    Both meet in buckets of bytes that they reach.
    """
    order = Window.partitionBy("lecture_id").orderBy("pos")
    size = F.when(F.col("kind") == "text", F.octet_length("text")).otherwise(0)
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / BUCKET)))
    placed = spans.withColumn("s_end", F.sum(size).over(order)).withColumn("s_start", F.col("s_end") - size).filter("kind = 'text'").select("lecture_id", "s_start", "s_end", "source_start", "source_end", reach("s_start", "s_end").alias("__bucket"))
    own = passages.select("lecture_id", "passage_id", "byte_start", "byte_end", reach("byte_start", "byte_end").alias("__bucket"))
    met = own.join(placed, ["lecture_id", "__bucket"]).filter((F.col("byte_start") < F.col("s_end")) & (F.col("byte_end") > F.col("s_start")))
    return met.groupBy("lecture_id", "passage_id").agg(F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"))


def islands(passages: DataFrame) -> DataFrame:
    """Adds island: passages whose source ranges touch share one; a range past all before it starts the next."""
    order = Window.partitionBy("lecture_id").orderBy("passage_id")
    furthest = F.max("source_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = (furthest.isNull() | (F.col("source_start") > furthest)).cast("long")
    return passages.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order) - 1).drop("starts")


def _solid(text: str) -> str:
    if text.isascii() and text.isalnum():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def _middle(a: int, b: int) -> int:
    return (a + b + 1) // 2


def boundary_times(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The time of each boundary between the characters of tokens: even within a token, and halfway between two."""
    first = np.cumsum(sizes) - sizes
    token = np.repeat(np.arange(len(sizes)), sizes)
    inner = starts[token] + (ends - starts)[token] * (np.arange(len(token)) - first[token]) // sizes[token]
    inner[first[1:]] = (ends[:-1] + starts[1:] + 1) // 2
    return np.append(inner, ends[-1])


def carried(script: list[Edit], places: np.ndarray) -> np.ndarray:
    """Where places of the proposed text lie in the source: even within a stretch, and in the later one where two meet."""
    table = np.array([(e.a, e.b, e.c, e.d) for e in script if e.d > e.c], np.int64).reshape(-1, 4)
    a, b, c, d = table[np.searchsorted(table[:, 2], places, "right") - 1].T
    return a + ((places - c) * (b - a) + (d - c) // 2) // (d - c)


def timed_island(texts: list[str], coarse: list[tuple[int, int]], tokens: list[tuple[str, int, int]]) -> list[tuple[int, int]] | None:
    """Times of an island's passages from the tokens within it; None if any passage matches too little."""
    window = np.array(coarse, np.int64)
    first, last = min(start for start, _ in coarse), max(end for _, end in coarse)
    within = [(_solid(text), start, end) for text, start, end in tokens if start < last and end > first]
    within = [token for token in within if token[0]]
    parts = [_solid(text) for text in texts]
    if not within or not all(parts):
        return None
    heard, wanted = "".join(solid for solid, _, _ in within), "".join(parts)
    # every passage needs so many characters, so the whole island does
    least = sum(-(-MIN_MATCHED * len(part) // 100) for part in parts)
    script = edits(heard, wanted, len(heard) + len(wanted) - 2 * least)
    if script is None:
        return None
    equal = np.zeros(len(wanted) + 1, np.int64)
    for e in script:
        equal[e.c + 1 : e.d + 1] = e.equal
    bounds = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
    if (np.diff(np.cumsum(equal)[bounds]) * 100 < MIN_MATCHED * np.diff(bounds)).any():
        return None
    times = boundary_times(*(np.array(column, np.int64) for column in ([len(solid) for solid, _, _ in within], [start for _, start, _ in within], [end for *_, end in within])))
    found = times[carried(script, bounds)]
    spans = np.stack([np.maximum(found[:-1], window[:, 0]), np.minimum(found[1:], window[:, 1])], 1)
    return [(int(a), int(b)) for a, b in spans] if (spans[:, 0] < spans[:, 1]).all() else None


#: Rows that a worker holds before it gives them away, but for those of one lecture.
ROWS = 100_000


def playback(passages: DataFrame, tokens: DataFrame) -> DataFrame:
    """lecture_id, passage_id, start_ms, end_ms, basis. passages carry their coarse start_ms and end_ms, tokens are (lecture_id, pos, text, start_ms, end_ms).

    Many lectures share a batch; within one an island meets only the tokens around it.
    """

    def one(own: list[dict], heard: list[dict]) -> list[list]:
        spoken = [(t["text"], t["start_ms"], t["end_ms"]) for t in heard]
        # tokens before ``begun`` have ended, and those from ``ended`` on begin later, so an island sees only those between
        ends, starts = (list(accumulate((t[k] for t in side), keep)) for side, k, keep in ((spoken, 2, max), (spoken[::-1], 1, min)))
        starts.reverse()
        spans = [[p["start_ms"], p["end_ms"], "segments"] for p in own]
        for _, group in groupby(range(len(own)), lambda k: own[k]["island"]):
            at = list(group)
            coarse = [(own[k]["start_ms"], own[k]["end_ms"]) for k in at]
            if any(None in span for span in coarse):
                continue
            begun, ended = bisect_right(ends, min(s for s, _ in coarse)), bisect_left(starts, max(e for _, e in coarse))
            found = timed_island([own[k]["text"] for k in at], coarse, spoken[begun:ended])
            for k, span in zip(at, found or [], strict=False):
                spans[k] = [*span, "timed_tokens"]
        for left, right in pairwise(spans):
            middle = _middle(left[1], right[0])
            if left[2] == right[2] == "timed_tokens" and left[0] < middle < right[1]:
                left[1] = right[0] = middle
        return spans

    kind = passages.schema["lecture_id"].dataType.simpleString()
    names = ["lecture_id", "passage_id", "start_ms", "end_ms", "basis"]
    schema = f"lecture_id {kind}, passage_id long, start_ms long, end_ms long, basis string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("lecture_id").type, *[pa.int64()] * 3, pa.string()]
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                lecture, own, heard = (column[k].as_py() for column in batch.columns)
                rows += [(lecture, p["passage_id"], *span) for p, span in zip(own, one(own, heard or []), strict=True)]
                if len(rows) >= ROWS or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []

    listed = lambda df, name, *columns: df.groupBy("lecture_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    times = [F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms")]
    grouped = listed(islands(passages), "own", "passage_id", "island", "text", *times)
    heard = listed(tokens.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL"), "heard", "pos", "text", *times).withColumnRenamed("lecture_id", "__lecture")
    both = grouped.join(heard, F.col("lecture_id").eqNullSafe(F.col("__lecture")), "left")
    return both.select("lecture_id", "own", "heard").mapInArrow(run, schema)


def region_tokens(words: list[str], starts: np.ndarray, durations: np.ndarray, begin: int, stop: int, owned: tuple[int, int]) -> list[tuple[int, str, int, int]]:
    """Place, text, start and end of a region's tokens, in increasing time and clipped to what the region owns. Times in ms, ``starts`` from ``begin``.

    A token lasts as it says, else until the next begins, and a millisecond at least. It begins no earlier than the one
    before ends; so an end, less all lengths up to it, is the running maximum of beginnings less the lengths before them.
    """
    opens = begin + np.trunc(starts * 1000 + 0.5).astype(np.int64)
    known = np.arange(len(words)) < len(durations)
    length, earliest = np.ones(len(words), np.int64), np.maximum(opens, np.append(opens[1:], stop) - 1)
    length[known] = np.maximum(np.trunc(durations[: len(words)] * 1000 + 0.5).astype(np.int64), 1)
    earliest[known] = opens[known]
    spoken = np.flatnonzero([bool(word.strip()) for word in words])
    length, upto = length[spoken], np.cumsum(length[spoken])
    ends = upto + np.maximum.accumulate(np.maximum(earliest[spoken] - (upto - length), begin)) if len(spoken) else upto
    before = np.append(begin, ends[:-1]) if len(spoken) else upto
    from_, to = np.minimum(np.maximum(opens[spoken], before), stop - 1), np.minimum(ends, stop)
    middle = from_ + (to - from_) // 2
    kept = (before < stop) & (middle >= owned[0]) & (middle < owned[1])
    from_, to = np.maximum(from_, owned[0]), np.minimum(to, owned[1])
    return [(int(k), words[k], int(a), int(b)) for k, a, b, ok in zip(spoken, from_, to, kept, strict=True) if ok and a < b]


def normalized_tokens(regions: DataFrame) -> DataFrame:
    """Recognised tokens of each region in increasing time, clipped to what the region owns.

    regions (lecture_id, region, input_start, input_end, owned_start, owned_end, tokens array<string>,
    starts array<double>, durations array<double>), times in ms, those of tokens in seconds from input_start.
    Regions whose tokens and starts differ in number give none.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                words, starts, durations = (list(x) if x is not None else [] for x in (r.tokens, r.starts, r.durations))
                if words and len(words) == len(starts):
                    found = region_tokens(words, np.array(starts), np.array(durations), r.input_start, r.input_end, (r.owned_start, r.owned_end))
                    rows += [(r.lecture_id, r.region, *token) for token in found]
            yield pd.DataFrame(rows, columns=["lecture_id", "region", "pos", "text", "start_ms", "end_ms"])

    return regions.mapInPandas(run, "lecture_id long, region long, pos long, text string, start_ms long, end_ms long")
