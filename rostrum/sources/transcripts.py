"""Transcript scans: JSON, SRT, WebVTT and plain text into rows (lecture_id, id, start_ms, end_ms, text).

Each file is one lecture, read whole; parsing is native. The lecture's id is the file's path unless a table of texts is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import BLANK, SEGMENT_ENDS, is_blank, split_after, trimmed

#: Plain text without sentence ends is cut into pieces of so many characters.
PLAIN_CHUNK = 500
SEGMENTS = "array<struct<id:bigint,start_ms:bigint,end_ms:bigint,text:string>>"
CUE = r"^(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\s+-->\s+(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"


def files(spark: SparkSession, path: str) -> DataFrame:
    """lecture_id (the path) and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("lecture_id"), F.col("value").alias("text"))


def cleaned(text: Column) -> Column:
    """Without a byte order mark, with plain line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\r\n?", "\n")


def milliseconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return (F.coalesce(h.try_cast("long"), F.lit(0)) * 3600 + m.cast("long") * 60 + s.cast("long")) * 1000 + ms.cast("long")


def from_json(texts: DataFrame) -> DataFrame:
    """Segments of ``segments`` or its alias ``sentences``; a text that is neither gives no rows."""
    body = F.from_json(cleaned(F.col("text")), f"segments {SEGMENTS}, sentences {SEGMENTS}")
    rows = texts.select("lecture_id", F.posexplode(F.coalesce(body["segments"], body["sentences"])).alias("place", "s"))
    return rows.select("lecture_id", F.coalesce("s.id", F.col("place").cast("long")).alias("id"), "s.start_ms", "s.end_ms", "s.text")


def _cues(texts: DataFrame) -> DataFrame:
    """Blocks between blank lines that hold a time line: their times and the lines after it."""
    blocks = F.filter(F.split(cleaned(F.col("text")), r"\n[ \t]*\n+"), lambda b: b.contains("-->"))
    rows = texts.select("lecture_id", F.posexplode(blocks).alias("place", "block"))
    lines = F.split(trimmed(F.col("block")), "\n")
    at = F.when(lines[0].contains("-->"), 1).otherwise(2)
    timing = trimmed(F.element_at(lines, at))
    part = [F.regexp_extract(timing, CUE, k) for k in range(1, 9)]
    body = F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")
    out = rows.select("lecture_id", "place", timing.rlike(CUE).alias("ok"), *[p.alias(f"p{k}") for k, p in enumerate(part)], trimmed(body).alias("text")).filter("ok")
    c = [F.col(f"p{k}") for k in range(8)]
    return out.select("lecture_id", "place", milliseconds(*c[:4]).alias("start_ms"), milliseconds(*c[4:]).alias("end_ms"), "text")


def renumbered(rows: DataFrame) -> DataFrame:
    """Ids from 0 in order of place."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("lecture_id").orderBy("place")) - 1
    return rows.select("lecture_id", place.cast("long").alias("id"), "start_ms", "end_ms", "text")


def from_srt(texts: DataFrame) -> DataFrame:
    """Cues numbered anew from 0; the lines of one stay lines."""
    return renumbered(_cues(texts))


def from_vtt(texts: DataFrame) -> DataFrame:
    """As SRT; header, notes and styles have no time line and so are dropped, tags within cues removed."""
    return renumbered(_cues(texts).withColumn("text", F.regexp_replace("text", "<[^>]*>", "")))


def plain_pieces(text: Column) -> Column:
    pieces = split_after(cleaned(text), SEGMENT_ENDS + "\n")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / PLAIN_CHUNK).cast("int")), lambda k: F.substr(p, k * PLAIN_CHUNK + 1, F.lit(PLAIN_CHUNK)))
    return F.filter(F.flatten(F.transform(pieces, cut)), lambda p: ~is_blank(p))


def from_plain(texts: DataFrame) -> DataFrame:
    """Sentences without times; what has none for 500 characters is cut there."""
    rows = texts.select("lecture_id", F.posexplode(plain_pieces(F.col("text"))).alias("place", "text"))
    none = F.lit(None).cast("long")
    return rows.select("lecture_id", F.col("place").cast("long").alias("id"), none.alias("start_ms"), none.alias("end_ms"), F.regexp_replace("text", f"^{BLANK}+|{BLANK}+$", "").alias("text"))


READERS = {"json": from_json, "srt": from_srt, "vtt": from_vtt, "txt": from_plain}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return READERS[kind](files(spark, path))
