"""Cross-site line dedup by distinct-site spread, in DataFrame operations only.

Each non-blank line, trimmed, is known by two hashes (96 bits). One aggregation
gathers for each line a HyperLogLog sketch of its sites and its first place;
sketches merge map-side, so a line that a third of all rows hold costs one row
a task. Where the estimate is near the threshold, an exact distinct count
decides; elsewhere the estimate is more than six standard errors away.
Lines on ``min_sites`` sites or more are boilerplate: their first occurrence (by
doc_id, then place) stays, all others go. Lines on fewer sites are left alone,
however often they occur.

Null sites are one site. Null texts stay null, with no lines. Rows that agree in
id, text and source are treated alike: each keeps what the first place keeps.
An empty table gives an empty result. Long texts are split inside their row. All
columns are carried, and those that are named as the counts (n_lines, n_removed,
or as ``names`` says) are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import SPACES, checkpointed, documents, free, small

#: Sites that make a line boilerplate.
MIN_SITES = 5
#: Registers of a sketch, as a power of two, and its relative standard error.
LG_K = 10
ERROR = 1.04 / math.sqrt(1 << LG_K)
#: Rows of boilerplate lines (about 60 bytes each) up to which they are broadcast; beyond, a shuffle joins them.
BROADCAST_LINES = 100_000


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _key() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def _lines(df: DataFrame) -> DataFrame:
    """One row per non-blank line: key, site, place, h1, h2."""
    rows = df.select(_key().alias("key"), "doc_id", F.coalesce("source", F.lit("\x00")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = _trimmed(F.col("line"))
    return rows.filter(line != "").select("key", "doc_id", "site", "at", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (doc_id, key, at) of every line on ``min_sites`` sites or more."""
    lines = _lines(df)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc_id", "key", "at")).alias("first"))
    band = max(1, math.ceil(6 * ERROR * min_sites))
    wide = checkpointed(spread.filter(F.col("sites") >= min_sites - band))
    near = wide.filter(F.col("sites") <= min_sites + band)
    exact = lines.join(small(near.select("h1", "h2"), BROADCAST_LINES), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact"))
    sure = wide.filter(F.col("sites") > min_sites + band).select("h1", "h2", "first")
    return checkpointed(sure.unionByName(near.join(exact.filter(F.col("exact") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first")))


def _flags(gone: Column, n: Column) -> Column:
    """n booleans, true at the sorted places of ``gone``; linear in n."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    runs = F.zip_with(gone, before, lambda g, p: F.concat(F.array_repeat(F.lit(False), g - p - 1), F.array(F.lit(True))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), n - 1 - F.element_at(gone, -1)))


def dedup_lines(df: DataFrame, min_sites: int = MIN_SITES, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``df`` with boilerplate lines taken out of text, and n_lines, n_removed (or as ``names`` says)."""
    known = boilerplate(df, min_sites)
    met = _lines(df).join(small(known, BROADCAST_LINES), ["h1", "h2"])
    again = ~((F.col("key") == F.col("first.key")) & (F.col("at") == F.col("first.at")))
    own, gone = free(df, "__own"), free(df, "__gone")
    # the id with the hash, so that no document loses the lines of another
    removed = met.filter(again).groupBy(F.col("key").alias("__key"), F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("at")).alias(gone))
    keyed = df.withColumn(own, _key())
    joined = keyed.join(removed, (keyed[own] == removed["__key"]) & keyed["doc_id"].eqNullSafe(removed["__id"]), "left").select(*(keyed[c] for c in keyed.columns), removed[gone])
    lines = F.split("text", "\n")
    marked = F.zip_with(lines, _flags(F.col(gone), F.size(lines)), lambda x, gone: F.struct(x.alias("x"), gone.alias("gone")))
    text = F.array_join(F.transform(F.filter(marked, lambda m: ~m["gone"]), lambda m: m["x"]), "\n")
    counts = {names[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), names[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.withColumns(counts | {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)}).drop(own, gone)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text", "source"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, coalesce(source, chr(1)) AS site, unnest(ls) AS raw, unnest(range(0, len(ls))) AS pos FROM d),
t AS (SELECT r, doc_id, site, raw, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT t.*, b.line IS NOT NULL AND (doc_id, pos) <> first AS gone FROM t LEFT JOIN b USING (line))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text, d.source,
  CAST(coalesce(max(len(ls)), 0) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
FROM d LEFT JOIN m USING (r) GROUP BY d.r, d.doc_id, d.text, d.source
"""
