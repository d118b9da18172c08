"""Audit of how filters interact, by a subset-zeta transform.

Each document has a mask of the filters that it fails. Documents are counted by
part and mask; that is all that further steps see, 2^k counts a part for k filters,
whatever the number of documents. The zeta transform adds the counts of all
subsets of each mask in k rounds, so the survivors of any set of filters are one
entry: those whose mask lies in the set's complement. A step of an order is then
the difference between two neighbouring sets, and so are the labels lost in it.

A text that any smaller id has is a repeat. Only the first of each text is joined
back, by its digest and id together, so that no text is a hot key; every other
row repeats it.

Null texts are empty and equal to one another; a null id has no smaller one and is
no smaller one, so its row is no repeat; rows with the same id and text are both
the first. Null parts are the empty string. Labels that are missing or null are
zero, and of several rows for an id the largest counts. Long texts are worked on
inside their row, an empty table gives no part. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import SPACES, checkpointed, documents

#: Characters that separate words, in a class of a regular expression.
BLANKS = r"\x20\x09-\x0D"
COUNTS = ("n", "good", "toxic")


def text_failures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds A, B, C and D: too few words, too few distinct ones, too many capitals, signs of markup."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))
    counted = df.withColumn("__words", words).withColumns({"__n": F.size("__words"), "__distinct": F.size(F.array_distinct("__words"))}).drop("__words")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    own = {"A": F.col("__n") < 200, "B": 100 * F.col("__distinct") < 50 * F.col("__n"), "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}
    return counted.withColumns(own).drop("__n", "__distinct")


def masked(docs: DataFrame, labels: DataFrame, letters: str = "ABCD", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest, mask (bit k: the k-th letter's column is true) and good, toxic (0 or 1), written once."""
    mask = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(letters)), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    narrow = docs.select("doc_id", F.coalesce(part_col, F.lit("")).alias("part"), digest.alias("digest"), mask.alias("mask"))
    told = labels.filter("quality = 1 OR toxic = 1").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    return checkpointed(narrow.join(told, "doc_id", "left").select("doc_id", "part", "digest", "mask", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS[1:])))


def mask_counts(rows: DataFrame, repeat_bit: int) -> DataFrame:
    """part, mask, n, good, toxic; the mask has ``repeat_bit`` where a smaller id has the same digest."""
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["digest", "doc_id"], "left_semi").select("part", "mask", *COUNTS[1:])
    first = first.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", *COUNTS[1:]))
    counted = lambda df: df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every, first = counted(rows), counted(first)
    repeats = F.col("mask").bitwiseOR(repeat_bit).alias("mask")
    less = first.select("part", repeats, *((-F.col(c)).alias(c) for c in COUNTS))
    both = every.select("part", repeats, *COUNTS).unionByName(less).unionByName(first)
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).filter("n > 0")


def zeta(counts: Column, filters: int) -> Column:
    """From counts of masks, for each mask the sum over all its subsets: one filter at a time, 2^k additions each."""
    bits = F.array(*(F.lit(1 << k) for k in range(filters)))
    return F.aggregate(bits, counts, lambda z, bit: F.transform(z, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(z, m.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long"))))


def order_steps(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step of it, from counts of masks (bit k is the k-th letter)."""
    k, sets = len(letters), 1 << len(letters)
    full = F.lit(sets - 1)
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("by_mask"))
    filled = lambda c: F.transform(F.sequence(F.lit(0), full), lambda m: F.coalesce(F.element_at("by_mask", m)[c], F.lit(0).cast("long")))
    held = held.withColumns({c: filled(c) for c in COUNTS}).withColumns({f"z_{c}": zeta(F.col(c), k) for c in COUNTS}).drop("by_mask", "good", "toxic")

    orders = ["".join(p) for p in permutations(letters)]
    out = held.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit_of = f"shiftleft(1, instr('{letters}', {{}}) - 1)"
    out = out.withColumn("bit", F.expr(bit_of.format("substring(filter_order, step, 1)")))
    out = out.withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (a, c) -> a + {bit_of.format('c')})"))

    left = lambda c, applied: F.get(F.col(f"z_{c}"), full.bitwiseXOR(applied))
    after = F.col("before").bitwiseOR(F.col("bit"))
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    orders_through = F.array(*(F.lit(factorial(j) * factorial(max(k - 1 - j, 0))) for j in range(k + 1)))
    drop = lambda s: F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(orders_through, F.bit_count(s)) * (left("n", s) - left("n", s.bitwiseOR(F.col("bit"))))).otherwise(F.lit(0).cast("long"))
    shapley = F.aggregate(F.sequence(F.lit(0), full), F.lit(0).cast("long"), lambda a, s: a + drop(s))
    removed = left("n", F.col("before")) - left("n", after)
    return out.select(
        "part", "filter_order", "step", left("n", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), F.get("n", F.col("bit")).alias("unique_fails"),
        (left("good", F.col("before")) - left("good", after)).alias("good_lost"), (left("toxic", F.col("before")) - left("toxic", after)).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """All orders of the five filters, step by step, within each part."""
    failed = text_failures(docs.select("doc_id", text_col, part_col), text_col)
    return order_steps(mask_counts(masked(failed, labels, "ABCD", text_col, part_col), 1 << 4), "ABCDE")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask,
    CAST(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS INT) AS good, CAST(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS INT) AS toxic
  FROM d),
f AS (SELECT chr(65 + k) AS letter, 1 << k AS bit FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON a.bit <> b.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit, earlier)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
