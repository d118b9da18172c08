"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Every rule is a predicate over the text. The documents with the least hashes of
their texts are a sample, on which each rule's rejections are counted and its cost
is estimated: the characters that it scans, times what its kind of scan takes for
each, and a fixed part a document. One job reads both, and the same sample always
gives the same order. The rules form one CASE expression: first the one with
most rejections per cost among what passes the base rules, then the one with most
among what is left, and so on, so that a document meets dear rules only if cheap
ones let it pass. The order changes the time alone: the verdict is the same in any order.

Repeated words are those in 3-word windows that occur twice or more in a
text. They are found inside the row: hashes of the windows are sorted with
their positions, and equal neighbours mark repeats, so a text of n words
takes n log n steps and no row leaves its partition.

Nulls are texts without words. Every row gives one row, repeated or not; an empty
table gives none. A long text is worked on inside its row. All columns are
carried; those that are named as results are replaced by them, and names that
begin with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import SPACES, documents

#: Characters that separate words, in a class of a regular expression.
BLANKS = r"\x20\x09-\x0D"
#: Texts of the sample on which costs and rejections are estimated.
SAMPLE = 400
#: Nanoseconds that a rule takes for a document, and for each character by kind of scan: none (it reads base columns), a literal, a pattern.
#: Measured over the documents of the bench on one core; only their ratios matter.
DOCUMENT_COST, SCAN_COSTS = 50.0, {"none": 0.0, "literal": 10.0, "pattern": 30.0}
SCANS = {
    "mean_word_length": "none", "symbols_per_word": "none", "duplicate_lines": "none", "capitals": "pattern",
    "words_with_letters": "pattern", "shouting": "literal", "bullet_lines": "pattern", "ellipsis_lines": "pattern",
}


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once: what follows refers to each more than once, so the optimizer doesn't fold them into lambdas."""
    return df.withColumns(columns)


def _with_repeats(df: DataFrame, text: Column) -> DataFrame:
    """Adds __words and n_repeat_words.

    Most texts repeat no window: their hashes are distinct, which a hash set tells. In the others
    equal hashes meet by sorting, and the words that their windows cover are counted in one fold.
    """
    trimmed = F.trim(text, F.lit(SPACES))
    df = _staged(df, __words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+")))
    w, n = F.col("__words"), F.greatest(F.size("__words") - 2, F.lit(0))
    df = _staged(df, __h=F.transform(F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n)), lambda x: F.xxhash64(x)))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    df = _staged(df, __p=F.when(again, F.sort_array(F.transform("__h", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    n = F.size("__p")
    df = _staged(df, __same=F.zip_with(F.slice("__p", 1, n - 1), F.slice("__p", 2, n - 1), lambda a, b: a["h"] == b["h"]))
    marks = F.zip_with(F.concat(F.array(F.lit(False)), "__same"), F.concat("__same", F.array(F.lit(False))), lambda a, b: a | b)
    spots = F.sort_array(F.transform(F.filter(F.zip_with("__p", marks, lambda p, m: F.struct(p["k"].alias("k"), m.alias("m"))), lambda x: x["m"]), lambda x: x["k"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(spots, start, lambda a, k: F.struct(k.alias("last"), (a["sum"] + F.least(k - a["last"], F.lit(3))).alias("sum")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["sum"], F.lit(0)).cast("long")).drop("__h", "__p", "__same")


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and __lines (a count) for the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = _with_repeats(df, text)
    out = out.withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    out = out.withColumn("word_chars", F.char_length(F.regexp_replace(text, f"[{BLANKS}]+", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
    out = _staged(out, __split=F.split(text, "\n"))
    out = _staged(out.withColumn("__lines", F.size("__split")), __full=F.filter("__split", lambda x: x.rlike(f"[^{BLANKS}]")))
    out = out.withColumn("n_dup_lines", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long")).drop("__split", "__full")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rules(text_col: str = "text") -> dict[str, Column]:
    """What each rule asks of a document that passed the base rules; true lets it pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.col("n_words")
    without_letters = F.regexp_count(F.concat(F.lit(" "), text), F.lit(rf"(?<=[{BLANKS}])[^\p{{L}}{BLANKS}]++(?![^{BLANKS}])"))
    return {
        "mean_word_length": (F.col("word_chars") >= 2 * n) & (F.col("word_chars") <= 14 * n),
        "symbols_per_word": 10 * F.col("n_symbols") <= n,
        "duplicate_lines": 10 * F.col("n_dup_lines") <= 3 * F.col("__lines"),
        "capitals": 2 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) <= F.col("word_chars"),
        "words_with_letters": 10 * (n - without_letters) >= 6 * n,
        "shouting": 5 * (F.char_length(text) - F.char_length(F.replace(text, F.lit("!!"), F.lit("")))) <= 2 * n,
        "bullet_lines": 10 * F.regexp_count(text, F.lit(r"(?:^|\n)[-*•]")) <= 9 * F.col("__lines"),
        "ellipsis_lines": 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)\n")) <= 3 * F.col("__lines"),
    }


def sample(df: DataFrame, text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """The rows whose texts have the least hashes; hashes are picked first, so that no other texts move."""
    hashed = F.xxhash64(text_col)
    least = [r[0] for r in df.select(hashed.alias("h")).distinct().orderBy("h").limit(size).collect()]
    return df.select(text_col).filter(hashed <= least[-1]).dropDuplicates([text_col]) if least else df.select(text_col).limit(0)


def cascade_order(seen: list[dict[str, bool]], cost: dict[str, float]) -> list[str]:
    """Rule names, each the one with most rejections per cost among the rows that those before it pass; ties by name."""
    left, out = list(cost), []
    while left:
        name = min(left, key=lambda k: (-(sum(not row[k] for row in seen) + 0.5) / cost[k], k))
        out.append(name)
        left.remove(name)
        seen = [row for row in seen if row[name]]
    return out


def estimated_costs(rows: int, characters: int) -> dict[str, float]:
    """What each rule takes over so many texts with so many characters."""
    return {name: rows * DOCUMENT_COST + characters * SCAN_COSTS[scan] for name, scan in SCANS.items()}


def measured_order(df: DataFrame, text_col: str = "text") -> list[str]:
    """The order of the cascade, by verdicts and estimated costs on the sample."""
    own = rules(text_col)
    met = base_columns(sample(df, text_col), text_col).filter("NOT base_failed")
    seen = [r.asDict() for r in met.select(F.char_length(text_col).alias("characters"), *(rule.alias(name) for name, rule in own.items())).collect()]
    return cascade_order(seen, estimated_costs(max(len(seen), 1), sum(r["characters"] for r in seen)))


def apply_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base columns, base_failed and kept."""
    own, verdict = rules(text_col), F.when(F.col("base_failed"), False)
    for name in measured_order(df, text_col):
        verdict = verdict.when(~own[name], False)
    return base_columns(df, text_col).withColumn("kept", verdict.otherwise(True)).drop("__lines")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (
  SELECT doc_id, text, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines
  AND 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) <= word_chars
  AND 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) >= 6 * n_words
  AND 10 * len(regexp_extract_all(text, '!!')) <= 2 * n_words
  AND 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[-*\x{2022}]'))) <= 9 * len(string_split(text, chr(10)))
  AND 10 * len(regexp_extract_all(text, '(?:\.\.\.|\x{2026})\n')) <= 3 * n_lines AS kept
FROM f
"""
