"""JSON by structure: counts by path, and redaction of secret headers at any depth, over VARIANT values.

Texts that are no JSON give null counts, and are redacted as text (functions.text). A
redacted text is the canonical one of its value: without white space, keys in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import SECRET_HEADERS, redacted
from rostrum.session import checkpointed

HIDDEN = '"<REDACTED>"'


def count_at(value: Column, *paths: str) -> Column:
    """The whole number of zero or more at the first of these paths that has one; null is missing, 0 is zero. Texts and fractions are no counts."""
    own = [F.try_variant_get(value, path, "variant") for path in paths]
    found = [F.when(F.schema_of_variant(v).rlike("^(?:BIGINT|DECIMAL\\([0-9]+,0\\))$"), F.try_variant_get(v, "$", "bigint")) for v in own]
    return F.coalesce(*(F.when(n >= 0, n) for n in found))


#: Where tokens are told, the normalised response first and the provider's own after it.
USAGE = {
    "input_tokens": ("$.response.usage.prompt_tokens",),
    "cached_tokens": ("$.response.usage.prompt_tokens_details.cached_tokens", "$.raw_response.usage.prompt_tokens_details.cached_tokens"),
    "output_tokens": ("$.response.usage.completion_tokens",),
}


def usage_counts(value: Column) -> dict[str, Column]:
    """Input, cached and output tokens of a response."""
    return {name: count_at(value, *paths) for name, paths in USAGE.items()}


def header_values(rows: DataFrame) -> DataFrame:
    """key, name, value: every outermost secret header inside ``rows`` (key, value variant), found level by level.

    A level's containers are exploded into the next until none is left; what lies under a secret header isn't looked at.
    """
    level, found = rows, None
    secret = F.lower("name").isin(*SECRET_HEADERS)
    while True:
        level.createOrReplaceTempView("__level")
        inner = checkpointed(level.sparkSession.sql("SELECT l.key, e.key AS name, e.value FROM __level l, LATERAL variant_explode(l.value) e WHERE e.value IS NOT NULL"))
        level.sparkSession.catalog.dropTempView("__level")
        own = inner.filter(F.coalesce(secret, F.lit(False)))
        found = own if found is None else found.unionByName(own)
        level = inner.filter(~F.coalesce(secret, F.lit(False)) & F.schema_of_variant("value").rlike("^(?:OBJECT|ARRAY)")).select("key", "value")
        if level.isEmpty():
            return found


def redacted_json(df: DataFrame, text_col: str, secrets: list[str], name: str) -> DataFrame:
    """Adds ``name``: the text with every spelling of a secret replaced, and the whole value of each secret header, whatever it holds.

    Only texts that name a secret header are taken apart.
    """
    numbered = checkpointed(df.withColumn("__key", F.monotonically_increasing_id()))
    named = F.col(text_col).rlike(rf'(?i)"(?:{"|".join(SECRET_HEADERS)})"')
    suspects = numbered.filter(named).select(F.col("__key").alias("key"), F.try_parse_json(text_col).alias("value")).filter("value IS NOT NULL")
    pair = F.struct(F.concat(F.lit('"'), "name", F.lit('":')).alias("name"), F.to_json("value").alias("value"))
    parts = header_values(suspects).groupBy("key").agg(F.array_sort(F.collect_set(pair)).alias("__parts"))
    whole = suspects.select("key", F.to_json("value").alias("__whole")).join(parts, "key")
    # longer values first: one may be the beginning of another
    ordered = F.reverse(F.array_sort(F.transform("__parts", lambda p: F.struct(F.char_length(p["value"]).alias("n"), p["name"].alias("name"), p["value"].alias("value")))))
    hidden = F.aggregate(ordered, F.col("__whole"), lambda text, p: F.replace(text, F.concat(p["name"], p["value"]), F.concat(p["name"], F.lit(HIDDEN))))
    joined = numbered.join(whole.select(F.col("key").alias("__key"), hidden.alias("__hidden")), "__key", "left")
    return joined.withColumn(name, redacted(F.coalesce("__hidden", F.col(text_col)), secrets)).drop("__key", "__hidden")
