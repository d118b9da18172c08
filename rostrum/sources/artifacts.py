"""Logs and artifacts: strict and lenient JSON lines, appended traces, hashed JSON files, atomic output, price catalogs."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.functions.text import parsed_price, per_token, search_words
from rostrum.operators.places import placed
from rostrum.sources.lines import JsonLines, LogError, prepared

TRACE = "record_id bigint, at_ms bigint, exchange_id bigint, workflow string, window_index bigint, repair_turn bigint, provider_attempt bigint, hedge boolean, event string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, latency_ms bigint, category string"
VERSION = 1


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Every line must be a record; the first that isn't fails the read."""
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def parse_trace(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of lines (line, value): bad ones are counted by number, blank ones skipped."""
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", f"{TRACE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("r._bad").isNull() & F.col("r.record_id").isNotNull() & F.col("r.event").isNotNull()
    return parsed.filter(ok).select("r.*").drop("_bad"), parsed.filter(~ok).select("line", "value")


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, line (1, 2, 3 ... in each file), place (over all files), value of a JSON-lines log, whatever ranges it is read in: for ``parse_trace``.

    Ranges give the bytes where lines begin; their order over all files gives places, and the first of a file its lines' numbers.
    """
    spark.dataSource.register(JsonLines)
    ordered = placed(spark.read.format("json_lines").options(**options).load(path).select("file", "at", "value"), ["file", "at"])
    first = ordered.groupBy("file").agg(F.min("place").alias("first"))
    return ordered.join(first, "file").select("file", (F.col("place") - F.col("first") + 1).alias("line"), "place", "value")


def append_trace(records: DataFrame, path: str) -> int:
    """Appends records to a JSON-lines log, numbered on from its largest record id, in order of time and exchange; how many.

    A half-written last line is cut off first; any other line that is no record fails. Of two writers that
    began from the same log one fails and adds nothing, as they would give the same numbers.
    """
    spark = records.sparkSession
    spark.dataSource.register(JsonLines)
    number = prepared(path)
    known = numbered_lines(spark, path)
    parsed = known.filter(F.trim("value") != "").select("file", "line", F.from_json("value", "record_id bigint, event string").alias("r"))
    bad, last = parsed.agg(F.min(F.when(F.col("r.record_id").isNull() | F.col("r.event").isNull(), F.struct("file", "line"))), F.max("r.record_id")).first()
    if bad is not None:
        raise LogError(f"{bad.file}, line {bad.line}: not a record")
    placed_rows = placed(records.drop("record_id"), ["at_ms", "exchange_id", "event"], "record_id")
    rows = placed_rows.withColumn("record_id", F.col("record_id") + (0 if last is None else last + 1) - 1)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.format("json_lines").option("expected", number).mode("append").save(path)
    return rows.count()


class ArtifactError(ValueError):
    """An artifact that is not there or not whole."""


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/commits")
    except AnalysisException:
        return None


def write_artifact(tables: dict[str, DataFrame], path: str) -> None:
    """An artifact is a directory of tables, replaced all at once: readers see them when the last step, one row that names their folder, is there.

    Earlier versions stay; who owns the path removes them. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, known = uuid.uuid4().hex, _commits(spark, path)
    version = 0 if known is None else known.agg(F.max("version")).first()[0] + 1
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.array(*map(F.lit, sorted(tables))).alias("names"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read_artifact(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The newest version's tables. What they hold is checked by validation.artifact_errors."""
    known = _commits(spark, path)
    newest = None if known is None else known.orderBy(F.col("version").desc()).first()
    if newest is None or set(names) - set(newest["names"]):
        raise ArtifactError(f"{path} holds no artifact of {', '.join(names)}")
    return {name: spark.read.parquet(f"{path}/{newest['folder']}/{name}") for name in names}


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and SHA-256 of whole files; Spark lists no empty ones."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


COST = "struct<input:double,output:double,cache_read:double,tiers:array<string>>"
CATALOG = f"map<string,struct<id:string,name:string,models:map<string,struct<id:string,name:string,cost:{COST}>>>>"


def catalog(texts: DataFrame) -> DataFrame:
    """Price presets of catalog texts (text): models without valid prices are dropped; a missing cached price is the input's."""
    providers = texts.select(F.explode(F.from_json("text", CATALOG)).alias("key", "p"))
    # a provider's models leave the row before they are exploded, or each of them would carry them all
    named = providers.select(F.col("p.id").alias("provider_id"), F.col("p.name").alias("provider_name"), F.col("p.models").alias("models"))
    models = named.select("provider_id", "provider_name", F.explode("models").alias("k", "m"))
    valid = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    cost = lambda k: F.col(f"m.cost.{k}")
    cached = F.when(valid(cost("cache_read")), cost("cache_read"))
    return models.filter(valid(cost("input")) & valid(cost("output"))).select(
        "provider_id", "provider_name", F.col("m.id").alias("model_id"), F.col("m.name").alias("model_name"), per_token(cost("input")).alias("uncached_input"), per_token(F.coalesce(cached, cost("input"))).alias("cached_input"),
        per_token(cost("output")).alias("output"), cached.isNull().alias("cached_price_assumed"), (F.coalesce(F.size(cost("tiers")), F.lit(0)) > 0).alias("tiered_pricing"),
    )


def search_catalog(presets: DataFrame, text: str, offset: int = 0, page: int = 20) -> DataFrame:
    """A page of presets that hold every word of the search, the most relevant first, with total and next_offset. The model's id settles ties."""
    own = presets.withColumn("__q", search_words(F.lit(text)))
    names = ("provider_id", "provider_name", "model_id", "model_name")
    for name in names:
        own = own.withColumn(f"__{name}", search_words(F.col(name)))
    words = F.filter(F.split("__q", " "), lambda w: w != "")
    hay = F.concat_ws(" ", *[f"__{n}" for n in names])
    phrase = lambda n: F.concat(F.lit(" "), F.col("__q"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col(n), F.lit(" "))) & (F.col(n) != "")
    without = lambda n: F.when(phrase(n), F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), F.col("__q"), F.lit(" ")), F.concat(F.lit(" "), F.col(n), F.lit(" ")), F.lit(" ")), " +", " ")))
    rest = F.coalesce(F.nullif(without("__provider_id"), F.lit("")), F.nullif(without("__provider_name"), F.lit("")))
    exact = F.coalesce((F.col("__model_id") == F.col("__q")) | (F.col("__model_name") == F.col("__q")), F.lit(False)) | F.coalesce((F.col("__model_id") == rest) | (F.col("__model_name") == rest), F.lit(False))
    provider = phrase("__provider_id") | phrase("__provider_name")
    prefix = F.col("__model_id").startswith(F.col("__q")) | F.col("__model_name").startswith(F.col("__q"))
    hits = lambda a, b: F.size(F.filter(words, lambda w: F.col(a).contains(w) | F.col(b).contains(w)))
    found = own.filter(F.forall(words, lambda w: F.contains(hay, w))).withColumn("__score", F.struct((exact & provider).alias("a"), exact.alias("b"), provider.alias("c"), prefix.alias("d"), hits("__model_id", "__model_name").alias("e"), hits("__provider_id", "__provider_name").alias("f")))
    order = (F.col("__score").desc(), "provider_name", "model_name", "model_id")
    first = found.orderBy(*order).limit(offset + page).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    out = first.filter(F.col("place") >= offset).crossJoin(found.agg(F.count("*").alias("total")))
    more = F.when(F.col("total") > offset + page, F.lit(offset + page))
    return out.select(*presets.columns, "place", "total", more.alias("next_offset"))


def pricing_errors(prices: DataFrame) -> DataFrame:
    """Rows (input, cached, output) whose prices aren't all valid and in one currency."""
    cells = [parsed_price(F.col(c)) for c in ("input", "cached", "output")]
    bad = F.when(cells[0].isNull() | cells[1].isNull() | cells[2].isNull(), "invalid_price").when((cells[0]["currency"] != cells[1]["currency"]) | (cells[0]["currency"] != cells[2]["currency"]), "mixed_currencies")
    return prices.withColumn("error", bad).filter("error IS NOT NULL")
