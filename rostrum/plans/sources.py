"""Checked queries over scans, pages, catalogs and reports; texts of the driver's tables take the place of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.functions import variant as N
from rostrum.operators import reports
from rostrum.operators import trace as T
from rostrum.plans.registry import checkpoint_folder, query, table
from rostrum.plans.sequences import SCORES_SQL, scores
from rostrum.plans.standins import PASSAGES, SEGMENTS, TIMED, TRACE, passages, segments, timed, trace
from rostrum.sources import artifacts as R
from rostrum.sources.lines import JsonLines
from rostrum.sources import pages as G
from rostrum.sources import transcripts as S


@query("transcript_json_scan", f"WITH {SEGMENTS} SELECT lecture_id, id, CASE WHEN lecture_id % 2 = 0 THEN id * 1000 END AS start_ms, CASE WHEN lecture_id % 2 = 0 THEN id * 1000 + 900 END AS end_ms, text FROM seg")
def transcript_json_scan(spark, sf_dir):
    """Every conversation as JSON (with the alias key for odd ones), parsed back."""
    even, k = F.col("lecture_id") % 2 == 0, F.col("id")
    rows = F.sort_array(F.collect_list(F.struct(k.alias("id"), F.when(even, k * 1000).alias("start_ms"), F.when(even, k * 1000 + 900).alias("end_ms"), F.col("text").alias("text"))))
    own = segments(spark, sf_dir).groupBy("lecture_id").agg(rows.alias("r"))
    text = F.when(F.col("lecture_id") % 2 == 0, F.to_json(F.struct(F.col("r").alias("segments")))).otherwise(F.concat(F.lit("﻿"), F.to_json(F.struct(F.col("r").alias("sentences")))))
    return S.from_json(own.select("lecture_id", text.alias("text")))


def cue_files(spark: SparkSession, sf_dir: str, comma: str, head: str) -> DataFrame:
    """Conversations as subtitle files with CRLF line ends."""
    k = F.col("id")
    stamp = lambda ms: F.concat(F.lpad(F.floor(ms / 3600000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 60000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(comma), F.lpad((ms % 1000).cast("string"), 3, "0"))
    flat = X.trimmed(F.regexp_replace("text", "\n+", "\n"))
    cue = F.concat_ws("\n", (k + 7).cast("string"), F.concat(stamp(k * 1234567), F.lit(" --> "), stamp(k * 1234567 + 999)), flat)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), cue.alias("c")))), lambda x: x["c"]), "\n\n")
    return segments(spark, sf_dir).groupBy("lecture_id").agg(F.replace(F.concat(F.lit(head), joined, F.lit("\n")), F.lit("\n"), F.lit("\r\n")).alias("text"))


CUES_SQL = f"WITH {SEGMENTS} SELECT lecture_id, id, id * 1234567 AS start_ms, id * 1234567 + 999 AS end_ms, regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM seg"


@query("srt_scan", CUES_SQL)
def srt_scan(spark, sf_dir):
    return S.from_srt(cue_files(spark, sf_dir, ",", ""))


@query("vtt_scan", CUES_SQL)
def vtt_scan(spark, sf_dir):
    return S.from_vtt(cue_files(spark, sf_dir, ".", "WEBVTT\n\nNOTE a remark\n\nSTYLE\n::cue {}\n\n"))


@query("plain_text_scan", """WITH s AS (SELECT doc_id, i, p FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+') AS ps FROM documents)) WHERE p <> ''),
c AS (SELECT doc_id, i, k, substr(p, k * 500 + 1, 500) AS t FROM (SELECT *, unnest(range(0, (length(p) - 1) // 500 + 1)) AS k FROM s))
SELECT doc_id AS lecture_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text FROM c WHERE regexp_matches(t, '\\S')""")
def plain_text_scan(spark, sf_dir):
    return S.from_plain(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lecture_id"), "text")).select("lecture_id", "id", "text")


def deck_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as pages of a deck, each with a footer of its count; short ones are sparse, some are broken."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("deck"), place.alias("page"), F.col("doc_id"), F.col("text").alias("head"))
    body = F.when(F.col("doc_id") % 11 == 0, "ab").when(F.col("doc_id") % 13 == 0, F.concat("head", F.lit(" □�"))).otherwise(F.col("head"))
    foot = F.when(F.length("deck") == 4, F.concat(F.lit("\n Course  notes "), F.col("page").cast("string"), F.lit(" / 90 "))).otherwise("")
    return rows.select("deck", "page", "doc_id", F.concat(body, foot).alias("text"))


PAGES_SQL = """pag AS (SELECT source AS deck, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'ab' WHEN doc_id % 13 = 0 THEN text || ' □' || chr(65533) ELSE text END AS body FROM documents),
lns AS (SELECT deck, page, doc_id, list_filter(list_transform(string_split(body || CASE WHEN length(deck) = 4 THEN chr(10) || ' Course  notes ' || page || ' / 90 ' ELSE '' END, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls, count(*) OVER (PARTITION BY deck) AS pages FROM pag),
cnd AS (SELECT *, regexp_replace(regexp_replace(ls[-1], '\\s+', ' ', 'g'), ' [0-9]+ / [0-9]+$', '') AS last FROM lns),
foo AS (SELECT deck, last AS footer, count(*) AS n, pages FROM cnd WHERE last IS NOT NULL GROUP BY deck, last, pages HAVING count(*) >= 3 AND count(*) * 2 > pages),
lin AS (SELECT c.deck, page, doc_id, array_to_string(CASE WHEN footer IS NULL THEN ls ELSE ls[:-2] END, chr(10)) AS text FROM cnd c LEFT JOIN foo f ON f.deck = c.deck AND f.footer = c.last)"""


@query("footer_majority", f"WITH {PAGES_SQL} SELECT deck, footer, n, pages FROM foo")
def footer_majority(spark, sf_dir):
    return G.repeated_footers(deck_pages(spark, sf_dir))


@query("deck_slides", f"WITH {PAGES_SQL} SELECT deck, page AS slide_id, text FROM lin")
def deck_slides(spark, sf_dir):
    return G.slides(deck_pages(spark, sf_dir))


@query("deck_slides_whole", f"WITH {PAGES_SQL} SELECT deck, page AS slide_id, text FROM lin")
def deck_slides_whole(spark, sf_dir):
    """The name under which round 1 read whole pages; deck_slides reads them too now."""
    return deck_slides(spark, sf_dir)


WARN_SQL = f"{PAGES_SQL}, war AS (SELECT deck, page + 1 AS page, length(regexp_replace(text, '\\s+', '', 'g')) < 8 AS sparse, list_sort(list_distinct(regexp_extract_all(text, '[□�]'))) AS glyphs FROM lin)"


@query("sparse_page_warnings", f"WITH {WARN_SQL} SELECT deck, page, sparse, array_to_string(glyphs, '') AS glyphs FROM war WHERE sparse OR len(glyphs) > 0")
def sparse_page_warnings(spark, sf_dir):
    return G.flagged(deck_slides(spark, sf_dir)).withColumn("glyphs", F.array_join("glyphs", ""))


@query("import_warning_rollup", f"""WITH {WARN_SQL} SELECT deck, 0 AS place, 'sparse pages: ' || string_agg(page, ', ' ORDER BY page) AS message FROM war WHERE sparse GROUP BY deck
UNION ALL SELECT deck, page + 1, 'page ' || page || ': ' || array_to_string(glyphs, ' ') FROM war WHERE len(glyphs) > 0""")
def import_warning_rollup(spark, sf_dir):
    return T.import_warnings(G.warnings(deck_slides(spark, sf_dir)))


@query("recognition_plan", f"WITH {PAGES_SQL} SELECT deck, page FROM pag WHERE (doc_id % 11 = 0 AND length(deck) <> 4) OR contains(body, '□') OR (doc_id % 20) / 100.0 >= 0.05 OR (length(regexp_replace(body || CASE WHEN length(deck) = 4 THEN 'Coursenotes0/90' ELSE '' END, '\\s+', '', 'g')) < 8)")
def recognition_plan(spark, sf_dir):
    own = deck_pages(spark, sf_dir).withColumn("objects", F.lit(2)).withColumn("image_share", (F.col("doc_id") % 20) / 100)
    return G.needs_recognition(own)


@query("recognised_line_merge")
def recognised_line_merge(spark, sf_dir):
    """Whole pages merged with recognised lines: their beginning and end in capitals, and a new one; the tests compare the kernel with cases."""
    head, tail = F.left("text", F.lit(40)), F.right("text", F.lit(40))
    return G.merged(deck_pages(spark, sf_dir).withColumn("recognised", F.concat_ws("\n", F.upper(head), F.upper(tail), F.lit("A new line of text"))))


@query("comparable_text")
def comparable_text(spark, sf_dir):
    """NFKC is not in SQL; the tests compare with the standard library."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.comparable("text"), 256).alias("comparable"), F.sha2(X.alphanumeric("text"), 256).alias("alphanumeric"))


@query("trace_lenient_scan", f"WITH {TRACE} SELECT count(*) FILTER (record_id % 9 <> 4) AS records, count(*) FILTER (record_id % 9 = 4) AS bad, min(record_id) FILTER (record_id % 9 = 4) AS first_bad FROM tra")
def trace_lenient_scan(spark, sf_dir):
    """The log as JSON lines of which some are cut short."""
    line = F.to_json(F.struct(*[F.col(c) for c in trace(spark, sf_dir).columns]))
    text = F.when(F.col("record_id") % 9 == 4, F.left(line, F.lit(30))).otherwise(line)
    good, bad = R.parse_trace(trace(spark, sf_dir).select(F.col("record_id").alias("line"), text.alias("value")))
    return good.agg(F.count("*").alias("records")).crossJoin(bad.agg(F.count("*").alias("bad"), F.min("line").alias("first_bad")))


def written_log(lines: DataFrame) -> str:
    """The path of a new JSON-lines log with these lines (value), in the shared folder."""
    path = f"{checkpoint_folder(lines.sparkSession)}-log"
    lines.sparkSession.dataSource.register(JsonLines)
    lines.write.format("json_lines").mode("append").save(path)
    return path


@query("log_line_numbers", f"WITH {TRACE} SELECT count(*) AS lines, count(*) FILTER (record_id % 9 = 4) AS bad, CAST(min(n) FILTER (record_id % 9 = 4) AS BIGINT) AS first_bad, CAST(max(n) FILTER (record_id % 9 = 4) AS BIGINT) AS last_bad, CAST(sum(n) FILTER (record_id % 9 = 4) AS BIGINT) AS total FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS n FROM tra)")
def log_line_numbers(spark, sf_dir):
    """A log in several files, read in ranges of some kilobytes: the numbers of its bad lines over all files."""
    line = F.to_json(F.struct(*[F.col(c) for c in trace(spark, sf_dir).columns]))
    text = F.when(F.col("record_id") % 9 == 4, F.left(line, F.lit(30))).otherwise(line)
    path = written_log(trace(spark, sf_dir).repartitionByRange(4, "record_id").sortWithinPartitions("record_id").select(text.alias("value")))
    lines = R.numbered_lines(spark, path, split_bytes=50_000)
    _, bad = R.parse_trace(lines.select(F.col("place").alias("line"), "value"))
    return lines.agg(F.count("*").alias("lines")).crossJoin(bad.agg(F.count("*").alias("bad"), F.min("line").alias("first_bad"), F.max("line").alias("last_bad"), F.sum("line").alias("total")))


@query("appended_log", f"""WITH {TRACE}, p AS (SELECT at_ms, exchange_id, event, record_id % 3 > 0 AS late FROM tra)
SELECT CAST(row_number() OVER (ORDER BY late, at_ms, exchange_id, event) - 1 AS BIGINT) AS record_id, at_ms, exchange_id, event FROM p""")
def appended_log(spark, sf_dir):
    """A log appended to twice, and read back: the second part's numbers go on from the first's."""
    path = f"{checkpoint_folder(spark)}-log"
    for late in (False, True):
        R.append_trace(trace(spark, sf_dir).filter((F.col("record_id") % 3 > 0) == F.lit(late)), path)
    return R.read_trace(spark, path).select("record_id", "at_ms", "exchange_id", "event")


@query("hashed_artifacts", "SELECT s_nationkey AS folder, count(*) AS files, string_agg(sha256(s_name || chr(10)), ',' ORDER BY sha256(s_name || chr(10))) AS hashes, CAST(sum(length(s_name) + 1) AS BIGINT) AS characters FROM supplier GROUP BY 1")
def hashed_artifacts(spark, sf_dir):
    """A file for each supplier, in folders by nation, read whole and hashed."""
    folder = f"{checkpoint_folder(spark)}-files"
    # one row a file, written by all cores: a folder for each file would have to be listed and moved by itself
    table(spark, sf_dir, "supplier").select("s_name", "s_nationkey").repartition(spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 1).partitionBy("s_nationkey").text(folder)
    read = R.hashed_files(spark, folder).withColumn("folder", F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("long"))
    return read.groupBy("folder").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias("hashes"), F.sum(F.char_length("text")).alias("characters"))


@query("fenced_json", "SELECT event_id, event_id % 3 <> 2 AS parsed, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def fenced_json(spark, sf_dir):
    """Responses that are JSON, one whole fenced block, or prose around one, which is refused."""
    e = F.col("event_id") % 3
    content = F.when(e == 0, F.col("props")).when(e == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```")))
    body = F.from_json(X.json_body(content), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", body["k"].isNotNull().alias("parsed"), body["k"].alias("k"))


@query("redacted_payloads", "SELECT event_id, '{\"authorization\":\"<REDACTED>\",\"body\":\"' || replace(event_type, 'purchase', '<REDACTED>') || '\"}' AS payload FROM events")
def redacted_payloads(spark, sf_dir):
    payload = F.concat(F.lit('{"authorization":"Bearer abc","body":"'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", X.redacted(payload, ["purchase", ""]).alias("payload"))


@query("redacted_headers", "SELECT event_id, '{\"a\":[{\"Authorization\":\"<REDACTED>\"},' || CASE WHEN event_id % 3 = 0 THEN '{\"deep\":{\"x-api-key\":\"<REDACTED>\"}}' ELSE '0' END || '],\"body\":\"' || replace(event_type, 'purchase', '<REDACTED>') || '\",\"n\":' || event_id || '}' AS payload FROM events")
def redacted_headers(spark, sf_dir):
    """Secret headers whose values are objects that hold others, inside lists and objects."""
    k = F.get_json_object("props", "$.k")
    deep = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"deep": {"x-api-key": [{"v": '), k, F.lit('}, ["purchase"]]}}'))).otherwise("0")
    payload = F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit(', "body": "'), "event_type", F.lit('", "a": [{"Authorization": {"scheme": {"name": "Bearer"}, "t": ['), k, F.lit(']}}, '), deep, F.lit("]}"))
    return N.redacted_json(table(spark, sf_dir, "events").select("event_id", payload.alias("raw")), "raw", ["purchase"], "payload").select("event_id", "payload")


@query("usage_by_path", """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE k END AS input_tokens, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN k + 1 END AS cached_tokens, CASE WHEN k % 3 > 0 THEN k * 2 END AS output_tokens FROM k""")
def usage_by_path(spark, sf_dir):
    """Token counts by path of nested responses: missing, zero, null, text, and told by the provider's own response alone."""
    k = F.get_json_object("props", "$.k").cast("long")
    text = lambda c: c.cast("string")
    prompt = F.when(k % 6 == 0, F.lit('"prompt_tokens": null, ')).when(k % 6 == 1, F.lit('"prompt_tokens": 0, ')).otherwise(F.concat(F.lit('"prompt_tokens": '), text(k), F.lit(", ")))
    completion = F.when(k % 3 > 0, text(k * 2)).otherwise(F.concat(F.lit('"'), text(k), F.lit('"')))
    cached = F.when(k % 4 == 0, F.lit('"prompt_tokens_details": {"cached_tokens": 0}, ')).otherwise("")
    raw = F.concat(F.lit('{"usage": {"prompt_tokens_details": {'), F.when(k % 4 < 2, F.concat(F.lit('"cached_tokens": '), text(k + 1))).otherwise(""), F.lit("}}}"))
    response = F.concat(F.lit('{"response": {"usage": {'), prompt, cached, F.lit('"completion_tokens": '), completion, F.lit('}}, "raw_response": '), raw, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in N.usage_counts(F.try_parse_json(response)).items()))


@query("price_parsing", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 0 THEN 'USD' ELSE 'CNY' END AS currency, CASE WHEN p_size % 4 <> 3 THEN round(p_retailprice, 6) END AS amount FROM part")
def price_parsing(spark, sf_dir):
    sign = F.element_at(F.array(*map(F.lit, ("$", "￥", "¥", "?"))), F.col("p_size") % 4 + 1)
    price = X.parsed_price(F.concat(sign, F.col("p_retailprice").cast("decimal(20,6)").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", price["currency"].alias("currency"), F.round(price["amount"], 6).alias("amount"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as price catalogs, one for each brand and ten thousand keys: brands are providers, a tenth of the prices are invalid."""
    bad = F.col("p_partkey") % 10 == 0
    cost = F.struct(F.when(bad, -1.0).otherwise(F.col("p_size").cast("double")).alias("input"), (F.col("p_size") * 2.0).alias("output"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 4).alias("cache_read"))
    model = F.struct(F.concat(F.lit("m-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), cost.alias("cost"))
    models = F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("key"), model.alias("value"))))
    own = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000)).agg(models.alias("m"))
    whole = F.create_map("p_brand", F.struct(F.lower("p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("m").alias("models")))
    return R.catalog(own.select(F.to_json(whole).alias("text")))


CATALOG_SQL = """cat AS (SELECT lower(p_brand) AS provider_id, p_brand AS provider_name, 'm-' || p_partkey AS model_id, p_name AS model_name, p_size AS i, CASE WHEN p_partkey % 3 = 0 THEN p_size / 4 ELSE p_size END AS c, p_partkey % 3 <> 0 AS cached_price_assumed FROM part WHERE p_partkey % 10 <> 0)"""
PER_TOKEN = "'$' || regexp_replace(regexp_replace(printf('%.15f', {} / 1000000.0), '0+$', ''), '\\.$', '.0')"


@query("price_catalog", f"WITH {CATALOG_SQL} SELECT provider_id, model_id, model_name, {PER_TOKEN.format('i')} AS uncached_input, {PER_TOKEN.format('c')} AS cached_input, cached_price_assumed FROM cat")
def price_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select("provider_id", "model_id", "model_name", "uncached_input", "cached_input", "cached_price_assumed")


@query("price_search", f"""WITH {CATALOG_SQL}, f AS (SELECT provider_name, model_id, model_name, regexp_replace(lower(provider_name), '[^a-z0-9]+', ' ', 'g') AS pn FROM cat), m AS (SELECT * FROM f WHERE contains(pn || ' ' || pn || ' ' || replace(model_id, '-', ' ') || ' ' || model_name, 'brand') AND contains(pn || ' ' || pn || ' ' || replace(model_id, '-', ' ') || ' ' || model_name, '7'))
SELECT provider_name, model_id, place, total, CASE WHEN total > 20 THEN 20 END AS next_offset FROM (SELECT *, row_number() OVER (ORDER BY pn = 'brand 7' DESC, CAST(contains(replace(model_id, '-', ' '), '7') OR contains(model_name, '7') AS INTEGER) DESC, 1 + CAST(contains(pn, '7') AS INTEGER) DESC, provider_name, model_name, model_id) - 1 AS place, count(*) OVER () AS total FROM m) WHERE place < 20""")
def price_search(spark, sf_dir):
    return R.search_catalog(catalog(spark, sf_dir), "Brand 7").select("provider_name", "model_id", F.col("place").cast("long").alias("place"), "total", F.col("next_offset").cast("long").alias("next_offset"))


@query("search_text_normalisation", "SELECT page_id, trim(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words FROM pages")
def search_text_normalisation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.search_words(F.col("url")).alias("words"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, length(text) AS chars, strlen(text) AS bytes, length(regexp_replace(text, '\\s+', '', 'g')) AS solid FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), X.solid_length(F.col("text")).cast("long").alias("solid"))


@query("passage_view", f"""WITH {TIMED}, p AS (SELECT lecture_id, pos // 5 AS passage_id, min(pos) AS a, max(pos) AS b FROM tok GROUP BY ALL), v AS (SELECT p.lecture_id, passage_id, CASE WHEN passage_id % 2 = 0 THEN s.start_ms + 5 ELSE s.start_ms END AS start_ms, e.end_ms, CASE WHEN passage_id % 2 = 0 THEN 'timed_tokens' ELSE 'segments' END AS basis
  FROM p JOIN tok s ON s.lecture_id = p.lecture_id AND s.pos = a JOIN tok e ON e.lecture_id = p.lecture_id AND e.pos = b) SELECT lecture_id, passage_id, start_ms, end_ms, basis FROM v""")
def passage_view(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumnRenamed("pos", "id")
    own = rows.groupBy("lecture_id", F.floor(F.col("id") / 5).alias("passage_id")).agg(F.min("id").alias("source_start"), F.max("id").alias("source_end"), (F.min("start_ms") + 5).alias("start_ms"), F.max_by("end_ms", "id").alias("end_ms"))
    found = own.filter("passage_id % 2 = 0").withColumn("basis", F.lit("timed_tokens"))
    return reports.passage_view(own, rows, found).select("lecture_id", "passage_id", "start_ms", "end_ms", "basis")


@query("passage_titles", f"WITH {PASSAGES}, t AS (SELECT lecture_id, passage_id, string_agg(s.text, ' ' ORDER BY s.id) AS joined FROM pas p JOIN seg s USING (lecture_id) WHERE s.id BETWEEN source_start AND source_end GROUP BY ALL) SELECT lecture_id, passage_id, CASE WHEN passage_id % 2 = 0 THEN 'Summary ' || passage_id ELSE joined END AS title FROM t")
def passage_titles(spark, sf_dir):
    own = passages(spark, sf_dir).drop("text").withColumn("summary", F.when(F.col("passage_id") % 2 == 0, F.concat(F.lit("Summary "), F.col("passage_id").cast("string"))).otherwise(" 　"))
    return reports.titled(own, segments(spark, sf_dir)).select("lecture_id", "passage_id", "title")


@query("alignment_heat_map", f"WITH {SCORES_SQL}, n AS (SELECT lecture_id * 10 + query_id AS query_id, slide_id, score FROM sco) SELECT query_id, slide_id, CAST(round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * 100) AS BIGINT) AS percent FROM n WINDOW w AS (PARTITION BY query_id)")
def alignment_heat_map(spark, sf_dir):
    return reports.heat_map(scores(spark, sf_dir).withColumn("query_id", F.col("lecture_id") * 10 + F.col("query_id")))


@query("markdown_export", f"WITH {PASSAGES} SELECT lecture_id, string_agg('## ' || passage_id || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY chars % 100 DESC, passage_id) AS value FROM pas GROUP BY 1")
def markdown_export(spark, sf_dir):
    return reports.markdown(passages(spark, sf_dir).withColumn("percentile", F.col("chars") % 100))


@query("newest_first", "SELECT event_id AS item, epoch_us(ts) // 1000 AS created_ms, row_number() OVER (ORDER BY epoch_us(ts) // 1000 DESC, event_id) AS place FROM events")
def newest_first(spark, sf_dir):
    own = timed(spark, sf_dir).select(F.col("event_id").alias("item"), F.col("start_ms").alias("created_ms"))
    return reports.ranked_titles(own).withColumn("place", F.col("place").cast("long"))


@query("restored_text", f"WITH {SEGMENTS} SELECT lecture_id, string_agg(text, '' ORDER BY id) FILTER (role <> 'system') AS text FROM seg GROUP BY 1")
def restored_text(spark, sf_dir):
    """Spans of text in order; omissions have none."""
    own = segments(spark, sf_dir).withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("id", "text")))), lambda x: x["text"]), "")
    return own.groupBy("lecture_id").agg(F.nullif(joined, F.lit("")).alias("text"))




@query("redacted_chunks", f"WITH {TIMED} SELECT lecture_id AS stream, replace(string_agg(event_type, '' ORDER BY pos), 'kview', '<REDACTED>') AS text FROM tok GROUP BY 1")
def redacted_chunks(spark, sf_dir):
    """A user's events as chunks of one text, with a secret that spans two."""
    from rostrum.functions.redaction import redacted_chunks

    out = redacted_chunks(timed(spark, sf_dir).select(F.col("lecture_id").alias("stream"), "pos", F.col("event_type").alias("text")), "kview")
    return out.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


@query("retry_after", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 100) * 1000 WHEN event_id % 3 = 1 THEN 90000 END AS wait_ms FROM events")
def retry_after(spark, sf_dir):
    """Seconds, dates ninety seconds on, and values that are neither."""
    from rostrum.functions.redaction import retry_after_ms

    e, now = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    header = F.when(e % 3 == 0, (e % 100).cast("string")).when(e % 3 == 1, F.date_format(now + F.expr("INTERVAL 90 SECOND"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", retry_after_ms(header, now).alias("wait_ms"))
