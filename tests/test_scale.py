"""Queries on tables that are larger or odder than the stand-ins, against their SQL."""

import duckdb
import pytest

from rostrum.plans.catalog import ORACLES, QUERIES
from tests.test_queries import rows


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables from DuckDB's SQL and compares a query with its own."""

    def check(name, **tables):
        db = duckdb.connect()
        for table, sql in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            db.execute(f"COPY ({sql}) TO '{path}'").fetchall()
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'").fetchall()
        got, want = QUERIES[name](spark, str(tmp_path)), db.sql(ORACLES[name])
        found = rows(got.columns, got.collect())
        assert found and found == rows(want.columns, want.fetchall())

    return check


def test_decisions_beyond_a_million(same):
    same("decision_errors", orders="SELECT k AS o_orderkey, k % 15 AS o_custkey, (k * 7919) % 1000 / 1.0 AS o_totalprice FROM (SELECT unnest(range(1200)) + base AS k FROM (VALUES (0), (4000000), (8000000)) v(base))")


def test_choices_beyond_a_million_are_checked(spark, tmp_path):
    """Comparison 1,000,022 and others have a choice that was no candidate, which is told."""
    path = f"{tmp_path}/orders.parquet"
    duckdb.connect().execute(f"COPY (SELECT range AS o_orderkey, range % 15 AS o_custkey, range * 1.0 AS o_totalprice FROM range(4000000, 4000400)) TO '{path}'").fetchall()
    found = QUERIES["decision_errors"](spark, str(tmp_path)).filter("error = 'not_a_candidate'")
    assert [r.comparison_id for r in found.orderBy("comparison_id").collect()] == [k for k in range(1_000_000, 1_000_100) if k % 60 == 2 and k % 70 != 1] != []


def test_steps_of_float_differences(same):
    """0.03 as a float lies below 0.03; a float product gives 3 steps, a double's 2."""
    same("competition_ranks", embeddings="SELECT range AS vec_id, [CAST(range / 100.0 AS FLOAT), 1::FLOAT] AS embedding, 1 AS label FROM range(8)")


def test_catalog_texts_are_bounded(spark, tmp_path, monkeypatch):
    """No text holds all models of a brand, and a model's row doesn't carry the others."""
    from rostrum.plans import sources

    duckdb.connect().execute(f"COPY (SELECT range AS p_partkey, 'part' AS p_name, 'Brand#1' AS p_brand, 3 AS p_size FROM range(0, 40000, 10) UNION ALL SELECT 1, 'part', 'Brand#1', 3) TO '{tmp_path}/part.parquet'").fetchall()
    seen, own = [], sources.R.catalog
    monkeypatch.setattr(sources.R, "catalog", lambda texts: seen.append(texts) or own(texts))
    assert sources.catalog(spark, str(tmp_path)).count() == 1
    assert seen[0].count() == 4


def test_artifacts_have_no_folder_each(spark, monkeypatch):
    from pathlib import Path

    from rostrum.plans import sources

    seen, own = [], sources.R.hashed_files
    monkeypatch.setattr(sources.R, "hashed_files", lambda spark, path: seen.append(path) or own(spark, path))
    made = sources.hashed_artifacts(spark, "/root/testdata/sf0.001")
    root = Path(seen[0].split("*")[0])
    nations = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    assert sum(p.is_dir() for p in root.rglob("*")) == nations.select("s_nationkey").distinct().count()
    assert sum(r.files for r in made.collect()) == len(list(root.rglob("*.txt"))) == nations.count()


def test_texts_are_cut_together_as_one_by_one():
    import random

    from rostrum.functions import segmentation as S

    draw = random.Random(5)
    model = S.model_of({"".join(draw.choices("abcd木", k=draw.randint(1, 5))): draw.randint(2, 9) for _ in range(60)})
    texts = ["".join(draw.choices("abcdeX木水. 1\0", weights=[9] * 8 + [1] * 4, k=draw.randint(0, 90))) for _ in range(80)]
    walker = model.trie.lists()
    for unspaced in (r"\p{L}", S.UNSPACED):
        found = S.Cutter(model, unspaced).terms([*texts, None, ""])
        assert found == [*(S.terms_of(text, model, walker, unspaced) for text in texts), None, []]


def test_terms_are_cut_once(spark):
    """A costly analyzer sees each text once, and scores are added up in the slide's row."""
    from pyspark.sql import functions as F

    from rostrum.operators import retrieval as R

    seen = spark.sparkContext.accumulator(0)

    def cut(text):
        seen.add(1)
        return text.split()

    slides = spark.createDataFrame([(k, "a b b c" if k % 2 else "c d") for k in range(40)], "slide_id long, text string")
    queries = spark.createDataFrame([(1, "a c"), (2, "b"), (3, "none")], "query_id long, text string")
    scores = R.bm25(slides, queries, F.udf(cut, "array<string>")("text"), F.split("text", " "))
    found = {(r.query_id, r.slide_id): r.score for r in scores.collect()}
    assert seen.value == 40
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    wanted = queries.select("query_id", F.explode(F.split("text", " ")).alias("term"))
    joined = {(r.query_id, r.slide_id): r.score for r in R.bm25_by_joins(slides, wanted, F.split("text", " ")).collect()}
    assert found == pytest.approx(joined) and len(found) == 60


def test_cosines_by_blocks(spark, monkeypatch):
    """The k best by blocks are those of all pairs, ties, zero and missing vectors among them, and no row is made for a pair."""
    from pyspark.sql import functions as F

    from rostrum.operators import retrieval as R

    monkeypatch.setattr(R, "BLOCK", 7)
    rows = [(k, None if k % 19 == 3 else [0.0, 0.0] if k % 17 == 2 else [float(k % 5 - 2), float(k % 3)]) for k in range(90)]
    slides = spark.createDataFrame(rows, "slide_id long, vector array<float>").repartition(3)
    queries = slides.filter("slide_id % 10 = 0").withColumnRenamed("slide_id", "query_id")
    key = lambda df: sorted((r.query_id, r.slide_id, round(r.score, 9), r["rank"]) for r in df.collect())
    found = R.dense_top_k(slides, queries, 5)
    assert key(found) == key(R.top_k(R.dense(slides, queries).withColumn("score", F.round("score", 9)), 5)) != []


def test_shown_digits_are_rounded_once(spark):
    from pyspark.sql import functions as F

    from rostrum.plans import retrieval

    scores = spark.createDataFrame([(1, 1, 0.4554154996)], "query_id long, slide_id long, score double")
    assert retrieval.by_nine(scores).select(F.round("raw", 6)).first()[0] == 0.455415


def test_short_lectures_share_a_batch(spark):
    """Windows are cut without a pandas group for each lecture."""
    from rostrum.operators import windows as W

    rows = spark.createDataFrame([(k, i, None, None, None if (k + i) % 5 == 0 else "x" * (i * 60)) for k in range(30) for i in range(8)], "lecture_id long, id long, start_ms long, end_ms long, text string")
    found = W.greedy_windows(rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in found.filter("lecture_id = 1").orderBy("window_index").collect()] == [(0, 0, 4), (1, 5, 5), (2, 6, 6), (3, 7, 7)]


def odd_vectors(spark):
    """Ties, zero and missing vectors, and missing labels."""
    rows = [(k, None if k % 19 == 3 else [0.0, 0.0] if k % 17 == 2 else [(k * 37 % 101 - 50) / 100, (k % 7 - 3) / 10], None if k % 11 == 5 else k % 4) for k in range(90)]
    slides = spark.createDataFrame(rows, "slide_id long, vector array<float>, label int").repartition(3)
    return slides, slides.filter("slide_id % 5 = 0 OR slide_id % 19 = 3").withColumnRenamed("slide_id", "query_id").withColumnRenamed("label", "ql")


def near_pairs(slides, queries):
    from pyspark.sql import functions as F

    steps = F.abs(F.element_at(F.col("vector"), 1) - F.element_at(F.col("q"), 1)) * F.lit(100).cast("float")
    pairs = queries.select("query_id", F.col("vector").alias("q")).crossJoin(slides)
    return pairs.select("query_id", "slide_id", F.greatest(10 - F.floor(steps), F.lit(0)).cast("double").alias("score"))


def test_first_relevant_ranks_by_blocks(spark, monkeypatch):
    """Ranks by tiles are those of all pairs, and no row is made for a pair."""
    from pyspark.sql import functions as F

    from rostrum.operators import retrieval as R
    from rostrum.plans.retrieval import near_steps

    monkeypatch.setattr(R, "BLOCK", 7)
    slides, queries = odd_vectors(spark)
    found = R.first_relevant_ranks(slides, queries.withColumnRenamed("ql", "label"), R.cosine_units, near_steps)
    relevant = queries.join(slides, F.col("ql") == F.col("label")).select("query_id", "slide_id")
    for mode, scores in enumerate((R.dense(slides, queries).withColumn("score", F.round("score", 9)), near_pairs(slides, queries))):
        want = R.first_relevant_rank(scores.filter("slide_id <> query_id"), relevant)
        assert sorted(map(tuple, found.filter(F.col("mode") == mode).select("query_id", "rank").collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("constant", [60, 1_000_000])
def test_fusion_by_blocks(spark, monkeypatch, constant):
    """The best by fusion are those of all pairs; with the large constant nine digits tie far more slides than are kept of a step."""
    from pyspark.sql import functions as F

    from rostrum.operators import retrieval as R
    from rostrum.plans import retrieval

    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "RRF_K", constant)
    slides, queries = odd_vectors(spark)
    key = lambda df, score: sorted((r.query_id, r.slide_id, round(r[score], 9), r["rank"]) for r in df.collect())
    found = R.fused_top_k(slides, queries, R.cosine_units, retrieval.near_steps, 5)
    fused = R.fuse(R.dense(slides, queries).withColumn("score", F.round("score", 9)), near_pairs(slides, queries))
    assert key(found, "score") == key(R.top_k(retrieval.by_nine(fused), 5), "raw") != []


@pytest.mark.parametrize("name", ["retrieval_hit_mrr", "rrf_fusion_top5"])
def test_no_row_for_a_pair(spark, monkeypatch, name):
    """These queries make no table of pairs."""
    from rostrum.plans import retrieval

    monkeypatch.setattr(retrieval, "second_mode", None)
    monkeypatch.setattr(retrieval.R, "dense", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_long_intervals_come_in_few_buckets(spark):
    """Rows that last far longer than a bucket is wide meet without a row for each of its buckets."""
    from rostrum.operators import intervals as I

    left = spark.createDataFrame([(1, g, g * 10**10, (g + 1) * 10**10) for g in range(5)] + [(2, 0, 5, 9)], "lecture_id long, grp long, s long, e long")
    right = spark.createDataFrame([(1, p, p * 3 * 10**9, (p + 1) * 3 * 10**9) for p in range(20)] + [(2, 0, 0, 5), (2, 1, 8, 12), (3, 0, 5, 9)], "lecture_id long, pos long, start_ms long, end_ms long")
    want = sorted((a, g, p) for a, g, s, e in left.collect() for b, p, x, y in right.collect() if a == b and y > s and x < e)
    assert sorted(map(tuple, I.overlapping(left, right, 2).select("lecture_id", "grp", "pos").collect())) == want


#: Marks after letters, digits and scripts, letters of two cases, and characters that change when they are normalised.
ODD = ["", None, "ab1\u0e31\u0e31กั1ก\u0e31ab", "\u0301a\u0301\u0302b 1\u0301\u03012", "ΑΣ.Α ΑΣ ας İstanbul", "ＡＢ ﬁ ²x _a_b_", "木水a木\u0301木", "Ab aB AB ab", "\0a\0", "ก" * 40 + "木ab" * 30]


def cutters(seed=7):
    import random

    from rostrum.functions import segmentation as S

    draw = random.Random(seed)
    return S.model_of({"".join(draw.choices("abก木\u0e31", k=draw.randint(1, 6))): draw.randint(2, 9) for _ in range(80)}), draw


def test_blocks_of_the_word_graph_do_not_show(monkeypatch):
    """Columns and blocks of any size, with marks that go on with words, give the terms of one text alone."""
    from rostrum.functions import segmentation as S

    model, draw = cutters()
    texts = [*ODD, *("".join(draw.choices("abก木\u0e31\u0301cX1. ", k=draw.randint(0, 200))) for _ in range(60))]
    walker = model.trie.lists()
    for cells, column, together in ((1, 1, 1), (7, 3, 50), (64, 1000, 10**6)):
        monkeypatch.setattr(S, "CELLS", cells)
        monkeypatch.setattr(S, "COLUMN", column)
        monkeypatch.setattr(S, "TOGETHER", together)
        for unspaced in (r"\p{L}", S.UNSPACED):
            assert S.Cutter(model, unspaced).terms(texts) == [None if t is None else S.terms_of(t, model, walker, unspaced) for t in texts]


@pytest.mark.parametrize("often", [1, 1000])
def test_terms_are_counted_where_they_are_cut(spark, monkeypatch, often):
    """Counts of rows, of which only those with a shared id are added up; equal to counts of the analyzer's terms, missing ids and texts among them."""
    from rostrum.functions import segmentation as S
    from rostrum.operators import retrieval as R

    monkeypatch.setattr(R, "REPEATED", often)
    model, _ = cutters()
    rows = [*enumerate(ODD), (3, "Ab 1 木"), (3, "ab"), (None, "ab ab"), (None, "ab 木"), (4, None)]
    docs = spark.createDataFrame(rows, "slide_id long, text string").repartition(3)
    for unspaced in (r"\p{L}", S.UNSPACED):
        found = R.index_of_counts(docs, lambda some, own=unspaced: S.term_counts(some, model, own))
        want = R.inverted_index(docs, S.analyzer(model, unspaced)("text"))
        assert found.schema.names == want.schema.names and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize("name", ["segmented_terms", "analyzed_terms"])
def test_terms_do_not_leave_workers_one_by_one(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan


def test_texts_below_the_scripts_are_not_searched_for_them(spark):
    from rostrum.functions import segmentation as S

    assert S.least(S.UNSPACED) == 0xE00 and S.least(r"\p{L}") == 0
    df = spark.createDataFrame([("ab ab é – ” ab",), ("กก ab กก",), (None,)], "text string")
    assert S.cohesive_words(df) == {"ก": 4}
    assert S.cohesive_words(df, unspaced="a") == {"a": 4}


def test_only_nearly_best_pairs_leave_workers(spark, monkeypatch):
    """The three best in nine digits are the same, with ties of more slides than are kept, and few pairs are left."""
    from pyspark.sql import functions as F

    from rostrum.functions import segmentation as S
    from rostrum.operators import retrieval as R
    from rostrum.plans import retrieval

    model, draw = cutters()
    texts = ["".join(draw.choices("abก木1 ", k=draw.randint(1, 40))) for _ in range(30)]
    slides = spark.createDataFrame([(k * 7 % 301, texts[k % 11] if k % 3 else texts[k % 30]) for k in range(300)] + [(400, None), (401, "")], "slide_id long, text string").repartition(3)
    queries = spark.createDataFrame([*enumerate(texts[:12]), (50, "zz"), (51, None)], "query_id long, text string")
    terms = S.analyzer(model, retrieval.LETTERS)(F.col("text"))
    every = R.bm25(slides, queries, terms, terms)
    few = R.bm25(slides, queries, terms, terms, lambda rows, wanted: S.wanted_counts(rows, wanted, model, retrieval.LETTERS), 3)
    key = lambda df: sorted((r.query_id, r["rank"], r.slide_id, round(r.raw, 9)) for r in R.top_k(retrieval.by_nine(df), 3).collect())
    assert key(few) == key(every) != []
    assert few.count() < every.count() / 4
