"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from rostrum.llm import quality_model, token_counts
from tests.llm.test_operators import WORD, components, plain_dedup, wanted_targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents and of every stage, each from those of the one before as read back."""
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append(docs.collect())
    return out


def test_quality_stage_keeps_what_the_classifier_predicts(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r.doc_id for r in quality_model.score_quality(docs, model).collect() if r.predicted == 1}
    assert Counter(stages[1]) == Counter(r for r in stages[0] if r.doc_id in kept)


def test_line_stage_is_the_plain_one(stages):
    plain = plain_dedup([(r.doc_id, r.text, r.source) for r in stages[1]], 5)
    want = {k: t for k, t, gone in plain if not gone or WORD.search(t)}
    assert {r.doc_id: r.text for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_jaccard_stage_keeps_one_of_each_component(stages):
    want = {c for _, n, c in components([(r.doc_id, r.text, r.source) for r in stages[2]]) if n}
    assert {r.doc_id for r in stages[3] if WORD.search(r.text or "")} == want
    assert not set(stages[3]) - set(stages[2])


def test_mix_stage_meets_targets(stages):
    size = lambda r: len(WORD.findall(r.text or ""))
    before, after, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[3]:
        before[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in stages[4]:
        after[r.source] += size(r)
    for source, target in wanted_targets(before).items():
        assert abs(after[source] - target) <= largest[source] / 2 + 1e-6
    assert max(Counter(stages[4]).values()) <= 3 and not set(stages[4]) - set(stages[3])


def test_token_stage_is_the_librarys(stages):
    library = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(e.ids), r.text) for r, e in zip(stages[4], library.encode_batch([r.text for r in stages[4]], add_special_tokens=False), strict=True))
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in stages[5]) == want


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[5])


def test_columns(stages):
    assert all(tuple(s[0].__fields__) == ("doc_id", "text", "lang", "source", "n_chars") for s in stages[:5])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing names; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n_lines string, n_removed string"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", "a", 150_000), (4, "one two three", None, "b", 13), (4, "one two three", None, "b", 13), (None, "four five", "en", None, 9)]
    docs = spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, FOLDER)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        if name != "bpe_codec":
            assert got.columns == docs.columns and all((r.score, r.predicted, r.n_lines, r.n_removed) == ("w", "x", "y", "z") for r in got.collect())
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 6
    scored = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)
    assert scored.columns == docs.columns and scored.count() <= 6
