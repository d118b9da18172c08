"""Operators on small tables: order independence, windows, validation, playback, sources, streams."""

import json

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import projection, segmentation, validation, windows
from rostrum.plans import catalog
from rostrum.sources import artifacts, transcripts

SEGMENT = "lecture_id long, id long, start_ms long, end_ms long, text string"
SMOKE = "/root/testdata/sf0.001"


def segments(spark, texts, timed=False):
    rows = [(1, k, k * 1000 if timed else None, k * 1000 + 1000 if timed else None, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENT)


@pytest.mark.parametrize("parts", [1, 7])
def test_greedy_windows_ignore_partitioning(spark, parts):
    rows = segments(spark, ["a" * 200, "b" * 200, "c", "d" * 900, "e"]).orderBy(F.rand(1)).repartition(parts)
    got = sorted(tuple(r)[1:] for r in windows.greedy_windows(rows).collect())
    assert got == [(0, 0, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4)]


def test_greedy_windows_by_time(spark):
    got = windows.greedy_windows(segments(spark, ["x"] * 5, timed=True), 400, 2000).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 1), (1, 2, 3), (2, 4, 4)]


def test_omissions_never_cut(spark):
    got = windows.greedy_windows(segments(spark, ["a" * 300, None, "b" * 300, None])).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 1), (1, 2, 3)]
    assert windows.greedy_windows(segments(spark, [None, None])).count() == 0


def test_atoms_join_to_their_text(spark):
    texts = ["一。二！", "x" * 451, "a，" * 100, "", "end\n\nnext; 🦀", "，" * 400]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "lecture_id long, text string")
    rows = windows.atom_table(df).collect()
    for k, t in enumerate(texts):
        own = [r.text for r in sorted((r for r in rows if r.lecture_id == k), key=lambda r: r.atom_id)]
        assert "".join(own) == t and all(0 < len(a) <= 150 for a in own)
    assert sorted(len(r.text) for r in rows if r.lecture_id == 1) == [112, 113, 113, 113]


def test_first_violation_is_raised(spark):
    good = segments(spark, ["a", "b"])
    validation.demand(validation.source_errors(good))
    with pytest.raises(validation.ValidationError, match="blank_text"):
        validation.demand(validation.source_errors(segments(spark, ["a", "　 "])))


def test_playback_shares_boundaries(spark):
    tokens = spark.createDataFrame([(1, k, c, 100 * k, 100 * k + 100) for k, c in enumerate("abcdefghij")], "lecture_id long, pos long, text string, start_ms long, end_ms long")
    own = spark.createDataFrame([(1, 0, 0, 0, 0, 600, "abcde"), (1, 1, 1, 1, 400, 1000, "fghij")], "lecture_id long, passage_id long, source_start long, source_end long, start_ms long, end_ms long, text string")
    got = sorted(tuple(r) for r in projection.playback(own, tokens).collect())
    assert got == [(1, 0, 0, 500, "timed_tokens"), (1, 1, 500, 1000, "timed_tokens")]
    coarse = projection.playback(own.withColumn("text", F.lit("zzz")), tokens).collect()
    assert {r.basis for r in coarse} == {"segments"}


def test_recognised_tokens_stay_in_order(spark):
    row = (1, 0, 0, 10_000, 1_000, 9_000, ["a", " ", "b", "c"], [0.5, 1.0, 2.0, 1.5], [0.2, 0.1, 1.0, 0.1])
    df = spark.createDataFrame([row], "lecture_id long, region long, input_start long, input_end long, owned_start long, owned_end long, tokens array<string>, starts array<double>, durations array<double>")
    got = sorted((r.pos, r.text, r.start_ms, r.end_ms) for r in projection.normalized_tokens(df).collect())
    assert got == [(2, "b", 2000, 3000), (3, "c", 3000, 3100)]


def test_sentences_and_stitching(spark):
    tokens = spark.createDataFrame([(1, k, c, k, k + 1) for k, c in enumerate(["a", "b。", "c", "d?", "e"])], "lecture_id long, pos long, text string, start_ms long, end_ms long")
    assert [r.text for r in segmentation.sentences(tokens).orderBy("sentence").collect()] == ["ab。", "cd?", "e"]
    pieces = spark.createDataFrame([(1, 0, 0, True, "a", 1), (1, 1, 0, True, "b", 2), (1, 1, 1, True, "c", 2), (1, 2, 0, True, "d", 1)], "lecture_id long, window_index long, pos long, continues boolean, text string, slide long")
    got = segmentation.stitched(pieces).orderBy("passage_id").collect()
    assert [(r.text, r.slides) for r in got] == [("ab", [1, 2]), ("cd", [2, 1])]


def test_text_functions(spark):
    df = spark.createDataFrame([("Ａｂ１ + ①", 3_723_004), ("　x ", 59_999), (None, None)], "t string, ms long")
    rows = df.select(X.comparable("t"), X.alphanumeric("t"), X.trimmed(F.col("t")), X.clock(F.col("ms")), X.solid_length(F.col("t"))).collect()
    assert tuple(rows[0]) == ("ab1+1", "ab11", "Ａｂ１ + ①", "01:02:03", 5)
    assert tuple(rows[1]) == ("x", "x", "x", "00:59", 1)
    assert tuple(rows[2]) == (None,) * 5


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿7\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n8\r\n01:00:00,000 --> 01:00:01,000\r\nBye\r\n".encode())
    (tmp_path / "a.vtt").write_text("WEBVTT\n\nNOTE no cue\n\n00:01.000 --> 00:02.500 align:start\n<b>Hi</b>\n")
    (tmp_path / "a.txt").write_text("One. 你好！Yes?\n\n" + "z" * 501)
    (tmp_path / "a.json").write_text(json.dumps({"sentences": [{"id": 0, "start_ms": 0, "end_ms": 5, "text": "x"}]}))
    read = lambda kind: [tuple(r)[1:] for r in transcripts.read(spark, f"{tmp_path}/a.{kind}", kind).orderBy("id").collect()]
    assert read("srt") == [(0, 1500, 2000, "Hello\nthere"), (1, 3_600_000, 3_601_000, "Bye")]
    assert read("vtt") == [(0, 1000, 2500, "Hi")]
    assert [r[3] for r in read("txt")] == ["One. 你好！", "Yes?", "z" * 500, "z"]
    assert read("json") == [(0, 0, 5, "x")]


def test_appended_traces_number_on(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 1, "request"), (0, 6, 1, "completion")], "record_id long, at_ms long, exchange_id long, event string")
    for _ in range(2):
        artifacts.append_trace(rows, f"{tmp_path}/t")
    assert sorted(r.record_id for r in artifacts.read_trace(spark, f"{tmp_path}/t").collect()) == [0, 1, 2, 3]


def test_strict_traces_fail_on_a_bad_line(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"record_id": 1, "event": "request"}\n{"record_id": 2,\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        artifacts.read_trace(spark, f"{tmp_path}/t.jsonl").collect()
    good, bad = artifacts.parse_trace(spark.read.text(f"{tmp_path}/t.jsonl").selectExpr("monotonically_increasing_id() AS line", "value"))
    assert (good.count(), bad.count()) == (1, 1)


def test_streamed_admission_is_the_batch_one(spark):
    batch, stream = (sorted(map(tuple, catalog.QUERIES[q](spark, SMOKE).collect())) for q in ("adaptive_admission", "stream_admission"))
    assert batch == stream


def test_fenced_json_only_whole(spark):
    df = spark.createDataFrame([('{"a":1}',), ('```json\n{"a":1}\n```',), ('so ```json\n{"a":1}\n```',)], "c string")
    assert [r[0] for r in df.select(F.from_json(X.json_body(F.col("c")), "a int")["a"]).collect()] == [1, 1, None]


def test_boundary_labels_by_openings_and_endings(spark):
    """Golden cases by hand: openings, white space before them, and the last mark of an atom whatever follows it."""
    texts = ["开始", " 下面我们看", "最后我们说", "\u3000首先", "其次。”", "好，那么接下来：", "完。 x", "对，y", "a；b", "问？)", "End! (so)", "Next", "好。，"]
    want = ["required_break", "required_break", "preferred_break", "preferred_break", "required_break", "continue", "possible_break", "continue", "continue", "possible_break", "possible_break", "continue", None]
    from rostrum.operators import segmentation

    atoms = spark.createDataFrame([("l", k, t) for k, t in enumerate(texts)], "lecture_id string, atom_id long, text string")
    got = [r.label for r in segmentation.boundary_labels(atoms).orderBy("atom_id").collect()]
    assert got == want


def test_every_lecture_is_partitioned_or_named(spark):
    from rostrum.operators import segmentation
    from rostrum.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    for name in ("segmentation_dp", "segmentation_prototype"):
        rows = QUERIES[name](spark, folder).collect()
        assert {r.lecture_id for r in rows} == ids or name == "segmentation_dp" and {r.lecture_id for r in rows} <= ids
        whole = [r for r in rows if r.error is None]
        for lecture in {r.lecture_id for r in whole}:
            own = sorted((r for r in whole if r.lecture_id == lecture), key=lambda r: r.passage_id)
            assert own[0].atom_start == 0 and all(a.atom_end == b.atom_start for a, b in zip(own, own[1:], strict=False))
        assert all(r.chars <= (450 if "prototype" in name else 300) for r in whole)
    rows = [("a", 0, "x" * 500, "continue"), ("b", 0, "x" * 100, None)]
    got = segmentation.partition(spark.createDataFrame(rows, "lecture_id string, atom_id long, text string, cut string"), prototype=True).collect()
    assert {(r.lecture_id, r.passage_id, r.error) for r in got} == {("a", None, "no_partition"), ("b", 0, None)}


def test_redaction_reaches_every_spelling_and_depth(spark):
    import json

    from rostrum.functions.text import redacted

    secret = 'k"1 /é'
    payload = {"a": [{"X-API-Key": "other", "note": f"<{secret}>"}], "Authorization": 'Bearer a"b\\', "proxy-authorization": ["x", "y"], "x-api-key": 12, "kept": "authorization: no"}
    rows = [(json.dumps(payload, ensure_ascii=False),), ("?key=k%221+%2F%C3%A9&b=1",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(redacted(F.col("text"), [secret, ""])).collect()]
    mark = "<REDACTED>"
    assert json.loads(got[0]) == {"a": [{"X-API-Key": mark, "note": f"<{mark}>"}], "Authorization": mark, "proxy-authorization": mark, "x-api-key": mark, "kept": "authorization: no"}
    assert got[1:] == [f"?key={mark}&b=1", None]


def test_places_of_groups(spark):
    from rostrum.operators.reports import ranked_titles

    rows = [(f"i{k}", k * 7919 % 500_000 if k % 9 else None) for k in range(300)]
    got = ranked_titles(spark.createDataFrame(rows, "item string, created_ms long").repartition(5)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 301))
    assert [r["item"] for r in got] == [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_empty_passages_have_no_provenance(spark):
    from rostrum.operators.validation import provenance_errors

    spans = spark.createDataFrame([(1, 0, "text", 0, 0, "ab" * 5000), (1, 1, "omitted_disfluency", 1, 1, None), (1, 2, "text", 2, 3, "é")], "lecture_id long, pos long, kind string, source_start long, source_end long, text string")
    own = spark.createDataFrame([(1, 0, 0, 0, "ab" * 4000), (1, 1, 0, 3, "ab" * 1000 + "é"), (1, 2, 3, 3, ""), (1, 3, 3, 3, "beyond")], "lecture_id long, passage_id long, source_start long, source_end long, text string")
    assert sorted((r.error, r.position) for r in provenance_errors(own, spans).collect()) == [("empty_passage", 2), ("missing_provenance", 3)]
