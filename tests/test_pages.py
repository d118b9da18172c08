"""Queries over pages against plain versions on a small table of documents with long texts."""

import pytest

from rostrum.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    line = "a line of plain words "
    texts = [f"{line * 5}\n second  line {k}\nend {k}" for k in range(6)] + [line * 9 + "\nbroken \u25a1 here", " " * 80 + "\nall of it stands behind blanks"]
    rows = [(100 + k, text, "long deck") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def plain(text):
    return "\n".join(x.strip() for x in text.split("\n") if x.strip())


def test_slides_hold_whole_pages(spark, folder):
    path, rows = folder
    got = {r.slide_id: r.text for r in QUERIES["deck_slides_whole"](spark, path).collect()}
    want = {k: "ab" if i % 11 == 0 else plain(t + (" \u25a1\ufffd" if i % 13 == 0 else "")) for k, (i, t, _) in enumerate(rows)}
    assert got == want


def test_warnings_see_whole_pages(spark, folder):
    path, _ = folder
    got = {(r.page, r.sparse, r.glyphs) for r in QUERIES["sparse_page_warnings"](spark, path).collect()}
    assert got == {(5, False, "\u25a1\ufffd"), (7, False, "\u25a1")}
    assert {r.place for r in QUERIES["import_warning_rollup"](spark, path).collect()} == {6, 8}
    assert {6} <= {r.page for r in QUERIES["recognition_plan"](spark, path).collect()}


def test_every_repeated_footer_is_given(spark, tmp_path):
    texts = ["one\nThe same last  line", "two\nThe same last line", "three\nThe same last line", "four\nanother"]
    rows = [(200 + k, t, "long deck") for k, t in enumerate(texts)] + [(300 + k, f"page {k}\nlast x{k}y", "no footer") for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.deck, r.footer, r.n, r.pages) for r in QUERIES["footer_majority"](spark, str(tmp_path)).collect()]
    assert got == [("long deck", "The same last line", 3, 4)]


def test_pages_are_merged_a_few_at_a_time(spark, monkeypatch):
    """Merged pages leave in parts, whatever a batch holds, and null texts and lines stay what they were."""
    from rostrum.sources import pages

    monkeypatch.setattr(pages, "PAGES", 3)
    rows = [("d", k, None if k == 4 else f"a first line {k}\nanother", None if k == 5 else "A FIRST LINE\nsomething new") for k in range(10)]
    found = pages.merged(spark.createDataFrame(rows, "deck string, page long, text string, recognised string").coalesce(1))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.page: r.text for r in found.collect()}
    assert got[0] == "a first line 0\nanother\nsomething new" and got[4] == "A FIRST LINE\nsomething new" and got[5] == "a first line 5\nanother" and len(got) == 10
