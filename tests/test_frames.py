"""Frame matching against windows summed one by one, with odd sizes, ties, nulls and lectures without pages."""

import numpy as np
import pytest

from rostrum.operators import frames
from rostrum.plans.catalog import QUERIES
from rostrum.plans.standins import PICTURE, brighter_below, pictures


def plain_similarity(a, b, size, stride):
    total = area = 0.0
    for y in range(0, max(len(a) - size, 0) + stride, stride):
        for x in range(0, max(len(a[0]) - size, 0) + stride, stride):
            p, q = (np.array(m, float)[y : y + size, x : x + size] for m in (a, b))
            if p.size:
                cov = ((p - p.mean()) * (q - q.mean())).mean()
                own = (2 * p.mean() * q.mean() + 6.5025) * (2 * cov + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var() + q.var() + 58.5225))
                total, area = total + own * p.size, area + p.size
    return total / area


@pytest.mark.parametrize(("high", "wide", "size", "stride"), [(16, 16, 8, 8), (20, 24, 8, 8), (9, 5, 8, 8), (3, 4, 8, 8), (20, 24, 8, 3), (11, 13, 4, 1), (1, 1, 8, 8)])
def test_similarities_are_those_of_windows_one_by_one(high, wide, size, stride):
    rng = np.random.default_rng(high * wide)
    deck, frame = rng.integers(0, 256, (5, high, wide)).astype(float), rng.integers(0, 256, (high, wide)).astype(float)
    got = frames.Pages(deck, size, stride).similarities(frame)
    assert got == pytest.approx([plain_similarity(page, frame, size, stride) for page in deck], abs=1e-9)
    assert frames.Pages(frame[None], size, stride).similarities(frame) == pytest.approx([1.0])


def test_matches_of_odd_frames(spark, monkeypatch):
    monkeypatch.setattr(frames, "TOGETHER", 2)
    rng = np.random.default_rng(3)
    deck = [rng.integers(0, 256, 60).astype(np.uint8).tobytes() for _ in range(5)]
    pages = [(1, k, p, "x") for k, p in enumerate(deck)] + [(1, 5, deck[2], "x"), (1, 6, None, "x"), (1, 7, b"short", "x"), (2, 0, deck[0], "x"), (3, 0, None, "x")]
    shown = [(1, 0, deck[2]), (1, 200_000, deck[4]), (1, 200_000, deck[4]), (1, 5, None), (1, 6, b"abc"), (2, 0, deck[1]), (3, 0, deck[0]), (4, 0, deck[0])]
    got = frames.matched(spark.createDataFrame(shown, "lecture_id long, at_ms long, pixels binary"), spark.createDataFrame(pages, "lecture_id long, slide_id long, pixels binary, block string"), 10, 6).collect()
    rows = sorted((r.lecture_id, r.at_ms, r.best, r.second, r.error) for r in got)
    assert [r[:3] + r[4:] for r in rows] == [(1, 0, 2, None), (1, 5, None, "frame_size"), (1, 6, None, "frame_size"), (1, 200_000, 4, None), (1, 200_000, 4, None), (2, 0, 0, None), (3, 0, None, "no_pages"), (4, 0, None, "no_pages")]
    assert rows[0][3] == 5 and rows[5][3] is None, "ties go to the lower page; one page has no runner-up"


def test_query_is_the_best_of_all_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = {}
    for r in pictures(spark, folder).collect():
        pages.setdefault(r.lecture_id, {})[r.slide_id] = np.frombuffer(r.pixels, np.uint8).reshape(PICTURE[1], PICTURE[0])
    got = {(r.lecture_id, r.at_ms): r for r in QUERIES["frame_matches"](spark, folder).collect()}
    assert len(got) == sum(map(len, pages.values()))
    for lecture, deck in pages.items():
        for slide in list(deck)[::16]:
            frame = np.minimum(deck[slide].astype(int) + 9 * (np.arange(deck[slide].size) >= deck[slide].size // 2).reshape(deck[slide].shape), 255)
            scores = sorted(((-round(plain_similarity(page, frame, 8, 8), 6), k) for k, page in deck.items()))
            r = got[lecture, slide * 1000]
            assert (r.best_score, r.second_score) == pytest.approx((-scores[0][0], -scores[1][0]), abs=2e-6)
            assert scores[0][1] == r.best or scores[0][0] == scores[1][0]
    import pandas as pd

    assert brighter_below(pd.Series([bytes([0, 250])]))[0] == bytes([0, 255])
