"""Frames of a recording matched to grey pages by mean structural similarity.

Two pictures are compared window by window: means, variances and the covariance of a
window come from summed-area tables, four look-ups each, so windows may overlap at no
cost. Windows at the right and lower edge are cut there and count by their area.

Frames of a lecture are dealt out in blocks of time, and a block's task gets the
deck and keeps, for each frame, the best page and the runner-up as pages go by: no
row is made for a frame and a page. Memory is one deck and one block of frames.

Frames whose lecture has no page, or whose picture is null or not of its stated size,
give a row with an error and no match. Pages that are null or of another size than
the frame are passed over. Ties go to the lower page. Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a window, and how far the next one is.
WINDOW, STRIDE = 8, 8
#: Fixed values of the measure for samples of 8 bits: (0.01 * 255)^2 and (0.03 * 255)^2.
C1, C2 = 6.5025, 58.5225
#: Milliseconds of frames that one task gets at a time.
BLOCK_MS = 64_000


def edges(length: int, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin and end along one side."""
    starts = np.arange(0, max(length - size, 0) + stride, stride)
    starts = starts[starts < length]
    return starts, np.minimum(starts + size, length)


def window_sums(values: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Sums over all windows of the last two axes, by a summed-area table."""
    table = np.zeros((*values.shape[:-2], values.shape[-2] + 1, values.shape[-1] + 1))
    table[..., 1:, 1:] = values.cumsum(-2).cumsum(-1)
    (top, bottom), (left, right) = edges(values.shape[-2], size, stride), edges(values.shape[-1], size, stride)
    return table[..., bottom[:, None], right] - table[..., top[:, None], right] - table[..., bottom[:, None], left] + table[..., top[:, None], left]


class Pages:
    """Pages of one size with what a comparison needs of them."""

    def __init__(self, pixels: np.ndarray, size: int = WINDOW, stride: int = STRIDE):
        self.pixels, self.size, self.stride = pixels, size, stride
        (top, bottom), (left, right) = (edges(length, size, stride) for length in pixels.shape[-2:])
        self.area = (bottom - top)[:, None] * (right - left).astype(float)
        self.mean, self.variance = self.moments(pixels)

    def moments(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = window_sums(pixels, self.size, self.stride) / self.area
        return mean, window_sums(pixels * pixels, self.size, self.stride) / self.area - mean * mean

    def similarities(self, frame: np.ndarray) -> np.ndarray:
        """Mean structural similarity of one frame to every page."""
        mean, variance = self.moments(frame)
        together = window_sums(self.pixels * frame, self.size, self.stride) / self.area - self.mean * mean
        found = (2 * self.mean * mean + C1) * (2 * together + C2) / ((self.mean**2 + mean**2 + C1) * (self.variance + variance + C2))
        return (found * self.area).sum((-2, -1)) / self.area.sum()


def picture(pixels: bytes | None, width: int, height: int) -> np.ndarray | None:
    if pixels is None or width <= 0 or height <= 0 or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width).astype(float)


def two_best(scores: np.ndarray, ids: np.ndarray, held: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """The two highest of these and of those held so far; ties go to the lower id."""
    order = np.lexsort((ids, -scores))[:2]
    return sorted([*held, *((float(scores[k]), int(ids[k])) for k in order)], key=lambda pair: (-pair[0], pair[1]))[:2]


#: Pages that are compared with a frame at once.
TOGETHER = 64
COLUMNS = ["lecture_id", "at_ms", "best", "best_score", "second", "second_score", "error"]


def matched(frames: DataFrame, pages: DataFrame, width: int, height: int, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """lecture_id, at_ms, best, best_score, second, second_score, error of every frame.

    frames (lecture_id, at_ms, pixels binary), pages (lecture_id, slide_id, pixels binary), all of width x height grey samples.
    """

    def run(own: pd.DataFrame, deck: pd.DataFrame) -> pd.DataFrame:
        whole = [(int(k), picture(p, width, height)) for k, p in zip(deck.slide_id, deck.page, strict=True)]
        whole = [(k, p) for k, p in whole if p is not None]
        parts = [(np.array([k for k, _ in part]), Pages(np.stack([p for _, p in part]), size, stride)) for part in (whole[i : i + TOGETHER] for i in range(0, len(whole), TOGETHER))]
        rows = []
        for lecture, at, pixels in zip(own.lecture_id, own.at_ms, own.pixels, strict=True):
            frame, held = picture(pixels, width, height), []
            if frame is None or not parts:
                rows.append((lecture, at, None, None, None, None, "frame_size" if frame is None else "no_pages"))
                continue
            for ids, some in parts:
                held = two_best(some.similarities(frame), ids, held)
            second = held[1] if len(held) > 1 else (None, None)
            rows.append((lecture, at, held[0][1], held[0][0], second[1], second[0], None))
        return pd.DataFrame(rows, columns=COLUMNS).astype({"best": "Int64", "second": "Int64"})

    key = ["lecture_id", "block"]
    dealt = frames.select("lecture_id", "at_ms", "pixels", F.floor(F.col("at_ms") / BLOCK_MS).alias("block"))
    # the blocks' own columns have other names than the frames', as both sides come of one table
    blocks = dealt.select(F.col("lecture_id").alias("of"), F.col("block").alias("nth")).distinct()
    decks = blocks.join(pages.select(F.col("lecture_id").alias("deck"), "slide_id", F.col("pixels").alias("page")), F.col("of") == F.col("deck"))
    kind = frames.schema["lecture_id"].dataType.simpleString()
    schema = f"lecture_id {kind}, at_ms long, best long, best_score double, second long, second_score double, error string"
    return dealt.groupBy(*key).cogroup(decks.groupBy("of", "nth")).applyInPandas(lambda own, deck: run(own, deck), schema)
