"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every whole text gives a short vector of statistics. Random Fourier features
approximate a Gaussian kernel over the standardised vectors. Each partition of
the training rows sums its normal equations, by fold; the sums are added in a
tree of tasks; the driver adds the last few, solves the ridge system on all
folds, and on all folds but one for scores out of fold. Those scores, counted in
bins, give a monotone calibration by pooling adjacent violators.

Training takes at most ``max_train`` labelled documents, those with the least
hash of their id; everything is scored. Null labels and ids are not learned
from; conflicting labels of an id count by their mean. Null texts are scored as
empty ones. Without labels every score is 0.5; with one class only, its share.
Repeated rows get the same score, each in its own row; an empty table gives an
empty result. Texts are read whole, whatever their length, a megabyte of them at
a time. Columns other than ``keep``, the id and the text are not read; ``keep``
may not hold the names of the results, which ``names`` can change.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rostrum.llm.common import checkpointed, documents, merged, pieces, results_free, texts, tidy, trainable, with_text

#: Labelled documents that the fit uses at most; 16 bytes each are broadcast.
MAX_TRAIN = 20_000
FEATURES, FOLDS, BINS, PARTS = 192, 4, 200, 8
RIDGE, WIDTH, SEED = 1e-3, 3.0, 11
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS, STOPS, SPACE = b"#*$%&|<>@^~=+_\\{}[]", b".,;:?", b" \t\n\r\x0b\x0c"
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """What the classifier sees of a text: shares and lengths, none of them of its words themselves."""
    raw = text.encode()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m, k = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n if raw else 0.0
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    follows = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, lower = share(UPPER), share(LOWER)
    return [
        np.log1p(len(words)), np.log1p(len(lines)), len(raw) / m, upper / max(upper + lower, 1e-3), share(DIGITS), share(SYMBOLS), share(b"!"), share(STOPS), share(SPACE), share(b"\"'()-/"),
        share(bytes(range(128, 256))),
        (len(words) - len(counts)) / (m + 10), max(max(counts.values(), default=0) - 1, 0) / (m + 10), follows / (m + 3), max(len(words) - 1 - len(pairs), 0) / (m + 10), (len(lines) - len(set(lines))) / (k + 2),
        len(zlib.compress(raw, 1)) / (n + 60), sum(w.isupper() for w in words) / (m + 1), sum(not w[-1].isalnum() for w in words) / (m + 5), np.log1p(max(map(len, lines), default=0)),
    ]


def with_statistics(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    width, (sent, at) = len(keep), with_text(df, text_col, keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in pieces(batch, at)):
            x = np.array([statistics(t) for t in texts(part.column(at))], np.float64).reshape(-1, STATISTICS)
            yield pa.record_batch([*part.columns[:width], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return sent.mapInArrow(tidy(run), df.select(*keep).schema.add("x", ArrayType(DoubleType())))


@dataclass
class Model:
    """Standardisation, the random directions, ridge weights, and the calibration's bin edges and values."""

    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.direction + self.phase), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.values[0])
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, STATISTICS)


def _fold_sums(model: Model) -> callable:
    side = FEATURES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, side, side)), np.zeros((FOLDS, side))
        for batch in batches:
            z, y, fold = model.features(_stack(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                gram[k] += own.T @ own
                right[k] += own.T @ y[fold == k]
        yield pa.record_batch([pa.array([np.concatenate([gram.ravel(), right.ravel()]).tobytes()], pa.binary())], names=["summary"])

    return run


def _added(parts: Iterator[bytes]) -> bytes:
    total = np.zeros(FOLDS * (FEATURES + 1) * (FEATURES + 2))
    for part in parts:
        total += np.frombuffer(part)
    return total.tobytes()


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = max(gram[-1, -1], 1)
    penalty = np.full(len(right), RIDGE * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(gram + np.diag(penalty), right)


def pooled(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Isotonic means of bins in order, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, s in zip(counts, sums, strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + w]
    return np.repeat([s / n for n, s, _ in blocks], [w for *_, w in blocks])


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    label = labels.filter(F.col("quality").isNotNull() & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    label = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    joined = df.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(label), "doc_id")
    rows = with_statistics(joined, "text", ("doc_id", "y")).withColumn("fold", F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")).cast("long") % FOLDS)
    rows = checkpointed(rows.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "x"))
    moments = rows.agg(F.count("*"), F.avg("y"), *[f(F.element_at("x", k + 1)) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    n, mean_y = moments[0], moments[1]
    rng = np.random.default_rng(SEED)
    blank = np.zeros(STATISTICS)
    model = Model(blank, blank + 1, rng.normal(size=(STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), None, np.array([0.0]), np.array([0.5 if mean_y is None else mean_y]))
    if n < 2 * FOLDS or mean_y in (0.0, 1.0):
        return model
    model.mean, model.scale = np.array(moments[2::2], float), np.maximum(np.array(moments[3::2], float), 1e-6)

    side = FEATURES + 1
    sums = np.frombuffer(merged(rows.select("x", "y", "fold").mapInArrow(_fold_sums(model), "summary binary"), _added, fan=8))
    gram, right = sums[: FOLDS * side * side].reshape(FOLDS, side, side), sums[FOLDS * side * side :].reshape(FOLDS, side)
    held = np.stack([_solved(gram.sum(0) - gram[k], right.sum(0) - right[k]) for k in range(FOLDS)])

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(_stack(batch)), batch.column("fold").to_numpy()
            raw = np.einsum("ij,ij->i", z, held[fold])
            yield pa.record_batch([pa.array(np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    found = rows.select("x", "y", "fold").mapInArrow(binned, "bin long, raw double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("raw")).orderBy("bin").collect()
    counts, ys = np.array([r.n for r in found], float), np.array([r.y for r in found], float)
    model.weights = _solved(gram.sum(0), right.sum(0))
    model.knots, model.values = np.array([r.raw for r in found]), pooled(counts, ys)
    return model


def score_quality(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns, score and predicted (score >= threshold), or as ``names`` says, of every row."""
    results_free(keep, *names)
    width, (sent, at) = len(keep), with_text(df, text_col, keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in pieces(batch, at)):
            found = model.score(np.array([statistics(t) for t in texts(part.column(at))], np.float64).reshape(-1, STATISTICS))
            yield pa.record_batch([*part.columns[:width], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*keep, *names])

    return sent.mapInArrow(tidy(run), df.select(*keep).schema.add(names[0], "double").add(names[1], "integer"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.llm.common import held_out

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
