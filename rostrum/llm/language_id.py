"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of every whole text are cut into windows. In each window one
recurrent network reads forwards and one backwards; both states label every
position with a language distribution, and the mean over all positions of a
text (not of its windows) is the document's. Padding is masked out.

The network is trained in numpy by backpropagation through time, on windows of
at most ``max_train`` documents, of each language those with the least hash of
their id (one at least). Executors draw the windows: of every such document
equally many, each place of its whole text equally likely, so that the driver gets
as many windows as training takes and no texts. Steps draw among them so that
languages come equally often. Gates are the piecewise linear sigmoid, so that a
step is cheap; the batch is over windows, so that a step serves thousands of
positions at once.

Null languages and ids are not learned from; of repeated ids the least text counts.
A text that is null or has no letter is ``und`` with score 0. Without anything to
learn from, as in an empty table, every text is. Every row gives one row, repeated
or not. Long texts are labelled whole, some megabytes of windows at a time. Columns
other than ``keep`` and the text are not read; ``keep`` may not hold the names of
the results (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.common import documents, results_free, text_buffers, trainable

#: Documents that training uses at most.
MAX_TRAIN = 2_000
HIDDEN, WINDOW, BATCH, STEPS, RATE, SEED = 8, 64, 192, 260, 0.02, 5
#: Windows that go through the network at once.
LANES = 4_096


@dataclass
class Network:
    """Weights of both directions: input table (256, 3H), recurrent (H, 2H) and (H, H); output (2H, L)."""

    table: list[np.ndarray]
    gates: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.gates, *self.inner, self.out, self.bias]

    def read(self, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States after each byte of windows x (time, lanes), in the order read; ``keep`` gets what the way back needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states = np.empty((*x.shape, HIDDEN), np.float32)
        table, gates, inner = self.table[way], self.gates[way], self.inner[way]
        for t in range(len(x)):
            given = table[x[t]]
            raw = h @ gates
            raw += given[:, : 2 * HIDDEN]
            gate = np.clip(raw * 0.25 + 0.5, 0, 1)
            update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
            kept = reset * h
            new = np.tanh(given[:, 2 * HIDDEN :] + kept @ inner)
            before, h = h, h + update * (new - h)
            states[t] = h
            if keep is not None:
                keep.append((before, gate, kept, new))
        return states

    def label(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of every position: (time, lanes, languages)."""
        both = self.read(x, 0) @ self.out[:HIDDEN] + self.read(x[::-1], 1)[::-1] @ self.out[HIDDEN:] + self.bias
        both = np.exp(both - both.max(-1, keepdims=True))
        return both / both.sum(-1, keepdims=True)


def _back(net: Network, x: np.ndarray, way: int, kept: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction's weights from those of its states, through time."""
    g_table, g_gates, g_inner = np.zeros_like(net.table[way]), np.zeros_like(net.gates[way]), np.zeros_like(net.inner[way])
    later = np.zeros_like(given[0])
    for t in range(len(x) - 1, -1, -1):
        before, gate, mid, new = kept[t]
        update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
        g = given[t] + later
        g_new = g * update * (1 - new * new)
        g_mid = g_new @ net.inner[way].T
        g_gate = np.hstack([g * (new - before), g_mid * before]) * np.where((gate > 0) & (gate < 1), np.float32(0.25), np.float32(0))
        g_inner += mid.T @ g_new
        g_gates += before.T @ g_gate
        np.add.at(g_table, x[t], np.hstack([g_gate, g_new]))
        later = g * (1 - update) + g_mid * reset + g_gate @ net.gates[way].T
    return g_table, g_gates, g_inner


def train(bodies: list[bytes], langs: list[str], steps: int = STEPS, seed: int = SEED) -> Network | None:
    """The network for these texts, by Adam on the cross entropy of every position."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(
        [draw(256, 3 * HIDDEN, scale=0.5) for _ in range(2)],
        [draw(HIDDEN, 2 * HIDDEN, scale=0.4) for _ in range(2)],
        [draw(HIDDEN, HIDDEN, scale=0.4) for _ in range(2)],
        draw(2 * HIDDEN, len(languages), scale=0.3),
        np.zeros(len(languages), np.float32),
        languages,
    )
    by_language = [[b for b, own in zip(bodies, langs, strict=True) if own == name and len(b) > 0] for name in languages]
    present = [k for k, own in enumerate(by_language) if own]
    if not present:
        return None
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        x, y = np.zeros((WINDOW, BATCH), np.uint8), np.array([present[k % len(present)] for k in range(BATCH)])
        mask = np.zeros((WINDOW, BATCH, 1), np.float32)
        for k in range(BATCH):
            body = by_language[y[k]][rng.integers(len(by_language[y[k]]))]
            at = int(rng.integers(max(len(body) - WINDOW, 0) + 1))
            part = np.frombuffer(body[at : at + WINDOW], np.uint8)
            x[: len(part), k], mask[: len(part), k] = part, 1
        ahead, behind = [], []
        up, down = net.read(x, 0, ahead), net.read(x[::-1], 1, behind)[::-1]
        scores = up @ net.out[:HIDDEN] + down @ net.out[HIDDEN:] + net.bias
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        g = scores / scores.sum(-1, keepdims=True)
        g[:, np.arange(BATCH), y] -= 1
        g *= mask / mask.sum()
        flat = g.reshape(-1, g.shape[-1])
        g_out = np.vstack([up.reshape(-1, HIDDEN).T @ flat, down.reshape(-1, HIDDEN).T @ flat])
        one, two = _back(net, x, 0, ahead, g @ net.out[:HIDDEN].T), _back(net, x[::-1], 1, behind, (g @ net.out[HIDDEN:].T)[::-1])
        found = [one[0], two[0], one[1], two[1], one[2], two[2], g_out, flat.sum(0)]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, d, m, v in zip(net.parameters(), found, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def sample(df: DataFrame, max_train: int = MAX_TRAIN, windows: int = STEPS * BATCH) -> DataFrame:
    """h, lang, windows: of each language the documents with the least hashes of their ids, an equal number, one at least.

    Together they have about ``windows`` windows, of WINDOW characters each, from anywhere in their texts. Hashes that
    can't be among the least are dropped before they are ordered: only those below four times the share
    that is wanted, of some thousands that is as good as certain to leave enough, and a language's order is never one task's whole table.
    """
    rows = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & trainable(F.col("doc_id"))).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 11))
    counts = rows.groupBy("lang").count()
    many = max(max_train // max(counts.count(), 1), 1)
    share = F.col("h") / F.lit(float(1 << 53))
    near = rows.select("lang", "h").join(F.broadcast(counts), "lang").filter(share * F.col("count") < 4 * max(many, 32)).select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    most = near.withColumn("place", place).filter(F.col("place") <= many).groupBy("lang").agg(F.max("h").alias("most"), F.count("*").alias("picked"))
    each = F.ceil(F.lit(windows) / F.greatest(F.col("picked") * F.lit(max_train // many), F.lit(1))).cast("int")
    picked = rows.join(F.broadcast(most), "lang").filter("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"), F.first("picked").alias("picked"))
    spot = lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1).cast("int")
    return picked.select("h", "lang", F.transform(F.sequence(F.lit(1), each), lambda k: F.substring("text", spot(k) + 1, F.lit(WINDOW))).alias("windows"))


def fit(df: DataFrame, max_train: int = MAX_TRAIN) -> Network | None:
    """Learns from text and non-null lang of documents that may be learned from."""
    picked = sorted(sample(df, max_train).collect(), key=lambda r: (r.h, r.lang))
    return train([w.encode() for r in picked for w in r.windows], [r.lang for r in picked for _ in r.windows]) if picked else None


def pooled(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each text; zeros for empty ones."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), windows)
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    lengths = np.minimum(offsets[1:][owner] - starts, WINDOW)
    total = np.zeros((len(sizes), len(net.languages)))
    steps = np.arange(WINDOW)
    for i in range(0, len(owner), LANES):
        s, n = starts[i : i + LANES], lengths[i : i + LANES]
        at = s[None, :] + steps[:, None]
        there = steps[:, None] < n[None, :]
        x = np.where(there, raw[np.minimum(at, len(raw) - 1)], 0)
        found = (net.label(x) * there[..., None]).sum(0, dtype=np.float64)
        np.add.at(total, owner[i : i + LANES], found)
    return total / np.maximum(sizes, 1)[:, None]


def identify(df: DataFrame, net: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (the pooled probability) of every row."""
    results_free(keep, "lang_pred", "score")
    width = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(width))
            lettered = batch.column(width + 1).to_pylist()
            rows, i = len(lettered), 0
            while i < rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
                if net is None:
                    names, scores = ["und"] * (j - i), [0.0] * (j - i)
                else:
                    found = pooled(net, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best = found.argmax(1)
                    names = [net.languages[b] if ok else "und" for b, ok in zip(best, lettered[i:j], strict=True)]
                    scores = [float(min(found[k, b], 1.0)) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, lettered[i:j], strict=True))]
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns[:width]), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
                i = j

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__lettered")
    return df.select(*keep, F.col(text_col).alias("__text"), lettered).mapInArrow(run, df.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.llm.common import held_out

    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
