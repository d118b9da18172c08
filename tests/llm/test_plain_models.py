"""The two trained models against plain versions: a dense fit with a loop for isotonic means, and a network run position by position."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import bpe, language_id, quality_model, quality_rules, tiff, token_counts
from rostrum.llm.common import held_out


def labelled(rng, n):
    good = ["The quiet river ran past the old mill, and nobody spoke of it.", "We measured the samples twice; both agreed."]
    bad = ["BUY NOW!!! $$$ CLICK $$$", "#### %%% x x x x x x 1234567"]
    rows = []
    for k in range(n):
        y = rng.random() < 0.6
        rows.append((k, " ".join(rng.choices(good if y else bad, k=rng.randrange(1, 12))), int(y if rng.random() < 0.95 else not y)))
    return rows


def isotonic_means(xs, ns, ys):
    """Least-squares increasing means by the minimax formula."""
    k = len(ys)
    mean = lambda i, j: sum(ys[i : j + 1]) / sum(ns[i : j + 1])
    return [max(min(mean(i, j) for j in range(at, k)) for i in range(at + 1)) for at in range(k)]


def test_quality_scores_are_those_of_a_dense_fit(spark):
    rng = random.Random(12)
    rows = labelled(rng, 240) + [(500, None, 1), (501, "", 0), (502, "long " * 40_000, 1)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, model).collect()}

    train = [(k, t or "", y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    x, y = np.array([quality_model.statistics(t) for _, t, _ in train]), np.array([float(v) for *_, v in train])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    z = np.hstack([np.sqrt(2 / quality_model.FEATURES) * np.cos(z @ model.direction + model.phase), np.ones((len(z), 1))])
    fold = np.array([zlib.crc32(f"fold{k}".encode()) % quality_model.FOLDS for k, *_ in train])

    def ridge(own):
        # rows of the penalty under those of the data: ordinary least squares of both is the ridge solution
        penalty = np.full(z.shape[1], np.sqrt(quality_model.RIDGE * own.sum()))
        penalty[-1] = np.sqrt(1e-9 * own.sum())
        return np.linalg.lstsq(np.vstack([z[own], np.diag(penalty)]), np.concatenate([y[own], np.zeros(z.shape[1])]), rcond=None)[0]

    raw = np.array([z[i] @ ridge(fold != fold[i]) for i in range(len(z))])
    bins = np.clip((raw + 0.5) * quality_model.BINS / 2, 0, quality_model.BINS - 1).astype(int)
    there = sorted(set(bins.tolist()))
    knots = [raw[bins == b].mean() for b in there]
    values = isotonic_means(knots, [int((bins == b).sum()) for b in there], [y[bins == b].sum() for b in there])
    final = ridge(np.ones(len(z), bool))
    for k, t, _ in rows:
        own = np.clip((np.array(quality_model.statistics(t or "")) - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
        own = np.append(np.sqrt(2 / quality_model.FEATURES) * np.cos(own @ model.direction + model.phase), 1.0)
        assert got[k] == pytest.approx(np.interp(own @ final, knots, values), abs=2e-3), k


def test_quality_of_an_empty_table_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    assert len({r.score for r in quality_model.score_quality(docs, model).collect()}) == 1
    assert quality_model.score_quality(docs.limit(0), quality_model.fit(docs.limit(0), labels)).count() == 0


def plain_pooled(net, body):
    size, hidden = language_id.WINDOW, language_id.HIDDEN

    def states(window, way):
        h, out = np.zeros(hidden), []
        for byte in window:
            given = net.table[way][byte].astype(float)
            gate = np.clip((h @ net.gates[way] + given[: 2 * hidden]) * 0.25 + 0.5, 0, 1)
            new = np.tanh(given[2 * hidden :] + (gate[hidden:] * h) @ net.inner[way])
            h = h + gate[:hidden] * (new - h)
            out.append(h)
        return out

    total = np.zeros(len(net.languages))
    for start in range(0, len(body), size):
        window = body[start : start + size]
        padded = window + bytes(size - len(window))
        ahead, behind = states(padded, 0), states(padded[::-1], 1)[::-1]
        for at in range(len(window)):
            scores = np.concatenate([ahead[at], behind[at]]) @ net.out + net.bias
            e = np.exp(scores - scores.max())
            total += e / e.sum()
    return total / max(len(body), 1)


@pytest.fixture(scope="module")
def net():
    return language_id.train([b"abc abd " * 30, b"xyz zyx " * 30, "éè ça ".encode() * 20], ["a", "z", "f"], steps=12)


def test_language_probabilities_are_those_of_a_walk_by_positions(spark, net):
    bodies = ["abc" * 50, "x", "é" * 33, "zyx " * 16, "abd xyz ça " * 90]
    docs = spark.createDataFrame(list(enumerate(bodies)) + [(9, None), (10, ""), (11, "12 !"), (0, bodies[0])], "doc_id long, text string")
    got = language_id.identify(docs, net).collect()
    assert len(got) == len(bodies) + 4
    for r in got:
        if r.doc_id < len(bodies):
            want = plain_pooled(net, bodies[r.doc_id].encode())
            assert r.score == pytest.approx(want.max(), abs=1e-4) and r.lang_pred == net.languages[int(want.argmax())]
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language_id.identify(docs.limit(0), net).count() == 0 and language_id.fit(docs.limit(0).withColumn("lang", F.lit("a"))) is None


def test_gradients_of_both_directions_and_the_output(net):
    rng = np.random.default_rng(4)
    for p in net.parameters():
        p *= np.float32(0.5)
    x, y = rng.integers(0, 256, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.label(x)[:, np.arange(4), y]).mean()

    ahead, behind, h = [], [], language_id.HIDDEN
    up, down = net.read(x, 0, ahead), net.read(x[::-1], 1, behind)[::-1]
    g = net.label(x)
    g[:, np.arange(4), y] -= 1
    g /= 36
    one, two = language_id._back(net, x, 0, ahead, g @ net.out[:h].T), language_id._back(net, x[::-1], 1, behind, (g @ net.out[h:].T)[::-1])
    flat = g.reshape(-1, g.shape[-1])
    out = np.vstack([up.reshape(-1, h).T @ flat, down.reshape(-1, h).T @ flat])
    byte = int(x[4, 1])
    spots = [(out, net.out, [(0, 0), (h + 2, 1), (2 * h - 1, 2)]), (flat.sum(0), net.bias, [(0,), (2,)])]
    for way, found in enumerate((one, two)):
        spots += [(found[0], net.table[way], [(byte, 1), (byte, h + 3), (byte, 2 * h + 5)]), (found[1], net.gates[way], [(0, 0), (3, h + 1)]), (found[2], net.inner[way], [(1, 1), (6, 2)])]
    for grad, weights, places in spots:
        for spot in places:
            old = weights[spot]
            weights[spot] = old + np.float32(2e-2)
            high = loss()
            weights[spot] = old - np.float32(2e-2)
            low = loss()
            weights[spot] = old
            assert abs((high - low) / 4e-2 - grad[spot]) < 2e-3


def test_kept_columns_with_names_of_results_are_refused(spark, net):
    docs = spark.createDataFrame([(1, "a", 1, 1, 1, 1)], "doc_id long, text string, n_tokens int, ids int, N_Bytes int, score int")
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    blank = quality_model.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    for call in (
        lambda: token_counts.count_tokens(docs, path, keep=("doc_id", "n_tokens")),
        lambda: bpe.encode(docs, path, keep=("doc_id", "ids")),
        lambda: tiff.write_column(docs, keep=("N_Bytes",)),
        lambda: language_id.identify(docs, net, keep=("score",)),
        lambda: quality_model.score_quality(docs, blank, keep=("doc_id", "score")),
    ):
        with pytest.raises(ValueError, match="names of results"):
            call()


def test_order_of_rules_is_the_same_every_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    order = quality_rules.measured_order(docs)
    assert sorted(order) == sorted(quality_rules.rules()) == sorted(quality_rules.SCANS)
    assert all(quality_rules.measured_order(docs.repartition(n)) == order for n in (2, 5, 7))
    assert quality_rules.measured_order(docs.limit(0)) == sorted(quality_rules.SCANS), "ties go by name"


def test_held_out_ids(spark):
    assert [r[0] for r in spark.createDataFrame([(k,) for k in (3, 4, None)], "k long").select(held_out(F.col("k"))).collect()] == [zlib.crc32(b"3") % 4 == 2, zlib.crc32(b"4") % 4 == 2, False]
