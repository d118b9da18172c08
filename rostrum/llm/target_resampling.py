"""Importance resampling towards a target distribution of words, by partition-local tries.

Every partition builds a trie of words: a node for each word that starts a
feature, below it a node for each word that follows. A node holds how often its
path was met and the CRC state after it, so the hash of a two-word feature is that
of its first word carried on, and each different path is hashed once. Counts go to
buckets of the hash; the bucket totals of partitions (never the features) merge
through a tree of tasks. From the totals of the corpus and of the target follow
the gains of buckets. In the second pass a trie's nodes hold gains instead of
counts, and a document's weight is the mean over the paths that it walks. Gumbel
noise from a hash of the id makes the highest scores a sample without replacement,
and scores are placed by ranges, not in one task.

A trie that grows beyond its bound gives its counts to the totals and starts anew,
which changes no count. Its nodes are kept in arrays: words in a table, edges
sorted by (node, word).

Null texts have no words: weight 0, not drawn. A null id is hashed as an empty one
and comes last in ties. Repeated rows are rows of their own, an empty table stays
empty and an empty target has no features. A long text is walked whole, in memory
in proportion to it. Other columns than ``keep`` are not read; ``keep`` may not
hold the names of the results (ValueError).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import checkpointed, documents, merged, pieces, results_free, text_buffers, tidy
from rostrum.operators.places import placed

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: Nodes, and bytes of their words, at which a trie gives away its counts and starts anew.
MAX_NODES, MAX_BYTES = 400_000, 64 << 20
#: Bytes as words see them: A-Z in lower case, digits, a-z and all beyond ASCII as they are, the rest blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Words(dict):
    """The number of each word, given at the first meeting."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Trie:
    """Paths of one word and of two; ``value`` gives what a node holds from the CRC of its path."""

    def __init__(self, value: Callable[[np.ndarray], np.ndarray]):
        self.value = value
        self.clear()

    def clear(self) -> None:
        self.words, self.list, self.crc, self.bytes = _Words(), [], [], 0
        self.first = np.zeros(0, np.int64)
        self.edges, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.list) + len(self.edges) > MAX_NODES or self.bytes > MAX_BYTES

    def walk(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text, then the node of each word, the edge of each pair, and the text of each pair."""
        met: list[bytes] = []
        sizes = np.zeros(len(bodies), np.int64)
        for k, body in enumerate(bodies):
            own = body.translate(TABLE).split()
            sizes[k] = len(own)
            met += own
        node = np.fromiter(map(self.words.__getitem__, met), np.int64, len(met))
        self._learn_words()
        owner = np.repeat(np.arange(len(bodies)), sizes)
        inside = owner[1:] == owner[:-1]
        paths, edge = np.unique((node[:-1][inside] << 32) | node[1:][inside], return_inverse=True)
        return sizes, node, self._edges(paths)[edge], owner[1:][inside]

    def _learn_words(self) -> None:
        fresh = list(self.words)[len(self.list) :] if len(self.words) > len(self.list) else []
        crc = [zlib.crc32(w) for w in fresh]
        self.list += fresh
        self.crc += crc
        self.bytes += sum(map(len, fresh))
        self.first = np.concatenate([self.first, self.value(np.array(crc, np.int64))])

    def _edges(self, paths: np.ndarray) -> np.ndarray:
        """Places of sorted paths among the edges; those not met before are added."""
        at = np.searchsorted(self.edges, paths)
        new = np.ones(len(paths), bool)
        there = at < len(self.edges)
        new[there] = self.edges[at[there]] != paths[there]
        if new.any():
            fresh = paths[new]
            crc = [zlib.crc32(b" " + self.list[p & 0xFFFFFFFF], self.crc[p >> 32]) for p in fresh.tolist()]
            self.edges = np.insert(self.edges, at[new], fresh)
            self.second = np.insert(self.second, at[new], self.value(np.array(crc, np.int64)))
            at = np.searchsorted(self.edges, paths)
        return at


class Counted(Trie):
    """A trie whose nodes hold their bucket and how often they were met."""

    def __init__(self, buckets: int):
        self.totals = np.zeros(buckets, np.int64)
        super().__init__(lambda crc: crc % buckets)

    def clear(self) -> None:
        super().clear()
        self.n_first, self.n_second = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, bodies: list[bytes]) -> None:
        held = self.edges
        _, node, edge, _ = self.walk(bodies)
        self.n_first = np.concatenate([self.n_first, np.zeros(len(self.first) - len(self.n_first), np.int64)]) + np.bincount(node, minlength=len(self.first))
        moved = np.zeros(len(self.edges), np.int64)
        moved[np.searchsorted(self.edges, held)] = self.n_second
        self.n_second = moved + np.bincount(edge, minlength=len(self.edges))
        if self.full:
            self.settle()

    def settle(self) -> np.ndarray:
        np.add.at(self.totals, self.first, self.n_first)
        np.add.at(self.totals, self.second, self.n_second)
        self.clear()
        return self.totals


def _bodies(column: pa.Array) -> list[bytes]:
    raw, offsets = text_buffers(column)
    data = raw.tobytes()
    return [data[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _added(parts: Iterator[bytes]) -> bytes:
    return sum(np.frombuffer(p, np.int64) for p in parts).tobytes()


def bucket_totals(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall into each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Counted(buckets)
        for part in (part for batch in batches for part in pieces(batch, 0)):
            trie.add(_bodies(part.column(0)))
        yield pa.record_batch([pa.array([trie.settle().tobytes()], pa.binary())], names=["summary"])

    found = merged(df.select(text_col).mapInArrow(tidy(run), "summary binary"), _added)
    return np.zeros(buckets, np.int64) if found is None else np.frombuffer(found, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, both smoothed by one a bucket."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight: the floored mean of gains over a text's features."""
    results_free(keep, "n_words", "n_features", "weight")
    width = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lambda crc: gain[crc % len(gain)])
        for part in (part for batch in batches for part in pieces(batch, width)):
            sizes, node, edge, owner = trie.walk(_bodies(part.column(width)))
            sums = np.zeros(len(sizes), np.int64)
            np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), trie.first[node])
            np.add.at(sums, owner, trie.second[edge])
            features = np.maximum(2 * sizes - 1, 0)
            yield pa.record_batch([*part.columns[:width], pa.array(sizes), pa.array(features), pa.array(sums // np.maximum(features, 1))], names=[*keep, "n_words", "n_features", "weight"])
            if trie.full:
                trie.clear()

    schema = df.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def scored(df: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", keep: tuple[str, ...] = (), buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, ``keep`` columns, n_words, n_features, weight and score: the weight with Gumbel noise of the id."""
    results_free(keep, "doc_id", "score", "rank")
    gain = gains(bucket_totals(df, text_col, buckets), bucket_totals(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed(df, gain, text_col, ("doc_id", *keep)).withColumn("score", F.col("weight") + noise)


def resampled(df: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 ... for the highest scores, ``percent`` of the documents with ``min_words`` words; null for the rest."""
    rows = checkpointed(scored(df, target, **options).withColumn("__may", F.col("n_words") >= min_words))
    drawn = rows.filter("__may").count() * percent // 100
    ordered = placed(rows, [F.col("__may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    return ordered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("__may")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def _nibble_table() -> list[int]:
    """What four shifts of the CRC make of each nibble."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP13_SQL = rf"""
WITH w AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
l AS (SELECT kind, r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w),
f AS (SELECT kind, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM l),
h AS (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM f)),
n AS (SELECT feature, list_transform(range(0, length(hx)), lambda i: CAST(strpos('0123456789ABCDEF', hx[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT)) AS nibbles FROM h),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, nibbles), lambda c, x: xor({_nibble_table()}[(xor(c, x) & 15) + 1], c >> 4)), 4294967295) % 10000 AS bucket FROM n),
c AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (SELECT CAST(sum(s) + 10000 AS DOUBLE) FROM c) / (CAST(s + 1 AS DOUBLE) * (SELECT CAST(sum(t) + 10000 AS DOUBLE) FROM c)))) AS BIGINT) AS gain FROM c),
m AS (SELECT r, count(*) AS n, sum(gain) AS total FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE kind = 0 GROUP BY r),
s AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight,
    CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM l LEFT JOIN m USING (r) WHERE kind = 0),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS many FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN place END AS rank FROM k
"""
