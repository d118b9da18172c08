"""N-gram Jaccard join by set-relation skipping, exact at the given threshold.

Every text becomes the set of its word shingles (64-bit hashes). Texts with the
same set form one class; classes are joined, and copies never expand into pairs.

1. Shingles are ordered by an estimate of how many documents hold them (a count
   sketch of fixed size over all documents), the rare ones first. Two sets at
   the threshold share a shingle among the first fifth of either, so only that
   prefix is indexed: rows (shingle, position, set), sorted into lists.
2. In every list, the set for which the shingle comes first is the hub: the
   set that has least of its own. Each member is compared with its hubs: linear
   in the index. The overlaps computed here are the answers that others reuse.
3. Lists whose members are all linked by now are done. In the others, members
   of different components are compared where they can still reach the
   threshold: the list is cut into blocks by position and size, and a pair of
   blocks whose positions leave too few shingles is skipped whole. Where two
   sets have answers against the same hub, these bound their overlap from both
   sides, and often decide it without reading either set.
4. Links found make components, by alternating large-star and small-star steps.

Links beyond those that connect a component are counted, or listed, in a step of
their own (``ngram_joined``, ``ngram_links``): every link lies inside a component,
so the sets of each component of three or more meet in blocks. In a pair of
blocks one set is the pivot; where the answers against it bound two sets' overlap
away from the threshold, they decide, and elsewhere the overlap follows from what
both sets differ from the pivot in. Only sums leave a block, never pairs, unless
the pairs are what is asked for.

No link between different sets is lost: a pair at the threshold passes every
filter in the list of its first common shingle. Lists are streamed in step 2; in
step 3 a list of more than LIST_ROWS rows, and a component of more than SETS
sets, is dealt out as pairs of blocks, so no task holds more than two of them. A
set that takes part in many pairs is repeated, once for every SPREAD of them.

Sets are known by a 64-bit hash; where two sets of the corpus agree in it, both
go by their second hash instead, so that different sets stay different.

Texts without words have no shingles, no links, and are their own component;
nulls likewise. Null ids are allowed: a component's id is the least that isn't
null. Repeated ids with different texts are different sets; repeated rows are
rows of one set, each with its own row in the results. Very long texts are hashed
alone and take memory in proportion to their length. An empty table gives an
empty result. Columns other than doc_id, text and ``keep`` are not read, whatever
their names; one_of_each carries all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.common import WORD, checkpointed, documents, free, merged, release, small, text_buffers, tidy

#: Counters of the frequency sketch, as powers of two: one for every 256 shingles of the corpus between these. Beyond, counts
#: stand on the level of all that share a slot; shingles that many documents hold still rise above it. 8 to 32 MB.
SKETCH_BITS = (20, 22)
#: Bits of the filter of wanted sets, as powers of two: eight for each set between these; up to 32 MB. Sets that pass by chance cost a shuffle alone.
FILTER_BITS = (16, 28)
#: Bytes of text that are hashed at once; longer texts go alone.
CHUNK = 1 << 18
#: Linked sets and answers (40 bytes a row) up to which they are broadcast to the lists; beyond, a shuffle joins them.
BROADCAST_ROWS = 1_000_000
#: Rows of a block of an index list, and of a list that one task compares.
BLOCK, LIST_ROWS = 256, 4_096
#: Rows of a list up to which it is compared together with others.
SHORT = 32
#: Sets of a component, and shingles of them, that make a block; columns that are multiplied at once.
SETS, SHINGLES, COLUMNS = 512, 500_000, 2_048
#: Pairs that one copy of a set serves.
SPREAD = 256
#: Keys that two sets share at most; beyond, hashes are broken (70 are expected of 5e10 sets).
CLASHES = 100_000
#: A link needs 9 * overlap >= 4 * (sum of sizes), which is a Jaccard similarity of 0.8.
OVER, UNDER = 9, 4

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RANDOM.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_NONE = np.zeros(0, np.int64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(max(n, CHUNK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word, and the number of the text it stands in."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    there = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = there.copy()
    first[1:] &= ~there[:-1] | edge[1:n]
    last = there.copy()
    last[:-1] &= ~there[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power(n)
    sums = np.cumsum(_BYTE[raw] * up, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    found = mixed((sums[ends] - before) * down[starts] + (ends - starts).astype(np.uint64))
    return found, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the text's number."""
    words, doc = word_hashes(raw, offsets)
    n = len(words)
    parts, owners = [], []
    if n >= width:
        whole = doc[: n - width + 1] == doc[width - 1 :]
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total += words[k : n - width + 1 + k] * _PLACE[k]
        parts.append(mixed(total[whole]))
        owners.append(doc[: n - width + 1][whole])
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        total = np.full(len(short), size, np.uint64)
        for k in range(size):
            total += words[firsts[short] + k] * _PLACE[k]
        parts.append(mixed(total ^ np.uint64(_STEP)))
        owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def _chunks(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, row of each counted from the first) for a few rows at a time."""
    raw, offsets = text_buffers(column)
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        hashes, owner = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        yield i, j, hashes, owner
        i = j


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _ids(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64), pa.int64())


def frequency_sketch(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """How many documents hold the shingles of each slot: never too few for any shingle in it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, hashes, _ in _chunks(batch.column(0), width):
                np.add.at(total, _slot(hashes, bits), 1)
        yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["summary"])

    def add(parts: Iterator[bytes]) -> bytes:
        total = np.zeros(1 << bits, np.int64)
        for part in parts:
            total += np.frombuffer(zlib.decompress(part), np.int64)
        return zlib.compress(total.tobytes(), 1)

    found = merged(texts.mapInArrow(tidy(count), "summary binary"), add, fan=8)
    return np.frombuffer(zlib.decompress(found), np.int64) if found else np.zeros(1 << bits, np.int64)


def _folded(hashes: np.ndarray, n: np.ndarray, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets whose shingles lie one after another, n each: k, and more bits."""
    ends = np.cumsum(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + np.uint64(_STEP)), dtype=np.uint64)])
    more = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(_BACK)), dtype=np.uint64)])
    k, k2 = (sums[ends] - sums[ends - n]).view(np.int64), (more[ends] - more[ends - n]).view(np.int64)
    return (np.where(np.isin(k, clashing), k2, k) if len(clashing) else k), k2


def signatures(df: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, n, k (a key of the set) and k2 (more bits of it) of each document."""
    kept = list(keep)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, owner in _chunks(batch.column(len(kept)), width):
                n = np.bincount(owner, minlength=j - i)
                k, k2 = _folded(hashes, n, _NONE)
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns[: len(kept)]), pa.array(n, pa.int64()), pa.array(k), pa.array(k2)], names=schema.names)

    schema = df.select(*kept).schema.add("n", "long").add("k", "long").add("k2", "long")
    return df.select(*kept, "text").mapInArrow(tidy(sign), schema)


def prefixes(df: DataFrame, width: int, bits: int, clashing: np.ndarray) -> DataFrame:
    """n, k and the prefix of each document with words: its rarest shingles, as many as a link must meet one of."""
    order = df.sparkSession.sparkContext.broadcast(frequency_sketch(df.select("text"), width, bits))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = order.value
        for batch in batches:
            for i, j, hashes, owner in _chunks(batch.column(0), width):
                n = np.bincount(owner, minlength=j - i)
                k, _ = _folded(hashes, n, clashing)
                ranked = hashes[np.lexsort((hashes, often[_slot(hashes, bits)], owner))]
                length = np.where(n > 0, n + (-4 * n) // 5 + 1, 0)
                place = np.arange(len(ranked)) - (np.cumsum(n) - n)[owner]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), _ids(ranked[place < length[owner]]))
                yield pa.record_batch([pa.array(n, pa.int64()), pa.array(k), lists], names=["n", "k", "prefix"])

    return df.select("text").mapInArrow(tidy(sign), "n long, k long, prefix array<long>").filter("n > 0")


def _reach(n: np.ndarray, at: np.ndarray, m: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m whose first common shingle stands at these places can reach the threshold."""
    left = np.minimum(n - at, m - there)
    return (OVER * left >= UNDER * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _starred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle, place, size, set: drops lists of one row; adds the list's hub and whether it can link."""
    held: tuple | None = None  # the last list's first row, while it may go on
    for batch in batches:
        tok, at, n, k = (batch.column(c).to_numpy() for c in range(4))
        if not len(tok):
            continue
        first = np.ones(len(tok), bool)
        first[1:] = tok[1:] != tok[:-1]
        starts = np.flatnonzero(first)
        own = np.cumsum(first) - 1
        hub, hub_n, hub_at = k[starts][own], n[starts][own], at[starts][own]
        many = np.diff(np.append(starts, len(tok)))[own] > 1
        extra = None
        if held is not None and held[0] == tok[0]:
            same = own == 0
            hub[same], hub_n[same], hub_at[same] = held[3], held[2], held[1]
            many |= same
            if not held[4]:
                extra = held
        # the last list may go on in the next batch: its first row waits there if it is alone
        alone = not many[-1]
        if held is not None and held[0] == tok[-1]:
            held = (held[0], held[1], held[2], held[3], True)
        else:
            s = starts[-1]
            held = (tok[s], at[s], n[s], k[s], not alone)
        out = [tok[many], at[many], n[many], k[many], hub[many], (_reach(n, at, hub_n, hub_at) & (k != hub))[many]]
        if extra is not None:
            out = [np.concatenate([[v], o]) for v, o in zip((extra[0], extra[1], extra[2], extra[3], extra[3], False), out, strict=True)]
        yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["tok", "at", "n", "k", "hub", "star"])


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by their first ``keys`` columns, in runs of equal ones."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in own:
            change |= c[1:] != c[:-1]
        cuts = (np.flatnonzero(change) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(int(c[i]) for c in own)
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(batch.slice(i, j - i))
    if held:
        yield held


def _whole_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, many whole runs of equal ones at a time, and where each run starts."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0)) + 1])
        if starts[-1]:
            yield [c[: starts[-1]] for c in held], starts[:-1]
            held = [c[starts[-1] :] for c in held]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _crossed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tok, part, side, at, n, k, c, hub, hub_n, o) sorted by the first four: pairs of different components that may link, or do.

    Short lists are compared many at once, each row with the next, the one after, and so on; long ones by pairs of blocks.
    """
    for columns, starts in _whole_runs(batches, 2):
        side, at, n, k, c, hub, hub_n, o = columns[2:]
        sizes = np.diff(np.append(starts, len(at)))
        ends = np.repeat(starts + sizes, sizes)

        def judged(r: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = (c[r] != c[s]) & _reach(n[r], at[r], n[s], at[s])
            r, s = r[ok], s[ok]
            known = (hub[r] == hub[s]) & (o[r] >= 0) & (o[s] >= 0)
            total = UNDER * (n[r] + n[s])
            upper = np.minimum(o[r], o[s]) + np.minimum(n[r] - o[r], n[s] - o[s])
            keep = ~known | (OVER * upper >= total)
            sure = known & (OVER * (o[r] + o[s] - hub_n[r]) >= total)
            r, s, sure = r[keep], s[keep], sure[keep]
            if len(r):
                yield pa.record_batch([pa.array(np.minimum(k[r], k[s])), pa.array(np.maximum(k[r], k[s])), pa.array(sure)], names=["a", "b", "sure"])

        rows = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        for step in range(1, SHORT):
            rows = rows[rows + step < ends[rows]]
            if not len(rows):
                break
            yield from judged(rows, rows + step)
        for first, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            last = first + size
            middle = first + int(np.searchsorted(side[first:last], 1))
            one = [(i, min(i + BLOCK, middle)) for i in range(first, middle, BLOCK)]
            two = [(i, min(i + BLOCK, last)) for i in range(middle, last, BLOCK)]
            for (i, j), (p, q) in ((u, v) for u in one for v in two) if two else ((u, v) for x, u in enumerate(one) for v in one[x:]):
                most = min((n[i:j] - at[i:j]).max(), (n[p:q] - at[p:q]).max())
                if OVER * most < UNDER * (n[i:j].min() + n[p:q].min()) or 5 * n[i:j].max() < 4 * n[p:q].min() or 5 * n[p:q].max() < 4 * n[i:j].min():
                    continue
                r, s = np.divmod(np.arange((j - i) * (q - p)), q - p)
                ahead = slice(None) if i != p else r < s
                yield from judged(r[ahead] + i, s[ahead] + p)


def _parts(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows of k in every pair of blocks that they belong to: part (the pair) and side (0 in the first block, or where both are one)."""
    own = F.pmod(F.xxhash64("k"), blocks)
    pair = lambda j: F.struct((F.least(own, j) * blocks + F.greatest(own, j)).alias("part"), (j < own).cast("int").alias("side"))
    return df.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), pair))).select("*", "__p.*").drop("__p")


def _row_keys(k: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mixed(k.view(np.uint64) ^ mixed(ids + np.uint64(_STEP)))


def wanted_sets(needed: DataFrame, df: DataFrame, width: int, clashing: np.ndarray) -> DataFrame:
    """k, items: the sets of the rows ``needed`` (k, doc_id, checkpointed), hashed again from their texts; some may come twice, and others with them."""
    low, high = FILTER_BITS
    size = min(max(int(needed.count() * 8).bit_length(), low), high)

    def places(k: np.ndarray, doc_id: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        slot = _slot(_row_keys(k, doc_id), size)
        return slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size - 3, np.uint8)
        for batch in batches:
            at, bit = places(batch.column(0).to_numpy(), batch.column(1))
            np.bitwise_or.at(bits, at, bit)
        yield pa.record_batch([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["summary"])

    def either(parts: Iterator[bytes]) -> bytes:
        bits = np.zeros(1 << size - 3, np.uint8)
        for part in parts:
            bits |= np.frombuffer(zlib.decompress(part), np.uint8)
        return zlib.compress(bits.tobytes(), 1)

    wanted = df.sparkSession.sparkContext.broadcast(merged(needed.select("k", "doc_id").mapInArrow(tidy(mark), "summary binary"), either, fan=8))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(wanted.value), np.uint8) if wanted.value else np.zeros(1 << size - 3, np.uint8)
        for batch in batches:
            for i, j, hashes, owner in _chunks(batch.column(1), width):
                n = np.bincount(owner, minlength=j - i)
                k, _ = _folded(hashes, n, clashing)
                at, bit = places(k, batch.column(0).slice(i, j - i))
                take = ((bits[at] & bit) != 0) & (n > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[take])]), pa.int32()), _ids(hashes[take[owner]]))
                yield pa.record_batch([pa.array(k[take]), lists], names=["k", "items"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(hashed), "k long, items array<long>")


class Pairs:
    """Pairs (a, b) of sets. A set of many pairs has salts, one for every SPREAD of them, so that no join has a hot key."""

    def __init__(self, pairs: DataFrame):
        pairs = checkpointed(pairs.select("a", "b"))
        self.met = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("pairs")))
        self.hot = small(self.met.filter(F.col("pairs") > SPREAD).select("k", F.ceil(F.col("pairs") / SPREAD).alias("salts")), BROADCAST_ROWS)
        for own, other in (("a", "b"), ("b", "a")):
            salt = F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1)))
            pairs = pairs.join(self.hot.withColumnRenamed("k", own), own, "left").withColumn(f"salt_{own}", salt).drop("salts")
        self.salted = pairs

    def joined(self, table: DataFrame, *values: str) -> DataFrame:
        """a, b and the values of both ends, as a_value and b_value. ``table`` may repeat a key k with its values."""
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
        spread = table.select("k", *values).join(self.hot, "k", "left").withColumn("salt", salts).dropDuplicates(["k", "salt"])
        out = self.salted
        for own in ("b", "a"):
            out = out.join(spread.select(F.col("k").alias(own), F.col("salt").alias(f"salt_{own}"), *(F.col(v).alias(f"{own}_{v}") for v in values)), [own, f"salt_{own}"])
        return out.drop("salt_a", "salt_b")


def overlaps(pairs: DataFrame, df: DataFrame, classes: DataFrame, width: int, clashing: np.ndarray) -> DataFrame:
    """a, b, o (common shingles), na, nb of pairs (a, b)."""
    found = Pairs(pairs)
    needed = checkpointed(found.met.join(classes.select("k", "doc_id"), "k").select("k", "doc_id"))
    both = found.joined(wanted_sets(needed, df, width, clashing), "items")
    return both.select("a", "b", F.size(F.array_intersect("a_items", "b_items")).cast("long").alias("o"), F.size("a_items").cast("long").alias("na"), F.size("b_items").cast("long").alias("nb"))


def plausible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs whose common prefix shingles, with all that lies beyond the longer rest, can reach the threshold.

    Lists hold every prefix shingle that two sets share, so one set's rows there are all that can be common.
    """
    found = Pairs(pairs)
    own = lists.join(small(found.met.select("k"), BROADCAST_ROWS), "k", "left_semi").groupBy("k").agg(F.first("n").alias("n"), F.collect_list("tok").alias("toks"))
    rest = F.ceil(F.greatest("a_n", "b_n") * 4 / 5) - 1
    return found.joined(own, "n", "toks").filter(OVER * (F.size(F.array_intersect("a_toks", "b_toks")) + rest) >= UNDER * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """k, c: of every node of an edge the least node it is connected with. Edges (a, b), in any order."""
    state = None
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("k"), F.col("b").alias("c")).unionByName(edges.select(F.col("b").alias("k"), F.col("b").alias("c")).distinct())


class Joined:
    """Rows with their set's n, k, k2; classes of equal sets with doc_id (their least) and c, their component's key."""

    def __init__(self, df: DataFrame, width: int, keep: tuple[str, ...] = ()):
        self.texts, self.width = df.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text"), width
        rows = checkpointed(signatures(self.texts, width, ("doc_id", *keep)))
        same = lambda: rows.filter("n > 0").groupBy("n", "k", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("many"))
        classes = checkpointed(same())
        clashing = [r[0] for r in classes.groupBy("k").count().filter("count > 1").select("k").limit(CLASHES + 1).collect()]
        if len(clashing) > CLASHES:
            raise ValueError("too many sets share a key")
        if clashing:
            rows = rows.withColumn("k", F.when(F.col("k").isin(clashing), F.col("k2")).otherwise(F.col("k")))
            classes = checkpointed(same())
        self.rows, self.classes, self.clashing = rows, classes, np.array(clashing, np.int64)
        self.labels = self._labelled()

    def _labelled(self) -> DataFrame:
        classes, texts, width, clashing = self.classes, self.texts, self.width, self.clashing
        shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bits = min(max((shingles >> 8).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
        # prefixes are hashed in a pass of their own, so that they are never stored
        first = prefixes(texts, width, bits, clashing).groupBy("n", "k").agg(F.first("prefix").alias("prefix"))
        index = first.select("k", "n", F.posexplode("prefix").alias("at", "tok")).select("tok", "at", "n", "k")
        lists = checkpointed(index.repartition("tok").sortWithinPartitions("tok", "at", "n", "k").mapInArrow(tidy(_starred), "tok long, at int, n long, k long, hub long, star boolean"))
        del first, index
        release(texts.sparkSession)

        linked = (OVER * F.col("o")) >= UNDER * (F.col("na") + F.col("nb"))
        stars = lists.filter("star").select(F.col("k").alias("a"), F.col("hub").alias("b")).distinct()
        answers = checkpointed(overlaps(plausible(stars, lists), texts, classes, width, clashing))
        release(texts.sparkSession)
        links = answers.filter(linked).select("a", "b")
        known = answers.select(F.col("a").alias("k"), F.col("b").alias("hub"), F.col("nb").alias("hub_n"), "o")
        labelled = lists.drop("star").join(small(components(links), BROADCAST_ROWS), "k", "left").withColumn("c", F.coalesce("c", "k")).join(small(known, BROADCAST_ROWS), ["k", "hub"], "left")
        own = F.col("k") == F.col("hub")
        left = labelled.select("tok", "at", "n", "k", "c", "hub", F.when(own, F.col("n")).otherwise(F.coalesce("hub_n", F.lit(0))).alias("hub_n"), F.when(own, F.col("n")).otherwise(F.coalesce("o", F.lit(-1))).alias("o"))
        long = checkpointed(lists.groupBy("tok").agg(F.count("*").alias("rows")).filter(F.col("rows") > LIST_ROWS).select("tok", F.ceil(F.col("rows") / LIST_ROWS).alias("blocks")))
        left = _parts(left.join(small(long, BROADCAST_ROWS), "tok", "left"), F.coalesce("blocks", F.lit(1).cast("long")))
        # one exchange: parts of one component fall out behind a window over the same partitioning
        together = Window.partitionBy("tok", "part")
        left = left.repartition("tok", "part").withColumn("lo", F.min("c").over(together)).withColumn("hi", F.max("c").over(together)).filter("lo <> hi")
        left = left.select("tok", "part", "side", "at", "n", "k", "c", "hub", "hub_n", "o").sortWithinPartitions("tok", "part", "side", "at", "n", "k")
        crossed = checkpointed(left.mapInArrow(tidy(_crossed), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))
        release(texts.sparkSession)
        done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        checked = overlaps(plausible(crossed.filter("not sure").join(done, ["a", "b"], "left_anti"), lists), texts, classes, width, clashing)
        found = links.unionByName(crossed.filter("sure").select("a", "b")).unionByName(checked.filter(linked).select("a", "b"))
        return checkpointed(classes.join(components(found), "k", "left").withColumn("c", F.coalesce("c", "k")))

    def named(self, keep: tuple[str, ...] = ()) -> DataFrame:
        names = self.labels.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        named = self.labels.join(small(names, BROADCAST_ROWS), "c").select("k", "k2", "n", F.col("doc_id").alias("class_id"), "component_id", "c")
        out = self.rows.join(named, ["k", "k2", "n"], "left")
        return out.select("doc_id", *keep, "k", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("c").alias("component"))

    def _blocks(self, least: int) -> DataFrame:
        """Sets of components of ``least`` classes or more, dealt out as pairs of blocks and sorted by them."""
        release(self.texts.sparkSession)
        sizes = checkpointed(self.labels.groupBy("c").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).filter(F.col("sets") >= least))
        members = checkpointed(self.labels.join(small(sizes, BROADCAST_ROWS), "c").select("k", "doc_id", "n", "many", "c", F.greatest(F.ceil(F.col("sets") / SETS), F.ceil(F.col("total") / SHINGLES)).alias("blocks")))
        sets = wanted_sets(members.select("k", "doc_id"), self.texts, self.width, self.clashing).dropDuplicates(["k"])
        dealt = _parts(sets.join(members.drop("doc_id"), "k"), F.col("blocks")).select("c", "part", "side", "k", "n", "many", "items")
        return dealt.repartition("c", "part").sortWithinPartitions("c", "part", "side")

    def near(self) -> DataFrame:
        """k, near: how many rows of other sets each set of a component links with."""
        pairs = self.labels.groupBy("c").agg(F.count("*").alias("sets"), F.sum("many").alias("rows")).filter("sets = 2")
        two = self.labels.join(small(pairs, BROADCAST_ROWS), "c").select("k", (F.col("rows") - F.col("many")).alias("near"))
        more = self._blocks(3).mapInArrow(tidy(_counted), "k long, near long").groupBy("k").agg(F.sum("near").alias("near"))
        return two.unionByName(more)

    def links(self) -> DataFrame:
        """a, b (keys of sets, a < b): every link."""
        return self._blocks(2).mapInArrow(tidy(_listed), "a long, b long")


def linked_sets(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray, middle: int) -> np.ndarray:
    """Which of the first ``middle`` sets link with which of the others, or, if there are none, which of all with which.

    o are the overlaps with a pivot. Two sets that differ from it in disjoint ways share o + o' - pivot; they share one
    more for each shingle in which both differ from it alike.
    """
    m = len(n)
    pivot = int(np.argsort(n, kind="stable")[m // 2])
    order = np.argsort(hashes, kind="stable")
    ranked, own = hashes[order], owner[order]
    column = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])) - 1
    ones = np.bincount(column)
    there = np.zeros(len(ones), bool)
    there[column[own == pivot]] = True
    o = np.bincount(own[there[column]], minlength=m)
    apart = n[pivot] - o + n - o
    one, two = (slice(0, middle), slice(middle, m)) if middle < m else (slice(0, m), slice(0, m))
    base = o[one, None] + o[None, two] - n[pivot]
    total = UNDER * (n[one, None] + n[None, two])
    found = OVER * base >= total
    unsure = ~found & (OVER * (base + np.minimum(apart[one, None], apart[None, two])) >= total)
    if unsure.any():
        i, j = np.flatnonzero(unsure.any(1)), np.flatnonzero(unsure.any(0))
        live = np.flatnonzero(np.where(there, m - ones, ones) >= 2)
        place = np.full(len(ones), -1)
        place[live] = np.arange(len(live))
        at = place[column]
        own, at = own[at >= 0], at[at >= 0]
        alike = np.zeros((len(i), len(j)), np.float32)
        for s in range(0, len(live), COLUMNS):
            low, high = np.searchsorted(at, [s, s + COLUMNS])
            held = there[live[s : s + COLUMNS]]
            differs = np.repeat(held[None, :], m, 0)
            differs[own[low:high], at[low:high] - s] ^= True
            alike += differs[one][i].astype(np.float32) @ differs[two][j].astype(np.float32).T
        spot = np.ix_(i, j)
        found[spot] |= unsure[spot] & (OVER * (base[spot] + alike) >= total[spot])
    if middle == m:
        np.fill_diagonal(found, False)
    return found


def _related(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Of rows (c, part, side, k, n, many, items), of each part k, many, where the second side starts, and the links."""
    for run in _runs(batches, 2):
        side, k, n, many = (np.concatenate([b.column(i).to_numpy() for b in run]) for i in range(2, 6))
        hashes = np.concatenate([b.column(6).flatten().to_numpy() for b in run])
        middle = int(np.searchsorted(side, 1))
        if middle == 0 or len(k) < 2:
            continue
        yield k, many, middle, linked_sets(hashes, np.repeat(np.arange(len(n)), n), n, middle)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, many, middle, found in _related(batches):
        weight = many.astype(np.float64)
        if middle < len(k):
            near = np.concatenate([found @ weight[middle:], weight[:middle] @ found])
        else:
            near = found @ weight
        yield pa.record_batch([pa.array(k), pa.array(near.astype(np.int64))], names=["k", "near"])


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, _, middle, found in _related(batches):
        r, s = np.nonzero(found if middle < len(k) else np.triu(found))
        x, y = k[r], k[s + (middle if middle < len(k) else 0)]
        yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def ngram_components(df: DataFrame, width: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of every row of ``df`` (doc_id, text): doc_id and ``keep``, n_shingles, class_id, component_id and component.

    component is the component's own key, null for texts without words; ids alone may be null or repeat.
    """
    return Joined(df, width, keep).named(keep).drop("k")


def ngram_links(df: DataFrame, width: int = 5) -> DataFrame:
    """a, b (keys of sets, a < b) and a_class, b_class (their least ids): every link between different sets."""
    own = Joined(df, width)
    left, right = own.classes.select(F.col("k").alias("a"), F.col("doc_id").alias("a_class")), own.classes.select(F.col("k").alias("b"), F.col("doc_id").alias("b_class"))
    return own.links().join(left, "a").join(right, "b").select("a", "b", "a_class", "b_class")


def ngram_joined(df: DataFrame, width: int = 5) -> DataFrame:
    """The columns of ngram_components and n_links: how many other rows are linked with a row, those of its own set among them."""
    own = Joined(df, width)
    near = own.near()
    counts = own.classes.join(near, "k", "left").select("k", (F.col("many") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = own.named().join(counts, "k", "left").withColumn("n_links", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", "component", "n_links")


def one_of_each(df: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the one with the least id, then the least hash of its text.

    Texts without words all stay. Of rows that agree in id and text one stays.
    """
    own = free(df, "__h")
    keyed = df.withColumn(own, F.xxhash64("text"))
    found = ngram_components(keyed, width, (own,)).filter("n_shingles > 0")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(own).alias("h"))).alias("x"))
    chosen = least.select(F.col("x.id").alias(free(keyed, "__id")), F.col("x.h").alias(free(keyed, "__own")))
    there = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) > 0
    kept = keyed.filter(there).join(chosen, (F.col(own) == chosen[1]) & F.col("doc_id").eqNullSafe(chosen[0]), "left_semi").dropDuplicates([own, "doc_id"])
    return kept.unionByName(keyed.filter(~there)).select(*df.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_joined(documents(spark, sf_dir)).drop("component")
