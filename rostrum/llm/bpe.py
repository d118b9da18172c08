"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token holds inside can never
lie within one token, so a text may be cut between them for certain. Fragments
between such cuts are encoded on their own, and their ids concatenated.

The library also splits text by a pattern before it merges bytes. A cut leaves
that pattern's matches as they are unless it can see across: so no cut is made
after a white-space byte (the pattern looks at what follows white space), next
to an apostrophe (it starts the contractions), inside a contraction's letters,
or inside a character. Fragments repeat, as words do; each worker remembers
the ids of short ones and gives the library those it hasn't met.

Nulls are empty texts: no ids, an empty decoded text. Very long texts take
memory in proportion to their length. Special strings inside texts become
their special id, as the library does by default. Repeated rows give repeated
results, an empty table an empty one. Columns other than ``keep`` and the text
are not read; ``keep`` may not hold the names of the results (ValueError).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rostrum.llm.common import documents, results_free, text_buffers, tidy
from rostrum.llm.token_counts import tokenizer

#: Fragments that a worker remembers at most, and the longest of them in bytes.
CACHE_SIZE, CACHE_WIDTH = 150_000, 48
#: Last bytes of white-space characters in UTF-8, ASCII and others.
SPACE_ENDS = [*range(0x09, 0x0E), 0x20, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
#: Letter pairs inside the contractions that the pattern knows.
CONTRACTED = (b"re", b"ve", b"ll")

_worker: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """One vocabulary: its certain cuts, the bytes of each id, and a cache of encoded fragments."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        self.library = tokenizer(path)
        alphabet = byte_alphabet()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k.encode(): str(v).encode() for k, v in added.items()}
        self.bytes_of: dict[bytes, bytes] = {}
        inside = np.zeros(65_536, bool)
        for token, k in spec["model"]["vocab"].items():
            if token in added:
                self.bytes_of[str(k).encode()] = token.encode()
                continue
            raw = bytes(alphabet[c] for c in token)
            self.bytes_of[str(k).encode()] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a << 8 | b] = True
        self.bytes_of |= {v: k for k, v in self.special.items()}
        left, right = np.arange(65_536) >> 8, np.arange(65_536) & 255
        certain = ~inside & ~np.isin(left, SPACE_ENDS) & (left != 0x27) & (right != 0x27) & ((right < 0x80) | (right >= 0xC0))
        for pair in CONTRACTED:
            certain[pair[0] << 8 | pair[1]] = False
        self.certain = certain
        self.by_id = {int(k): v for k, v in self.bytes_of.items()}
        self.cache: dict[bytes, bytes] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2:
            return [raw] if raw else []
        data = np.frombuffer(raw, np.uint8)
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        cuts = (np.flatnonzero(self.certain[pairs]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)], strict=True)]

    def pieces(self, raw: bytes) -> list[bytes]:
        """Fragments of a text in order, special strings on their own."""
        parts = [raw]
        for special in self.special:
            if special in raw:
                parts = [x for p in parts for k, y in enumerate(p.split(special) if p not in self.special else [p]) for x in ([special] if k else []) + [y]]
        return [x for p in parts for x in ([p] if p in self.special else self.fragments(p))]

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Of each text its decimal ids joined by commas."""
        if len(self.cache) > CACHE_SIZE:
            self.cache = {}
        cache, out = self.cache, []
        for at in range(0, len(raws), 64):
            pieces = [self.pieces(raw) for raw in raws[at : at + 64]]
            fresh = {x: b"" for own in pieces for x in own if x not in cache}
            words = list(fresh)
            for k in range(0, len(words), 4096):
                part = words[k : k + 4096]
                for word, found in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                    fresh[word] = ",".join(map(str, found.ids)).encode()
            long = {w: v for w, v in fresh.items() if len(w) > CACHE_WIDTH}
            cache.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_WIDTH)
            for own in pieces:
                out.append(b",".join([cache[x] if x in cache else long[x] for x in own]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of decimal ids joined by commas; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(b","))).decode("utf-8", "replace") if ids else ""


def codec(path: str) -> Codec:
    if path not in _worker:
        _worker[path] = Codec(path)
    return _worker[path]


def _rows(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, about one MB at a time."""
    raw, offsets = text_buffers(column)
    data, ends = raw.tobytes(), offsets.tolist()
    own: list[bytes] = []
    held = 0
    for i, j in zip(ends, ends[1:], strict=False):
        own.append(data[i:j])
        held += j - i
        if held > 1_000_000:
            yield own
            own, held = [], 0
    yield own


def _ids(joined: bytes) -> list[int]:
    return list(map(int, joined.split(b","))) if joined else []


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False, decoded: bool = False) -> DataFrame:
    """``keep`` columns and ids array<int>; with decoded, also the text that they decode to, by the same worker; with digest, instead counts and digests of both directions."""
    results_free(keep, *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded") if decoded else ("ids",)))
    width = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for raws in _rows(batch.column(width)):
                joined = own.encode(raws)
                kept = [c.slice(at, len(raws)) for c in batch.columns[:width]]
                at += len(raws)
                if digest:
                    back = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in joined]
                    more = [pa.array([x.count(b",") + 1 if x else 0 for x in joined], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined]), pa.array(back)]
                else:
                    more = [pa.array([_ids(x) for x in joined], pa.list_(pa.int32()))] + ([pa.array([own.decode(x) for x in joined], pa.string())] if decoded else [])
                if raws:
                    yield pa.record_batch([*kept, *more], names=names)

    schema = df.select(*keep).schema
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string") if digest else schema.add("ids", ArrayType(IntegerType()))
    if decoded and not digest:
        schema = schema.add("decoded", "string")
    names = schema.names
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded text of an id array; null ids give an empty text."""
    results_free(keep, "decoded")
    width = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                back = [b"".join(map(own.by_id.__getitem__, ids or ())).decode("utf-8", "replace") for ids in part.column(width).to_pylist()]
                yield pa.record_batch([*part.columns[:width], pa.array(back, pa.string())], names=[*keep, "decoded"])

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(tidy(run), df.select(*keep).schema.add("decoded", "string"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
