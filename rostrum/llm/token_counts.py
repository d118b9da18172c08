"""Token counts by a map-side two-tier lookup.

One pass gathers, in each partition, a bounded summary of the most frequent
pre-tokens; the summaries (never the pre-tokens) merge through a tree of tasks.
The frequent pre-tokens are encoded once on the driver and broadcast as a
compact table of lengths. A second pass splits every whole text into
pre-tokens, looks each up in that table, and encodes the misses in batches
through a cache that each worker keeps. The table decides speed only: every
miss is encoded by the library, so counts are exact whatever the table holds.

Nulls count as empty texts (0 tokens). Repeated rows give repeated results, an
empty table an empty one. Texts are taken a megabyte at a time, a longer one alone
and whole. Other columns are carried along only where asked for; ``keep`` may not
hold the names of the results (ValueError).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import documents, merged, pieces, results_free, texts

#: How the vocabulary's library splits text before merging, and its special token.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
ASCII_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
SPECIAL = "<|endoftext|>"

#: Pre-tokens in the broadcast table at most, and the longest one that it takes, in characters: under 3 MB.
TABLE_SIZE, TABLE_WIDTH = 65_536, 32
#: Pre-tokens that a partition's summary passes on at most, and that it holds while it reads.
SUMMARY_SIZE, SUMMARY_HELD = 16_384, 200_000
#: Pre-tokens that a worker remembers at most; the cache starts anew beyond.
CACHE_SIZE = 300_000

_worker: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, once per worker process, on one thread."""
    if ("tokenizer", path) not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _worker["tokenizer", path] = found
    return _worker["tokenizer", path]


def splitter():
    """Texts to pre-tokens; special strings stand alone."""
    if "split" not in _worker:
        import re

        import regex

        plain, ascii_only = regex.compile(SPLIT).findall, re.compile(ASCII_SPLIT).findall

        def split(text: str) -> list[str]:
            if SPECIAL not in text:
                return (ascii_only if text.isascii() else plain)(text)
            out: list[str] = []
            for k, part in enumerate(text.split(SPECIAL)):
                if k:
                    out.append(SPECIAL)
                out += (ascii_only if part.isascii() else plain)(part)
            return out

        _worker["split"] = split
    return _worker["split"]


def _pack(counts: dict[str, int]) -> bytes:
    words = [w.encode() for w in counts]
    head = struct.pack("<I", len(words))
    return zlib.compress(head + np.array([len(w) for w in words], "<u2").tobytes() + np.array(list(counts.values()), "<u8").tobytes() + b"".join(words), 1)


def _unpack(data: bytes) -> dict[str, int]:
    raw = zlib.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    lengths, counts = np.frombuffer(raw, "<u2", n, 4), np.frombuffer(raw, "<u8", n, 4 + 2 * n)
    ends = np.cumsum(lengths, dtype=np.int64) + 4 + 10 * n
    return {raw[e - k : e].decode(): int(c) for e, k, c in zip(ends.tolist(), lengths.tolist(), counts.tolist(), strict=True)}


def _top(counts: Counter, size: int) -> Counter:
    return counts if len(counts) <= size else Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]))


def _merge(summaries: Iterator[bytes]) -> bytes:
    total: Counter = Counter()
    for data in summaries:
        total.update(_unpack(data))
        if len(total) > SUMMARY_HELD:
            total = _top(total, SUMMARY_HELD // 2)
    return _pack(_top(total, TABLE_SIZE))


def _summarize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    split = splitter()
    for batch in batches:
        for text in (text for part in pieces(batch, 0) for text in texts(part.column(0))):
            total.update(split(text))
            if len(total) > SUMMARY_HELD:
                total = _top(total, SUMMARY_HELD // 4)
    kept = Counter({w: c for w, c in total.items() if c > 1 and len(w) <= TABLE_WIDTH and w != SPECIAL})
    yield pa.record_batch([pa.array([_pack(_top(kept, SUMMARY_SIZE))], pa.binary())], names=["summary"])


def frequent_lengths(df: DataFrame, text_col: str, path: str) -> tuple[bytes, bytes]:
    """The compact table: its pre-tokens joined by a byte that UTF-8 never has, and their token counts."""
    summary = merged(df.select(F.col(text_col)).mapInArrow(_summarize, "summary binary"), _merge)
    words = list(_unpack(summary)) if summary else []
    counts = [len(e.ids) for e in tokenizer(path).encode_batch(words, add_special_tokens=False)] if words else []
    return b"\xff".join(w.encode() for w in words), bytes(min(c, 255) for c in counts)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """``keep`` columns and n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    results_free(keep, "n_bytes", "n_tokens", "over_limit")
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(df, text_col, path))
    width = len(keep)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = table.value
        if _worker.get("table_of") != table.value:
            _worker["table_of"] = table.value
            _worker["table"] = dict(zip((w.decode() for w in words.split(b"\xff")), lengths, strict=True)) if lengths else {}
            _worker["missed"] = {}
        frequent, split, library = _worker["table"].get, splitter(), tokenizer(path)
        for batch in (part for batch in batches for part in pieces(batch, width)):
            if len(_worker["missed"]) > CACHE_SIZE:
                _worker["missed"] = {}
            missed = _worker["missed"]
            bodies = texts(batch.column(width))
            totals, late, fresh = [], [], {}
            for text in bodies:
                total, left = 0, []
                for word in split(text):
                    n = frequent(word)
                    if n is None:
                        n = missed.get(word)
                        if n is None:
                            left.append(word)
                            fresh[word] = 0
                            continue
                    total += n
                totals.append(total)
                late.append(left)
                if len(fresh) > 50_000:
                    _settle(library, fresh, missed, totals, late)
            _settle(library, fresh, missed, totals, late)
            n_bytes = [len(t.encode()) for t in bodies]
            yield pa.record_batch(
                [*batch.columns[:width], pa.array(n_bytes, pa.int64()), pa.array(totals, pa.int64()), pa.array([t > limit for t in totals], pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = df.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(count, schema)


def _settle(library, fresh: dict[str, int], missed: dict[str, int], totals: list[int], late: list[list[str]]) -> None:
    """Encode what no table knew, remember the short ones, and add them where they were met."""
    if fresh:
        words = list(fresh)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, found in zip(part, library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                fresh[word] = len(found.ids)
        for k, left in enumerate(late):
            if left:
                totals[k] += sum(fresh[w] for w in left)
                late[k] = []
        missed.update((w, n) for w, n in fresh.items() if len(w) <= TABLE_WIDTH)
        fresh.clear()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
