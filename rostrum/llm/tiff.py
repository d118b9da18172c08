"""Media columns: TIFF files of 8-bit grey pages, written and read without any imaging library.

The writer fills the bytes up to units of 576 and lays them out as rows of 96
samples, in pages of at most 1,536 rows. A checksum of the bytes picks one of six storage forms, so that a table
holds strips and tiles, PackBits, LZW and deflate, with and without horizontal
differencing. The reader walks the chain of image directories in either
byte order, decodes strips or tiles, undoes the predictor, and gives one row
per page.

Null texts are empty; an empty text still is one row of padding. Equal bytes
give equal files. Media that is null gives no page; media that can't be read
gives one row with its error and page -1. Repeated rows give repeated results, an
empty table an empty one. A long text becomes many pages, and is measured page by
page. Columns other than ``keep`` and the text or media are not read; ``keep`` may
not hold the names of the results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import documents, pieces, results_free, texts

UNIT, PAD = 576, 255
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_WIDTH, TILE_ROWS = 96, 1_536, 96, 48, 32
#: Codes of the TIFF specification.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_at": 273, "samples": 277, "strip_rows": 278, "strip_size": 279, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_at": 324, "tile_size": 325}
SIZES = {1: 1, 3: 2, 4: 4}
#: Samples that a byte of a file can stand for at most; above what deflate and LZW reach.
MOST_RATIO = 4_096
#: (compression, tiled, predictor) of the forms that files take in turn.
FORMS = [(PACKBITS, False, 1), (LZW, False, 2), (DEFLATE, True, 2), (LZW, True, 1), (PACKBITS, True, 1), (DEFLATE, False, 1)]
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in _RUN.finditer(row):
        literal(row[at : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.append(row[run.start()])
        at = run.end()
    literal(row[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, got = [], 0, 0
    while got < size and at < len(data):
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        got += len(part)
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    size, free, held = 9, 258, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        known = table.get(key)
        if known is not None:
            held = known
            continue
        codes.append(held)
        widths.append(size)
        table[key] = free
        free += 1
        held = byte
        if free == 4094:
            codes.append(256)
            widths.append(size)
            table, size, free = {}, 9, 258
        elif free >> size:
            size += 1
    if held >= 0:
        codes.append(held)
        widths.append(size)
        free += 1
        if free >> size and size < 12:
            size += 1
    codes.append(257)
    widths.append(size)
    width = np.array(widths)
    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    bits = np.repeat(np.array(codes), width) >> (np.repeat(width, width) - 1 - place) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _schedule() -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes that follow a clear code, and where each starts in bits."""
    free = 258 + np.maximum(np.arange(3900) - 1, 0)
    width = np.select([free < 511, free < 1023, free < 2047], [9, 10, 11], 12)
    return width, np.cumsum(width) - width


_WIDTHS, _STARTS = _schedule()


def unlzw(data: bytes, size: int) -> bytes:
    """Between clear codes the widths follow a fixed schedule, so a whole run of codes is cut out at once."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    total, bit, out, got = len(data) * 8, 0, [], 0
    singles = [bytes([k]) for k in range(256)] + [b"", b""]
    while got < size and bit + 9 <= total:
        at = bit + _STARTS
        fits = int(np.searchsorted(at + _WIDTHS, total, "right"))
        if not fits:
            break
        at, width = at[:fits], _WIDTHS[:fits]
        spot = at >> 3
        word = raw[spot] << 16 | raw[spot + 1] << 8 | raw[spot + 2]
        codes = (word >> (24 - (at & 7) - width)) & ((1 << width) - 1)
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(ends[0]) if len(ends) else fits
        table, before = list(singles), b""
        for code in codes[:stop].tolist():
            if not before:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(before + entry[:1])
            else:
                entry = before + before[:1]
                table.append(entry)
            out.append(entry)
            got += len(entry)
            before = entry
        if not len(ends) or codes[stop] == 257:
            break
        bit = int(at[stop] + width[stop])
    return b"".join(out)[:size]


def _coded(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.uint8(0))
    if compression == PACKBITS:
        return b"".join(packbits(row.tobytes()) for row in block)
    return lzw(block.tobytes()) if compression == LZW else zlib.compress(block.tobytes(), 6)


def _decoded(data: bytes, rows: int, width: int, compression: int, predictor: int, samples: int) -> np.ndarray:
    size = rows * width * samples
    if compression == PACKBITS:
        raw = unpackbits(data, size)
    elif compression == LZW:
        raw = unlzw(data, size)
    elif compression in (DEFLATE, DEFLATE_OLD):
        raw = zlib.decompress(data)[:size]
    elif compression == NONE:
        raw = data[:size]
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(raw) < size:
        raise ValueError(f"a strip or tile has {len(raw)} of {size} bytes")
    block = np.frombuffer(raw, np.uint8).reshape(rows, width, samples)
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return block


def write(pages: list[np.ndarray], compression: int = DEFLATE, tiled: bool = False, predictor: int = 1, order: str = "<") -> bytes:
    """A TIFF file of 8-bit grey pages (rows, width)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        rows, width = page.shape
        if tiled:
            grid = np.pad(page, ((0, -rows % TILE_ROWS), (0, -width % TILE_WIDTH)), mode="edge")
            blocks = [grid[y : y + TILE_ROWS, x : x + TILE_WIDTH] for y in range(0, rows, TILE_ROWS) for x in range(0, width, TILE_WIDTH)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, rows, STRIP_ROWS)]
        places, sizes = [], []
        for block in blocks:
            data = _coded(block, compression, predictor)
            places.append(len(out))
            sizes.append(len(data))
            out += data
        out += bytes(len(out) & 1)
        own: dict[str, list[int]] = {"width": [width], "height": [rows], "bits": [8], "compression": [compression], "photometric": [1], "samples": [1], "predictor": [predictor]}
        own |= {"tile_width": [TILE_WIDTH], "tile_height": [TILE_ROWS], "tile_at": places, "tile_size": sizes} if tiled else {"strip_at": places, "strip_rows": [STRIP_ROWS], "strip_size": sizes}
        fields = []
        for tag, values in sorted((TAGS[k], v) for k, v in own.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(packed) > 4:
                packed, spot = struct.pack(order + "I", len(out)), packed
                out += spot
            fields.append(struct.pack(order + "HHI", tag, 4, len(values)) + packed)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += bytes(4)
    return bytes(out)


@dataclass
class Page:
    width: int
    height: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def read(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, by its chain of directories; a chain that comes back to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    names = {v: k for k, v in TAGS.items()}
    while at:
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[str, tuple[int, ...]] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag in names and kind in SIZES:
                spot = at + 10 + 12 * k
                if n * SIZES[kind] > 4:
                    spot = struct.unpack_from(order + "I", data, spot)[0]
                tags[names[tag]] = struct.unpack_from(f"{order}{n}{'?BxHI'[kind]}", data, spot)
        yield _page(data, {k: v[0] for k, v in tags.items()}, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, one: dict[str, int], tags: dict[str, tuple[int, ...]]) -> Page:
    width, height, samples = one["width"], one["height"], one.get("samples", 1)
    if set(tags.get("bits", (8,))) != {8}:
        raise ValueError("only 8-bit samples are supported")
    compression, predictor = one.get("compression", NONE), one.get("predictor", 1)
    if width * height * samples > len(data) * MOST_RATIO:
        raise ValueError(f"{width} x {height} samples don't fit into {len(data)} bytes")
    pixels = np.empty((height, width, samples), np.uint8)
    tiled = "tile_at" in tags
    if tiled:
        w, h = one["tile_width"], one["tile_height"]
        across = -(-width // w)
        for k, (spot, size) in enumerate(zip(tags["tile_at"], tags["tile_size"], strict=True)):
            y, x = k // across * h, k % across * w
            block = _decoded(data[spot : spot + size], h, w, compression, predictor, samples)
            pixels[y : y + h, x : x + w] = block[: height - y, : width - x]
    else:
        h = min(one.get("strip_rows", height), height)
        for k, (spot, size) in enumerate(zip(tags["strip_at"], tags["strip_size"], strict=True)):
            y = k * h
            rows = min(h, height - y)
            pixels[y : y + rows] = _decoded(data[spot : spot + size], rows, width, compression, predictor, samples)
    return Page(width, height, compression, predictor, tiled, pixels)


def payload(body: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of the unit."""
    return body + bytes([PAD]) * (-len(body) % UNIT or (0 if body else UNIT))


def stored(body: bytes) -> bytes:
    """The file of a payload; its checksum picks the form."""
    rows = np.frombuffer(body, np.uint8).reshape(-1, WIDTH)
    compression, tiled, predictor = FORMS[zlib.crc32(body) % len(FORMS)]
    return write([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, tiled, predictor)


def write_column(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (of the text) and media (the TIFF file)."""
    results_free(keep, "n_bytes", "media")
    width = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, width):
                bodies = [t.encode() for t in texts(part.column(width))]
                media = [stored(payload(b)) for b in bodies]
                yield pa.record_batch([*part.columns[:width], pa.array([len(b) for b in bodies], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, df.select(*keep).schema.add("n_bytes", "long").add("media", "binary"))


def read_column(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), every: bool = False) -> DataFrame:
    """One row per page: ``keep`` columns, page, width, height, compression, predictor, tiled, pixels, error.

    Pages of a file come one after another, in order. With ``every``, null media give a row too, of page -1.
    """
    names = [*keep, "page", "width", "height", "compression", "predictor", "tiled", "pixels", "error"]
    schema = df.select(*keep).schema
    for name, kind in zip(names[len(keep) :], ("integer", "integer", "integer", "integer", "integer", "boolean", "binary", "string"), strict=True):
        schema = schema.add(name, kind)
    kinds = [pa.int32()] * 5 + [pa.bool_(), pa.binary(), pa.string()]

    def pages(media: pa.Scalar) -> Iterator[tuple]:
        try:
            if media.is_valid:
                for i, p in enumerate(read(media.as_py())):
                    yield i, p.width, p.height, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None
            elif every:
                yield (-1, *[None] * 6, "no media")
        except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError) as e:
            yield (-1, *[None] * 6, str(e))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, held = [], [], 0

            def flushed() -> pa.RecordBatch:
                return pa.record_batch([*(c.take(pa.array(own)) for c in batch.columns[: len(keep)]), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)  # noqa: B023

            for k, media in enumerate(batch.column(len(keep))):
                for row in pages(media):
                    own.append(k)
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > 1_000_000:
                        yield flushed()
                        own, rows, held = [], [], 0
            if rows:
                yield flushed()

    return df.select(*keep, F.col(media_col).alias("__media")).mapInArrow(run, schema)


class Measured:
    """Of the pages of a file, one after another: payload bytes, digest, the last 32 bytes, and integer sums for the feature."""

    def __init__(self):
        self.bytes, self.sha, self.tail = 0, hashlib.sha256(), b""
        self.pages = self.height = self.total = self.square = self.edges = 0
        self.width, self.error = None, None

    def add(self, page: int, width: int | None, height: int | None, pixels: bytes | None, error: str | None) -> None:
        if page < 0:
            self.error = error
            return
        x = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
        self.bytes += len(pixels)
        self.sha.update(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        self.pages += 1
        self.width = self.width or width
        self.height += height
        self.total += int(x.sum(dtype=np.int64))
        self.square += int((x.astype(np.int64) ** 2).sum())
        self.edges += int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))

    def found(self) -> tuple:
        """payload_bytes, payload_sha256, tail_crc32 and feature: page count, size, mean, deviation and edge strength. Nulls where the file can't be read."""
        if self.error is not None or not self.bytes:
            return None, None, None, None, self.error
        mean = self.total / self.bytes
        deviation = max(self.square / self.bytes - mean * mean, 0) ** 0.5
        feature = f"pages={self.pages};size={self.width}x{self.height};mean={mean:.3f};std={deviation:.3f};edge={self.edges / self.bytes:.3f}"
        return self.bytes, self.sha.hexdigest(), zlib.crc32(self.tail), feature, None


def digest(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the pages of each file hold, read back page by page: ``keep``, sizes, digests, feature and error. One row per row, also where media is null or can't be read."""
    width = len(keep)
    known = {"__size": F.octet_length("media").cast("long"), "__sha": F.sha2("media", 256), "__row": F.monotonically_increasing_id()}
    pages = read_column(df.withColumns(known), keep=(*keep, *known), every=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # files: their columns, measures of their pages so far, and row

        def flushed(files: list) -> pa.RecordBatch:
            own = [pa.concat_arrays([f[0][c] for f in files]) for c in range(width)]
            rows = [(*f[1].found(), f[0][width][0].as_py(), f[0][width + 1][0].as_py()) for f in files]
            return pa.record_batch([*own, *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature", "error", "media_bytes", "media_sha256"])

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            row, number, wide, high, pixels, error = (batch.column(width + 2 + c) for c in (0, 1, 2, 3, 7, 8))
            for k, (now, page) in enumerate(zip(row.to_pylist(), number.to_pylist(), strict=True)):
                if not held or held[-1][2] != now:
                    held.append(([c.slice(k, 1) for c in batch.columns[: width + 2]], Measured(), now))
                held[-1][1].add(page, wide[k].as_py(), high[k].as_py(), pixels[k].as_py(), error[k].as_py())
            if len(held) > 512:
                yield flushed(held[:-1])
                held = held[-1:]
        if held:
            yield flushed(held)

    schema = df.select(*keep).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string"), ("error", "string"), ("media_bytes", "long"), ("media_sha256", "string")):
        schema = schema.add(name, kind)
    return pages.mapInArrow(run, schema)


def op5_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(write_column(documents(spark, sf_dir))).drop("error")
