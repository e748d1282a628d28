"""Media columns: GIF files to timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a file: blocks, palettes (global and local), interlace, code streams of the
Lempel-Ziv-Welch kind with growing widths, clear and end codes, transparency, the disposal methods and delays. Frames
are composed on the canvas as a viewer would show them.

``payload_gif`` stores bytes losslessly: each byte is the index of a colour whose red part is the byte, 64 to a row, in
frames of up to 256 rows. A frame draws only what the canvas doesn't show yet (one colour that it has no use for is
transparent) and the disposal methods take turns, so that reading back goes through all of the decoder.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts give equal files; texts of any length
take as many frames as they need; an empty table gives an empty result; extra columns are ignored. A null or empty file
has no frames. Of a file that is damaged, or whose canvas or frame is above ``MAX_PIXELS``, the frames before the damage
come out, then a row that says what is wrong.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, text_of

ROW = 64
FRAME_ROWS = 256
DELAY = 4  # hundredths of a second
#: Pixels of a canvas or a frame that the decoder makes room for.
MAX_PIXELS = 1 << 26


# --- code streams ---

#: Most codes of a table, by the format, and codes that are cut out of the bits at a time once the width is full.
FULL, CHUNK = 4096, 4096
_CHILDREN = [0] * (FULL << 8)


def pack_codes(codes: np.ndarray, width: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    place = np.arange(12)
    bits = ((codes[:, None] >> place) & 1).astype(np.uint8)
    return np.packbits(bits[place < width[:, None]], bitorder="little").tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Code stream of data: the longest string that the table holds, each time, and a clear code when the table is full."""
    clear = 1 << bits
    # The child of a string's code and a byte, as code << 8, in a list that is set back after each run.
    child, touched = _CHILDREN, []
    runs: list[list[int]] = []
    codes, size = [clear], clear + 2
    put, touch = codes.append, touched.append
    at = data[0] << 8 if data else -1
    entry, full = size << 8, FULL << 8
    for b in data[1:]:
        if at := child[k := at + b]:
            continue
        put(k >> 8)
        if entry < full:
            child[k] = entry
            touch(k)
            entry += 256
        else:
            runs.append(codes)
            for k in touched:
                child[k] = 0
            touched.clear()
            codes, entry = [clear], clear + 2 << 8
            put = codes.append
        at = b << 8
    if at >= 0:
        put(at >> 8)
    for k in touched:
        child[k] = 0
    put(clear + 1)
    runs.append(codes)
    # The reader's table grows by a code with each but the first of a run, and the width with the table.
    width, grown = [], bits + 1
    for run in runs:
        size = np.arange(len(run)) + clear
        own = np.clip(np.frexp(size)[1], bits + 1, 12)
        own[0] = grown  # a clear code is read at the width that the run before has come to
        grown = min(12, (clear + len(run)).bit_length())
        width.append(own)
    return pack_codes(np.array([c for run in runs for c in run], np.int32), np.concatenate(width))


def _codes(stream: np.ndarray, at: int, count: int, width: int) -> np.ndarray:
    """Up to count codes of width from bit at."""
    count = min(count, (len(stream) - at) // width)
    return stream[at : at + count * width].reshape(count, width).astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """The first limit bytes of a code stream. Codes are cut out of the bits together, as far as one width reaches."""
    if not 2 <= bits <= 8:
        raise ValueError(f"code size {bits}")
    stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, first = 1 << bits, (1 << bits) + 2
    fresh = [*(bytes([b]) for b in range(clear)), b"", b""]
    table, before, parts, done, at = fresh.copy(), b"", [], 0, 0  # the table's strings; the one before in the run; bytes that came
    while done < limit:
        size = len(table)  # a string and the next one's first byte are an entry
        width = min(12, size.bit_length())
        some = _codes(stream, at, CHUNK if width == 12 else (1 << width) - size, width)
        if not len(some):
            break
        stop = np.flatnonzero((some == clear) | (some == clear + 1))
        end = int(stop[0]) if len(stop) else len(some)
        came, codes = len(parts), some[:end].tolist()
        put, grow = parts.append, table.append
        if codes and not before:  # the first of a run makes no entry
            if codes[0] >= clear:
                raise ValueError("code beyond the table")
            put(before := table[codes.pop(0)])
        for code in codes:
            if code < size:
                string = table[code]
            elif code == size < FULL:  # the string that is being written
                string = before + before[:1]
            else:
                raise ValueError("code beyond the table")
            put(string)
            if size < FULL:
                grow(before + string[:1])
                size += 1
            before = string
        done += sum(map(len, parts[came:]))
        at += width * (end + (1 if len(stop) else 0))
        if len(stop):
            if some[end] == clear + 1:
                break
            table, before = fresh.copy(), b""
    return b"".join(parts)[:limit]


# --- files ---


@dataclass
class Frame:
    """A frame as shown: the canvas after it is drawn, and what drew it."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None


def _blocks(blob: bytes, at: int) -> tuple[bytes, int]:
    """Data of a chain of sub-blocks, and where it ends."""
    parts = []
    while n := blob[at]:
        parts.append(blob[at + 1 : at + 1 + n])
        if len(parts[-1]) < n:
            raise ValueError("file is cut short")
        at += n + 1
    return b"".join(parts), at + 1


def chained(data: bytes) -> bytes:
    whole = len(data) // 255
    body = np.frombuffer(data, np.uint8)
    head = np.empty((whole, 256), np.uint8)
    head[:, 0], head[:, 1:] = 255, body[: whole * 255].reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _palette(blob: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(blob, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


#: What ``decode_gif`` raises on a damaged file.
DAMAGE = (ValueError, IndexError, struct.error)


def decode_gif(blob: bytes) -> Iterator[Frame]:
    """Frames of a file in order. A damaged file raises one of ``DAMAGE``."""
    if blob[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF file")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", blob, 6)
    common, at = _palette(blob, 13, flags)
    if width * height > MAX_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = blob[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = blob[at + 1]
            data, at = _blocks(blob, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", data[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", blob, at + 1)
        own, at = _palette(blob, at + 10, flags)
        palette = common if own is None else own
        if palette is None:
            raise ValueError("no palette")
        if w * h > MAX_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        data, end = _blocks(blob, at + 1)
        pixels = np.frombuffer(lzw_decode(data, blob[at], w * h), np.uint8)
        at = end
        if len(pixels) < w * h:
            raise ValueError("frame is cut short")
        pixels = pixels.reshape(h, w)
        if flags & 0x40:  # interlaced: rows come in four passes
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        before = canvas.copy() if disposal == 3 else None
        seen = canvas[y : y + h, x : x + w]
        part = pixels[: seen.shape[0], : seen.shape[1]]
        colours = palette[np.minimum(part, len(palette) - 1)]
        if transparent is None:
            seen[:] = colours
        else:
            drawn = part != transparent
            seen[drawn] = colours[drawn]
        yield Frame(canvas, x, y, w, h, delay, disposal, transparent)
        if disposal == 2:
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


_BYTES = np.arange(256, dtype=np.uint8)
#: The stored files' colours; red tells the byte.
COLOURS = np.stack([_BYTES, 255 - _BYTES, _BYTES * np.uint8(37)], 1).tobytes()


def payload_gif(payload: bytes) -> bytes:
    """A file whose frames show payload (a multiple of 64 bytes) in rows of 64."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    shown = np.zeros((min(len(data), FRAME_ROWS), ROW), np.uint8)
    parts = [b"GIF89a", struct.pack("<HHBBB", ROW, len(shown), 0xF7, 0, 0), COLOURS]
    for number, top in enumerate(range(0, len(data), FRAME_ROWS)):
        frame = data[top : top + FRAME_ROWS]
        seen = shown[: len(frame)]
        unused = np.flatnonzero(np.bincount(frame.ravel(), minlength=256) == 0)
        clear = int(unused[0]) if len(unused) else None
        drawn = frame if clear is None else np.where(frame == seen, np.uint8(clear), frame)
        disposal = 1 + number % 3
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), DELAY, clear or 0, 0))
        parts.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, ROW, len(frame), 0, 8))
        parts.append(chained(lzw_encode(drawn.tobytes())))
        if disposal < 3:
            seen[:] = frame if disposal == 1 else 0
    return b"".join([*parts, b"\x3b"])


def histogram(frame: Frame, bins: int = 8) -> np.ndarray:
    """Pixels of the frame's rectangle by channel and bin (3 x bins)."""
    seen = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width].reshape(-1, 3)
    return np.stack([np.bincount(seen[:, c], minlength=256).reshape(bins, -1).sum(1) for c in range(3)])


FRAMES = "media_id string, frame int, start_ms long, delay_ms long, x int, y int, width int, height int, disposal int, transparent int, red array<long>, green array<long>, blue array<long>, error string"


def gif_frames(media: DataFrame) -> DataFrame:
    """One row per frame of media (media_id, body): time, place, disposal and histogram columns."""
    small_batches(media.sparkSession, 200)

    schema = pa.schema([("media_id", pa.string()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), *((n, pa.int32()) for n in ("x", "y", "width", "height", "disposal", "transparent")), *((n, pa.list_(pa.int64())) for n in ("red", "green", "blue")), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                try:
                    for i, f in enumerate(decode_gif(body) if body else ()):
                        rows.append((key, i, start, 10 * f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent, *histogram(f).tolist(), None))
                        start += 10 * f.delay
                except DAMAGE as error:
                    rows.append((key, *[None] * 12, str(error) or type(error).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return media.select(media["media_id"].cast("string").alias("media_id"), media["body"].cast("binary").alias("body")).mapInArrow(work, FRAMES)


def media_row(text: str) -> tuple:
    """Store a text and read it back: the columns of ``text_media``."""
    raw = text.encode()
    body = payload_gif(raw + bytes(-len(raw) % ROW or (0 if raw else ROW)))
    back, hist, time, frames = [], np.zeros((3, 8), np.int64), 0, 0
    for f in decode_gif(body):
        back.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        hist += histogram(f)
        time, frames = time + 10 * f.delay, frames + 1
    payload = b"".join(back)
    feature = f"frames={frames};ms={time};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip("rgb", hist.tolist(), strict=True))
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(body), hashlib.sha256(body).hexdigest(), feature)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF file and read back: sizes, digests and features."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            columns = list(zip(*map(media_row, batch.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir))
