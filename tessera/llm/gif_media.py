"""Media columns: GIF animations.

``store`` writes a text's bytes as the 8-bit samples of a GIF animation (frames of 24 columns and up
to 96 rows under a grey palette, LZW coded, timed; the last frame may have fewer rows); ``decode`` reads any GIF: LZW code streams, global and local
palettes, interlacing, transparency and the disposal rules.  ``features`` adds the timed frames of each file, with
a colour histogram for each channel of the canvas as shown, and ``frames`` gives a row per frame.  Files are columns
of rows, one text at a time is in memory.

Defined cases: a null text counts as empty; an empty text is one frame of padding; equal texts give
equal files; repeated rows and null ids are kept; a null, broken or cut-off file, or one whose canvas or frame has
more pixels than the caller's ``max_pixels`` (``MAX_PIXELS`` by default, None for no bound), has null digests, no frames and a reason in ``error``; ``n_bytes`` is null where a file does not
note it; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table

QUERY = "op5_gif_media"

SIDE = 24
#: The payload is a multiple of UNIT bytes; a frame shows up to UNITS of them.
UNIT = SIDE * SIDE
UNITS = 4
PAD = b"\xff"
#: Hundredths of a second that a frame is shown.
DELAY = 4
#: Buckets of each colour channel in a histogram.
BUCKETS = 8
GREY = bytes(v for v in range(256) for _ in range(3))
#: The largest canvas or frame that is decoded unless the caller sets another bound; a header may claim 2**32 pixels in a few bytes.
MAX_PIXELS = 1 << 24
#: The comment that notes a text's bytes.
NOTE = re.compile(rb"text bytes: (\d{1,18})")
#: The table of LZW codes ends at 12 bits.
LIMIT = 4096


@functools.lru_cache(maxsize=8)
def _schedule(root: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and the bits before each: a reader's table has one entry fewer than codes read."""
    size = (1 << root) + 2 + np.maximum(np.arange(LIMIT + 2) - 1, 0)
    bits = np.full(len(size), root + 1, np.int64)
    for b in range(root + 1, 12):
        bits[size >= 1 << b] = b + 1
    return bits, np.cumsum(bits) - bits


def lzw_encode(samples: bytes, root: int = 8) -> bytes:
    """LZW code stream of samples below 2**root (little-endian bits, clear code first)."""
    clear = 1 << root
    codes, widths = [], [np.array([root + 1])]
    schedule = _schedule(root)[0]
    # codes are kept eight bits up, so that a sample joins them as it is
    known: dict[int, int] = {}
    add, get, following, limit = codes.append, known.get, clear + 2 << 8, LIMIT << 8
    add(clear << 8)
    it = iter(samples)
    prefix = next(it, None)
    if prefix is not None:
        prefix <<= 8
    for c in it:
        key = prefix | c
        n = get(key)
        if n:
            prefix = n
            continue
        add(prefix)
        known[key] = following
        following += 256
        prefix = c << 8
        if following == limit:
            add(clear << 8)
            run = LIMIT - clear - 2
            widths.append(schedule[: run + 1])
            following = clear + 2 << 8
            known.clear()
    run = (following >> 8) - clear - 2
    if prefix is not None:
        add(prefix)
        run += 1
    add(clear + 1 << 8)
    widths.append(schedule[: run + 1])
    bits = np.concatenate(widths)
    at = np.cumsum(bits) - bits
    value = (np.array(codes, np.int64) >> 8) << (at & 7)
    first, size = at >> 3, int(at[-1] + bits[-1] + 7) >> 3
    out = sum(np.bincount(first + k, (value >> 8 * k) & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, root: int, expected: int) -> bytes:
    """Samples of a code stream; a stream that ends early leaves the rest out."""
    clear, end = 1 << root, (1 << root) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at = len(data) * 8, 0
    out = bytearray()
    while at < total and len(out) < expected:
        # codes of one run between clear codes: their widths follow from their number alone
        n = min((total - at) // (root + 1) + 1, LIMIT + 1, expected - len(out) + 2)
        bits, before = _schedule(root)
        n = min(n, int(np.searchsorted(before + bits, total - at, side="right")))
        if not n:
            break
        bits, pos = bits[:n], at + before[:n]
        codes = (wide[pos >> 3] >> (pos & 7)) & ((1 << bits) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        last = int(stop[0]) if len(stop) else len(codes)
        _expand(codes[:last].tolist(), clear, out)
        if not len(stop) or codes[last] == end:
            break
        at = int(pos[last] + bits[last])
    return bytes(out[:expected])


@functools.lru_cache(maxsize=8)
def _singles(clear: int) -> tuple[bytes, ...]:
    """Strings of the codes that a table begins with; clear and end codes stand for nothing."""
    return (*(bytes([k]) for k in range(clear)), b"", b"")


def _expand(codes: list[int], clear: int, out: bytearray) -> None:
    """Append the strings of the codes between two clear codes."""
    if not codes:
        return
    if codes[0] >= clear:
        raise ValueError("code beyond the table")
    table = [*_singles(clear)]
    add, last = table.append, table[codes[0]]
    parts = [last]
    say = parts.append
    for c in codes[1:]:
        try:
            entry = table[c]
        except IndexError:  # the string that this very code completes
            if c != len(table):
                raise ValueError("code beyond the table") from None
            entry = last + last[:1]
        add(last + entry[:1])
        say(entry)
        last = entry
    out += b"".join(parts)


@dataclass
class Frame:
    rgb: np.ndarray  # height x width x 3, the canvas as shown
    delay: int  # hundredths of a second
    box: tuple[int, int, int, int]  # left, top, width and height of what the frame drew


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def encode(payload: bytes, comment: bytes = b"") -> bytes:
    """GIF89a whose frames are up to UNITS units each under a grey palette."""
    frame = UNIT * min(UNITS, len(payload) // UNIT)
    out = [b"GIF89a", struct.pack("<HHBBB", SIDE, frame // SIDE, 0xF7, 0, 0), GREY]
    if comment:
        out.append(b"\x21\xfe" + bytes([len(comment)]) + comment + b"\0")
    for at in range(0, len(payload), frame):
        samples = payload[at : at + frame]
        stream = lzw_encode(samples)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, len(samples) // SIDE, 0) + b"\x08")
        out.extend(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255))
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def decode(data: bytes, max_pixels: int | None = MAX_PIXELS) -> tuple[Iterator[Frame], bytes]:
    """Frames of a GIF as shown, one at a time, and the comments before them.  A broken file raises ``ValueError``,
    an ``IndexError`` or a ``struct.error``."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if max_pixels is not None and width * height > max_pixels:
        raise ValueError("canvas too large")
    palette, at = _palette(data, 13, packed)
    comment, k = b"", at
    while data[k : k + 1] == b"\x21" and data[k + 1] == 0xFE:
        more, k = _blocks(data, k + 2)
        comment += more
    return _frames(data, at, width, height, palette, background, max_pixels), comment


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray | None, int]:
    """The colour table that the packed field announces, if any, and what follows."""
    if not packed & 0x80:
        return None, at
    n = 2 << (packed & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _frames(data: bytes, at: int, width: int, height: int, palette: np.ndarray | None, background: int, max_pixels: int | None) -> Iterator[Frame]:
    ground = palette[background] if palette is not None and background < len(palette) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(ground, (height, width, 3)).copy()
    delay, disposal, transparent = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = _blocks(data, at + 2)
            if kind == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", block)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, packed)
        colours = palette if own is None else own
        if colours is None:
            raise ValueError("no palette")
        root = data[at]
        if not 1 <= root <= 8:
            raise ValueError("bad code size")
        if max_pixels is not None and w * h > max_pixels:
            raise ValueError("frame too large")
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, root, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if packed & 0x40:  # interlaced: rows come in four passes
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            rows = np.empty_like(index)
            rows[order] = index
            index = rows
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        index = index[: area.shape[0], : area.shape[1]]
        shown = colours[np.minimum(index, len(colours) - 1)]
        if transparent < 0:
            area[:] = shown
        else:
            np.copyto(area, shown, where=(index != transparent)[..., None])
        yield Frame(canvas.copy(), delay, (left, top, w, h))
        if disposal == 2:
            area[:] = ground
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes padded to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw.ljust(size, PAD), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: the GIF of each text, which notes the text's length in a comment."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                media = []
                for text in part["text"].to_pylist():
                    payload, n = payload_of(text)
                    media.append(encode(payload, b"text bytes: %d" % n))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 100), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_type(docs, 'doc_id')}, media binary")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: A timed frame: its place in the animation, what it drew, and its canvas' histograms.
FRAME = ("number", "start", "delay", "left", "top", "width", "height", "red", "green", "blue")
_HISTOGRAM = pa.list_(pa.int64())
_FRAME = pa.struct([(c, _HISTOGRAM if c in FRAME[-3:] else pa.int64()) for c in FRAME])
_DESCRIBED = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.list_(_FRAME), "error": pa.string()}
_FRAME_DDL = "array<struct<" + ", ".join(f"{c}: {'array<long>' if c in FRAME[-3:] else 'long'}" for c in FRAME) + ">>"


def _histograms(rgb: np.ndarray) -> list[list[int]]:
    """Pixels by bucket for each channel, from one count of the pixels' three buckets together."""
    red, green, blue = (rgb[..., k].astype(np.intp) >> 5 for k in range(3))
    count = np.bincount((red << 6 | green << 3 | blue).ravel(), minlength=BUCKETS**3).reshape((BUCKETS,) * 3)
    return [count.sum(axis).tolist() for axis in ((1, 2), (0, 2), (0, 1))]


def describe(data: bytes | None, max_pixels: int | None = MAX_PIXELS) -> dict:
    """What a file tells when it is read: payload, digests and timed frames, or why it can't be read."""
    if data is None:
        return {"error": "no media"}
    try:
        shown, comment = decode(data, max_pixels)
        payload, frames, start = [], [], 0
        for frame in shown:
            left, top, w, h = frame.box
            payload.append(frame.rgb[top : top + h, left : left + w, 0].tobytes())
            histograms = _histograms(frame.rgb)
            frames.append(dict(zip(FRAME, (len(frames), start, frame.delay, left, top, w, h, *histograms), strict=True)))
            start += frame.delay
    except (ValueError, IndexError, struct.error) as e:
        return {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "error": str(e) if type(e) is ValueError else "cut off"}
    whole, noted = b"".join(payload), NOTE.fullmatch(comment)
    return {
        "n_bytes": int(noted[1]) if noted else None,
        "payload_bytes": len(whole),
        "payload_sha256": hashlib.sha256(whole).hexdigest(),
        "tail_crc32": zlib.crc32(whole[-32:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "frames": frames,
    }


def features(media: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """Read stored files (``doc_id``, ``media``): lengths, digests, ``frames`` (an array of timed frames) and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(m, max_pixels) for m in batch["media"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r.get(c) for r in rows], t) for c, t in _DESCRIBED.items())], names=["doc_id", *_DESCRIBED])

    kinds = ", ".join(f"{c} {_FRAME_DDL if c == 'frames' else 'string' if t == pa.string() else 'long'}" for c, t in _DESCRIBED.items())
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {_type(media, 'doc_id')}, {kinds}")


def frames(media: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """A row per frame of each file: ``doc_id``, its number, start and delay in hundredths of a second, the box it drew, and
    the histogram columns ``red``, ``green`` and ``blue`` of the canvas as shown."""
    return features(media, max_pixels).select("doc_id", F.inline("frames"))


def feature_string(frames: Column) -> Column:
    """Number of frames, duration, and the histograms of all frames together."""

    def total(channel: str) -> Column:
        none = F.array_repeat(F.lit(0).cast("long"), BUCKETS)
        return F.array_join(F.aggregate(frames, none, lambda sums, f: F.zip_with(sums, f[channel], lambda x, y: x + y)), "-")

    duration = F.aggregate(frames, F.lit(0).cast("long"), lambda n, f: n + f["delay"])
    return F.concat(F.lit("frames="), F.size(frames), F.lit(";duration="), duration, *[x for c in FRAME[-3:] for x in (F.lit(f";{c[0]}="), total(c))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(store(table(spark, sf_dir, "documents")))
    return found.withColumn("feature", feature_string(F.col("frames"))).drop("frames", "error")
