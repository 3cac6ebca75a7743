"""Media columns of GIF: decoding to timed frames with colour histograms, and a lossless store of bytes.

The decoder reads global and local palettes, LZW code streams, interlacing, delays, transparency and
the disposal rules. Code streams are read in vectors: between two clear codes the widths follow from
the places, each code beyond the table's start stands for what an earlier code gave and one sample
more, so lengths and samples follow from chains of places, resolved by doubling. The encoder grows
its table to twelve bits and clears it when it is full.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a line, and the unit that payloads are padded to.
WIDTH = 576
FRAME_LINES = 64
DELAY_CS = 4
PAD = 255
#: Bins of each colour channel.
BINS = 8
MOST_CODES = 4096
_STEPS = np.arange(256, dtype=np.uint16)
#: The palette of stored bytes: red is the byte itself, green and blue spread it over the other channels.
PALETTE = np.stack([_STEPS, 255 - _STEPS, _STEPS * 97 % 256], axis=1).astype(np.uint8)


@dataclass
class Frame:
    """One image as stored, and the canvas as shown once it is drawn."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray
    shown: np.ndarray


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with bytes 255 up to a positive multiple of the width; null text is empty."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


@cache
def _places(bits: int, n: int = 2 * MOST_CODES) -> tuple[np.ndarray, np.ndarray]:
    """(bit offsets from a clear code on, widths) of the n codes that follow it; a full table lasts until it is cleared."""
    size = np.minimum((1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0), MOST_CODES)  # of the table as each code is read
    width = np.clip(np.ceil(np.log2(size + 1)).astype(np.int64), bits + 1, 12)
    return np.append(0, np.cumsum(width)), width


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of given widths, least bit first."""
    at = np.append(0, np.cumsum(widths))
    x = codes.astype(np.int64) << (at[:-1] & 7)
    where, size = at[:-1] >> 3, int(at[-1] + 7) >> 3
    out = np.zeros(size + 3)
    for k in range(3):
        out[: size + 3] += np.bincount(where + k, weights=(x >> 8 * k) & 255, minlength=size + 3)[: size + 3]
    return out[:size].astype(np.uint8).tobytes()


def lzw(samples: bytes) -> bytes:
    """The code stream of 8-bit samples: the table grows to 4096 entries, then a clear code begins a new one."""
    clear, stop = 256, 257
    codes, ends = [clear], []
    table: dict[int, int] = {}
    after, held = stop + 1, samples[0] if samples else stop
    put = codes.append
    for sample in samples[1:]:
        key = held << 8 | sample
        if key in table:
            held = table[key]
            continue
        put(held)
        if after < MOST_CODES:
            table[key] = after
            after += 1
        else:
            put(clear)
            ends.append(len(codes))
            table.clear()
            after = stop + 1
        held = sample
    put(held)
    if held != stop:
        put(stop)
    bounds = [1, *ends, len(codes)]
    width = _places(8)[1]
    widths = np.concatenate([[9], *[width[: b - a] for a, b in zip(bounds, bounds[1:], strict=False)]])
    return _pack(np.array(codes), widths)


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    head = np.empty((whole, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose samples, in order, are the payload; its length is a multiple of the width."""
    lines = len(payload) // WIDTH
    if len(payload) != lines * WIDTH or not lines:
        raise ValueError("the payload is no positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(lines, FRAME_LINES), 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, lines, FRAME_LINES):
        part = payload[at * WIDTH : (at + FRAME_LINES) * WIDTH]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out.append(_blocks(lzw(part)))
    return b"".join([*out, b"\x3b"])


def _run(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes between two clear codes. A code may refer to those before it alone."""
    n, base = len(codes), (1 << bits) + 2
    places = np.arange(n)
    deep = codes >= base
    if ((codes - base >= places) & deep).any() or ((codes >= base - 2) & ~deep).any():
        raise ValueError("a code is beyond the table")
    # code k >= base is what the code at place k - base gave, and the first sample of the one after it
    jump, length = np.where(deep, codes - base, places), deep.astype(np.int64)
    while True:
        then = jump[jump]
        if (then == jump).all():
            break
        length, jump = length + length[jump], then
    length += 1
    start = np.append(0, np.cumsum(length))
    total = int(start[-1])
    # a sample of such a code lies as far behind as the two places' outputs are apart
    back = np.where(deep, start[:-1] - start[np.where(deep, codes - base, 0)], 0)
    source = np.arange(total) - np.repeat(back, length)
    while True:
        then = source[source]
        if (then == source).all():
            break
        source = then
    value = np.zeros(total, np.uint8)
    value[start[:-1][~deep]] = codes[~deep]
    return value[source]


def unpack_codes(data: bytes, bits: int, most: int) -> np.ndarray:
    """Samples of an LZW code stream with codes of bits + 1 bits at first; no more than `most`."""
    clear, at, got, have = 1 << bits, 0, [], 0
    size = len(data) * 8
    offsets, widths = _places(bits)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    while at < size and have < most:
        n = int(np.searchsorted(offsets, size - at, "right")) - 1
        places, wide = at + offsets[:n], widths[:n]
        where = places >> 3
        codes = (raw[where] | raw[where + 1] << 8 | raw[where + 2] << 16) >> (places & 7) & ((1 << wide) - 1)
        ends = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(ends) and n == len(widths):  # a table that lasts for longer than most
            offsets, widths = _places(bits, 2 * n)
            continue
        last = int(ends[0]) if len(ends) else n
        if last:
            if codes[0] > clear:
                raise ValueError("a code stream begins with a code that is not in its table")
            got.append(_run(codes[:last], bits))
            have += len(got[-1])
        if not len(ends) or codes[last] == clear + 1:
            break
        at += int(offsets[last + 1])
    return np.concatenate(got)[:most] if got else np.empty(0, np.uint8)


def _lines(height: int, interlaced: bool) -> list[int]:
    return [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)] if interlaced else [*range(height)]


def decode(data: bytes) -> Iterator[Frame]:
    """The frames in order. A stream that ends early leaves its missing samples at 0; other damage raises ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3

    def body(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        common, at = colours(at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            if label == 0xF9:
                bits, cs, index = struct.unpack_from("<BHB", data, at + 3)
                delay, disposal, clear = cs * 10, bits >> 2 & 7, index if bits & 1 else None
            _, at = body(at + 2)
            continue
        if kind != 0x2C:
            raise ValueError(f"an unknown block {kind:#x}")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, common
        if bits & 0x80:
            palette, at = colours(at, bits)
        size = data[at]
        if not 1 <= size <= 8:
            raise ValueError("a code size out of range")
        stream, at = body(at + 1)
        got = unpack_codes(stream, size, w * h)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(got)] = got
        samples = samples.reshape(h, w)
        if bits & 0x40:
            straight = np.empty_like(samples)
            straight[_lines(h, True)] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        rgb = palette[np.minimum(seen, len(palette) - 1)]
        drawn = np.ones(seen.shape, bool) if clear is None else seen != clear
        if drawn.all():
            area[..., :3], area[..., 3] = rgb, 255
        else:
            area[drawn] = np.concatenate([rgb[drawn], np.full((int(drawn.sum()), 1), 255, np.uint8)], axis=1)
        yield Frame(left, top, samples, palette, delay, disposal, clear, canvas.copy(), area.copy())
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[int]:
    """Visible pixels by red, then by green, then by blue, each in equal bins."""
    flat = pixels.reshape(-1, 4)
    seen = flat if not len(flat) or flat[:, 3].all() else flat[flat[:, 3] > 0]
    return [int(x) for k in range(3) for x in np.bincount(seen[:, k] // (256 // bins), minlength=bins)]


def histogram_of(frame: Frame, bins: int = BINS) -> list[int]:
    """The same for the area a frame draws, from the counts of its samples where no pixel is see-through."""
    if frame.transparent is not None:
        return histogram(frame.shown, bins)
    n = len(frame.palette)
    counts = np.bincount(np.minimum(frame.samples.ravel(), n - 1), minlength=n)
    return [int(x) for k in range(3) for x in np.bincount(frame.palette[:, k] // (256 // bins), weights=counts, minlength=bins)]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each text; null and empty texts give one line of padding."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                sizes.append(len(raw.encode()))
                media.append(encode(payload_of(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_bytes long, media binary")


FRAMES = "doc_id long, frame int, delay_ms int, disposal int, left int, top int, width int, height int, samples binary, histogram array<long>"


def frames(media: DataFrame) -> DataFrame:
    """The timed frames of (doc_id, media), with their histograms. Null media and damaged GIFs have no frames."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for k, f in enumerate(decode(blob.as_py() or b"")):
                        rows.append((doc, k, f.delay_ms, f.disposal, f.left, f.top, f.samples.shape[1], f.samples.shape[0], f.samples.tobytes(), histogram(f.canvas)))
                except ValueError:
                    rows = []
                if rows:
                    names = [x.split()[0] for x in FRAMES.split(", ")]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({c: "int32" for c in names[1:8]}), preserve_index=False)

    return media.select("doc_id", "media").mapInArrow(of, FRAMES)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Reads stored media back: digests of the samples through their palettes, and a feature of the frames.

    A sample's byte is the red of its colour. The feature has the frames, their time and colour histogram.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_py()
                hashed, size, tail, count, ms, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(3 * BINS, np.int64)
                for f in decode(blob):
                    part = np.ascontiguousarray(f.palette[f.samples.ravel(), 0]).tobytes()
                    hashed.update(part)
                    size, tail, count, ms = size + len(part), (tail + part)[-32:], count + 1, ms + f.delay_ms
                    bins += histogram_of(f)
                feature = json.dumps({"frames": count, "ms": ms, "histogram": bins.tolist()}, separators=(",", ":"))
                out.append((doc, n, size, hashed.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(of, DIGESTS)
