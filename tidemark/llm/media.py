"""Media columns: texts stored as GIF, GIFs read into timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
ROWS = 1024
DELAY_MS = 40
BINS = 64
_FULL = 4096
_BITS = np.arange(12, dtype=np.int32)


def palette() -> bytes:
    """256 colours: three bits of red and green each, two of blue."""
    return bytes(v for i in range(256) for v in (i & 0xE0, (i & 0x1C) << 3, (i & 0x03) << 6))


# -- LZW ----------------------------------------------------------------------------------------


@cache
def _first_widths(first_free: int) -> np.ndarray:
    return np.array([min(12, max(first_free - 2, first_free - 1 + i).bit_length()) for i in range(_FULL)], np.int32)


def _widths(first_free: int, count: int, start: int = 0) -> np.ndarray:
    """Bits of the codes after a clear code, from number ``start`` on: one more each time the table has outgrown them, 12 at most."""
    known = _first_widths(first_free)[start : start + count]
    return known if len(known) == count else np.concatenate((known, np.full(count - len(known), 12, np.int32)))


def lzw_codes(data: bytes, size: int = 8) -> tuple[np.ndarray, list[int]]:
    """The codes of a stream, and where a clear code stands in it."""
    clear = 1 << size
    free, table, clears = clear + 2, {}, [0]
    # Codes are kept shifted by a byte, as a longer string is looked up by its beginning's code and one more value.
    codes = [clear << 8]
    get, emit = table.get, codes.append
    values = iter(data)
    begun = next(values, -1) << 8
    for value in values:
        known = get(begun | value)
        if known is not None:
            begun = known
            continue
        emit(begun)
        if free < _FULL:
            table[begun | value] = free << 8
            free += 1
        else:
            clears.append(len(codes))
            emit(clear << 8)
            table.clear()
            free = clear + 2
        begun = value << 8
    if begun >= 0:
        emit(begun)
    emit(clear + 1 << 8)
    return np.array(codes, np.int32) >> 8, clears


def lzw_pack(codes: np.ndarray, clears: list[int], size: int = 8) -> bytes:
    """Codes as bits, lowest first."""
    width = np.empty(len(codes), np.int64)
    width[0] = size + 1
    for start, stop in zip(clears, [*clears[1:], len(codes) - 1], strict=True):
        width[start + 1 : stop + 1] = _widths((1 << size) + 2, stop - start)
    bits = (codes[:, None] >> _BITS & 1).astype(np.uint8)[width[:, None] > _BITS]
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """The values of a code stream, ``most`` of them at most; a broken code raises ValueError."""
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    # A code lies within the three bytes from the one it begins in.
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, clear = len(stream) * 8, 1 << size
    out: list[bytes] = []
    held: list[np.ndarray] = []
    made, at, seen = 0, 0, 0
    while made < most and at < total:
        width = _widths(clear + 2, _FULL, seen)
        place = at + np.cumsum(width) - width
        place = place[: int(np.searchsorted(place + width, total, "right"))]
        if not len(place):
            break
        codes = three[place >> 3] >> (place & 7) & (1 << width[: len(place)]) - 1
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(marks[0]) if len(marks) else len(codes)
        held.append(codes[:stop])
        if not len(marks):
            # A stream may go on without a clear code when the table is full: its codes still mean the same strings.
            at, seen = int(place[-1] + width[len(place) - 1]), seen + len(codes)
            continue
        out.append(_strings(np.concatenate(held), clear))
        made, held = made + len(out[-1]), []
        if codes[stop] == clear + 1:
            break
        at, seen = int(place[stop] + width[stop]), 0
    if held:
        out.append(_strings(np.concatenate(held), clear))
    return b"".join(out)[:most]


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """What the codes after a clear code stand for.

    The string that the n-th code adds to the table is its own string and the value after it: it already stands in the output, at
    the place of the n-th code and one longer. So a code of the table copies from there, and what it copies may be a
    copy again: sources are followed in doubling steps until all are plain values.
    """
    n = len(codes)
    if not n:
        return b""
    number = np.arange(n, dtype=np.int32)
    copies = codes >= clear + 2
    source = np.where(copies, codes - clear - 2, number).astype(np.int32)
    if (source[copies] >= number[copies]).any():
        raise ValueError("a code of a stream is not in its table")
    longer, root = copies.astype(np.int32), source
    while (further := root[root]).tobytes() != root.tobytes():
        longer, root = longer + longer[root], further
    length = longer + 1
    place = (np.cumsum(length) - length).astype(np.int32)
    code_of = np.repeat(number, length)
    here = np.arange(len(code_of), dtype=np.int32)
    from_ = np.where(copies[code_of], place[source[code_of]] + here - place[code_of], here)
    while (further := from_[from_]).tobytes() != from_.tobytes():
        from_ = further
    return codes[code_of[from_]].astype(np.uint8).tobytes()


# -- GIF ----------------------------------------------------------------------------------------


def _blocks(data: bytes) -> Iterator[bytes]:
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        yield bytes([len(part)]) + part
    yield b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A payload of whole rows as an animated GIF: a byte a pixel, ``rows`` rows a frame."""
    if not payload or len(payload) % width:
        raise ValueError(f"a payload of whole rows of {width} is needed")
    frames = [payload[i : i + width * rows] for i in range(0, len(payload), width * rows)]
    parts = [b"GIF89a", struct.pack("<HHBBB", width, len(frames[0]) // width, 0xF7, 0, 0), palette()]
    for pixels in frames:
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0))
        parts.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(pixels) // width, 0, 8))
        parts.extend(_blocks(lzw_pack(*lzw_codes(pixels))))
    return b"".join([*parts, b"\x3b"])


def _colours(data: bytes) -> np.ndarray:
    table = np.full((256, 4), (0, 0, 0, 255), np.uint8)
    table[: len(data) // 3, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return table


def _rows_of_passes(height: int) -> np.ndarray:
    """Interlaced images: where the stored rows belong."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(data: bytes) -> Iterator[dict]:
    """Every frame of a GIF in turn: its own pixels, and the picture they make with what earlier frames left.

    Local palettes come before the global one; transparent pixels leave what is below. After a frame is shown,
    disposal 2 clears its rectangle and 3 brings back what was there before. Data that is no GIF, or that breaks off, raises ValueError.
    """
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as error:
        raise ValueError(f"the file breaks off: {error}") from error


def _frames(data: bytes) -> Iterator[dict]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    at = 13
    shared = None
    if packed & 0x80:
        shared = _colours(data[at : at + (6 << (packed & 7))])
        at += 6 << (packed & 7)
    canvas = np.zeros((height, width, 4), np.uint8)
    number, disposal, delay, clear_index = 0, 0, 0, None

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += size + 1
        return b"".join(parts), at + 1

    while (mark := data[at]) != 0x3B:
        if mark == 0x21:
            kind = data[at + 1]
            content, at = joined(at + 2)
            if kind == 0xF9:
                flags, hundredths, index = struct.unpack_from("<BHB", content)
                disposal, delay, clear_index = flags >> 2 & 7, hundredths * 10, index if flags & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block {mark}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if packed & 0x80:
            colours = _colours(data[at : at + (6 << (packed & 7))])
            at += 6 << (packed & 7)
        if colours is None:
            raise ValueError("a frame has no palette")
        size = data[at]
        stream, at = joined(at + 1)
        if not 2 <= size <= 8:
            raise ValueError(f"a code size of {size}")
        decoded = lzw_decode(stream, size, w * h)
        if len(decoded) < w * h:
            raise ValueError(f"a frame of {w * h} pixels ends after {len(decoded)}")
        pixels = np.frombuffer(decoded, np.uint8).reshape(h, w)
        if packed & 0x40:
            straight = np.empty_like(pixels)
            straight[_rows_of_passes(h)] = pixels
            pixels = straight
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        inside = pixels[: part.shape[0], : part.shape[1]]
        if clear_index is None:
            part[: inside.shape[0], : inside.shape[1]] = colours[inside]
        else:
            paint = inside != clear_index
            part[paint] = colours[inside[paint]]
        yield {"frame": number, "delay_ms": delay, "width": w, "height": h, "pixels": pixels.tobytes(), "picture": canvas, "screen": (width, height)}
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        number, disposal, delay, clear_index = number + 1, 0, 0, None


def histogram(picture: np.ndarray) -> np.ndarray:
    """Visible pixels by colour: two bits each of red, green and blue."""
    top = picture[..., :3] >> 6
    bins = (top[..., 0] << 4 | top[..., 1] << 2 | top[..., 2])[picture[..., 3] > 0]
    return np.bincount(bins, minlength=BINS)


def padded(text: str | None) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of the width; NULL is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


# -- columns ------------------------------------------------------------------------------------


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """The rows with their text as a GIF. NULL counts as empty, which is one row of 64 zeros. ``out`` replaces a column of that name."""

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(padded(t)) for t in texts], dtype=object)

    return df.withColumn(out, media(F.col(text)))


FRAME = "struct<frame: int, delay_ms: int, width: int, height: int, rgba: binary, histogram: array<bigint>>"


def with_frames(df: DataFrame, media: str = "media", out: str = "frames") -> DataFrame:
    """The rows with an array of timed frames: the picture as shown (RGBA, the size of the screen) and its histogram.

    NULL media give NULL; so does what is no GIF or breaks off: no row is lost.
    """

    @F.pandas_udf(f"array<{FRAME}>")
    def read(values: pd.Series) -> pd.Series:
        return pd.Series([_timed(v) for v in values], dtype=object)

    return df.withColumn(out, read(F.col(media)))


def _timed(data: bytes | None) -> list[dict] | None:
    if data is None:
        return None
    try:
        return [
            {k: f[k] for k in ("frame", "delay_ms", "width", "height")} | {"rgba": f["picture"].tobytes(), "histogram": histogram(f["picture"]).tolist()}
            for f in frames(data)
        ]
    except ValueError:
        return None


DIGEST = "struct<payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, frames: bigint, millis: bigint, histogram: array<bigint>>"


def with_digest(df: DataFrame, media: str = "media", out: str = "digest", tail: int = 64) -> DataFrame:
    """The rows with what the frames of stored media hold, frame by frame: the pixels' length, SHA-256 and the CRC of

    the last of them, and the histograms' sum. NULL, no GIF, broken: NULL.
    """

    @F.pandas_udf(DIGEST)
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(v, tail) for v in values], columns=["payload_bytes", "payload_sha256", "tail_crc32", "frames", "millis", "histogram"])

    return df.withColumn(out, read(F.col(media)))


def _digest(data: bytes | None, tail: int) -> tuple:
    size, count, millis, last, sha, bins = 0, 0, 0, b"", hashlib.sha256(), np.zeros(BINS, np.int64)
    try:
        for f in frames(data or b""):
            size, count, millis = size + len(f["pixels"]), count + 1, millis + f["delay_ms"]
            last = (last + f["pixels"])[-tail:] if len(f["pixels"]) < tail else f["pixels"][-tail:]
            sha.update(f["pixels"])
            # A frame smaller than the screen leaves the rest of the last picture standing: only its own rows count here.
            bins += histogram(f["picture"][: f["height"], : f["width"]])
    except ValueError:
        return None, None, None, None, None, None
    return size, sha.hexdigest(), zlib.crc32(last), count, millis, bins.tolist()
