"""GIF89a: write 8-bit samples as timed frames, and decode any GIF: LZW code streams, palettes, disposal, transparency.

The writer's code streams are LZW with a table that grows to 4096 entries and is cleared when it is full. A frame after
the first leaves out what the canvas shows already: such samples are transparent, under an index that the frame doesn't
use otherwise, and the frames before stay (disposal 1). The decoder follows the format in general. Codes are put into
bits, and taken out of them, as arrays: their widths depend on their place behind the last clear code alone.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Entries of a full table.
MOST = 4096
WIDTH, ROWS = 192, 256
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_HEADER = struct.Struct("<6sHHBBB")


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame] = field(default_factory=list)


# ---------------------------------------------------------------- codes and bits
@functools.cache
def widths(least: int, n: int) -> np.ndarray:
    """Bits of the first ``n`` codes behind a clear code: each one after the first adds an entry, up to ``MOST``."""
    entries = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), least + 1, 12)


def _packed(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of so many bits each, lowest bit first."""
    ends = np.cumsum(bits)
    at = ends - bits
    value = codes.astype(np.int64) << (at & 7)  # 19 bits at most: three bytes
    first = at >> 3
    where = np.concatenate([first, first + 1, first + 2])
    parts = np.concatenate([value & 255, (value >> 8) & 255, value >> 16])
    return np.bincount(where, weights=parts, minlength=0)[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


def _unpacked(raw: np.ndarray, at: int, least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``n`` codes from the bit ``at`` on, behind a clear code, and where each ends. ``raw`` has three bytes to spare."""
    bits = widths(least, n)
    ends = at + np.cumsum(bits)
    bits = bits[: int(np.searchsorted(ends, 8 * (len(raw) - 3), "right"))]
    ends = ends[: len(bits)]
    start = ends - bits
    first = start >> 3
    value = raw[first].astype(np.int64) | raw[first + 1].astype(np.int64) << 8 | raw[first + 2].astype(np.int64) << 16
    return (value >> (start & 7)) & ((1 << bits) - 1), ends


# ---------------------------------------------------------------- writing
def lzw_codes(samples: bytes) -> list[int]:
    """The codes of 8-bit samples (one or more): clear, the longest strings that the table knows, clear, ..., end."""
    clear, free = 256, 258
    table: dict[int, int] = {}
    known, out = table.get, [clear]
    put = out.append
    rest = iter(samples)
    now = next(rest)
    for sample in rest:
        code = known(now << 8 | sample)
        if code is not None:
            now = code
            continue
        put(now)
        if free < MOST:
            table[now << 8 | sample] = free
            free += 1
        else:
            put(clear)
            table.clear()
            free = 258
        now = sample
    put(now)
    put(clear + 1)
    return out


#: Codes from one clear code of the writer to the next: those that fill the table, one more, and the clear code.
CYCLE = MOST - 258 + 2


def lzw_stream(samples: bytes) -> bytes:
    codes = np.array(lzw_codes(samples))
    bits = widths(8, CYCLE)[(np.arange(len(codes)) - 1) % CYCLE]
    bits[0] = 9
    return _packed(codes, bits)


def sub_blocks(data: bytes) -> bytes:
    """Data in blocks of up to 255 bytes, each after its length, closed by a block of none."""
    full, rest = divmod(len(data), 255)
    grid = np.empty((full, 256), dtype=np.uint8)
    grid[:, 0] = 255
    grid[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=full * 255).reshape(full, 255)
    tail = bytes([rest]) + data[full * 255 :] if rest else b""
    return grid.tobytes() + tail + b"\0"


def encode(samples: np.ndarray, width: int = WIDTH, rows: int = ROWS, delay: int = 10) -> bytes:
    """Samples (a multiple of ``width``) as frames of up to ``rows`` rows, grey palette, each shown ``delay`` / 100 s."""
    size = width * rows
    height = min(rows, len(samples) // width)
    out = [_HEADER.pack(b"GIF89a", width, height, 0xF7, 0, 0), GREY]
    canvas = np.zeros(0, dtype=np.uint8)
    for at in range(0, len(samples), size):
        part = shown_ = samples[at : at + size]
        free = np.flatnonzero(np.bincount(part, minlength=256) == 0)
        clear = int(free[0]) if len(canvas) and len(free) else None
        if clear is not None:
            part = np.where(part == canvas[: len(part)], np.uint8(clear), part)
        canvas = np.concatenate([shown_, canvas[len(shown_) :]])
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2 | (clear is not None), delay, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(sub_blocks(lzw_stream(part.tobytes())))
    return b"".join([*out, b"\x3b"])


# ---------------------------------------------------------------- reading
def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    return np.frombuffer(data, dtype=np.uint8, count=n, offset=at).reshape(-1, 3), at + n


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at`` and the place behind them."""
    start, n = at, len(data)
    while at < n and data[at] == 255:
        at += 256
    full = (at - start) // 256
    parts = [np.frombuffer(data, dtype=np.uint8, count=full * 256, offset=start).reshape(full, 256)[:, 1:].tobytes()]
    while data[at]:  # the last ones, and writers with shorter blocks
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _strings(codes: list[int], least: int) -> list[bytes]:
    """What the codes between two clear codes stand for."""
    clear = 1 << least
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    last = table[codes[0]] if codes[0] < clear else b""
    if not last:
        raise ValueError("a run of the LZW stream begins with a code that isn't in its table")
    out, put, add, grows = [last], None, table.append, MOST - len(table) + 1
    put = out.append
    try:
        for code in codes[1:grows]:
            try:
                now = table[code]
            except IndexError:
                if code > len(table):
                    raise
                now = last + last[:1]  # the string that this very code is about to name
            put(now)
            add(last + now[:1])
            last = now
        for code in codes[grows:]:  # a full table stays until the next clear code
            put(table[code])
    except IndexError:
        raise ValueError("the LZW stream names a code that isn't in its table") from None
    return out


def lzw(data: bytes, least: int) -> np.ndarray:
    """The indices of a code stream with ``least`` bits a sample: any LZW stream of the format."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, np.uint8)])
    at, n, out = 0, MOST, []
    while True:
        codes, ends = _unpacked(raw, at, least, n)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        if not len(marks) and len(codes) == n:  # a full table, kept on
            n *= 4
            continue
        stop = int(marks[0]) if len(marks) else len(codes)
        if stop:
            out += _strings(codes[:stop].tolist(), least)
        if not len(marks) or codes[stop] == end:
            return np.frombuffer(b"".join(out), dtype=np.uint8)
        at, n = int(ends[stop]), MOST


def _rows_in_order(indices: np.ndarray) -> np.ndarray:
    """The rows of an interlaced image, which come in four passes, from top to bottom."""
    h = len(indices)
    order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
    out = np.empty_like(indices)
    out[order] = indices
    return out


def decode(data: bytes) -> Gif:
    """All frames of a GIF with their palettes, delays, disposal and transparency."""
    kind, width, height, flags, background, _ = _HEADER.unpack_from(data)
    if kind not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    palette, at = _palette(data, _HEADER.size, flags)
    gif = Gif(width, height, background, palette)
    control = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                control = (delay, (bits >> 2) & 7, index if bits & 1 else None)
            _, at = _blocks(data, at + 2)
        elif data[at] == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, bits)
            least = data[at]
            stream, at = _blocks(data, at + 1)
            indices = lzw(stream, least)[: w * h]
            if len(indices) < w * h:
                raise ValueError("an image of the GIF is cut off")
            indices = indices.reshape(h, w)
            colours = own if own is not None else palette if palette is not None else np.frombuffer(GREY, dtype=np.uint8).reshape(-1, 3)
            gif.frames.append(Frame(left, top, w, h, _rows_in_order(indices) if bits & 0x40 else indices, colours, *control))
            control = (0, 0, None)
        else:
            raise ValueError(f"byte {data[at]} begins no block of a GIF")
    return gif


def shown(gif: Gif):
    """The canvas (height, width, RGBA) as each frame is shown, after disposal of the one before."""
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for f in gif.frames:
        area = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
        before = canvas.copy() if f.disposal == 3 else None
        target = canvas[area]
        seen = f.indices[: target.shape[0], : target.shape[1]]  # what lies outside the canvas isn't shown
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        new = colours[seen]
        if f.transparent is None:
            target[:] = new
        else:
            solid = seen != f.transparent
            target[solid] = new[solid]
        yield canvas.copy()
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas = before


def samples(gif: Gif) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The indices of each frame's area as it is shown, and which of them are (None: all).

    Where a frame is transparent, what the frames before have left there counts; where they left nothing, or outside the
    canvas, the index stays as it is stored and isn't shown. Indices are of the palettes of the frames they come from.
    """
    if all(f.transparent is None and f.left + f.width <= gif.width and f.top + f.height <= gif.height for f in gif.frames):
        for f in gif.frames:  # opaque frames inside the canvas show their own
            yield f.indices, None
        return
    canvas, there = np.zeros((gif.height, gif.width), np.uint8), np.zeros((gif.height, gif.width), bool)
    for f in gif.frames:
        area = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
        before = (canvas.copy(), there.copy()) if f.disposal == 3 else None
        target, solid = canvas[area], there[area]
        inside = (slice(0, target.shape[0]), slice(0, target.shape[1]))
        own = f.indices[inside] != f.transparent if f.transparent is not None else np.ones(target.shape, bool)
        target[own] = f.indices[inside][own]
        solid[own] = True
        out, seen = f.indices.copy(), np.zeros(f.indices.shape, bool)
        out[inside] = np.where(solid, target, f.indices[inside])
        seen[inside] = solid
        yield out, seen
        if f.disposal == 2:
            there[area] = False
        elif f.disposal == 3:
            canvas, there = before
