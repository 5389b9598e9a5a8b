"""Media columns: texts as the samples of GIF animations, stored, read back by decoding, with timed frames and colours.

Every text becomes its UTF-8 bytes, padded with spaces to a positive multiple of 192, in frames 192 samples wide. What is
read back are the samples as the frames show them: LZW strings, palettes, disposal and transparency all have their part.
One row in, one row out, no shuffle; memory is bounded by one batch of texts.

Defined cases: a null text counts as empty (one row of spaces); a very long text is an animation of many frames; equal
texts give equal media; there are no ties; repeated rows are kept; null ids stay null; an empty table gives none; columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gif
from .common import texts

UNIT = 192
TAIL = 16
BINS = 8
DELAY = 10
_MEDIA = "doc_id long, n_bytes long, media binary"
_FRAME = "starts_cs:long,ends_cs:long,left:int,top:int,width:int,height:int,histogram:array<long>"
_READ = f"doc_id long, n_bytes long, payload binary, frames array<struct<{_FRAME}>>, histogram array<long>, media binary"
#: Rows read back are given on once they hold so many bytes.
GIVEN = 1 << 24
_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs long"


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _write(text: bytes) -> bytes:
    return gif.encode(np.frombuffer(padded(text), dtype=np.uint8), UNIT, delay=DELAY)


def _histogram(palette: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BINS counts each of red, green and blue."""
    out = np.zeros(3 * BINS, dtype=np.int64)
    for c in range(3):
        np.add.at(out[c * BINS : (c + 1) * BINS], palette[:, c] // (256 // BINS), counts)
    return out


def _colours(found: gif.Gif, areas: list[tuple[np.ndarray, np.ndarray | None]]) -> list[np.ndarray]:
    """The colours of each frame's area as it is shown.

    Where a frame is transparent, what disposal left beneath it is counted, and nothing where that is empty too; what
    lies outside the canvas isn't shown. Frames of one palette are counted by index, without a canvas of colours.
    """
    if all(f.palette is found.frames[0].palette for f in found.frames):
        counts = [np.bincount((a if seen is None else a[seen]).reshape(-1), minlength=256) for a, seen in areas]
        return [_histogram(f.palette, n[: len(f.palette)]) for f, n in zip(found.frames, counts)]
    out = []
    for f, canvas in zip(found.frames, gif.shown(found)):
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width].reshape(-1, 4)
        seen = area[area[:, 3] > 0]
        out.append(_histogram(seen, np.ones(len(seen), dtype=np.int64)))
    return out


def _read(media: bytes) -> tuple[bytes, list[tuple], np.ndarray]:
    """The samples as shown, the timed frames and the colour histogram of all, all from the decoded stream."""
    found = gif.decode(media)
    areas = list(gif.samples(found))
    colours, frames, now = _colours(found, areas), [], 0
    for f, histogram in zip(found.frames, colours):
        frames.append((now, now + f.delay, f.left, f.top, f.width, f.height, histogram.tolist()))
        now += f.delay
    return b"".join([a.tobytes() for a, _ in areas]), frames, sum(colours, np.zeros(3 * BINS, dtype=np.int64))


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = [t or b"" for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in column], pa.int64()), pa.array([_write(t) for t in column], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _MEDIA)


_READ_TYPES = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()),
        ("frames", pa.list_(pa.struct([*((n, pa.int64()) for n in ("starts_cs", "ends_cs")), *((n, pa.int32()) for n in ("left", "top", "width", "height")), ("histogram", pa.list_(pa.int64()))]))),
        ("histogram", pa.list_(pa.int64())), ("media", pa.binary()),
    ]
)


def media_columns(media: DataFrame) -> DataFrame:
    """Decode stored media: the samples, timed frames with their colours, and the colours of all (red, green, blue bins)."""
    names = [f.name for f in _READ_TYPES.field("frames").type.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=_READ_TYPES)
            out.clear()
            return made

        for batch in batches:
            for doc_id, n_bytes, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                payload, frames, colours = _read(data)
                out.append({"doc_id": doc_id, "n_bytes": n_bytes, "payload": payload, "frames": [dict(zip(names, f)) for f in frames], "histogram": colours.tolist(), "media": data})
                size += len(payload) + len(data)
                if size > GIVEN:
                    yield given()
                    size = 0
        yield given()

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def digests(media: DataFrame) -> DataFrame:
    """Digests of what reading the stored media back gives; the samples themselves stay on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                payload, frames, colours = _read(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), ":".join(map(str, colours.tolist())), len(frames), frames[-1][1]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            names = [x.split()[0] for x in _DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGESTS)
