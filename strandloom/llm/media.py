"""Media columns: texts as progressive JPEG frames, read back into coefficients, tensors and features.

A payload's bytes become coefficients, 64 to a block and six blocks to a unit of 4:2:0 sampling, so
that they survive exactly. Bytes common in text get small magnitudes, and none is under two, so
that every coefficient is already known before the last bit's scans.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import materialize, tune_batches

#: Bytes of text by falling frequency; all others follow in order. Fixed values.
COMMON = b" enthairosdluc\xc3.mgpbf,wvyz\xa9kq\n"
_RANKED = list(dict.fromkeys(COMMON)) + [b for b in range(256) if b not in COMMON]
_VALUE = np.zeros(256, np.int64)
_VALUE[_RANKED] = [(2 + i // 2) * (1 - i % 2 * 2) for i in range(256)]
_BYTE = np.zeros(512, np.uint8)
_BYTE[_VALUE + 256] = np.arange(256)
#: Payload bytes of a frame, of what is coded, and stored bytes of what is decoded side by side, at most.
FRAME, TOGETHER, READ = 384 * 1024, 768 * 1024, 1536 * 1024
UNIT, TALLEST = 384, 4095


def payload(text: bytes | None) -> bytes:
    """The bytes of a text, filled with zeros to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def _shape(n: int) -> tuple[int, int]:
    units = -(-n // UNIT)
    wide = -(-units // TALLEST)
    return -(-units // wide), wide


def encode(payloads: Sequence[bytes]) -> list[list[bytes]]:
    """Frames of each payload."""
    parts = [(i, p[a : a + FRAME]) for i, p in enumerate(payloads) for a in range(0, len(p), FRAME)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to][1]) <= TOGETHER):
            size += len(parts[to][1])
            to += 1
        shapes = [_shape(len(p)) for _, p in parts[at:to]]
        raw = b"".join(p + bytes(h * w * UNIT - len(p)) for (_, p), (h, w) in zip(parts[at:to], shapes))
        blocks = _VALUE[np.frombuffer(raw, np.uint8)].reshape(-1, 64)
        files = jpeg.encode(blocks, shapes, [struct.pack(">I", len(p)) for _, p in parts[at:to]])
        for (i, _), f in zip(parts[at:to], files):
            out[i].append(f)
        at = to
    return out


def read(frames: Sequence[bytes]) -> Iterator[tuple[bytes, np.ndarray, tuple[int, int]]]:
    """Payload, RGB tiles and units down and across of each frame."""
    at = 0
    while at < len(frames):
        to, size = at, 0
        while to < len(frames) and (to == at or size + len(frames[to]) <= READ):
            size += len(frames[to])
            to += 1
        blocks, grid, parsed = jpeg.coefficients(frames[at:to])
        raw = _BYTE[blocks + 256].tobytes()
        rgb = jpeg.tiles(blocks, parsed[0].quant)
        first = 0
        for p, units in zip(parsed, grid.units.tolist()):
            yield raw[first * UNIT : first * UNIT + struct.unpack(">I", p.comment)[0]], rgb[first : first + units], p.shape
            first += units
        at = to


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (frames) of every whole text of docs, written to the shared folder and read back.

    A null text counts as empty; other columns are ignored. Memory is bounded by the longest text.
    """
    tune_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            frames = encode([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(frames, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, media array<binary>"), "media")


_TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])


def _image(rgb: np.ndarray, shape: tuple[int, int]) -> dict:
    """The tensor of a frame's RGB tiles: row by row, three bytes a pixel."""
    h, w = shape
    return {"height": 16 * h, "width": 16 * w, "rgb": rgb.reshape(h, w, 16, 16, 3).transpose(0, 2, 1, 3, 4).tobytes()}


def features(stored: DataFrame, *, tensors: bool = False) -> DataFrame:
    """What the stored frames give: the payload's digests and, of the RGB pixels, count, means and deviations.

    With tensors, every frame's full-resolution RGB tensor too (an array, in the order of the frames).
    """
    tune_batches(stored.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    schema = schema.append(pa.field("tensors", pa.list_(_TENSOR))) if tensors else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, out, held = b.column("media").to_pylist(), [], 0
            source = read([f for m in media for f in m])
            for doc_id, n, frames in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), media):
                digest, size, tail = hashlib.sha256(), 0, b""
                pixels, total, square, images = 0, np.zeros(3, np.int64), np.zeros(3, np.int64), []
                for _ in frames:
                    data, rgb, shape = next(source)
                    if tensors:
                        images.append(_image(rgb, shape))
                    digest.update(data)
                    size, tail = size + len(data), (tail + data)[-64:]
                    flat = rgb.reshape(-1, 3)
                    pixels += len(flat)
                    total += flat.sum(0, dtype=np.int64)
                    square += np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
                mean = total / pixels
                spread = np.sqrt(np.maximum(square / pixels - mean**2, 0))
                told = f"{pixels}:" + ",".join(f"{x:.3f}" for x in (*mean, *spread))
                whole = hashlib.sha256()
                for f in frames:
                    whole.update(f)
                out.append((doc_id, n, size, digest.hexdigest(), zlib.crc32(tail), sum(map(len, frames)), whole.hexdigest(), told, images)[: len(schema)])
                held += sum(len(x["rgb"]) for x in images)
                if held >= READ:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds += ", tensors array<struct<height int, width int, rgb binary>>" if tensors else ""
    return stored.mapInArrow(run, kinds)


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, frame, height, width and rgb (row by row, three bytes a pixel) of every stored frame."""
    tune_batches(stored.sparkSession, 64)
    schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column("media").to_pylist()
            source = read([f for m in media for f in m])
            for doc_id, frames in zip(b.column("doc_id").to_pylist(), media):
                for i, _ in enumerate(frames):
                    _, rgb, shape = next(source)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((doc_id, i, *_image(rgb, shape).values()), schema)], schema=schema)

    return stored.mapInArrow(run, "doc_id long, frame int, height int, width int, rgb binary")
