"""Token files by a static range asymmetric numeral system.

All files share one frequency table. A file holds whole documents in ascending order as independent
blocks of interleaved states, an index of where each block begins in tokens and bytes (a checkpoint
from which it decodes alone), each block's checksum, and its documents' ids and lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, lean, materialize, shared_dir, tune_batches
from .tokens import END, encoder

MAGIC = b"SLRANS01"
LANES, STEPS, BITS = 64, 256, 20
LOW = np.uint64(1 << 31)
BLOCK = LANES * STEPS
#: Tokens after which a file is closed at the end of a document.
FILE_TOKENS = 1 << 20
_HEAD = struct.Struct("<8sIIQII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2^BITS, every id that occurs at least 1; without counts the first id has all."""
    total, size = int(counts.sum()), 1 << BITS
    if not total:
        out = np.zeros(max(1, len(counts)), np.int64)
        out[0] = size
        return out
    out = np.where(counts > 0, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    while (over := int(out.sum()) - size) > 0:
        big = np.flatnonzero(out > 1)
        cut = np.minimum(out[big] - 1, np.maximum(1, out[big] * over // int(out[big].sum())))
        take = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        out[big] -= take
    out[int(out.argmax())] += size - int(out.sum())
    return out


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(freq.argmax())
        self.id = zlib.crc32(freq.astype("<u4").tobytes())

    def _encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids: blocks x steps x lanes. First states, words of all blocks in order, and their number in each."""
        blocks, steps, lanes = ids.shape
        x = np.full((blocks, lanes), LOW, np.uint64)
        words, gave = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[ids[:, t]], self.cum[ids[:, t]]
            over = x >= f << np.uint64(63 - BITS)
            words[:, t], gave[:, t] = x.astype(np.uint32), over
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(BITS)) + (x - q * f) + c
        return x, words[gave], gave.sum((1, 2))

    def _decode(self, x: np.ndarray, words: np.ndarray, first: np.ndarray, steps: int) -> np.ndarray:
        """Ids of blocks decoded side by side; first: where each block's words begin."""
        out = np.empty((len(x), steps, x.shape[1]), np.uint32)
        at, mask = first.astype(np.int64), np.uint64((1 << BITS) - 1)
        words = np.concatenate((words, np.zeros(1, np.uint32))).astype(np.uint64)
        for t in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[:, t] = s
            x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.cum[s]
            need = x < LOW
            place = np.minimum(at[:, None] + np.cumsum(need, 1) - 1, len(words) - 1)
            x = np.where(need, (x << np.uint64(32)) | words[place], x)
            at = at + need.sum(1)
        return out

    def write(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        """One file of documents, whose ids follow each other."""
        n, whole, parts = len(ids), len(ids) // BLOCK, []
        if whole:
            parts.append(self._encode(ids[: whole * BLOCK].reshape(whole, STEPS, LANES)))
        if rest := n - whole * BLOCK:
            steps = -(-rest // LANES)
            tail = np.full(steps * LANES, self.pad, ids.dtype)
            tail[:rest] = ids[whole * BLOCK :]
            parts.append(self._encode(tail.reshape(1, steps, LANES)))
        states = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, LANES), np.uint64)
        words = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        count = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, n, BLOCK)]
        checkpoints = np.zeros(len(count), np.dtype([("token", "<u8"), ("word", "<u8"), ("crc", "<u4")]))
        checkpoints["token"], checkpoints["word"], checkpoints["crc"] = np.arange(len(count)) * BLOCK, np.cumsum(count) - count, sums
        null = np.packbits([d is None for d in doc_ids]).tobytes()
        body = [
            _HEAD.pack(MAGIC, LANES, STEPS, n, len(doc_ids), self.id), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null,
            np.array(lengths, "<u8").tobytes(), checkpoints.tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
        ]
        data = b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def read(self, data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
        """Document ids, lengths and all ids of a file; damage raises ValueError."""
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the file's checksum does not match")
        magic, lanes, steps, n, docs, table = _HEAD.unpack_from(data)
        if magic != MAGIC or table != self.id:
            raise ValueError("not a token file of this frequency table")
        at, block = _HEAD.size, lanes * steps
        blocks = -(-n // block)

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        doc_ids = take("<i8", docs).tolist()
        null = np.unpackbits(take(np.uint8, -(-docs // 8)), count=docs)
        lengths = take("<u8", docs).tolist()
        checkpoints = take(np.dtype([("token", "<u8"), ("word", "<u8"), ("crc", "<u4")]), blocks)
        states = take("<u8", blocks * lanes).reshape(blocks, lanes)
        words = take("<u4", (len(data) - 4 - at) // 4)
        first, whole, out = checkpoints["word"], n // block, []
        for a in range(0, whole, 64):
            out.append(self._decode(states[a : min(a + 64, whole)], words, first[a : min(a + 64, whole)], steps).reshape(-1))
        if n > whole * block:
            out.append(self._decode(states[whole:], words, first[whole:], -(-(n - whole * block) // lanes)).reshape(-1))
        ids = np.concatenate(out)[:n] if out else np.zeros(0, np.uint32)
        for i, crc in enumerate(checkpoints["crc"].tolist()):
            if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {i} does not match its checksum")
        return [None if x else d for d, x in zip(doc_ids, null)], lengths, ids


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Encode docs (doc_id, text; others are ignored) into files below folder: `files` and `table`.

    Texts are encoded whole, once; a null text counts as empty, and every document ends with END.
    Documents are in ascending order of doc_id, null ids first, and of content where ids repeat.
    Files are rows of a table, since Spark's stores know no others that tasks may commit safely.
    """
    spark = docs.sparkSession
    tune_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary())])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, narrow=True)
        kind, total = f"<u{own.size}", np.zeros(0, np.int64)
        end = np.array([END], kind).tobytes()
        for b in batches:
            ids = [x + end for x in own.encode(b.column("text").to_pylist())]
            one = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            one[: len(total)] += total
            total = one
            yield batch(schema, b.column("doc_id"), [zlib.crc32(x) for x in ids], [own.size > 2] * len(ids), ids, [None] * len(ids))
        there = np.flatnonzero(total)
        if len(there):
            yield batch(schema, [None], [None], [None], [None], [np.stack((there, total[there])).astype("<i8").tobytes()])

    made = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(ids_of), "doc_id long, h long, wide boolean, ids binary, counts binary"), "ids")

    def unpack(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(b.column("ids").to_pylist(), b.column("wide").to_pylist())]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("counts").to_pylist():
                yield batch(pa.schema([("id", pa.int64()), ("n", pa.int64())]), *np.frombuffer(x, "<i8").reshape(2, -1))

    # one row for each task that encoded, then one for each id of the vocabulary
    rows = made.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = frequencies(counts)
    spark.createDataFrame([(freq.astype("<u4").tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{folder}/table")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, docs_, held, n = Coder(freq), TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            return batch(schema, [part], [seq], [len(docs_)], [n], [coder.write(docs_, lengths, np.concatenate(held).astype(np.int64))])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), unpack(b)):
                docs_.append(d)
                held.append(x)
                n += len(x)
                if n >= FILE_TOKENS:
                    yield file()
                    docs_, held, n, seq = [], [], 0, seq + 1
        if docs_:
            yield file()

    dealt = made.where("ids is not null").drop("counts").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "wide", "ids")
    dealt.mapInArrow(encode, "part long, seq long, n_docs long, n_tokens long, data binary").write.parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with keep_ids, ids of each document, decoded from the files."""
    freq = np.frombuffer(spark.read.parquet(f"{folder}/table").first().freq, "<u4").astype(np.int64)
    files = spark.read.parquet(f"{folder}/files")
    tune_batches(spark, 4)
    fields = [("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.binary())] * keep_ids)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for part, seq, data in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "data"))):
                doc_ids, lengths, ids = coder.read(data)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths)]
                k = len(own)
                yield batch(schema, [part] * k, [seq] * k, doc_ids, [e - n for e, n in zip(ends, lengths)], lengths, [zlib.crc32(x) for x in own], *([[bytes(x) for x in own]] * keep_ids))

    docs = materialize(files.select("part", "seq", "data").mapInArrow(decode, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids), "decoded")
    # tokens before a file: those of earlier parts, one row each, and of earlier files of its part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("earlier"))
    before = files.select("part", "seq", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("before"))
    begins = before.join(parts, "part").select("part", "seq", (F.col("before") + F.col("earlier")).alias("begin"))
    return docs.join(begins, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * keep_ids))


def roundtrip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to a new shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, folder)
    return read_tokens(docs.sparkSession, folder)
