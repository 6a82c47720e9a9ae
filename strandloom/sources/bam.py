"""BAM files as a data source: blocked gzip is read in splits and written in parts.

A split owns the records that begin in its blocks. Where a split begins inside a file, the first block is
found by its header and the first record by a chain of records that all make sense, as the format has
no marks of its own. Plain gzip has no blocks that could be found, so such a file is one split.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import CIGAR

SCHEMA = (
    "path string, record struct<block:bigint,place:int>, query_name string, flag int, reference_name string, reference_start bigint, mapping_quality int, "
    f"cigar {CIGAR}, next_reference_name string, next_reference_start bigint, template_length int, seq string, qual string, tags map<string,string>"
)
_BASES = "=ACMGRSVTWYHKDBN"
_NUMBER = {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I", b"f": "f"}
_FIXED = struct.Struct("<iiBBHHHiiii")
#: Bytes of a file in one split, records of a batch, bytes of a written block before compression, and the block that ends a file.
SPLIT, BATCH, BLOCK = 64 << 20, 2000, 60_000
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _files(path: str) -> tuple[pa.fs.FileSystem, list[str]]:
    system, place = pa.fs.FileSystem.from_uri(path)
    info = system.get_file_info(place)
    if info.type != pa.fs.FileType.Directory:
        return system, [place]
    return system, sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(place, recursive=False)) if f.path.endswith(".bam"))


def _block_size(head: bytes) -> int | None:
    """Whole size of the block that begins with these 18 bytes, or None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00" or head[10:12] != b"\x06\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class _Stream:
    """Uncompressed bytes from a place of a file on, which knows the block that each byte came from."""

    def __init__(self, file, at: int, blocked: bool) -> None:
        self.file, self.at, self.data, self.blocked = file, at, b"", blocked
        self.starts: list[tuple[int, int]] = []  # (place in data, block's place in the file)
        self.plain = None if blocked else zlib.decompressobj(31)

    def more(self) -> bool:
        """Append the next block; False at the file's end."""
        self.file.seek(self.at)
        if not self.blocked:
            raw = self.file.read(1 << 20)
            self.at += len(raw)
            while raw:
                self.data += self.plain.decompress(raw)
                raw = self.plain.unused_data
                if self.plain.eof:
                    self.plain = zlib.decompressobj(31)
            return self.at < self.file.size()
        size = _block_size(self.file.read(18))
        if size is None:
            return False
        raw = self.file.read(size - 18)
        self.starts.append((len(self.data), self.at))
        self.data += zlib.decompress(raw[:-8], -15)
        self.at += size
        return True

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more() and len(self.data) < n:
                return False
        return True

    def drop(self, n: int) -> None:
        """Forget the first n bytes."""
        self.data = self.data[n:]
        keep = max((i for i, (p, _) in enumerate(self.starts) if p <= n), default=0)
        self.starts = [(p - n, b) for p, b in self.starts[keep:]]

    def block_of(self, place: int) -> tuple[int, int]:
        """(block, place in it) of a byte."""
        p, b = next(((p, b) for p, b in reversed(self.starts) if p <= place), (0, 0))
        return b, place - p


def _header(s: _Stream, sizes: list[int] | None = None) -> tuple[list[str], int]:
    """Names of the contigs, whose lengths are added to sizes, and where the records begin."""
    if not s.need(8) or s.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", s.data, 4)[0]
    s.need(at + 4)
    n, names = struct.unpack_from("<i", s.data, at)[0], []
    at += 4
    for _ in range(n):
        s.need(at + 4)
        size = struct.unpack_from("<i", s.data, at)[0]
        s.need(at + 8 + size)
        names.append(s.data[at + 4 : at + 3 + size].decode())
        if sizes is not None:
            sizes.append(struct.unpack_from("<i", s.data, at + 4 + size)[0])
        at += 8 + size
    return names, at


def _record_end(s: _Stream, at: int, contigs: int) -> int | None:
    """Where a record that begins at this place ends, if it makes sense as one."""
    if not s.need(at + 36):
        return None
    size = struct.unpack_from("<i", s.data, at)[0]
    ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos, _ = _FIXED.unpack_from(s.data, at + 4)
    if not (-1 <= ref < contigs and -1 <= next_ref < contigs and pos >= -1 and next_pos >= -1 and n_name > 0 and n_seq >= 0):
        return None
    if not 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size < 1 << 28 or not s.need(at + 36 + n_name + 4 * n_cigar):
        return None
    name = s.data[at + 36 : at + 36 + n_name]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    ops = struct.unpack_from(f"<{n_cigar}I", s.data, at + 36 + n_name)
    return at + 4 + size if all(c & 15 <= 8 for c in ops) else None


def _first_record(s: _Stream, contigs: int, chain: int = 4) -> int | None:
    """The first place from which a chain of records follows, to the file's end if that is nearer."""
    at = 0
    while s.need(at + 36):
        end, good = at, 0
        while good < chain and (to := _record_end(s, end, contigs)) is not None:
            end, good = to, good + 1
            if not s.need(end + 1):
                return at if len(s.data) == end else None
        if good == chain:
            return at
        at += 1
    return None


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), raw[at + 2 : at + 3]
        at += 3
        if kind in b"ZH":
            end = raw.index(0, at)
            out[key], at = raw[at:end].decode(), end + 1
        elif kind == b"A":
            out[key], at = chr(raw[at]), at + 1
        elif kind == b"B":
            sub, n = _NUMBER[raw[at : at + 1]], struct.unpack_from("<I", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sub}", raw, at + 5)
            out[key], at = ",".join(map(str, values)), at + 5 + struct.calcsize(f"<{n}{sub}")
        else:
            form = "<" + _NUMBER[kind]
            out[key], at = str(struct.unpack_from(form, raw, at)[0]), at + struct.calcsize(form)
    return out


def _decoded(raw: bytes, names: list[str]) -> dict:
    ref, pos, n_name, quality, _, n_cigar, flag, n_seq, next_ref, next_pos, length = _FIXED.unpack_from(raw)
    at = 32 + n_name
    cigar = [{"op": c & 15, "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    qual = raw[at : at + n_seq]
    told = lambda r: names[r] if r >= 0 else None
    return {
        "query_name": raw[32 : 31 + n_name].decode(), "flag": flag, "reference_name": told(ref), "reference_start": pos, "mapping_quality": quality, "cigar": cigar,
        "next_reference_name": told(next_ref), "next_reference_start": next_pos, "template_length": length,
        "seq": "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or None,
        "qual": None if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode(), "tags": list(_tags(raw[at + n_seq :]).items()),
    }


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    end: int
    names: list[str]
    first: int  # where records begin in the first split
    blocked: bool


_CIGAR = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
_ROW = pa.schema([
    ("path", pa.string()), ("record", pa.struct([("block", pa.int64()), ("place", pa.int32())])), ("query_name", pa.string()), ("flag", pa.int32()), ("reference_name", pa.string()), ("reference_start", pa.int64()),
    ("mapping_quality", pa.int32()), ("cigar", _CIGAR), ("next_reference_name", pa.string()), ("next_reference_start", pa.int64()), ("template_length", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())),
])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int) -> None:
        self.paths, self.split = paths, split

    def partitions(self) -> list[_Split]:
        out = []
        for path in self.paths:
            system, files = _files(path)
            for f in files:
                with system.open_input_file(f) as file:
                    size, blocked = file.size(), _block_size(file.read(18)) is not None
                    names, first = _header(_Stream(file, 0, blocked))
                step = self.split if blocked else max(size, 1)
                uri = f if "://" not in path else path.split("://")[0] + "://" + f
                out += [_Split(uri, a, min(a + step, size), names, first, blocked) for a in range(0, size, step)]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        p = partition
        system, place = pa.fs.FileSystem.from_uri(p.path)
        with system.open_input_file(place) as file:
            at = self._first_block(file, p)
            if at is None:
                return
            s = _Stream(file, at, p.blocked)
            begin = p.first if p.start == 0 else _first_record(s, len(p.names))
            if begin is None or (p.start == 0 and not s.need(begin)):
                return
            held: list[dict] = []
            while s.need(begin + 4):
                block, inside = s.block_of(begin)
                if block >= p.end:
                    break
                size = struct.unpack_from("<i", s.data, begin)[0]
                if not s.need(begin + 4 + size):
                    raise ValueError(f"{p.path} ends inside a record")
                raw = s.data[begin + 4 : begin + 4 + size]
                held.append({"path": p.path, "record": {"block": block, "place": inside if p.blocked else len(held)}} | _decoded(raw, p.names))
                begin += 4 + size
                if begin > 1 << 20:
                    s.drop(begin)
                    begin = 0
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ROW)

    @staticmethod
    def _first_block(file, p: _Split) -> int | None:
        """The first block from the split's start on, told by its header and that of the one behind it."""
        if p.start == 0:
            return 0
        file.seek(p.start)
        data, at = file.read(1 << 17), 0  # two blocks' length
        while (at := data.find(b"\x1f\x8b\x08\x04", at)) >= 0:
            size = _block_size(data[at : at + 18])
            if size is not None:
                file.seek(p.start + at + size)
                after = file.read(18)
                if not after or _block_size(after) is not None:
                    return p.start + at if p.start + at < p.end else None
            at += 1
        return None


def _tag(key: str, kind: str, value) -> bytes:
    head = key.encode() + kind[:1].encode()
    if kind == "Z":
        return head + str(value).encode() + b"\0"
    if kind[0] == "B":
        return head + kind[1].encode() + struct.pack(f"<I{len(value)}{_NUMBER[kind[1].encode()]}", len(value), *value)
    return head + struct.pack("<" + _NUMBER[kind.encode()], value)


#: Typed columns of the canonical schema and their tags. Fixed values.
_TYPED = (("parent_id", "pi", "Z"), ("ts", "ts", "i"), ("sp", "sp", "i"), ("mv", "mv", "Bc"), ("sm", "sm", "f"), ("sd", "sd", "f"), ("mm", "MM", "Z"), ("ml", "ML", "BC"), ("ns", "ns", "BI"), ("nl", "nl", "BI"))


def encoded(row: dict, places: dict[str, int]) -> bytes:
    """A record's bytes; other tags are written as whole numbers, if they are, or as text."""
    seq, name = row.get("seq") or "", row["query_name"].encode() + b"\0"
    cigar = [c["len"] << 4 | c["op"] for c in row.get("cigar") or []]
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(ord(q) - 33 for q in row["qual"]) if row.get("qual") else b"\xff" * len(seq)
    tags = b"".join(_tag(k, t, row[c]) for c, k, t in _TYPED if row.get(c) is not None)
    for k, v in sorted((row.get("tags_extra") or {}).items()):
        whole = v.lstrip("-").isdigit() and abs(int(v)) < 1 << 31
        tags += _tag(k, "i", int(v)) if whole else _tag(k, "Z", v)
    at = lambda c: -1 if row.get(c) is None else places[row[c]]
    number = lambda c, other: other if row.get(c) is None else row[c]
    fixed = _FIXED.pack(at("reference_name"), number("reference_start", -1), len(name), number("mapping_quality", 255), 4680, len(cigar), number("flag", 4), len(seq), at("next_reference_name"), number("next_reference_start", -1), number("template_length", 0))
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def _compressed(data: bytes) -> bytes:
    """One block."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def _head(contigs: list[tuple[str, int]], ordered: bool) -> bytes:
    text = f"@HD\tVN:1.6\tSO:{'coordinate' if ordered else 'unsorted'}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + refs


class _Writer(DataSourceWriter):
    """Parts are written aside and moved in place when all tasks are done, so lost tasks leave nothing."""

    def __init__(self, path: str, contigs: list[tuple[str, int]]) -> None:
        self.path, self.contigs = path, contigs

    def write(self, rows: Iterable) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, place = pa.fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{place}/_temporary", recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bam"
        places = {n: i for i, (n, _) in enumerate(self.contigs)}
        with system.open_output_stream(f"{place}/_temporary/{name}", compression=None) as out:
            head = _head(self.contigs, bool(self.contigs))
            for a in range(0, len(head), BLOCK):
                out.write(_compressed(head[a : a + BLOCK]))
            held = b""
            for r in rows:
                held += encoded(r.asDict(recursive=True), places)
                while len(held) >= BLOCK:
                    out.write(_compressed(held[:BLOCK]))
                    held = held[BLOCK:]
            if held:
                out.write(_compressed(held))
            out.write(_EOF)
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages: list) -> None:
        system, place = pa.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{place}/_temporary/{m.name}", f"{place}/{m.name}")
        system.delete_dir(f"{place}/_temporary")

    def abort(self, messages: list) -> None:
        system, place = pa.fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{place}/_temporary").type == pa.fs.FileType.Directory:
            system.delete_dir(f"{place}/_temporary")


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["paths"].split("\n"), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        pairs = [x.rsplit(":", 1) for x in self.options.get("contigs", "").split("\n") if x]
        return _Writer(self.options["path"], [(n, int(size)) for n, size in pairs])


def read_bam(spark: SparkSession, paths: str | list[str], *, split: int = SPLIT) -> DataFrame:
    """Records of BAM files, or of folders' .bam files, with all tags as text; record is the place in its file, which sorts as the file does."""
    spark.dataSource.register(BamSource)
    return spark.read.format(BamSource.name()).option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).option("split", str(split)).load()


def contigs_of(path: str) -> list[tuple[str, int]]:
    """(name, length) of the contigs in the header of a BAM file, or of a folder's first one; empty if it has none."""
    system, files = _files(path)
    with system.open_input_file(files[0]) as file:
        blocked = _block_size(file.read(18)) is not None
        sizes: list[int] = []
        return list(zip(_header(_Stream(file, 0, blocked), sizes)[0], sizes))


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    """Records of the canonical schema as parts in a folder, each a whole BAM file.

    With contigs (name and length, in the header's order) the parts together are in coordinate order,
    unaligned records last; without any, records stay where they are. A record on another contig raises.
    """
    from ..operators.reads import in_coordinate_order

    reads.sparkSession.dataSource.register(BamSource)
    rows = in_coordinate_order(reads, [n for n, _ in contigs]) if contigs else reads
    rows.drop("line_no", "is_reverse").write.format(BamSource.name()).mode("append").option("contigs", "\n".join(f"{n}:{size}" for n, size in contigs)).save(path)


def merge_parts(folder: str, out: str) -> None:
    """The parts of write_bam() as one file: the first one's header, then all records' blocks as they are."""
    system, files = _files(folder)
    target, place = pa.fs.FileSystem.from_uri(out)
    with target.open_output_stream(place, compression=None) as to:
        for i, f in enumerate(files):
            with system.open_input_file(f) as file:
                s = _Stream(file, 0, True)
                _, first = _header(s)
                begin = next((b for p, b in s.starts if p >= first), s.at)  # records begin with a block
                end = file.size() - len(_EOF)
                file.seek(0 if i == 0 else begin)
                while file.tell() < end:
                    to.write(file.read(min(1 << 20, end - file.tell())))
        to.write(_EOF)


def typed(raw: DataFrame) -> DataFrame:
    """Records with the typed tag columns of the canonical schema."""
    t = F.col("tags")
    ints = lambda k: F.transform(F.split(t[k], ","), lambda x: x.cast("int"))
    known = ("pi", "ts", "sp", "mv", "sm", "sd", "MM", "Mm", "ML", "ns", "nl", "fi", "fp", "ri", "rp")
    return raw.select(
        "query_name", t["pi"].alias("parent_id"), "flag", "reference_name", "reference_start", "mapping_quality", "cigar", "next_reference_name", "next_reference_start", "template_length", "seq", "qual",
        (F.col("flag").bitwiseAND(16) != 0).alias("is_reverse"), t["ts"].cast("int").alias("ts"), t["sp"].cast("int").alias("sp"), ints("mv").alias("mv"), t["sm"].cast("double").alias("sm"), t["sd"].cast("double").alias("sd"),
        F.coalesce(t["MM"], t["Mm"]).alias("mm"), ints("ML").alias("ml"), ints("ns").alias("ns"), ints("nl").alias("nl"), F.map_filter("tags", lambda k, v: ~k.isin(*known)).alias("tags_extra"), F.struct("path", "record").alias("line_no"),
    )
