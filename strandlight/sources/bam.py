"""Binary alignments: ``read(spark, path)``, and a data source ``strand_bam`` with a writer.

Files are sequences of independently compressed blocks of at most 64 kB, and records may lie across blocks. ``read`` splits
files by byte ranges in any file system that Spark reads: every block begins with the same sixteen bytes, at which
Spark's reader of lines cuts, each in the split where it begins. A task inflates its split's blocks, finds the first
record that begins in them and decodes from there. The bytes before it, and those of the last record that lies
across the split's end, are fragments; joined along the file they must be whole records, so a record's start that
was found wrongly can't pass. Each file is passed twice, once for its fragments, which are small.

The data source decodes a file as one stream and reads local or mounted folders only.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "qname string, flag int, tid int, rname string, pos int, mapq int, cigar string, mtid int, mpos int, isize int, seq string, qual string, tags map<string,string>"
#: 4-bit bases, CIGAR operations, formats of tag values, and the empty block that ends a file.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
#: Fixed value: what a block begins with, up to its size.
BLOCK_HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
#: Bytes of a record's fixed part; records in a row that must fit where one is taken to begin, and bytes it may be long.
CORE, CHAIN, LONGEST = 32, 8, 1 << 26
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_QUALITY = bytes(min(q + 33, 255) for q in range(256))


def blocks(file) -> Iterator[bytes]:
    """Contents of the blocks of a file; the size of each stands in its header's extra field."""
    while head := file.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-compressed file")
        body = file.read(struct.unpack("<H", head[16:18])[0] + 1 - 18)
        yield zlib.decompress(body[:-8], -15)


class Stream:
    """Bytes of consecutive blocks."""

    def __init__(self, file):
        self.blocks, self.held, self.at = blocks(file) if hasattr(file, "read") else file, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            parts, size = [self.held[self.at :]], len(self.held) - self.at
            while size < n:
                more = next(self.blocks, None)
                if more is None:
                    if size:
                        raise ValueError("the file is truncated")
                    return b""
                parts.append(more)
                size += len(more)
            self.held, self.at = b"".join(parts), 0
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """Text and (name, length) of each sequence."""
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a binary alignment file")
    text = stream.take(stream.number()).rstrip(b"\x00").decode()
    return text, [(stream.take(stream.number())[:-1].decode(), stream.number()) for _ in range(stream.number())]


def decoded(data: bytes, refs: list[tuple[str, int]] | None) -> tuple:
    tid, pos, packed, flags, size, mtid, mpos, isize = struct.unpack_from("<iiIIiiii", data)
    at, names, ops = 32, packed & 0xFF, flags & 0xFFFF
    qname = data[at : at + names - 1].decode()
    at += names
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at)) or "*"
    at += 4 * ops
    seq = data[at : at + (size + 1) // 2].hex().translate(_LETTERS)[:size]
    at += (size + 1) // 2
    quality = data[at : at + size]
    qual = None if not size or quality[0] == 0xFF else quality.translate(_QUALITY).decode("latin-1")
    at, tags = at + size, {}
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            stop = data.index(b"\x00", at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        else:
            value, at = str(struct.unpack_from("<" + NUMBERS[kind], data, at)[0]), at + struct.calcsize(NUMBERS[kind])
        tags[tag] = f"{'i' if kind in 'cCsSiI' else kind}:{value}"
    return qname, flags >> 16, tid, refs[tid][0] if refs and tid >= 0 else None, pos, packed >> 8 & 0xFF, cigar, mtid, mpos, isize, seq or None, qual, tags


def inflated(body: bytes) -> bytes:
    """A block's content from its bytes behind BLOCK_HEAD."""
    if len(body) < 10 or struct.unpack_from("<H", body)[0] + 1 != len(body) + len(BLOCK_HEAD):
        raise ValueError("not a block-compressed file, or one that is truncated")
    return zlib.decompress(body[2:-8], -15)


def fits(data: bytes, at: int, n_refs: int) -> int:
    """The end of the record at ``at``, whose fixed part is in ``data``, if it can be one, else -1; it may lie beyond ``data``."""
    size, tid, pos, packed, flags, n, mtid, mpos, _ = struct.unpack_from("<iiiIIiiii", data, at)
    name, ops = packed & 0xFF, flags & 0xFFFF
    least = CORE + name + 4 * ops + (n + 1) // 2 + n
    if not (least <= size <= LONGEST and -1 <= tid < n_refs and -1 <= mtid < n_refs and pos >= -1 and mpos >= -1 and name and n >= 0):
        return -1
    begin = at + 4 + CORE
    if begin + name <= len(data):
        text = data[begin : begin + name]
        if text[-1] or not all(33 <= c <= 126 for c in text[:-1]):
            return -1
    if begin + name + 4 * ops <= len(data) and any(x & 15 > 8 for x in struct.unpack_from(f"<{ops}I", data, begin + name)):
        return -1
    return at + 4 + size


def first_record(data: bytes, n_refs: int, whole: bool) -> int | None:
    """Where the first record of ``data`` begins: the first place from which records fit, CHAIN in a row or as many as ``data`` has.

    None where more data may tell otherwise, unless it is ``whole``. Where no record's fixed part fits, none begins, and that is
    the end of ``data``; records that begin in its last bytes are left to the fragments.
    """
    for at in range(len(data) - CORE - 3):
        end, found = at, 0
        while end <= len(data) - CORE - 4 and found < CHAIN and (end := fits(data, end, n_refs)) >= 0:
            found += 1
        if end >= 0:
            return at if found == CHAIN or whole else None
    return len(data) if whole else None


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, body): the blocks of files, in order within each split; the one before a file's first block is empty."""
    found = spark.read.option("lineSep", BLOCK_HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*.bam").text(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("body"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Each split with the contents of its blocks."""
    from itertools import groupby

    rows = ((p.as_py(), s.as_py(), b.as_py()) for batch in batches for p, s, b in zip(*batch.columns, strict=True))
    for key, own in groupby(rows, lambda r: r[:2]):
        bodies = (r[2] for r in own)
        if key[1] == 0 and next(bodies):
            raise ValueError(f"{key[0]} doesn't begin with a compressed block")
        yield key, map(inflated, bodies)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, refs): each file's header and its references, array<struct<name,len>>."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("refs", pa.list_(pa.struct([("name", pa.string()), ("len", pa.int64())])))])
        for (name, _), contents in _by_split(batches):
            text, refs = header(Stream(contents))
            yield pa.RecordBatch.from_pylist([{"path": name, "text": text, "refs": [{"name": n, "len": size} for n, size in refs]}], schema)
            for _ in contents:
                pass

    # a header may be longer than a split, so all of its file's blocks pass through one task, which stops at its end
    files = raw_blocks(spark, path).where("split = 0")
    return files.mapInArrow(run, "path string, text string, refs array<struct<name:string,len:bigint>>")


def _cut(contents: Iterator[bytes], begins_file: bool, n_refs: int, record) -> tuple[bytes, bytes, bool]:
    """Passes the whole records of a split to ``record``; (bytes before the first, bytes of the last beyond it, whether any began)."""
    stream, before = Stream(contents), b""
    if begins_file:
        header(stream)
        data = stream.held[stream.at :]
    else:
        data, at = b"", None
        for more in stream.blocks:
            data += more
            if len(data) >= BLOCK and (at := first_record(data, n_refs, False)) is not None:
                break
        if at is None:
            at = first_record(data, n_refs, True)
        before, data = data[:at], data[at:]
        if not data:
            return before, b"", False
    held = [data]
    while True:
        data, at = b"".join(held), 0
        while len(data) - at >= 4 and len(data) - at >= 4 + (size := struct.unpack_from("<i", data, at)[0]):
            record(data[at + 4 : at + 4 + size])
            at += 4 + size
        held, missing = [data[at:]], 4 if len(data) - at < 4 else 4 + size - (len(data) - at)
        while missing > 0 and (more := next(stream.blocks, None)) is not None:
            held.append(more)
            missing -= len(more)
        if missing > 0:
            return before, b"".join(held), True


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files at ``path`` in the columns of SCHEMA; a file is spread over as many tasks as it has splits."""
    sizes = {r[0]: r[1] for r in headers(spark, path).select("path", F.size("refs")).collect()}
    names = headers(spark, path).select("path", F.col("refs.name").alias("names"))
    rows = "path string, " + SCHEMA

    def records(batches):
        out = []

        def keep(data):
            out.append((name, *decoded(data, None)))

        for (name, split), contents in _by_split(batches):
            _cut(contents, split == 0, sizes[name], keep)
            while out:
                yield _batch(out[:4096])
                del out[:4096]

    def fragments(batches):
        for (name, split), contents in _by_split(batches):
            before, after, began = _cut(contents, split == 0, sizes[name], lambda data: None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([split]), pa.array([before], pa.binary()), pa.array([after], pa.binary()), pa.array([began])], names=["path", "split", "before", "after", "began"])

    def joined(batches):
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    size = struct.unpack_from("<i", data, at)[0] if len(data) - at >= 4 else len(data)
                    if not CORE <= size <= len(data) - at - 4:
                        raise ValueError(f"{name} is truncated, or no record begins where one was found")
                    out.append((name, *decoded(data[at + 4 : at + 4 + size], None)))
                    at += 4 + size
            yield _batch(out)

    blocks_ = raw_blocks(spark, path)
    parts = blocks_.mapInArrow(fragments, "path string, split bigint, before binary, after binary, began boolean")
    # a record's bytes go on through splits in which none begins; the window passes over one row for each split
    order = Window.partitionBy("path").orderBy("split")
    parts = parts.withColumn("group", F.sum(F.col("began").cast("int")).over(order))
    pieces = parts.select("path", "split", F.explode(F.array(F.struct((F.col("group") - F.col("began").cast("int")).alias("group"), F.lit(0).alias("k"), F.col("before").alias("data")), F.struct("group", F.lit(1).alias("k"), F.col("after").alias("data")))).alias("x"))
    whole = pieces.groupBy("path", "x.group").agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "x.k", "x.data"))), lambda p: p["data"]).alias("data"))
    whole = whole.select("path", F.aggregate("data", F.lit(b""), lambda acc, d: F.concat(acc, d)).alias("data"))
    found = blocks_.mapInArrow(records, rows).unionByName(whole.mapInArrow(joined, rows))
    named = found.join(F.broadcast(names) if sum(sizes.values()) < 1_000_000 else names, "path")
    return named.withColumn("rname", F.when(F.col("tid") >= 0, F.get("names", F.col("tid")))).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array([list(m.items()) for m in c] if f.name == "tags" else c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


_ARROW = pa.schema([("path", pa.string())] + [(c.split(" ")[0], pa.int32() if c.endswith(" int") else pa.string()) for c in SCHEMA.split(", ")[:-1]] + [("tags", pa.map_(pa.string(), pa.string()))])


def encoded(row) -> bytes:
    name = row.qname.encode() + b"\x00"
    ops, n = [], 0
    for c in "" if row.cigar in (None, "*") else row.cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            n = 0
    seq = row.seq or ""
    codes = [max(BASES.find(b), 0) if b != "=" else 0 for b in seq.upper()] + [0]
    bases = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    quality = bytes(ord(q) - 33 for q in row.qual) if row.qual else b"\xff" * len(seq)
    tags = b""
    for tag, value in sorted((row.tags or {}).items()):
        kind, text = value[0], value[2:]
        tags += tag.encode() + kind.encode() + (text.encode() + b"\x00" if kind in "ZH" else text.encode() if kind == "A" else struct.pack("<" + NUMBERS[kind], float(text) if kind in "fd" else int(text)))
    span = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)) or 1
    last, bin_ = row.pos + span - 1, 0
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if row.pos >> shift == last >> shift:
            bin_ = first + (row.pos >> shift)
            break
    core = struct.pack("<iiIIiiii", row.tid, row.pos, bin_ << 16 | row.mapq << 8 | len(name), row.flag << 16 | len(ops), len(seq), row.mtid, row.mpos, row.isize)
    body = core + name + struct.pack(f"<{len(ops)}I", *ops) + bases + quality + tags
    return struct.pack("<i", len(body)) + body


def compressed(data: bytes) -> bytes:
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(p) for p in (sorted(glob.glob(os.path.join(self.path, "*.bam"))) if os.path.isdir(self.path) else [self.path])]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            stream = Stream(file)
            _, refs = header(stream)
            while size := stream.take(4):
                yield decoded(stream.take(struct.unpack("<i", size)[0]), refs)


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceWriter):
    """Each task writes a whole file with the header into a folder of the job; commit moves the files of the tasks that count.

    So a task that is repeated leaves nothing twice, and a job that fails leaves nothing.
    """

    suffix = ".bam"

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.text, self.overwrite = path, options.get("header", ""), overwrite
        self.staging = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, rows) -> WriterCommitMessage:
        name = self.staged()
        refs = [dict(t.split(":", 1) for t in line.split("\t")[1:]) for line in self.text.splitlines() if line.startswith("@SQ")]
        data = b"BAM\x01" + struct.pack("<i", len(self.text)) + self.text.encode() + struct.pack("<i", len(refs))
        data += b"".join(struct.pack("<i", len(r["SN"]) + 1) + r["SN"].encode() + b"\x00" + struct.pack("<i", int(r["LN"])) for r in refs)
        with open(os.path.join(self.staging, name), "wb") as file:
            for row in rows:
                data += encoded(row)
                while len(data) >= BLOCK:
                    file.write(compressed(data[:BLOCK]))
                    data = data[BLOCK:]
            if data:
                file.write(compressed(data))
            file.write(END_BLOCK)
        return Written(name)

    def staged(self) -> str:
        os.makedirs(self.staging, exist_ok=True)
        return f"part-{uuid.uuid4().hex}{self.suffix}"

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, f"*{self.suffix}")):
                os.remove(old)
        for message in messages:
            if message is not None:
                os.replace(os.path.join(self.staging, message.name), os.path.join(self.path, message.name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
