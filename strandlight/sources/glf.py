"""Files of genotype likelihoods: the records of ``calls.gap_likelihood_records`` as block-compressed bytes, and back.

Places stand as offsets from the record before, within a reference. Records are dealt to tasks by ranges of place; each task
writes a file of its own, which names the reference at its first record and counts from the reference's begin there, so
every file can be read by itself and in order they hold the whole.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from strandlight.operators import pileup
from strandlight.sources import bam

COLUMNS = "rname string, len bigint, pos bigint, kind int, ref string, depth bigint, rms_q bigint, min_lk bigint, lk array<bigint>, indel1 bigint, indel2 bigint, bases1 string, bases2 string"
#: What a file begins with, and types of records: the reference's end, a site, a gap.
MAGIC, END, SITE, GAP = b"GLF\x03", 0, 1, 2


def with_references(records: DataFrame, refs: DataFrame) -> DataFrame:
    """``calls.gap_likelihood_records`` in the columns of COLUMNS and ``tid``: with the reference's name, length and base; that of a gap is ``*``."""
    found = pileup.with_reference(records, refs).join(refs.select("tid", "rname", "len"), "tid")
    base = F.when(F.col("kind") == 1, "*").otherwise(F.upper("ref"))
    return found.withColumn("ref", base).select("tid", *[c.split(" ")[0] for c in COLUMNS.split(", ")])


def encoded(row, before: int) -> bytes:
    """A record whose place is counted from ``before``; a gap's is that of its site."""
    site = row.kind == 0
    code = pileup.CODES.rindex(row.ref) if site and row.ref in pileup.CODES else 0
    head = struct.pack("<BIIB", (SITE if site else GAP) << 4 | code, row.pos - before if site else 0, row.min_lk << 24 | min(row.depth, (1 << 24) - 1), min(row.rms_q, 255))
    if site:
        return head + bytes(row.lk)
    return head + bytes(row.lk[:3]) + struct.pack("<hh", row.indel1, row.indel2) + (row.bases1 or "").encode() + (row.bases2 or "").encode()


def decoded(stream: bam.Stream) -> Iterator[tuple]:
    """Rows of COLUMNS of one file's bytes."""
    if stream.take(4) != MAGIC:
        raise ValueError("not a file of likelihoods")
    stream.take(stream.number())
    while size := stream.take(4):
        name = stream.take(struct.unpack("<i", size)[0])[:-1].decode()
        length, pos = stream.number(), 0
        while True:
            head = stream.take(1)
            if not head or head[0] >> 4 == END:
                break
            site = head[0] >> 4 == SITE
            offset, packed, rms_q = struct.unpack("<IIB", stream.take(9))
            pos += offset
            lk = list(stream.take(10 if site else 3))
            one, two = (None, None) if site else struct.unpack("<hh", stream.take(4))
            bases = (None, None) if site else tuple(stream.take(abs(n)).decode() if n else "" for n in (one, two))
            yield name, length, pos, 0 if site else 1, pileup.CODES[head[0] & 15] if site else "*", packed & 0xFFFFFF, rms_q, packed >> 24, lk, one, two, *bases


class Writer(bam.Writer):
    suffix = ".glf"

    def write(self, rows) -> bam.Written:
        name = self.staged()
        data, at, before = MAGIC + struct.pack("<i", 0), None, 0
        with open(os.path.join(self.staging, name), "wb") as file:
            for row in rows:
                if row.rname != at:
                    data += bytes([END << 4]) if at is not None else b""
                    text = row.rname.encode() + b"\x00"
                    data += struct.pack("<i", len(text)) + text + struct.pack("<i", row.len)
                    at, before = row.rname, 0
                data += encoded(row, before)
                before = row.pos
                while len(data) >= bam.BLOCK:
                    file.write(bam.compressed(data[: bam.BLOCK]))
                    data = data[bam.BLOCK :]
            file.write(bam.compressed(data) + bam.END_BLOCK)
        return bam.Written(name)


class GlfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_glf"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options, overwrite)


def write(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records ``with_references`` as files by ranges of place, into a local or mounted folder."""
    spark = records.sparkSession
    spark.dataSource.register(GlfSource)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tid", "pos", "kind"]
    # a site and its gap stay together, as the gap has the site's place
    dealt = records.repartitionByRange(parts, "tid", "pos").sortWithinPartitions(*order)
    dealt.select(*[c.split(" ")[0] for c in COLUMNS.split(", ")]).write.format("strand_glf").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of COLUMNS of the files at ``path``, in any file system that Spark reads; a task takes whole files."""
    names = [c.split(" ") for c in COLUMNS.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[k]) for n, k in names])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in decoded(bam.Stream(io.BytesIO(content.as_py()))):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.glf").load(path).select("content").mapInArrow(run, COLUMNS)
