"""Files of fragment-length distributions: read groups' figures and cumulative histograms as bytes, and back.

A read group's lengths are cut into stretches of STRETCH, one record each, so no row holds more lengths than that; every
record has its group's name and figures, so each file can be read by itself. Both counts of pair modes are kept.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from strandlight.operators import filters, stats
from strandlight.sources import bam

COLUMNS = "rg string, valid bigint, invalid bigint, mean double, median bigint, stdev double, lengths array<bigint>, shares array<double>"
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]
#: What a file begins with, its version last; lengths of a record.
MAGIC, STRETCH = b"FLD\x02", 1 << 16


def distribution(aln: DataFrame, modes: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Rows of COLUMNS: each read group's pair modes, mean, median, deviation, and lengths with the share of pairs up to each.

    Read groups without a pair of a valid mode have one row without lengths and figures; a null group is one of its own.
    """
    histogram = stats.fragment_histogram(filters.normal_pairs(aln), modes)
    share = F.struct(F.col("frag_len").cast("bigint").alias("length"), (F.col("upto") / F.col("all")).alias("share"))
    stretches = stats.cumulative(histogram).groupBy("rg", F.floor(F.col("frag_len") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(share)).alias("x"))
    figures = stats.fragment_stats(histogram).withColumnRenamed("rg", "of")
    counts = stats.mode_counts(aln, modes).join(figures, F.expr("rg <=> of"), "left").drop("of")
    found = counts.join(stretches.withColumnRenamed("rg", "of"), F.expr("rg <=> of"), "left")
    none = F.array().cast("array<struct<length:bigint,share:double>>")
    found = found.withColumn("x", F.coalesce("x", none))
    return found.select("rg", "valid", "invalid", "mean", F.col("median").cast("bigint").alias("median"), "stdev", F.col("x.length").alias("lengths"), F.col("x.share").alias("shares"))


def cutoffs(rows: DataFrame, tail: float) -> DataFrame:
    """(rg, lower, upper) as of ``stats.fragment_cutoffs``, from rows that were read."""
    each = rows.select("rg", F.explode(F.arrays_zip("lengths", "shares")).alias("x")).select("rg", "x.*")
    return each.groupBy("rg").agg(F.min(F.when(F.col("shares") >= tail, F.col("lengths"))).alias("lower"), F.max(F.when(F.col("shares") <= 1 - tail, F.col("lengths"))).alias("upper"))


def encoded(row) -> bytes:
    """A record: name (its length first, -1 for none), both counts, whether figures follow and they, lengths, shares."""
    name = b"" if row.rg is None else row.rg.encode()
    figures = (row.mean, row.median, row.stdev)
    known = all(x is not None for x in figures)
    head = struct.pack("<i", -1 if row.rg is None else len(name)) + name + struct.pack("<QQB", row.valid, row.invalid, known)
    body = struct.pack("<I", len(row.lengths)) + np.array(row.lengths, "<u4").tobytes() + np.array(row.shares, "<f8").tobytes()
    return head + (struct.pack("<dqd", *figures) if known else b"") + body


def decoded(data: io.BufferedIOBase) -> Iterator[tuple]:
    """Rows of COLUMNS of one file's bytes; a file of another kind or version, or cut short, is an error."""

    def take(n: int) -> bytes:
        found = data.read(n)
        if len(found) != n:
            raise ValueError("a file of fragment lengths that is cut short")
        return found

    if data.read(4) != MAGIC:
        raise ValueError("not a file of fragment lengths of this version")
    while size := data.read(4):
        (length,) = struct.unpack("<i", size) if len(size) == 4 else struct.unpack("<i", size + take(4 - len(size)))
        name = None if length < 0 else take(length).decode()
        valid, invalid, known = struct.unpack("<QQB", take(17))
        figures = struct.unpack("<dqd", take(24)) if known else (None, None, None)
        (n,) = struct.unpack("<I", take(4))
        lengths, shares = np.frombuffer(take(4 * n), "<u4"), np.frombuffer(take(8 * n), "<f8")
        yield name, valid, invalid, *figures, lengths.tolist(), shares.tolist()


class Writer(bam.Writer):
    suffix = ".fld"

    def write(self, rows) -> bam.Written:
        name = self.staged()
        with open(os.path.join(self.staging, name), "wb") as file:
            file.write(MAGIC)
            for row in rows:
                file.write(encoded(row))
        return bam.Written(name)


class FragmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_fragments"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options, overwrite)


def write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of COLUMNS as files, one a task, into a local or mounted folder."""
    rows.sparkSession.dataSource.register(FragmentSource)
    rows.select(*NAMES).write.format("strand_fragments").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of COLUMNS of the files at ``path``, in any file system that Spark reads; a task takes whole files."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in COLUMNS.split(", ")])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for row in decoded(io.BytesIO(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fld").load(path).select("content").mapInArrow(run, COLUMNS)
