"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to a vectorised kernel together, in characters, unless one alone is longer.
BATCH_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the contracts' folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder named in ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine, as in tests, a folder of its own is set; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return df.checkpoint(eager=True)


def batches(texts: list, size: int = BATCH_CHARS):
    """Slices ``(first, last)`` of ``texts`` of about ``size`` characters and at most 1024 texts."""
    first, chars = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and (chars + n > size or i - first >= 1024):
            yield first, i
            first, chars = i, 0
        chars += n
    if first < len(texts):
        yield first, len(texts)


def arrow_table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Columns of a row that carries one stretch of a summed array.
STRETCH = 64


def summed(source: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of arrays of ``size`` numbers that ``add(batch, total)`` adds up within a task.

    Each task gives its non-zero stretches of STRETCH numbers; Spark sums them by stretch with partial
    aggregation, so a task holds one array and the driver gets one array, whatever the input.
    """
    names = [f"v{i}" for i in range(STRETCH)]

    def count(rows):
        total = np.zeros(size, np.float64)
        for batch in rows:
            add(batch, total)
        table = total.reshape(-1, STRETCH)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(table[at, i], pa.float64()) for i in range(STRETCH)]], names=["at", *names])

    counted = source.mapInArrow(count, "at bigint, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros((size // STRETCH, STRETCH))
    for r in counted.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r[0]] = r[1:]
    return out.reshape(-1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, outside: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most ``most`` labelled rows, by a hash of the id.

    Rows whose fold is ``held`` stay out if ``outside``. An id with several labels takes the largest.
    """
    fold = remainder(id_col, modulus)
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ((fold != held) if outside else (fold == held)))
    ids = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("id", "label", "text")
