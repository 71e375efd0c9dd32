"""A user's Python function over sites of a pileup or over the reads of regions, as Arrow batches."""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlight.functions import cigar as C
from strandlight.functions.opened import Elements, opened, text_of
from strandlight.operators import filters, pileup
from strandlight.operators.pileup import key_stretches

#: Bases of a cell, the unit in which sites are dealt to tasks; rows of results in a batch.
CELL, ROWS = 1 << 6, 10_000
#: Elements of a cell that are opened at once, and bytes of its reads that are held in memory, the rest in a file.
OPENED, HELD = 1 << 21, 1 << 26
#: Bases of a cell in which reads and regions meet.
REGION_CELL = 1 << 9


def _first(pieces: Iterable[pa.RecordBatch], n: int | None) -> Iterator[pa.RecordBatch]:
    """Pieces up to ``n`` rows in all."""
    left = n
    for piece in pieces:
        if left is None:
            yield piece
        elif left > 0:
            yield piece.slice(0, left)
            left -= min(left, len(piece))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield whole()
            held = []
    if held:
        yield whole()


def _schema(keys: str, ddl: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    found = StructType.fromDDL(f"{keys}, {ddl}")
    return found, to_arrow_schema(found)


class _Reads:
    """A cell's reads in order: the first in memory, the rest in a file of the task's."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.count, self.bytes, self.file, self.writer = 0, 0, None, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.count += len(batch)
        self.bytes += batch.nbytes
        if self.bytes <= HELD:
            self.batches.append(batch)
            return
        if self.writer is None:
            self.file = tempfile.NamedTemporaryFile(prefix="reads-", delete=False)
            self.writer = pa.ipc.new_stream(self.file, batch.schema)
        self.writer.write_batch(batch)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        yield from self.batches
        if self.file is not None:
            with pa.OSFile(self.file.name) as stored:
                yield from pa.ipc.open_stream(stored)

    def written(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.file.close()

    def dropped(self) -> None:
        if self.file is not None:
            os.unlink(self.file.name)


#: Letters by their bytes, none for 0.
_LETTERS = pa.array(["", *map(chr, range(1, 256))])


def _elements(reads: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Positions and rows of ``pileup.elements``, without their place, of the reads at positions in [low, high): by place, then in order of the reads."""
    at: Elements = opened(reads, low, high)
    at = at.taken(np.lexsort((at.read, at.pos)))
    text, offsets = text_of(reads["seq"])
    inserted: list[str | None] = [None] * len(at.pos)
    for k in np.flatnonzero(at.indel > 0).tolist():
        first = int(offsets[at.read[k]] + at.query[k] + 1)
        inserted[k] = text[first : min(first + int(at.indel[k]), int(offsets[at.read[k] + 1]))].tobytes().decode("latin-1")
    of = lambda c: reads[c].take(pa.array(at.read))
    base = pa.DictionaryArray.from_arrays(pa.array(at.base.astype(np.int16), mask=at.deleted), _LETTERS).cast(pa.string())
    columns = {
        "rec_no": of("rec_no"), "reverse": pa.array((reads["flag"].to_numpy()[at.read] & C.REVERSE) != 0), "mapq": of("mapq"), "deleted": pa.array(at.deleted), "base": base,
        "baseq": pa.array(at.quality), "qpos": pa.array(at.query), "head": pa.array(at.head), "tail": pa.array(at.tail), "indel": pa.array(at.indel), "inserted": pa.array(inserted, pa.string()),
    }
    return at.pos, pa.RecordBatch.from_pydict(columns)


def _sites(reads: _Reads, low: int, high: int) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(pos, pieces) of the covered sites in [low, high), a few sites' elements at a time."""
    wide = max(1, min(high - low, OPENED // max(1, reads.count)))
    for first in range(low, high, wide):
        last = min(first + wide, high)
        if last - first == 1 and reads.count > OPENED:
            # one very deep site: its pieces are opened as they are asked for
            pieces = (rows for part in reads if len((rows := _elements(part, first, last)[1])))
            if (head := next(pieces, None)) is not None:
                yield first, itertools.chain([head], pieces)
            continue
        parts = [(np.searchsorted(pos, np.arange(first, last + 1)), rows) for pos, rows in (_elements(part, first, last) for part in reads) if len(pos)]
        for k in range(last - first):
            own = [rows.slice(cut[k], cut[k + 1] - cut[k]) for cut, rows in parts if cut[k + 1] > cut[k]]
            if own:
                yield first + k, iter(own)


def over_sites(aln: DataFrame, call: Callable[[int, int, Iterator[pa.RecordBatch]], Iterable[tuple]], schema: str, depth: int | None = None, region: tuple[int, int, int] | None = None) -> DataFrame:
    """(tid, pos, *schema): what ``call(tid, pos, pieces)`` gives for each covered site, any number of rows.

    ``pieces`` are batches of the site's ``pileup.elements`` by ``rec_no``, one after another, so a site of any depth passes in
    bounded memory; a call need not read them all. ``depth`` keeps a site's first reads only; ``region`` (tid, begin,
    end) its sites only. Reads, not their elements, are dealt to the tasks of the cells that they touch and sorted there;
    a task opens a cell's reads for a few sites at a time, as many as their depth allows. A cell is the unit of parallel work.
    """
    reads = aln.where("tid >= 0")
    if region is not None:
        reads = filters.overlapping(reads, *region)
    tasks = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ["pos", "rec_no", "flag", "mapq", "cigar", "seq", *(["qual"] if "qual" in aln.columns else [])]
    dealt = reads.select(F.col("tid").cast("bigint").alias("tid"), F.explode(pileup.touched(CELL)).alias("cell"), *own)
    dealt = dealt.repartition(tasks, "tid", "cell").sortWithinPartitions("tid", "cell", "rec_no")
    found, arrow = _schema("tid bigint, pos bigint", schema)
    low, high = region[1:] if region is not None else (-(1 << 62), 1 << 62)

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tid, cell), group in groupby(key_stretches(batches, 2), lambda x: x[0]):
            reads = _Reads()
            try:
                for _, part in group:
                    reads.add(part)
                reads.written()
                for pos, pieces in _sites(reads, max(cell * CELL, low), min((cell + 1) * CELL, high)):
                    yield from ((tid, pos, *row) for row in call(tid, pos, _first(pieces, depth)))
            finally:
                reads.dropped()

    return dealt.mapInArrow(lambda batches: _batches(called(batches), arrow), found)


def over_regions(aln: DataFrame, regions: DataFrame, call: Callable[[int, pa.RecordBatch], Iterable[tuple]], schema: str) -> DataFrame:
    """(region, *schema): what ``call(region, reads)`` gives for the reads that overlap rows of ``regions`` (region, tid, begin, end).

    A region's reads come in batches, one call each, in any order and task: each read once a region that it overlaps. Calls
    that count give partial counts, to be added up by the region. Reads and regions are dealt to the tasks of the cells that
    they touch, not joined row by row: a task keeps its cell's regions, and reads pass in batches by place, from which each
    region takes its own. They meet in the first cell common to both.
    """
    found, arrow = _schema("region bigint", schema)
    last = F.greatest(C.end_of("pos", "cigar"), F.col("pos") + 1) - 1
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / REGION_CELL), F.floor(F.col(high) / REGION_CELL)))
    reads = aln.where("tid >= 0").select(F.col("tid").cast("bigint").alias("__tid"), F.lit(1).cast("bigint").alias("__side"), F.col("pos").cast("bigint").alias("__low"), last.cast("bigint").alias("__high"), F.lit(None).cast("bigint").alias("__region"), F.struct(*aln.columns).alias("__read"))
    spans = regions.where("end > begin AND tid >= 0").select(F.col("tid").cast("bigint").alias("__tid"), F.lit(0).cast("bigint").alias("__side"), F.col("begin").cast("bigint").alias("__low"), (F.col("end") - 1).cast("bigint").alias("__high"), F.col("region").cast("bigint").alias("__region"), F.lit(None).cast(reads.schema["__read"].dataType).alias("__read"))
    both = spans.unionByName(reads).withColumn("__cell", cells("__low", "__high"))
    tasks = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["__tid", "__cell", "__side"]
    dealt = both.repartition(tasks, "__tid", "__cell").sortWithinPartitions(*key, "__low", "__high").select(*key, "__low", "__high", "__region", *[F.col("__read")[c].alias(c) for c in aln.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_met(key_stretches(batches, 3), call), arrow)

    return dealt.mapInArrow(run, found)


def _met(stretches: Iterator[tuple[tuple, pa.RecordBatch]], call: Callable[[int, pa.RecordBatch], Iterable[tuple]]) -> Iterator[tuple]:
    """Rows of ``call`` for stretches ((tid, cell, side), rows (low, high, region, read's columns)): a cell's regions, then its reads."""
    for (_, cell), group in groupby(stretches, lambda x: x[0][:2]):
        held, spans = [], None
        for (_, _, side), rows in group:
            if side == 0:
                held.append(np.column_stack([rows.column(k).to_numpy() for k in range(3)]))
                continue
            if not held:
                continue
            if spans is None:
                # regions of one place take their reads from a batch once
                places, number = np.unique(np.concatenate(held)[:, :2], axis=0, return_inverse=True)
                order = np.argsort(number.ravel(), kind="stable")
                spans = places, np.split(np.concatenate(held)[order, 2], np.cumsum(np.bincount(number.ravel()))[:-1])
            low, high = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            reads = rows.select(list(range(3, rows.num_columns)))
            first = np.searchsorted(low, cell * REGION_CELL)
            begin, end = spans[0][:, 0], spans[0][:, 1]
            for k in np.flatnonzero((begin <= high.max()) & (end >= low[0])):
                # a region from an earlier cell has met the reads from there already
                a, b = first if begin[k] < cell * REGION_CELL else 0, np.searchsorted(low, end[k], "right")
                own = np.flatnonzero(high[a:b] >= begin[k]) + a
                if not len(own):
                    continue
                piece = reads.slice(own[0], len(own)) if own[-1] - own[0] + 1 == len(own) else reads.take(pa.array(own))
                for region in spans[1][k].tolist():
                    for row in call(region, piece):
                        yield region, *row
