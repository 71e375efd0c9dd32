"""Reference sequences: FASTA files to index rows, tiles and slices, and wrapped text.

Files are read as lines by byte range, so one file fills as many tasks as it has splits, in any file system that Spark
reads. A split's lines become pieces, one for each record that has lines in it, with sizes only; sums over these few rows
give every piece its place in its file and in its record. Bases travel in chunks of at most a tile; no row has a sequence
of more than that, and no task has a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.operators.pileup import TILE

PIECE = "path string, split bigint, piece bigint, head string, size bigint, at bigint, first bigint, bases bigint, longest bigint, last bigint, ragged boolean, lead boolean, blank boolean"
CHUNK = "path string, split bigint, piece bigint, begin bigint, bases string"
_GRAPHIC = np.zeros(256, np.int64)
_GRAPHIC[33:127] = 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, value) of the files' lines, without line feeds, in order within each split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _split_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(path, split, whether it begins, lines) of the stretches of batches that lie in one split."""
    now = None
    for batch in batches:
        paths, splits = batch.column(0), batch.column(1).to_numpy()
        names = paths.dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (splits[1:] != splits[:-1]))) if len(batch) else []
        for a, b in zip(edge, np.append(edge[1:], len(batch)) if len(batch) else [], strict=True):
            key = paths[int(a)].as_py(), int(splits[a])
            yield *key, key != now, batch.column(2)[int(a) : int(b)]
            now = key


def _measured(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with the line feed, bases, first byte or 0, bytes all together) of lines."""
    wide = text.cast(pa.large_string())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    sums = np.append(0, np.cumsum(_GRAPHIC[data[bounds[0] : bounds[-1]]]))
    size = np.diff(bounds)
    first = np.where(size > 0, data[np.minimum(bounds[:-1], max(len(data) - 1, 0))] if len(data) else 0, 0)
    return size + 1, np.diff(sums[bounds - bounds[0]]), first, data[bounds[0] : bounds[-1]]


def pieces(of: DataFrame) -> DataFrame:
    """One row for each stretch of a split's ``lines`` from one header to the next; the first has no header.

    ``head`` is the name, ``size`` the bytes, ``at`` where the sequence begins, from the piece's begin (null without
    bases); ``first`` and ``last`` bases of the first and last line that has some, ``longest`` bytes of the first one,
    ``ragged`` whether lines differ before the last one, ``lead`` and ``blank`` whether an empty line stands before its first
    and after its last line with bases. Lines that begin with ``;`` are comments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_ = [], None

        def piece(path, split, number, head):
            return {"path": path, "split": split, "piece": number, "head": head, "size": 0, "at": None, "first": None, "bases": 0, "longest": None, "last": None, "ragged": False, "lead": False, "blank": False}

        for path, split, begins, text in _split_parts(batches):
            if begins:
                done += [open_] if open_ else []
                open_ = piece(path, split, 0, None)
            size, bases, first, _ = _measured(text)
            heads = np.flatnonzero(first == ord(">"))
            for a, b in zip(np.append(0, heads), np.append(heads, len(size)), strict=True):
                if a < b and first[a] == ord(">"):
                    done.append(open_)
                    words = text[int(a)].as_py()[1:].split()
                    open_ = piece(path, split, open_["piece"] + 1, words[0] if words else "")
                    open_["size"] += int(size[a])
                    a += 1
                before = open_["size"] + np.cumsum(size[a:b]) - size[a:b]
                own = first[a:b] != ord(";")
                n, begin, wide = bases[a:b][own], before[own], size[a:b][own]
                open_["size"] += int(size[a:b].sum())
                some = np.flatnonzero(n)
                if not len(some):
                    open_["blank"] |= bool(len(n))
                    continue
                if open_["at"] is None:
                    open_ |= {"at": int(begin[some[0]]), "first": int(n[some[0]]), "longest": int(wide[some[0]]), "last": int(n[some[0]]), "lead": open_["blank"] or bool(some[0])}
                    rest = n[some[0] + 1 : some[-1] + 1]
                else:
                    # what was the last line is an inner one now
                    open_["ragged"] |= open_["blank"] or open_["last"] != open_["first"]
                    rest = n[: some[-1] + 1]
                open_["ragged"] |= bool((rest[:-1] != open_["first"]).any()) or bool(len(rest) and rest[-1] > open_["first"])
                open_ |= {"last": int(n[some[-1]]), "blank": some[-1] + 1 < len(n), "bases": open_["bases"] + int(n.sum())}
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        done += [open_] if open_ else []
        yield pa.RecordBatch.from_pylist(done, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PIECE.split(", "))])
    return of.select("path", "split", "value").mapInArrow(run, PIECE)


def placed(found: DataFrame) -> DataFrame:
    """``pieces`` with ``record``, the number of their header in the file, ``offset`` of the piece in bytes, ``begin`` of its bases in the record.

    The windows pass over one row for each record and split.
    """
    order = Window.partitionBy("path").orderBy("split", "piece")
    found = found.withColumn("record", F.count("head").over(order)).withColumn("offset", F.sum("size").over(order) - F.col("size"))
    own = Window.partitionBy("path", "record").orderBy("split", "piece")
    return found.withColumn("begin", F.sum("bases").over(own) - F.col("bases"))


def index(found: DataFrame) -> DataFrame:
    """(path, record, rname, length, offset, line_blen, line_len) of ``placed`` pieces.

    A record whose lines differ in length before its last one, or with an empty line between others, raises an error.
    """
    own = Window.partitionBy("path", "record").orderBy("split", "piece")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    begun = found.withColumns({"gap": F.col("blank") & (F.count("at").over(own) > 0), "inner": F.count("at").over(earlier) > 0})
    full = begun.withColumn("after_gap", F.coalesce(F.max("gap").over(earlier), F.lit(False))).where("at IS NOT NULL")
    full = full.withColumns({"before_last": F.lag("last").over(own), "line": F.first("first").over(own)})
    bad = F.col("ragged") | (F.col("first") > F.col("line")) | (F.col("inner") & (F.col("lead") | F.col("after_gap"))) | F.coalesce(F.col("before_last") != F.col("line"), F.lit(False))
    # within a piece lines were held to its own first one, which is short where it is also the last
    bad = bad | ((F.col("first") != F.col("line")) & (F.col("bases") > F.col("first")))
    of = full.groupBy("path", "record").agg(F.max(bad).alias("bad"), F.sum("bases").alias("length"), F.min_by(F.struct((F.col("offset") + F.col("at")).alias("at"), "first", "longest"), F.struct("split", "piece")).alias("x"))
    names = found.where("head IS NOT NULL").select("path", "record", F.col("head").alias("rname"))
    every = names.join(of, ["path", "record"], "left")
    checked = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("lines of different lengths in sequence "), "rname"))).otherwise(F.coalesce("length", F.lit(0)))
    return every.select("path", "record", "rname", checked.cast("bigint").alias("length"), F.coalesce("x.at", F.lit(0)).alias("offset"), F.coalesce("x.first", F.lit(0)).alias("line_blen"), F.coalesce("x.longest", F.lit(0)).alias("line_len"))


def write_index(found: DataFrame, path: str) -> None:
    """The index as text of five columns, in the order of the files' bytes."""
    order = found.orderBy("path", "offset", "record").select("rname", "length", "offset", "line_blen", "line_len")
    order.write.option("sep", "\t").mode("overwrite").csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(rname, length, offset, line_blen, line_len) of index text; a line that has not these five columns raises an error."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    rows = F.when(F.size("x") == 5, F.col("x")).otherwise(F.raise_error(F.lit("an index line has five columns")))
    parts = parts.select(rows.alias("x"))
    return parts.select(F.col("x")[0].alias("rname"), *[F.col("x")[i].cast("bigint").alias(n) for i, n in enumerate(("length", "offset", "line_blen", "line_len"), 1)])


def chunks(of: DataFrame) -> DataFrame:
    """(path, split, piece, begin, bases): the bases of each piece in stretches of at most TILE, placed from the piece's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, begin = 0, 0
        for path, split, begins, text in _split_parts(batches):
            number, begin = (0, 0) if begins else (number, begin)
            size, _, first, data = _measured(text)
            ends = np.cumsum(size - 1)
            kept = np.repeat((first != ord(";")) & (first != ord(">")), size - 1) & (_GRAPHIC[data] > 0)
            heads = np.flatnonzero(first == ord(">"))
            rows = []
            for a, b in zip(np.append(0, heads), np.append(heads, len(size)), strict=True):
                if a < b and first[a] == ord(">"):
                    number, begin = number + 1, 0
                lo, hi = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
                letters = data[lo:hi][kept[lo:hi]].tobytes().decode("ascii")
                for k in range(0, len(letters), TILE):
                    rows.append((path, split, number, begin + k, letters[k : k + TILE]))
                begin += len(letters)
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "split", "piece", "begin", "bases"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("path", pa.string()), ("split", pa.int64()), ("piece", pa.int64()), ("begin", pa.int64()), ("bases", pa.string())])
    return of.select("path", "split", "value").mapInArrow(run, CHUNK)


def tiles(of: DataFrame, found: DataFrame) -> DataFrame:
    """(path, record, tile, bases): ``lines`` as tiles of TILE bases, by their ``placed`` pieces."""
    at = chunks(of).withColumnRenamed("begin", "own").join(found.select("path", "split", "piece", "record", "begin"), ["path", "split", "piece"])
    begin = F.col("begin") + F.col("own")
    at = at.select("path", "record", begin.alias("begin"), "bases", F.explode(F.sequence(F.floor(begin / TILE), F.floor((begin + F.length("bases") - 1) / TILE))).alias("tile"))
    low = F.greatest(F.col("begin"), F.col("tile") * TILE)
    part = F.substring("bases", (low - F.col("begin") + 1).cast("int"), (F.col("tile") * TILE + TILE - low).cast("int"))
    cut = at.select("path", "record", "tile", F.struct(low.alias("low"), part.alias("part")).alias("x"))
    return cut.groupBy("path", "record", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("bases"))


def fetched(of: DataFrame, slices: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``slices`` (rname, begin, end) with ``bases`` of the sequences in ``lines``, clamped to them; unknown names drop out.

    Slices meet tiles by name and tile; of sequences of one name the first counts. A long slice is put together of its
    tiles' parts.
    """
    found = placed(pieces(of)) if found is None else found
    known = index(found).where("length > 0").withColumn("nth", F.row_number().over(Window.partitionBy("rname").orderBy("path", "record"))).where("nth = 1")
    asked = slices.select("rname", "begin", "end").distinct().join(known.select("rname", "path", "record", "length"), "rname")
    low, high = F.greatest(F.col("begin"), F.lit(0)), F.least("end", "length")
    asked = asked.withColumns({"low": low, "high": high})
    near = asked.where("low < high").withColumn("tile", F.explode(F.sequence(F.floor(F.col("low") / TILE), F.floor((F.col("high") - 1) / TILE))))
    first = F.greatest(F.col("low"), F.col("tile") * TILE)
    part = F.substring("bases", (first - F.col("tile") * TILE + 1).cast("int"), (F.least("high", (F.col("tile") + 1) * TILE) - first).cast("int"))
    met = near.join(tiles(of, found), ["path", "record", "tile"]).select("rname", "begin", "end", F.struct("tile", part.alias("part")).alias("x"))
    text = met.groupBy("rname", "begin", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("bases"))
    every = asked.select("rname", "begin", "end").join(text, ["rname", "begin", "end"], "left").select("rname", "begin", "end", F.coalesce("bases", F.lit("")).alias("bases"))
    return slices.join(every, ["rname", "begin", "end"])


def sequences(of: DataFrame) -> DataFrame:
    """(tid, rname, len, bases) of ``lines``: whole sequences, for those that fit a row; larger ones stay in ``tiles``.

    Numbers go by file and place in it; only names and lengths are ranked.
    """
    found = placed(pieces(of))
    named = index(found).withColumn("tid", F.row_number().over(Window.orderBy("path", "record")).cast("bigint") - 1)
    whole = tiles(of, found).groupBy("path", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "bases"))), lambda x: x["bases"]), "").alias("bases"))
    return named.join(whole, ["path", "record"], "left").select("tid", "rname", F.col("length").alias("len"), F.coalesce("bases", F.lit("")).alias("bases"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return sequences(lines(spark, path))


def wrapped(refs: DataFrame, width: int = 60, keep: list[str] | None = None) -> DataFrame:
    """One ``value`` a sequence: a header and lines of ``width`` bases; and the columns to keep."""
    return refs.select(*(keep or []), F.concat(F.lit(">"), "rname", F.lit("\n"), F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))
