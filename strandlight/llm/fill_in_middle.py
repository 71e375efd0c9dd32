"""Fill-in-middle transformation by displacement scatter.

A text is cut into lines; two cuts, drawn by a hash of the document's id, part it into prefix, middle and suffix, which
are written in another order between marks. The texts of a batch are one run of bytes. The cuts of all its documents are
scanned at once; each part has one displacement, so an array of differences, written at the parts' first bytes and summed
up, gives every byte its shift, and one scatter builds all outputs. ``restored`` finds the marks in the outputs alone, gets
the inverse shifts in the same way and gathers the bytes back.

Lines end at byte 10 and marks are ASCII, so cuts never part a code point. A text without marks stays free of them in its
output but for the three written: a mark's first byte occurs nowhere else in a mark, so none arises across a border.

Defined results: a null text is an empty one; empty texts, and texts that hold a mark, are plain: output and text are the same,
``prefix_chars`` and ``middle_chars`` null; a text of one line may have empty prefix, middle or suffix; a null id draws as an
id of no digits; rows of equal id draw alike, and repeated rows give repeated results; an empty table gives an empty
table; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The marks before prefix, suffix and middle, and what the id's hash is salted with.
PREFIX, SUFFIX, MIDDLE, SALT = b"<P>", b"<S>", b"<M>", "7:"
#: Percent of the texts that are transformed, and percent of these whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
#: Bytes of a batch that are scattered together, unless one text alone is longer.
BYTES = 4_000_000
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
MARK = len(PREFIX)


def draws(id_: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the salted id's hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings and the bounds of each; null is empty."""
    wide = strings.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about BYTES together."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BYTES, side="right")) - 1)
        yield a, b
        a = b


def shifts(size: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of ``size`` places the value of the last part that begins at or before it; of empty parts the last counts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, at, np.diff(value, prepend=0))
    return np.cumsum(steps[:size])


def marks(data: np.ndarray) -> np.ndarray:
    """Places where one of the three marks begins."""
    letter = data[1:-1]
    known = (letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1])
    return np.flatnonzero((data[:-2] == PREFIX[0]) & known & (data[2:] == PREFIX[2])) if len(data) >= MARK else np.zeros(0, np.int64)


def within(places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks that lie whole within one string, and the string of each."""
    of = np.searchsorted(bounds, places, side="right") - 1
    inside = places + MARK <= bounds[of + 1]
    return places[inside], of[inside]


def transform(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """(outputs' bytes, their bounds, n, form, prefix_chars, middle_chars) of the texts in ``data``; ``h`` is (4, texts)."""
    first, last = bounds[:-1], bounds[1:]
    size = last - first
    breaks = np.flatnonzero(data == 10) + 1  # a line ends after each, and at the text's end
    before = np.searchsorted(breaks, first, side="right")
    n = np.searchsorted(breaks, last, side="right") - before
    n += (size > 0) & (data[np.maximum(last - 1, 0)] != 10) if len(data) else 0
    low, high = np.sort(h[:2] % (n + 1), axis=0)
    # the k-th line's end; the last line may end without a break
    ends = np.append(breaks, len(data))
    cut = [np.where(k == 0, first, np.minimum(ends[np.minimum(before + np.maximum(k, 1) - 1, len(ends) - 1)], last)) for k in (low, high)]
    form = np.where(h[3] % 100 < suffix_first, SPM, PSM)
    form[(size == 0) | (h[2] % 100 >= rate)] = PLAIN
    form[within(marks(data), bounds)[1]] = PLAIN
    moved = form != PLAIN
    out = first + 3 * MARK * np.cumsum(moved) - 3 * MARK * moved  # where each output begins
    prefix, middle, suffix = cut[0] - first, cut[1] - cut[0], last - cut[1]
    ahead = np.where(form == SPM, 2 * MARK + suffix, np.where(moved, MARK, 0))
    to = out + np.stack([ahead, np.where(moved, 3 * MARK + prefix + suffix, prefix), np.where(form == SPM, MARK, np.where(moved, 2 * MARK + prefix, prefix + middle))])
    at = np.stack([first, *cut])
    made = np.empty(len(data) + 3 * MARK * int(moved.sum()), np.uint8)
    made[np.arange(len(data)) + shifts(len(data), at.T.reshape(-1), (to - at).T.reshape(-1))] = data
    for mark, place in zip((PREFIX, MIDDLE, SUFFIX), to, strict=True):
        for k in range(MARK):
            made[place[moved] - MARK + k] = mark[k]
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = [np.where(moved, points[b] - points[a], -1) for a, b in ((first, cut[0]), (cut[0], cut[1]))]
    return made, np.append(out, len(made)), n, form, *chars


def inverse(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and bounds from outputs and forms; transformed outputs have three marks each."""
    moved = form != PLAIN
    places, of = within(marks(data), bounds)
    places = places[moved[of]].reshape(-1, 3)
    first, last = bounds[:-1], bounds[1:]
    text = first - 3 * MARK * (np.cumsum(moved) - moved)  # where each text begins
    # of each part its first byte in the output and its size, in the text's order; plain texts are all prefix
    begin, size = np.stack([first] * 3), np.stack([last - first, 0 * first, 0 * first])
    part = np.stack([places + MARK, np.column_stack([places[:, 1:], last[moved]]) - places - MARK])
    order = np.where((form[moved] == SPM)[:, None], [1, 2, 0], [0, 2, 1])  # prefix, middle, suffix among the marks
    begin[:, moved], size[:, moved] = np.take_along_axis(part[0], order, 1).T, np.take_along_axis(part[1], order, 1).T
    at = text + np.cumsum(size, axis=0) - size
    total = len(data) - 3 * MARK * int(moved.sum())
    back = data[np.arange(total) + shifts(total, at.T.reshape(-1), (begin - at).T.reshape(-1))]
    return back, np.append(text, total)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of each row of ``docs``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, bounds = bytes_of(batch.column(1))
            h = np.stack([batch.column(2 + k).to_numpy() for k in range(4)])
            for a, b in slices(bounds):
                own, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                made, out, n, form, *chars = transform(own, at, h[:, a:b], rate, suffix_first)
                lengths = [pa.array(c, pa.int64(), mask=form == PLAIN) for c in chars]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(FORMS[form], pa.string()), *lengths, strings_of(made, out)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *draws(F.col(id_col)))
    found = rows.mapInArrow(run, "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return found.withColumnRenamed("id", id_col)


def restored(found: DataFrame) -> DataFrame:
    """``found`` with column ``restored``, the text rebuilt from columns ``output`` and ``form``, in place of any such column."""
    found = found.drop("restored")
    at = [found.columns.index(c) for c in ("output", "form")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, bounds = bytes_of(batch.column(at[0]))
            names = batch.column(at[1]).to_numpy(zero_copy_only=False)
            form = np.where(names == FORMS[PSM], PSM, np.where(names == FORMS[SPM], SPM, PLAIN))
            for a, b in slices(bounds):
                back, out = inverse(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], form[a:b])
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], strings_of(back, out)], names=[*batch.schema.names, "restored"])

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("restored", StringType())]))
