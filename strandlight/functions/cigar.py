"""CIGAR, flag and sequence functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE = (1 << i for i in range(11))
#: Bases and their complements, anything else becomes N.
BASES, COMPLEMENTS = "ACGTacgtMRWSYKVHDBNmrwsykvhdbn", "TGCAtgcaNNNNNNNNNNNnnnnnnnnnnn"


def has(flag: str | Column, bits: int) -> Column:
    """Whether any of ``bits`` is set."""
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bits)) != 0


#: Letters of the flag's bits, in their order.
FLAG_LETTERS = "pPuUrR12sfd"


def flag_number(text: Column) -> Column:
    """A flag's number from decimal, octal (``0``) or hexadecimal (``0x``) digits, else from its letters; others count nothing."""
    letters = reduce(lambda a, b: a + b, [F.when(text.contains(c), 1 << i).otherwise(0) for i, c in enumerate(FLAG_LETTERS)])
    return (
        F.when(text.rlike("^[1-9][0-9]*$"), text.try_cast("bigint")).when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("bigint"))
        .when(text.rlike("^0[0-7]*$"), F.conv(text, 8, 10).cast("bigint")).otherwise(letters.cast("bigint"))
    )


def length_of(cigar: str | Column, ops: str) -> Column:
    """Sum of the lengths of the operations in ``ops``; 0 for ``*`` and null."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.coalesce(F.aggregate(F.transform(found, lambda v: v.cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0))


def end_of(pos: str, cigar: str) -> Column:
    """First position after the alignment (exclusive)."""
    return F.col(pos) + length_of(cigar, "MDN")


def query_length(cigar: str) -> Column:
    return length_of(cigar, "MIS")


def operations(cigar: str) -> Column:
    """array<struct<len,op>> of a CIGAR string."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), F.when(o.isin("=", "X"), "M").otherwise(o).alias("op")))


def cigar_text(ops: str | Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def walked(ops: str | Column) -> Column:
    """The operations with ``ref`` and ``query``, what the ones before consume of reference and read."""
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("query"), F.array().cast("array<struct<len:int,op:string,ref:int,query:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["len"].alias("len"), x["op"].alias("op"), acc["ref"].alias("ref"), acc["query"].alias("query"))
        return F.struct((acc["ref"] + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0)).alias("ref"), (acc["query"] + F.when(x["op"].isin("M", "I", "S"), x["len"]).otherwise(0)).alias("query"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def query_position(pos: str, cigar: str, target: Column, left: bool = True) -> Column:
    """struct<query,at> of the read's base at reference position ``target``.

    In a deletion or skip: the base after it, ``at`` being the gap's begin or, if not ``left``, its end. Before the read:
    its first aligned base; beyond it: the place after the last aligned base.
    """
    blocks = F.filter(walked(operations(cigar)), lambda x: x["op"].isin("M", "D", "N"))
    offset = target - F.col(pos)
    first, last = F.get(blocks, F.lit(0)), F.element_at(blocks, -1)
    holds = F.get(F.filter(blocks, lambda x: (x["ref"] <= offset) & (offset < x["ref"] + x["len"])), F.lit(0))
    gap = holds["op"] != "M"
    query = F.when(offset < 0, first["query"]).when(holds.isNull(), last["query"] + F.when(last["op"] == "M", last["len"]).otherwise(0)).when(gap, holds["query"]).otherwise(holds["query"] + offset - holds["ref"])
    at = F.when(offset < 0, 0).when(holds.isNull(), last["ref"] + last["len"]).when(gap, holds["ref"] + (0 if left else holds["len"])).otherwise(offset)
    return F.struct(query.cast("bigint").alias("query"), (F.col(pos) + at).cast("bigint").alias("at"))


_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)
_COLOURS = np.frombuffer(b"0123....", np.uint8)


def _colour_text(seq: pa.Array) -> pa.Array:
    """``colours`` of a batch: the exclusive or of neighbours in all its bases at once, less the step between two reads."""
    text = pc.fill_null(pc.utf8_upper(seq.cast(pa.string())), "")
    if pc.any(pc.not_equal(pc.binary_length(text), pc.utf8_length(text))).as_py():
        text = pc.replace_substring_regex(text, "[^ACGT]", "N")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    codes = _CODES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if len(text) and data is not None else np.zeros(0, np.uint8)
    steps = _COLOURS[np.where((codes[:-1] | codes[1:]) > 3, 4, codes[:-1] ^ codes[1:])]
    size = np.diff(at)
    within = np.ones(len(codes), bool)
    within[at[1:][size > 0] - 1 - at[0]] = False
    ends = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(steps[within[:-1]].tobytes()))
    return pc.if_else(seq.is_valid(), found, pa.scalar(None, pa.string()))


def colours(seq: str | Column) -> Column:
    """Colours of neighbouring bases as digits: equal bases 0, and . where one is unknown."""
    return F.arrow_udf(_colour_text, "string")(seq)


def tag_number(tags: str, name: str, kind: str = "bigint") -> Column:
    """A tag's value as a number, 0 where it is none."""
    return F.coalesce(F.try_element_at(tags, F.lit(name)).try_cast(kind), F.lit(0).cast(kind))


def bin_of(begin: Column, end: Column) -> Column:
    """Smallest of the five levels of bins that holds [begin, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), F.lit(first) + F.shiftright(begin, shift)).otherwise(out)
    return out.cast("bigint")


def bins_over(begin: Column, end: Column) -> Column:
    """All bins that can hold an alignment that overlaps [begin, end)."""
    levels = [F.sequence(F.lit(first) + F.shiftright(begin, shift), F.lit(first) + F.shiftright(end - 1, shift)) for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))]
    return F.concat(F.array(F.lit(0)), *levels)


def insert_size(begin: Column, end: Column, mate_begin: Column, mate_end: Column) -> Column:
    """Signed size between a read and its mate; ends count matches and deletions and are exclusive."""
    return F.when(begin < mate_begin, mate_end - begin - 1).otherwise(mate_begin - end + 1)


def complement(seq: str | Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(complement(seq))


def mismatch_rate(cigar: str, length: Column) -> Column:
    """Inserted, deleted and mismatched lengths over the read's length."""
    return length_of(cigar, "IDX") / length


def alignment_status(flag: str, mapq: str, cigar: str, length: Column, clip: float = 0.2, rate: float = 0.1, min_mapq: int = 10) -> Column:
    """orphan, soft, anchor or poor; thresholds multiply in single precision."""
    head = F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    tail = F.coalesce(F.regexp_extract(cigar, r"(\d+)S$", 1).try_cast("int"), F.lit(0))
    least = F.floor(F.lit(clip).cast("float") * length.cast("float"))
    soft = ((head > 0) & (head >= least)) | ((tail > 0) & (tail >= least))
    good = (F.col(mapq) >= min_mapq) & (mismatch_rate(cigar, length).cast("float") <= F.lit(rate).cast("float"))
    return F.when(has(flag, UNMAPPED), "orphan").when(soft, "soft").when(good, "anchor").otherwise("poor")


def _mode(bits: int, turned: bool) -> int:
    """The mode of a pair by the four bits REVERSE, MATE_REVERSE, READ1, READ2 of its lower or, if ``turned``, upper read."""
    reverse, mate_reverse, first, second = ((bits >> k) & 1 for k in range(4))
    if first == second:
        return -1
    own, mate = reverse + 2 * second, mate_reverse + 2 * first
    up, down = (mate, own) if turned else (own, mate)
    # the upper one of a valid pair has the mate bit where the lower has none; numbers go by the upper's code
    return up * 2 + down - 2 if up < 2 <= down else 4 + (up - 2) * 2 + down if down < 2 <= up else -1


def pair_mode(flag: str, isize: str) -> Column:
    """Number (0-7) of the orientation of a pair, -1 where both or neither of the mate bits are set."""
    # a table of the 32 cases keeps the expression, and the code generated for it, small
    table = F.array(*[F.lit(_mode(k & 15, k > 15)).cast("bigint") for k in range(32)])
    case = F.shiftright(flag, 4).bitwiseAND(F.lit(15)) + F.when(F.col(isize) < 0, 16).otherwise(0)
    return F.get(table, case.cast("int"))


def natural_key(name: str) -> Column:
    """A string whose order is that of ``name`` with runs of digits compared as numbers (up to 18 digits)."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 18, "0")).otherwise(x)), "")


def parse_region(text: str) -> tuple[str, int, int]:
    """(name, begin, end) of ``name[:begin[-end]]``: 1-based inclusive text, 0-based half-open result."""
    m = re.fullmatch(r"(.+?)(?::(\d+)(?:-(\d+))?)?", text.replace(",", "").replace(" ", ""))
    if not m:
        raise ValueError(f"not a region: {text!r}")
    return m[1], max(int(m[2]) - 1, 0) if m[2] else 0, int(m[3]) if m[3] else 1 << 29


def letters(flag: str) -> Column:
    """The flag as letters, in the order of its bits."""
    return F.concat(*[F.when(has(flag, 1 << i), c).otherwise("") for i, c in enumerate(FLAG_LETTERS)])


def solexa_to_phred(quality: Column) -> Column:
    """Character of a quality on the older logarithmic scale (offset 64) as phred + 33, at most 93."""
    return F.least(F.floor(10 * F.log10(1 + F.pow(F.lit(10.0), (quality - 64) / 10.0)) + 0.499), F.lit(93)).cast("bigint")
