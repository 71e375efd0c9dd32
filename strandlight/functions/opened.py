"""Reads opened into positions, batch by batch: reads of one CIGAR at a time, by a template of what its operations cover."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: What reads need: record numbers give the qualities where there is no ``qual``.
COLUMNS = ("pos", "cigar", "seq", "rec_no")


@lru_cache(1 << 12)
def template(cigar: str) -> tuple[np.ndarray, ...]:
    """(place on the reference, place in the read, deleted, head, tail, indel that follows) of each covered position, from where the alignment begins."""
    ops = [(int(n), "M" if op in "=X" else op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    parts, x, y = [np.zeros((6, 0), np.int64)], 0, 0
    for k, (n, op) in enumerate(ops):
        before, after = ops[k - 1] if k else (0, "N"), ops[k + 1] if k + 1 < len(ops) else (0, "N")
        if op in "MD" and n:
            one, along = np.zeros((6, n), np.int64), np.arange(n)
            one[0], one[1], one[2] = x + along, y + (along if op == "M" else 0), op == "D"
            if op == "M":
                one[3, 0], one[4, -1] = before[1] in "NSH", after[1] in "NSH"
                one[5, -1] = after[0] if after[1] == "I" else -after[0] if after[1] == "D" else 0
            parts.append(one)
        x, y = x + n * (op in "MDN"), y + n * (op in "MIS")
    found = np.concatenate(parts, axis=1)
    return found[0], found[1], found[2] > 0, found[3] > 0, found[4] > 0, found[5]


@dataclass
class Elements:
    """One entry for each read and covered position; ``base`` is the letter, 0 where the read has none or a deletion."""

    read: np.ndarray
    pos: np.ndarray
    query: np.ndarray
    deleted: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    indel: np.ndarray
    base: np.ndarray
    quality: np.ndarray

    def taken(self, own: np.ndarray) -> Elements:
        return Elements(*[getattr(self, f)[own] for f in self.__dataclass_fields__])


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of text without nulls."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), at


def opened(reads: pa.RecordBatch, low: int | None = None, high: int | None = None) -> Elements:
    """The elements of ``reads`` at positions in [low, high), reads of one CIGAR together, each read's in order."""
    pos, rec_no = reads["pos"].to_numpy(zero_copy_only=False), reads["rec_no"].to_numpy(zero_copy_only=False)
    cigars = reads["cigar"].cast(pa.string()).dictionary_encode()
    number = cigars.indices.to_numpy(zero_copy_only=False)
    bases, base_at = text_of(reads["seq"])
    qualities, quality_at = text_of(reads["qual"]) if "qual" in reads.schema.names else (None, None)

    def letters(text: np.ndarray, at: np.ndarray, read: np.ndarray, place: np.ndarray, missing: int) -> np.ndarray:
        where = at[read] + place
        return np.where(where < at[read + 1], text.take(where, mode="clip"), np.uint8(missing))

    found = []
    for k, cigar in enumerate(cigars.dictionary.to_pylist()):
        own, form = np.flatnonzero(number == k), template(cigar)
        at = pos[own, None] + form[0]
        read, place = np.nonzero(np.ones(at.shape, bool) if low is None else (at >= low) & (at < high))
        at = at[read, place]
        read = own[read]
        query, deleted, head, tail, indel = (x[place] for x in form[1:])
        base = np.where(deleted, np.uint8(0), letters(bases, base_at, read, query, 0))
        base[base == 32] = 0
        if qualities is None:
            quality = 20 + (rec_no[read] + query) % 20
        else:
            # where the qualities end early a base has that of a blank, a deletion none
            quality = np.where(deleted, letters(qualities, quality_at, read, query, 0), letters(qualities, quality_at, read, query, 32)).astype(np.int64) - 33
        found.append(Elements(read, at, query, deleted, head, tail, indel, base, quality))
    if not found:
        return Elements(*[np.zeros(0, t) for t in (int, int, int, bool, bool, bool, int, np.uint8, int)])
    return Elements(*[np.concatenate([getattr(x, f) for x in found]) for f in Elements.__dataclass_fields__])
