"""Best-fit packing of tokenised documents by sum of squares.

Texts become token ids; a document over the sequence length is cut so that only its first piece is
shorter. Pieces are dealt at random over shards of bounded size, and each shard packs its own: a piece goes where the
sum, over gaps, of the squared number of open sequences with that gap becomes smallest; at the
end the pieces of sequences left unfilled are packed once more by best fit. A shard leaves few sequences
unfilled and holds thousands, so what its borders cost is small at any size.

Defined results: a null or empty text is its end token alone; texts of any length are cut, none dropped; repeated
rows and rows of a null id are packed each; pieces of full length have a sequence of their own; pieces of equal length are
placed by id, piece and ids; an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import checkpointed

CAPACITY, END = 1024, 2
#: Pieces that a shard holds on average.
SHARD_PIECES = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer file's own vocabulary is read as merge ranks by the faster of two libraries, whose ids are the same;
    a text that holds the string of a special token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [t["content"] for t in parts["added_tokens"]]
        of = byte_characters()
        ranks = {bytes(of[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in self.special}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, text: str | None) -> bytes:
        if text and any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text or "")
        return np.array(ids, "<u4").tobytes()


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; the first takes what full ones leave."""
    n = len(ids) // 4
    cuts = list(range(n % capacity or capacity, n + 1, capacity))
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer), np.asarray([END], "<u4").tobytes()
        for batch in rows:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                found = [pieces_of(ids + end, capacity) for ids in map(encode, part.column(1).to_pylist())]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = np.array([(k, *p) for f in found for k, p in enumerate(f)], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *[pa.array(flat[:, i]) for i in range(4)]], names=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, f"id {source.schema['id'].dataType.simpleString()}, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; those of gap 0 are closed and not counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, new = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        fits = np.flatnonzero(count[size:capacity]) + size
        after = capacity - size
        gap, cost = capacity, 2 * count[after] + 1 if after else 0
        if len(fits):
            costs = 2 * (np.where(fits > size, count[fits - size] + 1, 0) - count[fits]) + (fits == size)
            k = int(costs.argmin())
            if costs[k] <= cost:
                gap = int(fits[k])
        if gap == capacity:
            sequence[i], new = new, new + 1
        else:
            sequence[i] = open_[gap].pop()
            count[gap] -= 1
        offset[i] = capacity - gap
        if gap > size:
            open_[gap - size].append(int(sequence[i]))
            count[gap - size] += 1
    return sequence, offset


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the given order, each in the fullest sequence that has room."""
    gaps: list[tuple[int, int]] = []
    sequence, offset, new = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        k = bisect.bisect_left(gaps, (size, -1))
        gap, at = gaps.pop(k) if k < len(gaps) else (capacity, new)
        new += at == new
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            bisect.insort(gaps, (gap - size, at))
    return sequence, offset


def packed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of descending ``lengths``; what stands in sequences left unfilled is packed once more by best fit if that saves any."""
    sequence, offset = sum_of_squares(lengths, capacity)
    filled = np.bincount(sequence, lengths) == capacity
    loose = np.flatnonzero(~filled[sequence])
    again, place = best_fit(lengths[loose], capacity)
    if len(loose) and again.max() + 1 < np.count_nonzero(~filled):
        sequence, offset = sequence.copy(), offset.copy()
        sequence[loose], offset[loose] = len(filled) + again, place
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = checkpointed(tokenized(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col))
    shards = max(1, round(found.count() / SHARD_PIECES))
    kind = found.schema["id"].dataType.simpleString()

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sequence, offset = packed(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=sequence * shards + key[0], offset=offset).drop(columns="shard")

    # with the row's own number, so that pieces of equal ids spread too
    shard = F.pmod(F.xxhash64("id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    names = f"id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = found.select("*", shard).groupBy("shard").applyInPandas(place, names)
    return placed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
