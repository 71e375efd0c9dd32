"""SimHash near-duplicate components by pigeonring filtering.

A fingerprint has a bit for each of 64 that is set in over half of the hashes of a text's word shingles. Fingerprints link
at DISTANCE or fewer differing bits. Equal ones are one node from the start. The 64 bits form a ring of SEGMENTS
segments. If two fingerprints link, then on some chain of consecutive segments the differences summed up over the first l
segments stay within l * DISTANCE / SEGMENTS, for every l up to the whole ring: pigeonring's proportional budgets. With
2 * DISTANCE + 1 segments the first two of such a chain are equal, so fingerprints meet in an equi-join by a chain's first
two segments, and pairs over the budget of three or of four segments fall out before the full count of differing bits.

No cap on a group: chains' heads that over MOST fingerprints share are not joined pair by pair. There each fingerprint goes to
itself and to its neighbours of one changed bit outside the head; those that meet in one link with each other, at most 65
of them, and two that differ in two bits meet in two. Work is linear in the group, and tasks get it by neighbour. Links become components
by alternating star contraction, with one row for each fingerprint, not for each document.

Defined results: a null, empty or blank text has no words, fingerprint zero, and links like any other; a text of fewer than
three words is one shingle; rows of one id are one document, whatever their texts; a row of a null id links as others
do, but names no component, and a component of such rows alone has a null name; an empty table gives an empty table;
columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import batches, checkpointed
from strandlight.llm.jaccard_join import components

#: Words of a shingle, and seed of its hash.
WORDS, SEED = 3, 42
#: Most differing bits of a link; segments of the ring, so many that a chain's first two are equal.
DISTANCE = 2
SEGMENTS = 2 * DISTANCE + 1
#: Fingerprints that share a chain's head and are compared pair by pair; more take the way by neighbours.
MOST = 256
#: Parts over which the rows of one fingerprint are dealt when they get its component.
SALTS = 16


def segment_masks() -> list[int]:
    edge = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: only A to Z, and only ASCII white space
    if len(words) < WORDS:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*[words[k:] for k in range(WORDS)], strict=False))
    return [xxhash.xxh64_intdigest(r, SEED) for r in runs]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Fingerprints of ``texts``, as unsigned numbers."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    flat = np.array([x for h in hashes for x in h], ">u8")
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        first = (np.cumsum(sizes) - sizes)[some]
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > sizes[some, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row of ``docs``; the fingerprint as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            found = [fingerprints_of(texts[a:b]) for a, b in batches(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def chains(nodes: DataFrame) -> DataFrame:
    """(chain, head, fp): each fingerprint once for each place on the ring where a chain may begin."""
    masks = segment_masks()
    heads = [F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[(i + 1) % SEGMENTS]))).alias("head")) for i in range(SEGMENTS)]
    return nodes.select("fp", F.explode(F.array(*heads)).alias("x")).select("x.chain", "x.head", "fp")


def within_budgets(a: Column, b: Column, chain: Column) -> Column:
    """Whether the differences stay within the budget of each chain of three segments and more, and within DISTANCE."""
    masks = segment_masks()
    differ = a.bitwiseXOR(b)
    good = F.lit(True)
    for n in range(3, SEGMENTS):
        upto = [0] * SEGMENTS
        for i in range(SEGMENTS):
            for k in range(n):
                upto[i] |= masks[(i + k) % SEGMENTS]
        reach = F.element_at(F.array(*[F.lit(signed(m)) for m in upto]), chain + 1)
        good &= F.bit_count(differ.bitwiseAND(reach)) <= n * DISTANCE // SEGMENTS
    return good & (F.bit_count(differ) <= DISTANCE)


def pair_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) among fingerprints that share a chain's head, pair by pair."""
    other = rows.select("chain", "head", F.col("fp").alias("b"))
    met = rows.withColumnRenamed("fp", "a").join(other, ["chain", "head"])
    return met.where((F.col("a") < F.col("b")) & within_budgets(F.col("a"), F.col("b"), F.col("chain"))).select("a", "b")


def neighbour_links(rows: DataFrame) -> DataFrame:
    """Links that join the same fingerprints among those that share a chain's head, by neighbours of one changed bit."""
    masks = segment_masks()
    outside = [[0] + [signed(1 << bit) for bit in range(64) if not (masks[i] | masks[(i + 1) % SEGMENTS]) >> bit & 1] for i in range(SEGMENTS)]
    flips = F.element_at(F.array(*[F.array(*map(F.lit, own)) for own in outside]), F.col("chain") + 1)
    near = rows.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).distinct()
    met = near.groupBy("at").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("a"), "b").where("a <> b")


def fingerprint_links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``nodes`` that pairs of at most DISTANCE differing bits join."""
    rows = checkpointed(chains(nodes))
    sizes = rows.groupBy("chain", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(rows.join(sizes, ["chain", "head"]))
    few = pair_links(shared.where(F.col("n") <= most).select("chain", "head", "fp"))
    return few.unionByName(neighbour_links(shared.where(F.col("n") > most).select("chain", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row of ``docs``."""
    rows = checkpointed(fingerprinted(docs, id_col, text_col))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # rows of one id are one document
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("high")).where("b <> high").select("id", "b")
    same = rows.join(several, "id").select(F.col("fp").alias("a"), "b").where("a <> b")
    groups = components(fingerprint_links(nodes.select("fp"), most).unionByName(same).distinct()).withColumnRenamed("id", "fp")
    # fingerprints without a link are most; they stay out of the joins by group
    grouped = groups.join(nodes, "fp")
    named = grouped.groupBy("group").agg(F.min("least").alias("of_group"))
    linked = checkpointed(grouped.join(named, "group").select("fp", "of_group"))
    of_node = nodes.join(linked, "fp", "left").select("fp", F.coalesce("of_group", "least").alias("component_id"))
    # a third of all rows may share a fingerprint
    of_part = of_node.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    found = parted.join(of_part, ["fp", "part"])
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
