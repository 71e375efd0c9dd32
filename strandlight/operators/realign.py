"""Genotypes of gaps by realignment: reads are aligned anew to each haplotype that a site's gaps propose.

A site is a position after which some read has an insertion or a deletion. Its haplotypes, one for each length seen and
one for none, are made of the reference around it. Reads alike in place, CIGAR, bases and qualities are counted first;
those and sites are dealt to the tasks of short cells of the reference, a deep cell to several, where reads pass in batches
and each that covers a site is aligned once. What remains of a site are a few numbers for each haplotype and each two of
them, which add up by aggregation: from these the two best haplotypes are chosen and the reads weighed between them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.functions import cigar as C
from strandlight.functions import global_alignment as G
from strandlight.operators import pileup
from strandlight.operators.pileup import key_stretches
from strandlight.operators.sorting import checkpointed

#: Bases of the reference on each side of a site that reads are aligned to, and of a cell in which reads and sites meet.
WINDOW, CELL = 50, 128
#: Kinds of reads (place, CIGAR and bases) of a cell that go to one task, and that are passed at once.
SHARE, BLOCK = 400, 500
#: Quality of a gap in sequencing, dependency of its further lengths, rates of gaps and of SNPs between haplotypes.
GAP_QUALITY, GAP_DEPENDENCY, GAP_RATE, SNP_RATE, CAP = 40, 0.9, 0.00015, 0.001, 60
PHRED = 4.343
#: Penalty of a read that has no base of a haplotype.
WORST = 1 << 20
#: Pairs that are aligned side by side, and that are looked at whether they need to be.
SIDE, LOOK = 4096, 8192
SCORES = G.Scores(gap_end=0)
_CODES = np.full(256, G.UNKNOWN, np.uint8)
_CODES[list(b"ACGTacgt")] = [0, 1, 2, 3, 0, 1, 2, 3]


def gap_rows(aln: DataFrame) -> DataFrame:
    """(tid, pos, indel, inserted, n): one row for each gap of a placed read, at the last aligned base before it; ``n`` reads alike are one."""
    reads = aln.where(F.col("cigar").rlike("[ID]")).groupBy("tid", "pos", "cigar", "seq").agg(F.count(F.lit(1)).alias("n")).select("tid", "pos", "seq", "n", C.walked(C.operations("cigar")).alias("ops"))
    at = reads.select("tid", "pos", "seq", "n", "ops", F.posexplode("ops").alias("i", "x"))
    after = F.get("ops", F.col("i") + 1)
    found = at.where((F.col("x.op") == "M") & after["op"].isin("I", "D"))
    indel = F.when(after["op"] == "I", after["len"]).otherwise(-after["len"]).cast("bigint")
    inserted = F.when(after["op"] == "I", F.substring("seq", after["query"] + 1, after["len"]))
    return found.select("tid", (F.col("pos") + F.col("x.ref") + F.col("x.len") - 1).alias("pos"), indel.alias("indel"), inserted.alias("inserted"), "n")


def inserted_text(gaps: DataFrame) -> DataFrame:
    """(tid, pos, indel, text): for each length inserted after a position the commonest base of each place, N where none is known."""
    bases = gaps.where("indel > 0").select("tid", "pos", "indel", "n", F.posexplode(F.split(F.upper("inserted"), "")).alias("k", "base")).where("base <> ''")
    code = F.array_position(F.array(*map(F.lit, "ACGT")), F.col("base"))
    counted = bases.groupBy("tid", "pos", "indel", "k", code.alias("code")).agg(F.sum("n").alias("n"))
    best = counted.groupBy("tid", "pos", "indel", "k").agg(F.max(F.when(F.col("code") > 0, F.struct("n", -F.col("code")))).alias("b"))
    letter = F.when(F.col("b").isNull(), "N").otherwise(F.substring(F.lit("TGCA"), (F.col("b.col2") + 5).cast("int"), F.lit(1)))
    return best.select("tid", "pos", "indel", F.struct("k", letter.alias("letter")).alias("x")).groupBy("tid", "pos", "indel").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["letter"]), "").alias("text"))


def gap_sites(aln: DataFrame, refs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(tid, pos, left, ref, kinds): sites with the reference around them and their haplotypes, array<struct<indel,text>> by length.

    ``text`` is what is inserted. The window reaches as many bases further as the longest deletion takes.
    ``proposed`` (tid, pos, indel) adds lengths that need not be seen, as a list of sites may.
    """
    gaps = gap_rows(aln)
    seen = gaps.select("tid", "pos", "indel").distinct()
    if proposed is not None:
        seen = seen.unionByName(proposed.where("indel <> 0").select("tid", "pos", "indel")).distinct()
    kinds = seen.join(inserted_text(gaps), ["tid", "pos", "indel"], "left")
    shown = F.coalesce("text", F.repeat(F.lit("N"), F.greatest(F.col("indel"), F.lit(0)).cast("int")))
    none = F.struct(F.lit(0).cast("bigint").alias("indel"), F.lit("").alias("text"))
    sites = kinds.groupBy("tid", "pos").agg(F.array_sort(F.concat(F.collect_list(F.struct("indel", shown.alias("text"))), F.array(none))).alias("kinds"))
    left = F.greatest(F.col("pos") - WINDOW, F.lit(0))
    sites = checkpointed(sites.withColumn("left", left))
    size = F.col("pos") + WINDOW - F.least(F.get("kinds", F.lit(0))["indel"], F.lit(0)) - F.col("left")
    around = pileup.stretches(sites.select("tid", "pos", F.col("left").alias("begin"), size.alias("size")), refs, ["tid", "pos"])
    return sites.join(around.withColumnRenamed("text", "ref"), ["tid", "pos"])


@lru_cache(1 << 14)
def operations(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), "M" if op in "=X" else op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def places(cigar: str, targets: np.ndarray, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place in the read, place on the reference) of each of ``targets``, all counted from where the alignment begins.

    In a gap that a target falls into, the read's place is the gap, and the reference's its end, or its begin if ``at_end``.
    """
    found = np.full((2, len(targets)), -1, np.int64)
    x, y, last, open_ = 0, 0, 0, np.ones(len(targets), bool)

    def put(which: np.ndarray, query: np.ndarray | int, ref: np.ndarray | int) -> None:
        nonlocal open_
        which = which & open_
        found[0], found[1] = np.where(which, query, found[0]), np.where(which, ref, found[1])
        open_ = open_ & ~which

    for n, op in operations(cigar):
        if op == "M":
            put(targets < 0, y, 0)
            put(targets < x + n, y + targets - x, targets)
            x, y = x + n, y + n
            last = y
        elif op in "IS":
            y += n
        elif op in "DN":
            put(targets < x + n, y, x if at_end else x + n)
            x += n
    put(open_, last, x)
    return found[0], found[1]


#: Longest span on the reference of which ``places`` are kept for all targets.
KEPT = 1 << 12


def span_of(cigar: str) -> int:
    return sum(n for n, op in operations(cigar) if op in "MDN")


@lru_cache(1 << 12)
def all_places(cigar: str, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    return places(cigar, np.arange(-1, span_of(cigar) + 1), at_end)


def placed(cigar: str, targets: np.ndarray, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """``places``, looked up where the alignment is short."""
    if (span := span_of(cigar)) > KEPT:
        return places(cigar, targets, at_end)
    own = np.clip(targets, -1, span) + 1
    query, ref = all_places(cigar, at_end)
    return query[own], ref[own]


@lru_cache(1 << 12)
def own_gaps(cigar: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(stretches of the reference that the read has bases or a deletion of, length of the gap after each of its places that has one)."""
    x, kept, gaps, here = 0, [], {}, None
    for n, op in operations(cigar):
        if op in "ID" and x and x - 1 not in gaps and here == "M":
            gaps[x - 1] = n if op == "I" else -n
        if op in "MD":
            kept.append((x, x + n))
        if op in "MDN":
            x, here = x + n, op
    return kept, gaps


def haplotypes(ref: str, before: int, kinds: list[dict]) -> list[np.ndarray]:
    """Codes of each haplotype: ``before`` bases of ``ref`` and the site's, what is inserted, and the rest.

    What the longest deletion takes is unknown in those that keep it, so that none gains from it.
    """
    codes = _CODES[np.frombuffer(ref.encode(), np.uint8)]
    head = codes[: before + 1]
    longest = max(0, -min(k["indel"] for k in kinds))
    rest = codes[before + 1 + longest :]
    masked = min(longest, max(0, len(codes) - before - 1))
    return [np.concatenate([head, _CODES[np.frombuffer(k["text"].encode(), np.uint8)], np.full(max(0, masked + min(k["indel"], 0)), G.UNKNOWN, np.uint8), rest]) for k in kinds]


def penalties(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(score, bases in inner gaps, places of mismatches in the read's part) of pairs (haplotype's part, read's part, band)."""
    n, m, band = (np.array(x, np.int64) for x in ([len(a) for a, _, _ in parts], [len(b) for _, b, _ in parts], [w for _, _, w in parts]))
    texts = [np.concatenate([np.zeros(0, np.uint8), *[p[i] for p in parts]]) for i in range(2)]
    score, gaps, pair, place = penalties_of(texts[0], np.cumsum(n) - n, n, texts[1], np.cumsum(m) - m, m, band)
    order = np.argsort(pair, kind="stable")
    return score, gaps, np.split(place[order], np.cumsum(np.bincount(pair, minlength=len(parts)))[:-1])


def _cut(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parts of ``text`` side by side, filled up with UNKNOWN."""
    along = np.arange(max(1, int(size.max(initial=0))))
    return np.where(along < size[:, None], text.take(begin[:, None] + along, mode="clip"), np.uint8(G.UNKNOWN)) if len(text) else np.full((len(size), len(along)), G.UNKNOWN, np.uint8)


def penalties_of(haps: np.ndarray, hap_at: np.ndarray, n: np.ndarray, reads: np.ndarray, read_at: np.ndarray, m: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, bases in inner gaps) of pairs of ``n`` bases of ``haps`` from ``hap_at`` and ``m`` of ``reads`` from ``read_at``, and (pair, place in the read's part) of their mismatches.

    Parts of one length that differ in few places align without a gap: two gaps cost more than what that could win.
    """
    score, gaps = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    wrong: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    easy = m == 0  # nothing to align
    alike = np.flatnonzero((n == m) & ~easy)
    for own in np.split(alike, range(LOOK, len(alike), LOOK)):
        a, b = _cut(haps, hap_at[own], n[own]), _cut(reads, read_at[own], m[own])
        within = np.arange(a.shape[1]) < n[own, None]
        unlike, unknown = (a != b) & within, ((a == G.UNKNOWN) | (b == G.UNKNOWN)) & within
        bad, unclear = (unlike & ~unknown).sum(1), unknown.sum(1)
        few = (SCORES.match - SCORES.mismatch) * bad + (SCORES.match - SCORES.unknown) * unclear < 2 * SCORES.gap_open + 1
        score[own] = np.where(few, (n[own] - bad - unclear) * SCORES.match + bad * SCORES.mismatch + unclear * SCORES.unknown, 0)
        pair, place = np.nonzero(unlike & (a != G.UNKNOWN) & few[:, None])
        wrong.append((own[pair], place))
        easy[own] = few
    hard = np.flatnonzero(~easy)
    # pairs of one shape of band are passed together, and those of like lengths beside each other
    above, below = G.band_of(n[hard], m[hard], band[hard])
    order = np.lexsort((m[hard], above, below))
    hard, shape = hard[order], np.stack([above, below])[:, order]
    bounds = np.flatnonzero((shape[:, 1:] != shape[:, :-1]).any(0)) + 1
    for own in [part for same in np.split(hard, bounds) for part in np.split(same, range(SIDE, len(same), SIDE)) if len(part)]:
        a, b = _cut(haps, hap_at[own], n[own]), _cut(reads, read_at[own], m[own])
        score[own], path = G.align_padded(a, n[own], b, m[own], band[own], SCORES)
        gaps[own] = G.inner_gaps(path).sum(0)
        matched = path == G.MATCH
        i = n[own].astype(np.int32) - np.cumsum(matched | (path == G.DELETION), axis=0, dtype=np.int32)
        j = m[own].astype(np.int32) - np.cumsum(matched | (path == G.INSERTION), axis=0, dtype=np.int32)
        # beyond a path's end both are 0, and where it isn't a match they aren't looked at
        x = a.ravel().take(i + np.arange(len(own), dtype=np.int32) * a.shape[1], mode="clip")
        y = b.ravel().take(j + np.arange(len(own), dtype=np.int32) * b.shape[1], mode="clip")
        step, pair = np.nonzero((x != y) & (x != G.UNKNOWN) & matched)
        wrong.append((own[pair], j[step, pair].astype(np.int64)))
    return score, gaps, np.concatenate([w[0] for w in wrong]), np.concatenate([w[1] for w in wrong])


#: What two haplotypes that differ by so many numbers can be worth at most in one read.
WORTH = np.array([int(GAP_QUALITY * (1 - GAP_DEPENDENCY ** (k + 1)) / (1 - GAP_DEPENDENCY)) for k in range(200)])


class Cell:
    """Sites of a cell and what the reads that have passed add up to.

    For each site: depth, squares of mapping qualities; for each haplotype its penalties and the reads that show it;
    for each two (a, b) what ``a`` loses to ``b``, the reads that fit none better than both, and as well as one of them.
    """

    def __init__(self, sites: list[dict]) -> None:
        self.sites = sorted(sites, key=lambda r: r["pos"])
        get = lambda f: np.array([f(r) for r in self.sites], np.int64)
        self.pos, self.left, self.end = get(lambda r: r["pos"]), get(lambda r: r["left"]), get(lambda r: r["left"] + len(r["ref"]))
        self.kinds = get(lambda r: len(r["kinds"]))
        self.band = get(lambda r: 2 * max(0, r["kinds"][-1]["indel"]) + 2)
        size, most = len(self.sites), int(self.kinds.max())
        self.used = np.arange(most) < self.kinds[:, None]
        self.indel, self.hap_at, self.hap_end = np.zeros((3, size, most), np.int64)
        self.none = np.zeros(size, np.int64)
        texts, at = [], 0
        for k, r in enumerate(self.sites):
            for z, (kind, hap) in enumerate(zip(r["kinds"], haplotypes(r["ref"], r["pos"] - r["left"], r["kinds"]), strict=True)):
                self.indel[k, z], self.hap_at[k, z], self.hap_end[k, z] = kind["indel"], at, at + len(hap)
                texts.append(hap)
                at += len(hap)
                if kind["indel"] == 0:
                    self.none[k] = z
        self.haps = np.concatenate(texts)
        between = np.abs(np.subtract.outer(np.arange(most), np.arange(most)))
        self.worth = WORTH[np.minimum(between, len(WORTH) - 1)].astype(float)
        # whole numbers below 2^53, as sums of products of which are exact
        self.depth, self.squares = np.zeros((2, size))
        self.lost, self.shown = np.zeros((2, size, most))
        self.loses, self.better, self.unclear = np.zeros((3, size, most, most))

    def add(self, rows: list[tuple]) -> None:
        """Reads (at, cigar, seq, qual, n, squares), those of one alignment side by side."""
        kinds = [(key, list(own)) for key, own in groupby(rows, key=lambda r: r[:3])]
        for first in range(0, len(kinds), BLOCK):
            self._block(kinds[first : first + BLOCK])

    def _block(self, kinds: list[tuple[tuple, list[tuple]]]) -> None:
        parts, met, offset, texts = [], [], 0, []
        for (at, cigar, seq), rows in kinds:
            kept, gaps = own_gaps(cigar)
            own = np.concatenate([np.zeros(0, np.int64), *[np.arange(*np.searchsorted(self.pos, (at + a, at + b))) for a, b in kept]])
            if not len(own):
                continue
            q0, t0 = placed(cigar, self.left[own] - at, False)
            q1, t1 = placed(cigar, self.end[own] - at, True)
            shown = np.zeros(len(own), np.int64)
            for place, length in gaps.items():
                shown[self.pos[own] == at + place] = length
            parts.append(np.stack([own, q0, q1, t0 + at, t1 + at, shown, np.full(len(own), offset)]))
            met.append((len(own), len(seq), rows))
            texts.append(_CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)])
            offset += len(seq)
        if not parts:
            return
        site, q0, q1, t0, t1, shown, text = np.concatenate(parts, axis=1)
        size = (t1 - t0)[:, None] + self.indel[site]
        valid = self.used[site] & (size > 0)
        begin = self.hap_at[site] + (t0 - self.left[site])[:, None]
        n = np.maximum(np.minimum(size, self.hap_end[site] - begin), 0)
        most = self.used.shape[1]
        flat = np.flatnonzero(valid)
        pair = flat // most
        score, gaps = np.zeros((2, len(site) * most), np.int64)
        score[flat], gaps[flat], which, place = penalties_of(self.haps, begin.ravel()[flat], n.ravel()[flat], np.concatenate(texts), (text + q0)[pair], np.maximum(q1 - q0, 0)[pair], self.band[site][pair])
        wrong = np.zeros((len(site) * most, max(len(t) for t in texts)), np.float32)
        wrong[flat[which], place + q0[pair[which]]] = 1
        score, gaps = score.reshape(-1, most), GAP_QUALITY * gaps.reshape(-1, most)
        score[self.used[site] & ~valid] = -WORST
        cap = int(-PHRED * math.log(SNP_RATE) + 0.499)
        first = 0
        for count, length, rows in met:
            part = slice(first, first + count)
            first += count
            own = site[part]
            quality = np.zeros((len(rows), wrong.shape[1]), np.float32)
            for k, r in enumerate(rows):
                here = np.frombuffer(r[3].encode("latin-1", "replace"), np.uint8)[:length]
                quality[k, : len(here)] = np.minimum(here.astype(np.int64) - 33, cap)
            reads = np.array([r[4] for r in rows], float)
            lost = (wrong[part.start * most : part.stop * most] @ quality.T).astype(float).reshape(count, most, -1) + gaps[part, :, None]
            lost[self.used[own] & ~valid[part]] = WORST
            self.lost[own] += lost @ reads
            self.loses[own] += np.clip(lost[:, :, None] - lost[:, None], 0, self.worth[None, :, :, None]) @ reads
            lead = score[part][np.arange(count), self.none[own], None] - score[part]
            over, same = lead > 0, lead == 0
            both = over[:, :, None] & over[:, None]
            self.better[own] += both * reads.sum()
            self.unclear[own] += ((same[:, :, None] | same[:, None]) & ~both) * reads.sum()
            self.shown[own] += (self.used[own] & (self.indel[own] == shown[part, None])) * reads.sum()
            self.depth[own] += reads.sum()
            self.squares[own] += sum(r[5] for r in rows)

    def sums(self) -> Iterator[tuple[int, list[int]]]:
        """(pos, tally) of the sites that reads cover."""
        for k, r in enumerate(self.sites):
            if self.depth[k]:
                z = int(self.kinds[k])
                yield r["pos"], np.concatenate([[self.depth[k], self.squares[k]], self.lost[k, :z], self.shown[k, :z], *[x[k, :z, :z].ravel() for x in (self.loses, self.better, self.unclear)]]).astype(np.int64).tolist()


def counted(aln: DataFrame) -> DataFrame:
    """(tid, at, cigar, seq, qual, n, squares): placed mapped reads alike as one, with their number and the sum of squares of their capped mapping qualities."""
    reads = pileup.with_qualities(aln).where((F.col("tid") >= 0) & ~C.has("flag", C.UNMAPPED))
    capped = F.least("mapq", F.lit(CAP))
    return reads.groupBy("tid", F.col("pos").alias("at"), "cigar", "seq", "qual").agg(F.count(F.lit(1)).alias("n"), F.sum(capped * capped).alias("squares"))


def tallied(aln: DataFrame, sites: DataFrame) -> DataFrame:
    """(tid, pos, t): what the reads over each site add up to, ``Cell.sums`` as one array."""
    cell = lambda x: F.floor(x / CELL)
    reads = checkpointed(counted(aln)).withColumn("cell", F.explode(pileup.touched(CELL, "at")))
    loads = reads.groupBy("tid", "cell").agg((F.floor(F.approx_count_distinct(F.xxhash64("at", "cigar", "seq")) / SHARE) + 1).alias("parts"))
    loads = checkpointed(loads)
    reads = reads.join(loads, ["tid", "cell"]).withColumns({"part": F.pmod(F.xxhash64("at", "cigar", "seq"), F.col("parts")), "side": F.lit(1).cast("bigint")}).drop("parts")
    placed_ = sites.withColumn("cell", cell(F.col("pos"))).join(loads, ["tid", "cell"])
    placed_ = placed_.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)), "side": F.lit(0).cast("bigint")}).drop("parts")
    both = placed_.unionByName(reads, allowMissingColumns=True)
    key, own = ["tid", "cell", "part", "side"], ["pos", "left", "ref", "kinds"]
    read = ["at", "cigar", "seq", "qual", "n", "squares"]
    # the program is the costly part: a stated number of tasks, whatever the size of what comes before it
    tasks = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, "tid", "cell", "part").sortWithinPartitions(*key, "at", "cigar", "seq").select(*[F.col(k).cast("bigint") for k in key], *own, *read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tid, *_), group in groupby(key_stretches(batches, len(key)), lambda x: x[0][:3]):
            held, passed = [], None
            for (*_, side), rows in group:
                if side == 0:
                    held += rows.select(own).to_pylist()
                elif held:
                    passed = passed or Cell(held)
                    passed.add(list(zip(*(rows[c].to_pylist() for c in read), strict=True)))
            if passed:
                found = list(passed.sums())
                yield pa.RecordBatch.from_arrays([pa.array([tid] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["tid", "pos", "t"])

    parts = dealt.mapInArrow(run, "tid bigint, pos bigint, t array<bigint>")
    sums = parts.select("tid", "pos", F.posexplode("t").alias("i", "x")).groupBy("tid", "pos", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("tid", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("t"))


def best_two(tallies: DataFrame, sites: DataFrame) -> DataFrame:
    """``tallies`` with (size, none, a, b, indel_a, indel_b, allele_a, allele_b): how many haplotypes there are, numbers of the one without
    a gap and of the two that all reads fit best, the shorter length first among equals, and what these two show."""
    found = tallies.join(sites, ["tid", "pos"]).withColumn("size", F.size("kinds"))
    ranked = F.array_sort(F.transform(F.slice("t", F.lit(3), F.col("size")), lambda x, k: F.struct(x.alias("lost"), k.alias("k"))))
    found = found.withColumn("r", F.slice(ranked, 1, 2)).withColumns({"a": F.get("r", F.lit(0))["k"], "b": F.get("r", F.lit(1))["k"]})
    own = lambda x: F.get("kinds", F.col(x))

    def shown(x: Column) -> Column:
        gone = F.substring("ref", (F.col("pos") - F.col("left") + 2).cast("int"), (-x["indel"]).cast("int"))
        return F.when(x["indel"] > 0, F.concat(F.lit("+"), x["text"])).when(x["indel"] < 0, F.concat(F.lit("-"), F.upper(gone))).otherwise("*")

    none = (F.array_position(F.transform("kinds", lambda x: x["indel"]), 0) - 1).cast("int")
    return found.select("tid", "pos", "t", "size", none.alias("none"), "a", "b", own("a")["indel"].alias("indel_a"), own("b")["indel"].alias("indel_b"), shown(own("a")).alias("allele_a"), shown(own("b")).alias("allele_b"))


def indel_genotypes(aln: DataFrame, refs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(tid, pos, cons, gap_q, snp_q, rms_q, depth, allele1, allele2, n1, n2, n_other, n_ref, n_unclear,
    likelihood): the genotype of each site of gaps.

    ``allele1`` and ``allele2`` are the two haplotypes that the reads fit best (none is ``*``), ``n1`` and ``n2`` the reads
    whose own alignment shows them, ``n_other`` the rest. Where neither is the haplotype without a gap, ``n_ref`` reads
    fit that better than both, ``n_unclear`` as well as one of them. ``gap_q`` is the genotype's lead over the next, ``snp_q``
    over that without a gap; ``likelihood`` has what speaks against either haplotype and against both.
    """
    sites = checkpointed(gap_sites(aln, refs, proposed))
    met = best_two(checkpointed(tallied(aln, sites)), sites)
    both_gaps = (F.col("indel_a") != 0) & (F.col("indel_b") != 0)
    at = lambda k: F.get("t", k.cast("int"))
    # after depth and squares one number a haplotype for each of two, then one for each two haplotypes for each of three
    shows = lambda x: at(2 + F.col("size") + F.col(x))
    two = lambda part, x, y: at(2 + 2 * F.col("size") + part * F.col("size") * F.col("size") + F.col(x) * F.col("size") + F.col(y))
    depth, zero = at(F.lit(0)), F.lit(0).cast("bigint")
    found = met.select(
        "tid", "pos", "allele_a", "allele_b", two(0, "a", "b").alias("q0"), two(0, "b", "a").alias("q1"), depth.alias("depth"),
        F.floor(F.sqrt(at(F.lit(1)) / depth) + 0.499).cast("bigint").alias("rms_q"), shows("a").alias("n1"), shows("b").alias("n2"),
        F.when(both_gaps, two(1, "a", "b")).otherwise(zero).alias("n_ref"), F.when(both_gaps, two(2, "a", "b")).otherwise(zero).alias("n_unclear"),
    )
    prior = int(-PHRED * math.log(GAP_RATE) + 0.5)
    found = found.withColumn("q2", F.col("depth") * 3 + prior)
    found = found.withColumn("ranked", F.sort_array(F.array(*[F.struct(F.col(f"q{g}").alias("q"), F.lit(g).alias("g")) for g in range(3)])))
    g, one, two = F.col("ranked")[0]["g"], F.col("allele_a"), F.col("allele_b")
    cons = F.when(g == 0, F.concat(one, F.lit("/"), one)).when(g == 1, F.concat(two, F.lit("/"), two)).otherwise(F.concat(one, F.lit("/"), two))
    first = F.when(g == 0, F.when(one == "*", 0).otherwise(F.col("q1") - F.col("q0") - prior - 3)).when(g == 1, F.when(two == "*", 0).otherwise(F.col("q0") - F.col("q1") - prior - 3))
    led = F.coalesce(first, F.when(one == "*", F.col("q0")).otherwise(F.col("q1")) - F.col("q2"))
    return found.select(
        "tid", "pos", cons.alias("cons"), (F.col("ranked")[1]["q"] - F.col("ranked")[0]["q"]).alias("gap_q"), F.greatest(led, F.lit(0)).cast("bigint").alias("snp_q"), "rms_q", "depth",
        one.alias("allele1"), two.alias("allele2"), "n1", "n2", (F.col("depth") - F.col("n1") - F.col("n2")).alias("n_other"), "n_ref", "n_unclear",
        F.array("q0", "q1", F.col("depth") * 3).alias("likelihood"),
    )
