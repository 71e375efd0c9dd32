"""Record filters. Each takes and returns an alignment DataFrame (schema of strandlight.plans.fixtures.aln)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.functions import cigar as C

MASKED = C.SECONDARY | C.QC_FAIL | C.DUPLICATE


def _usable() -> Column:
    return C.has("flag", C.PAIRED) & (F.col("qname") != "*") & ~C.has("flag", MASKED)


def orphan_candidates(aln: DataFrame) -> DataFrame:
    """Reads of pairs of which exactly one mate is unmapped."""
    return aln.where(_usable() & (C.has("flag", C.UNMAPPED) != C.has("flag", C.MATE_UNMAPPED)))


def rescue_candidates(aln: DataFrame) -> DataFrame:
    """Reads of pairs with a mapped mate; keeps pairs of two mapped mates too."""
    return aln.where(_usable() & ~(C.has("flag", C.UNMAPPED) & C.has("flag", C.MATE_UNMAPPED)))


def normal_pairs(aln: DataFrame) -> DataFrame:
    """Reads of pairs mapped to one reference, with a size."""
    return aln.where(_usable() & ~C.has("flag", C.UNMAPPED | C.MATE_UNMAPPED) & (F.col("isize") != 0) & (F.col("tid") == F.col("mtid")))


def sv_candidates(aln: DataFrame, stats: DataFrame) -> DataFrame:
    """Reads that cross references, have an unusual orientation, or a size outside their read group's range."""
    usable = aln.where(_usable() & ~C.has("flag", C.UNMAPPED | C.MATE_UNMAPPED)).withColumn("pair_mode", C.pair_mode("flag", "isize"))
    across = F.col("tid") != F.col("mtid")
    usable = usable.where(across | ((F.col("isize") != 0) & (F.col("pair_mode") >= 0)))
    # one row a read group: Spark broadcasts it by its measured size
    known = usable.join(stats.select("rg", "lower", "upper"), "rg")
    return known.where(across | ~F.abs("isize").between(F.col("lower"), F.col("upper")))


def view(aln: DataFrame, min_mapq: int = 0, required: int = 0, excluded: int = 0, groups: list[str] | None = None, library: str | None = None) -> DataFrame:
    """Reads by mapping quality, flag bits, read groups and library; a read without a group passes the group filter."""
    keep = (F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(F.lit(required)) == required) & (F.col("flag").bitwiseAND(F.lit(excluded)) == 0)
    if groups is not None:
        keep &= F.col("rg").isNull() | F.col("rg").isin(groups)
    return aln.where(keep if library is None else keep & (F.col("lib") == library))


def pileup_mask(aln: DataFrame, mask: int = C.UNMAPPED | MASKED) -> DataFrame:
    return aln.where((F.col("tid") >= 0) & (F.col("flag").bitwiseAND(F.lit(C.UNMAPPED | mask)) == 0))


def overlapping(aln: DataFrame, tid: int, begin: int, end: int) -> DataFrame:
    """Reads on a reference that overlap [begin, end); one without a CIGAR has length 1."""
    last = F.greatest(C.end_of("pos", "cigar"), F.col("pos") + 1)
    return aln.where((F.col("tid") == tid) & (F.col("pos") < end) & (last > begin))


def overlapping_any(aln: DataFrame, regions: list[tuple[int, int, int]]) -> DataFrame:
    """Bag union over regions: a read that overlaps two of them appears twice, with the region's number."""
    return reduce(DataFrame.unionByName, [overlapping(aln, *r).withColumn("region", F.lit(i).cast("bigint")) for i, r in enumerate(regions)])


#: Bases of a cell in which reads and regions meet.
REGION_CELL = 1 << 12
#: The same where both are counted by place, so that few of a cell's pairs don't overlap.
COUNT_CELL = 1 << 9


def overlapping_regions(aln: DataFrame, regions: DataFrame, size: int = REGION_CELL) -> DataFrame:
    """Reads with ``region`` for each row (region, tid, begin, end) of a table of regions that they overlap.

    Both meet by an equi-join on the cells of a reference that they touch, in the first cell common to both, so neither
    side is broadcast and no pair comes twice.
    """
    last = F.greatest(C.end_of("pos", "cigar"), F.col("pos") + 1)
    reads = aln.where("tid >= 0").withColumn("last_pos", last - 1)
    reads = reads.withColumn("cell", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor(F.col("last_pos") / size))))
    spans = regions.where("end > begin").select("region", "tid", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size))).alias("cell"))
    met = reads.join(spans, ["tid", "cell"]).where((F.col("pos") < F.col("end")) & (F.col("last_pos") >= F.col("begin")))
    return met.where(F.col("cell") == F.floor(F.greatest("pos", "begin") / size)).select(*aln.columns, "region")


def region_counts(aln: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, n, first, last): how many reads overlap the rows (region, tid, begin, end) of a region, and the least and greatest of their record numbers.

    Reads of one place are counted before they meet regions, and regions of one place meet them once, so deep places
    and many regions don't multiply each other.
    """
    totals = lambda n: [F.sum(n).alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    places = aln.where("tid >= 0").groupBy("tid", "pos", "cigar").agg(F.count(F.lit(1)).alias("n"), F.min("rec_no").alias("first"), F.max("rec_no").alias("last"))
    span = ["tid", "begin", "end"]
    spans = regions.select("region", *span).where("end > begin")
    met = overlapping_regions(places, spans.select(F.struct(*span).alias("region"), *span).distinct(), COUNT_CELL)
    counted = met.groupBy("region").agg(*totals("n")).select(*[F.col(f"region.{c}").alias(c) for c in span], "n", "first", "last")
    return spans.join(counted, span).groupBy("region").agg(*totals("n"))


def site_list(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """(tid, pos, gaps) of text lines ``name pos [gap lengths]``, 1-based: each site once, unknown names left out.

    Cells stand between tabs where a line has any, else between spaces.
    """
    cell = F.when(F.col("value").contains("\t"), F.split(F.trim("value"), r"\t")).otherwise(F.split(F.trim("value"), " +"))
    gaps = F.filter(F.transform(F.slice(cell, 3, 1 << 20), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    found = lines.select(cell[0].alias("rname"), (F.get(cell, F.lit(1)).try_cast("bigint") - 1).alias("pos"), gaps.alias("gaps")).where("pos IS NOT NULL")
    known = found.join(refs.select("tid", "rname"), "rname")
    return known.groupBy("tid", "pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gaps")))).alias("gaps"))


def well_mapped_pairs(pairs: DataFrame, min_mapq: int) -> DataFrame:
    """Pairs (a, b) both of whose reads are mapped with at least ``min_mapq``."""
    good = lambda x: ~C.has(F.col(f"{x}.flag"), C.UNMAPPED) & (F.col(f"{x}.mapq") >= min_mapq)
    return pairs.where(good("a") & good("b"))


def mismatch_filter(mismatches: Column, event: Column, cigar: str, rate: float = 0.1) -> Column:
    """Fewer mismatches outside the event than the rate allows, in single precision."""
    allowed = F.ceil(C.length_of(cigar, "MI").cast("float") * F.lit(rate).cast("float"))
    return mismatches - event < allowed


def aligned_base_filter(query_begin: Column, query_end: Column, length: Column, rate: float = 0.2) -> Column:
    return query_end - query_begin + 1 > F.floor(length.cast("float") * F.lit(rate).cast("float"))
