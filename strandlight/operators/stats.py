"""Counts over alignments: flags, references, read groups, fragment lengths, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions import cigar as C


def flagstat(aln: DataFrame) -> DataFrame:
    """Twelve counters in one row."""
    unmapped, mate = C.has("flag", C.UNMAPPED), C.has("flag", C.MATE_UNMAPPED)
    paired = C.has("flag", C.PAIRED)
    both = paired & ~unmapped & ~mate
    across = both & (F.col("tid") != F.col("mtid"))
    counters = {
        "total": F.lit(True), "qcfail": C.has("flag", C.QC_FAIL), "duplicates": C.has("flag", C.DUPLICATE), "mapped": ~unmapped, "paired": paired,
        "read1": paired & C.has("flag", C.READ1), "read2": paired & C.has("flag", C.READ2), "proper": paired & C.has("flag", C.PROPER),
        "both_mapped": both, "singletons": paired & mate & ~unmapped, "mate_other_ref": across, "mate_other_ref_q5": across & (F.col("mapq") >= 5),
    }
    return aln.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def idxstats(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """For each reference its mapped and unmapped reads, and a row ``*`` of those placed nowhere."""
    counts = aln.groupBy("tid").agg(F.count_if(~C.has("flag", C.UNMAPPED)).alias("mapped"), F.count_if(C.has("flag", C.UNMAPPED)).alias("unmapped"))
    placed = refs.join(counts, "tid", "left").select("rname", "len", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mapped", "unmapped")])
    nowhere = aln.where("tid < 0").agg(F.count(F.lit(1)).alias("unmapped")).select(F.lit("*").alias("rname"), F.lit(0).cast("bigint").alias("len"), F.lit(0).cast("bigint").alias("mapped"), "unmapped")
    return placed.unionByName(nowhere)


def fragment_histogram(aln: DataFrame, modes: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(rg, frag_len, freq) over normal pairs of valid orientation; one row a pair, from the mate of positive size."""
    sized = aln.where((F.col("isize") > 0) & C.pair_mode("flag", "isize").isin(*modes))
    return sized.groupBy("rg", F.abs("isize").alias("frag_len")).agg(F.count(F.lit(1)).alias("freq"))


def mode_counts(aln: DataFrame, modes: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(rg, valid, invalid): reads of pairs whose orientation is one of ``modes``, and of others."""
    valid = F.count_if(C.pair_mode("flag", "isize").isin(*modes))
    return aln.groupBy("rg").agg(valid.alias("valid"), (F.count(F.lit(1)) - valid).alias("invalid"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """The histogram with the running count and all pairs of the read group."""
    by = Window.partitionBy("rg")
    return histogram.withColumns({"upto": F.sum("freq").over(by.orderBy("frag_len")), "all": F.sum("freq").over(by)})


def fragment_stats(histogram: DataFrame) -> DataFrame:
    """(rg, n, mean, median, stdev): the median is the first length whose cumulated share is half or more."""
    sums = cumulative(histogram).groupBy("rg").agg(
        F.sum("freq").alias("n"), F.sum(F.col("freq") * F.col("frag_len")).alias("s"), F.sum(F.col("freq") * F.col("frag_len") * F.col("frag_len")).alias("ss"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("frag_len"))).alias("median"),
    )
    square = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return sums.select("rg", "n", (F.col("s") / F.col("n")).alias("mean"), "median", F.sqrt(F.greatest(square, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("stdev"))


def fragment_cutoffs(histogram: DataFrame, tail: float) -> DataFrame:
    """(rg, lower, upper): first length whose share reaches the tail, last whose share stays under one less it."""
    share = F.col("upto") / F.col("all")
    return cumulative(histogram).groupBy("rg").agg(F.min(F.when(share >= tail, F.col("frag_len"))).alias("lower"), F.max(F.when(share <= 1 - tail, F.col("frag_len"))).alias("upper"))


def covered(aln: DataFrame) -> DataFrame:
    """(tid, begin, end) of the stretches that reads cover by matches and deletions, without skips."""
    ops = aln.select("tid", "pos", F.explode(C.walked(C.operations("cigar"))).alias("x")).where(F.col("x.op").isin("M", "D"))
    return ops.select("tid", (F.col("pos") + F.col("x.ref")).alias("begin"), (F.col("pos") + F.col("x.ref") + F.col("x.len")).alias("end"))


def depth(aln: DataFrame) -> DataFrame:
    """(tid, pos, depth) of covered positions: stretches become positions, summed where they meet."""
    at = covered(aln).groupBy("tid", "begin", "end").agg(F.count(F.lit(1)).alias("n"))
    return at.select("tid", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"), "n").groupBy("tid", "pos").agg(F.sum("n").alias("depth"))


def coverage_runs(spans: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(tid, begin, end, depth) of maximal stretches of one depth, by sweeping the changes at stretches' ends.

    Spans are cut at bucket borders, so a sweep's window is one bucket of one reference. Of each bucket only the runs
    that touch its borders, two at most, go on to be joined with those of the next.
    """
    low, high = F.floor(F.col("begin") / bucket), F.floor((F.col("end") - 1) / bucket)
    cut = spans.where("end > begin").select("tid", "begin", "end", F.explode(F.sequence(low, high)).alias("bucket"))
    cut = cut.select("tid", "bucket", F.greatest("begin", F.col("bucket") * bucket).alias("begin"), F.least("end", (F.col("bucket") + 1) * bucket).alias("end"))
    change = cut.select("tid", "bucket", F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    change = change.groupBy("tid", "bucket", "e.at").agg(F.sum("e.d").alias("d")).where("d != 0")
    order = Window.partitionBy("tid", "bucket").orderBy("at")
    runs = change.select("tid", F.col("at").alias("begin"), F.lead("at").over(order).alias("end"), F.sum("d").over(order).alias("depth")).where("depth > 0")
    touches = (F.col("begin") % bucket == 0) | (F.col("end") % bucket == 0)
    along = Window.partitionBy("tid").orderBy("begin")
    follows = (F.lag("end").over(along) == F.col("begin")) & (F.lag("depth").over(along) == F.col("depth"))
    edge = runs.where(touches).withColumn("new", F.when(follows, 0).otherwise(1))
    joined = edge.withColumn("run", F.sum("new").over(along)).groupBy("tid", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("depth").alias("depth"))
    return runs.where(~touches).unionByName(joined.drop("run"))


def islands(spans: DataFrame, key: str = "tid", bucket: int = 1 << 16) -> DataFrame:
    """(key, begin, end): stretches joined where one begins within what those before it reach.

    Stretches are joined by bucket of their begin first, and what comes of that over the whole reference, as joining
    joined stretches gives the same.
    """

    def joined(found: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("begin", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = found.withColumn("new", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
        return marked.withColumn("island", F.sum("new").over(order)).groupBy(*by, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")

    parts = joined(spans.withColumn("bucket", F.floor(F.col("begin") / bucket)), [key, "bucket"])
    return joined(parts.drop("bucket"), [key])


def rms(quality: Column, cap: int = 60) -> Column:
    """Aggregate: root mean square of capped qualities, rounded as whole numbers are."""
    capped = F.least(quality, F.lit(cap))
    return F.floor(F.sqrt(F.sum(capped * capped) / F.count(F.lit(1))) + 0.499).cast("bigint")
