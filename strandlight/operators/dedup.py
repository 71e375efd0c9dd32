"""Duplicate removal, mate fixing, best hits and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions import cigar as C


def paired_duplicates(aln: DataFrame) -> DataFrame:
    """``aln`` with ``dropped`` and ``checked``: of pairs of one library, place and size the best by summed quality stays.

    Heads (positive size) decide; the tail mates of a dropped head's name go with it. Two windows mark the rows themselves, so
    rows that share a number or a name, as those of merged inputs do, stay as many as they are.
    """
    eligible = (F.col("tid") >= 0) & C.has("flag", C.PAIRED) & ~C.has("flag", C.UNMAPPED | C.MATE_UNMAPPED) & (F.col("tid") == F.col("mtid"))
    marked = aln.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "checked": F.coalesce(eligible & (F.col("isize") > 0), F.lit(False))})
    # rows that are no heads have a group each, so that none is large
    place = ["checked", "lib", "tid", "pos", "isize", F.when(~F.col("checked"), F.xxhash64("qname", "rec_no"))]
    order = Window.partitionBy(*place).orderBy(F.desc("sumq"), "rec_no", "qname")
    lost = marked.withColumn("loser", F.col("checked") & (F.row_number().over(order) > 1))
    gone = F.max("loser").over(Window.partitionBy("qname"))
    dropped = F.when(F.col("checked"), F.col("loser")).otherwise(F.col("eligible") & F.col("qname").isNotNull() & F.coalesce(gone, F.lit(False)))
    return lost.withColumn("dropped", dropped).drop("eligible", "loser")


def single_duplicates(aln: DataFrame, paired_too: bool = True) -> DataFrame:
    """``aln`` with ``dropped``: of reads of one library, strand and 5' end the best by summed quality stays."""
    open_ = (F.col("tid") >= 0) & ~C.has("flag", C.UNMAPPED) & (F.lit(paired_too) | ~C.has("flag", C.PAIRED))
    reverse = C.has("flag", C.REVERSE)
    five = F.when(reverse, C.end_of("pos", "cigar")).otherwise(F.col("pos"))
    marked = aln.withColumns({"open": open_, "reverse": reverse, "five": five})
    order = Window.partitionBy("lib", "tid", "reverse", "five").orderBy(F.desc("sumq"), "rec_no")
    best = marked.where("open").withColumn("dropped", F.row_number().over(order) > 1)
    rest = marked.where(~F.col("open")).withColumn("dropped", F.lit(False))
    return best.unionByName(rest).drop("open", "reverse", "five")


def duplicate_rate(marked: DataFrame) -> DataFrame:
    """(lib, checked, removed) over heads."""
    return marked.where("checked").groupBy("lib").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("dropped")).alias("removed"))


def fixed_mates(aln: DataFrame) -> DataFrame:
    """Mate fields and flags from the other read of the name; the second and third, fourth and fifth... never pair."""
    order = Window.partitionBy("qname").orderBy("rec_no")
    own = F.struct("tid", "pos", "flag", C.end_of("pos", "cigar").alias("end"))
    seen = aln.withColumns({"n": F.row_number().over(order), "before": F.lag(own).over(order), "after": F.lead(own).over(order)})
    seen = seen.withColumn("mate", F.when(F.col("n") % 2 == 0, F.col("before")).otherwise(F.col("after")))
    five = lambda flag, pos, end: F.when(C.has(flag, C.REVERSE), end).otherwise(pos)
    both = (F.col("tid") == F.col("mate.tid")) & ~C.has("flag", C.UNMAPPED | C.MATE_UNMAPPED) & ~C.has(F.col("mate.flag"), C.UNMAPPED | C.MATE_UNMAPPED)
    size = F.when(both, five(F.col("mate.flag"), F.col("mate.pos"), F.col("mate.end")) - five(F.col("flag"), F.col("pos"), C.end_of("pos", "cigar"))).otherwise(0)
    turned = F.col("flag").bitwiseAND(F.lit(~C.MATE_REVERSE)) + F.when(C.has(F.col("mate.flag"), C.REVERSE), C.MATE_REVERSE).otherwise(0)
    lone = C.has(F.col("mate.flag"), C.UNMAPPED)
    with_mate = F.when(lone, turned.bitwiseOR(F.lit(C.MATE_UNMAPPED)).bitwiseAND(F.lit(~C.PROPER))).otherwise(turned)
    without = F.when(C.has("flag", C.PAIRED), F.col("flag").bitwiseOR(F.lit(C.MATE_UNMAPPED)).bitwiseAND(F.lit(~(C.MATE_REVERSE | C.PROPER)))).otherwise(F.col("flag"))
    paired = F.col("mate").isNotNull()
    return seen.select(
        *[c for c in aln.columns if c not in ("mtid", "mpos", "isize", "flag")], F.when(paired, with_mate).otherwise(without).cast("bigint").alias("flag"),
        *[F.when(paired, F.col(f"mate.{c}")).otherwise(-1).cast("bigint").alias(f"m{c}") for c in ("tid", "pos")], F.when(paired, size).otherwise(0).cast("bigint").alias("isize"),
    )


def best_hits(aln: DataFrame, factor: float = 250.0, match: int = 1, opening: int = 5, extension: int = 2) -> DataFrame:
    """The best-scoring read of each name, its mapping quality from how far the second best lies behind."""
    gaps = F.size(F.regexp_extract_all("cigar", F.lit(r"(\d+)[ID]"), F.lit(1)))
    score = F.greatest(F.lit(1), C.length_of("cigar", "M") * match - gaps * opening - C.length_of("cigar", "ID") * extension)
    order = Window.partitionBy("qname").orderBy(F.desc("score"), "rec_no")
    seen = aln.withColumn("score", score).withColumns({"n": F.row_number().over(order), "second": F.coalesce(F.lead("score").over(order), F.lit(0))}).where("n = 1")
    quality = F.least(F.floor(F.lit(factor) * (F.col("score") - F.col("second")) / F.col("score") + 0.499), F.lit(250)).cast("bigint")
    return seen.withColumn("mapq", quality).drop("n", "second")


def compared_runs(first: DataFrame, second: DataFrame, min_mapq: int = 10, within: int = 100) -> DataFrame:
    """(bucket, n): names by agreement of strand, reference and position and by quality in either run; the last record of a name counts."""
    def last(run: DataFrame, side: str) -> DataFrame:
        row = F.struct((F.col("flag").bitwiseAND(F.lit(C.REVERSE)) != 0).alias("reverse"), "tid", "pos", "mapq")
        return run.groupBy("qname").agg(F.max_by(row, "rec_no").alias(side))

    both = last(first, "a").join(last(second, "b"), "qname", "full")
    good = {s: F.col(f"{s}.mapq") >= min_mapq for s in "ab"}
    same = (F.col("a.reverse") == F.col("b.reverse")) & (F.col("a.tid") == F.col("b.tid")) & (F.abs(F.col("a.pos") - F.col("b.pos")) < within)
    level = F.when(good["a"] & good["b"], "high_high").when(good["a"], "high_low").when(good["b"], "low_high")
    bucket = (
        F.when(F.col("b").isNull(), F.when(good["a"], "second_missing_high").otherwise("second_missing_low"))
        .when(F.col("a").isNull(), F.when(good["b"], "first_missing_high").otherwise("first_missing_low"))
        .when(level.isNotNull(), F.concat(F.when(same, "consistent_").otherwise("inconsistent_"), level))
    )
    return both.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("bucket IS NOT NULL")
