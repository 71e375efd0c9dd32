"""Filters of called variants, as rules over neighbourhoods.

Every rule is a grouped aggregate or an equi-join on short cells of a reference with a range condition, so a reference is
spread over as many tasks as its sites fill and no row depends on the order in which others were judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.operators import pileup

#: Bases of a cell in which neighbours meet, and of a stretch in which dense sites are counted.
CELL, STRETCH = 256, 1 << 16


def cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(F.greatest(low, F.lit(0)) / CELL), F.floor(high / CELL))


def beaten_gaps(gaps: DataFrame, within: int) -> DataFrame:
    """(tid, pos, cons) of gaps that have one of a greater score, or of the same and earlier, within ``within`` bases.

    A gap's distance to a later one counts from the end of what it deletes. Two gaps meet once, in the cell where the
    later one begins.
    """
    first = gaps.select("tid", "pos", "size", "score", "cons", F.explode(cells(F.col("pos"), F.col("pos") + F.col("size") + within)).alias("cell"))
    second = gaps.select("tid", F.floor(F.col("pos") / CELL).alias("cell"), F.col("pos").alias("pos_2"), F.col("score").alias("score_2"), F.col("cons").alias("cons_2"))
    after = (F.col("pos") < F.col("pos_2")) | ((F.col("pos") == F.col("pos_2")) & (F.col("cons") < F.col("cons_2")))
    met = first.join(second, ["tid", "cell"]).where(after & (F.col("pos") + F.col("size") + within >= F.col("pos_2")))
    second_loses = F.col("score") >= F.col("score_2")
    return met.select("tid", F.when(second_loses, F.col("pos_2")).otherwise(F.col("pos")).alias("pos"), F.when(second_loses, F.col("cons_2")).otherwise(F.col("cons")).alias("cons")).distinct()


def near_gaps(snps: DataFrame, gaps: DataFrame, within: int) -> DataFrame:
    """(tid, pos) of sites within ``within`` bases before a gap or after what it deletes."""
    reach = gaps.select("tid", (F.col("pos") - within).alias("low"), (F.col("pos") + F.col("size") + within).alias("high"))
    reach = reach.withColumn("cell", F.explode(cells(F.col("low"), F.col("high"))))
    at = snps.select("tid", "pos", F.floor(F.col("pos") / CELL).alias("cell"))
    return at.join(reach, ["tid", "cell"]).where(F.col("pos").between(F.col("low"), F.col("high"))).select("tid", "pos").distinct()


def dense_sites(snps: DataFrame, within: int, most: int) -> DataFrame:
    """(tid, pos) of sites in a stretch of ``within`` bases that holds more than ``most`` of them.

    Sites near a border of the stretches counted together stand in both; each is judged in its own.
    """
    near = F.sequence(F.floor(F.greatest(F.col("pos") - within, F.lit(0)) / STRETCH), F.floor((F.col("pos") + within) / STRETCH))
    at = snps.select("tid", "pos", F.explode(near).alias("part"))
    order = Window.partitionBy("tid", "part").orderBy("pos")
    full = F.count(F.lit(1)).over(order.rangeBetween(-within, 0)) > most
    some = F.max(F.col("full")).over(order.rangeBetween(0, within))
    found = at.withColumn("full", full).withColumn("some", some)
    return found.where(F.col("some") & (F.col("part") == F.floor(F.col("pos") / STRETCH))).select("tid", "pos").distinct()


def filtered_variants(sites: DataFrame, d: int = 3, D: int = 100, l: int = 30, Q: int = 25, q: int = 10, G: int = 25, s: int = 100, w: int = 10, W: int = 10, N: int = 2, S: int = 0, i: int = 0) -> DataFrame:  # noqa: E741
    """(tid, pos, ref, cons, filter) of ``sites`` (tid, pos, ref, cons, snp_q, rms_q, depth, allele1, allele2, n1, n2).

    The letter of the rule that a site fails, U where it passes all:

    * d, D: depth under ``d``, over ``D``; s, i: quality of a SNP under ``S``, of a gap under ``i``. These sites count for
      no other's rule.
    * Q: root mean square mapping quality under ``Q``, of a gap under ``q``.
    * g: a gap near one of a greater score (``l``), a score being the quality and ``s`` for each read that shows a gap.
    * G: a SNP near a gap (``w``) of quality ``G`` or more.
    * W: a SNP of good mapping quality in a stretch of ``W`` with more than ``N`` such.

    The rules stand in this order, from the weakest; a site has the letter of the last it fails, but Q stays with a
    SNP that is only dense, as it isn't counted there. Gaps whose genotype is ``*/*`` are no variants and are left out.
    """
    gap = F.col("ref") == "*"
    deleted = F.transform(F.split("cons", "/"), lambda a: F.when(a.startswith("-"), F.length(a) - 1).otherwise(0))
    own = F.when(F.col("depth") < d, "d").when(F.col("depth") > D, "D").when(F.col("snp_q") < F.when(gap, i).otherwise(S), F.when(gap, "i").otherwise("s"))
    reads = F.when(F.col("allele1") != "*", F.col("n1")).otherwise(0) + F.when(F.col("allele2") != "*", F.col("n2")).otherwise(0)
    found = sites.where("cons <> '*/*'").withColumns({
        "gap": gap, "own": own, "weak": F.col("rms_q") < F.when(gap, q).otherwise(Q),
        "size": F.when(gap, F.array_max(deleted)).otherwise(0), "score": F.col("snp_q") + s * reads,
    })
    good = found.where("own IS NULL")
    gaps, snps = good.where("gap"), good.where("NOT gap")
    beaten = beaten_gaps(gaps, l).withColumns({"ref": F.lit("*"), "beaten": F.lit(True)})
    close = near_gaps(snps, gaps.where(F.col("snp_q") >= G), w).withColumns({"gap": F.lit(False), "close": F.lit(True)})
    dense = dense_sites(snps.where("NOT weak"), W, N).withColumns({"gap": F.lit(False), "weak": F.lit(False), "dense": F.lit(True)})
    judged = found.join(beaten, ["tid", "pos", "cons", "ref"], "left").join(close, ["tid", "pos", "gap"], "left").join(dense, ["tid", "pos", "gap", "weak"], "left")
    letter = F.coalesce("own", F.when(F.col("dense"), "W"), F.when(F.col("close"), "G"), F.when(F.col("beaten"), "g"), F.when(F.col("weak"), "Q"), F.lit("U"))
    return judged.select("tid", "pos", "ref", "cons", letter.alias("filter"))


def as_vcf(sites: DataFrame, refs: DataFrame, snps: bool = True, indels: bool = True) -> DataFrame:
    """(tid, pos, ref, alt, qual, info, gt): variant records of ``calls.variant_sites``, positions from 1.

    A gap stands at the base before it, inserted bases as ``I`` and their text, deleted ones as ``D`` and their number.
    Where the genotype is that of no gap, the two lengths compared are shown. Bases of unclear codes drop out.
    """
    info = F.concat(F.lit("DP="), F.col("depth").cast("string"))
    parts = []
    if snps:
        called = pileup.as_variants(sites.where("ref <> '*'"), "snp_q", "depth")
        parts.append(called.select("tid", "pos", "ref", "alt", F.col("snp_q").alias("qual"), info.alias("info"), "gt"))
    if indels:
        shown = lambda a: F.when(a.startswith("+"), F.concat(F.lit("I"), F.substring(a, 2, 1 << 20))).when(a.startswith("-"), F.concat(F.lit("D"), (F.length(a) - 1).cast("string")))
        alleles = F.when(F.col("cons") == "*/*", F.array("allele1", "allele2")).otherwise(F.split("cons", "/"))
        gaps = pileup.with_reference(sites.where("ref = '*'").drop("ref").withColumn("a", F.transform(alleles, shown)), refs)
        one, two = F.get("a", F.lit(0)), F.get("a", F.lit(1))
        alt = F.when(one.isNotNull() & two.isNotNull() & (one != two), F.concat(one, F.lit(","), two)).otherwise(F.coalesce(one, two))
        gt = F.when(one.isNull() | two.isNull(), "0/1").when(one == two, "1/1").otherwise("1/2")
        parts.append(gaps.select("tid", (F.col("pos") + 1).alias("pos"), F.upper("ref").alias("ref"), alt.alias("alt"), F.col("snp_q").alias("qual"), info.alias("info"), gt.alias("gt")).where("alt IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)
