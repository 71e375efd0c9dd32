"""Registered queries: one for each operator, over alignments derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.functions import cigar as C
from strandlight.operators import callbacks, calls, dedup, filters, pairing, pileup, realign, rescue, seeds, sorting, stats, variants
from strandlight.plans.fixtures import aln, refs, special_refs
from strandlight.sources import convert, fasta, sam

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WINDOW = 1000
REGIONS = [(1, 200, 900), (1, 800, 1500), (3, 0, 400)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of two orders in three, placed up to four bases further on."""
    found = aln(spark, sf_dir).where("pair_id % 3 <> 0")
    return found.withColumn("pos", F.when(F.col("tid") >= 0, F.col("pos") + F.col("h") % 5).otherwise(F.col("pos")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.classified(pairing.mate_pairs(filters.rescue_candidates(aln(spark, sf_dir)), WINDOW))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pileup_mask(aln(spark, sf_dir))


@query
def pair_type_counts(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("pair_type").agg(F.count(F.lit(1)).alias("n"))


@query
def flagstat(spark, sf_dir):
    return stats.flagstat(aln(spark, sf_dir))


@query
def idxstats(spark, sf_dir):
    return stats.idxstats(aln(spark, sf_dir), refs(spark, sf_dir))


@query
def view_flag_mapq(spark, sf_dir):
    return filters.view(aln(spark, sf_dir), 20, 2, 1024, ["1-URGENT", "2-HIGH"]).select("qname", "m", "flag", "mapq", "rg")


@query
def view_library(spark, sf_dir):
    return filters.view(aln(spark, sf_dir), library="lib1").groupBy("rg").agg(F.count(F.lit(1)).alias("n"))


@query
def orphan_filter(spark, sf_dir):
    return filters.orphan_candidates(aln(spark, sf_dir)).select("qname", "m", "flag", "tid", "pos")


@query
def badmate_filter(spark, sf_dir):
    return filters.rescue_candidates(aln(spark, sf_dir)).select("qname", "m", "flag", "tid", "pos")


@query
def normal_filter(spark, sf_dir):
    return filters.normal_pairs(aln(spark, sf_dir)).select("qname", "m", "isize")


@query
def sv_candidates(spark, sf_dir):
    reads = aln(spark, sf_dir)
    cutoffs = stats.fragment_cutoffs(stats.fragment_histogram(filters.normal_pairs(reads)), 0.05)
    return filters.sv_candidates(reads, cutoffs).select("qname", "m", "tid", "mtid", "isize", "rg")


@query
def pileup_mask(spark, sf_dir):
    return masked(spark, sf_dir).groupBy("tid", "flag").agg(F.count(F.lit(1)).alias("n"))


@query
def region_fetch(spark, sf_dir):
    name, begin, end = C.parse_region("AMERICA:1,001-1,200")
    found = aln(spark, sf_dir).join(refs(spark, sf_dir).where(F.col("rname") == name).select("tid"), "tid")
    last = F.greatest(C.end_of("pos", "cigar"), F.col("pos") + 1)
    return found.where((F.col("pos") < end) & (last > begin)).select("qname", "m", "pos", "cigar")


@query
def multi_region_bag(spark, sf_dir):
    return filters.overlapping_any(aln(spark, sf_dir), REGIONS).select("region", "qname", "m", "pos")


@query
def cigar_lengths(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", C.end_of("pos", "cigar").alias("end_pos"), C.query_length("cigar").alias("qlen"), C.cigar_text(C.operations("cigar")).alias("text"))


@query
def reg2bin(spark, sf_dir):
    reads = aln(spark, sf_dir).where("tid >= 0")
    end = F.greatest(C.end_of("pos", "cigar"), F.col("pos") + 1)
    return reads.select("qname", "m", C.bin_of(F.col("pos"), end).alias("bin"), C.bin_of(F.col("pos") * 50000, end * 50000).alias("wide_bin"), F.size(C.bins_over(F.col("pos") * 50000, end * 50000)).cast("bigint").alias("n_bins"))


@query
def mismatch_rate(spark, sf_dir):
    reads = aln(spark, sf_dir).where("cigar <> '*'")
    return reads.select("qname", "m", F.round(C.mismatch_rate("cigar", F.length("seq")), 4).alias("rate"))


@query
def align_status(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", C.alignment_status("flag", "mapq", "cigar", F.length("seq")).alias("status"))


@query
def insert_sizes(spark, sf_dir):
    found = pairing.mate_pairs(aln(spark, sf_dir).where("flag & 12 = 0"), WINDOW)
    end = {s: F.col(f"{s}.pos") + C.length_of(F.col(f"{s}.cigar"), "MD") for s in "ab"}
    return found.select("qname", C.insert_size(F.col("a.pos"), end["a"], F.col("b.pos"), end["b"]).alias("size_a"), C.insert_size(F.col("b.pos"), end["b"], F.col("a.pos"), end["a"]).alias("size_b"))


@query
def pair_modes(spark, sf_dir):
    return aln(spark, sf_dir).groupBy(C.pair_mode("flag", "isize").alias("pair_mode")).agg(F.count(F.lit(1)).alias("n"))


@query
def pair_stats(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", C.pair_mode("flag", "isize").alias("pair_mode"), F.abs("isize").alias("frag_len"), "rg")


@query
def mate_pairs(spark, sf_dir):
    found = pairing.mate_pairs(filters.rescue_candidates(aln(spark, sf_dir)), WINDOW)
    return found.select("qname", "tid", F.col("a.rec_no").alias("first"), F.col("b.rec_no").alias("second"))


@query
def mate_pairs_replayed(spark, sf_dir):
    return pairing.replayed_pairs(filters.rescue_candidates(aln(spark, sf_dir)), WINDOW)


@query
def pair_types(spark, sf_dir):
    return pairs(spark, sf_dir).select("qname", F.col("anchor.rec_no").alias("anchor_no"), F.col("target.rec_no").alias("target_no"), "pair_type")


@query
def frag_hist(spark, sf_dir):
    return stats.fragment_histogram(filters.normal_pairs(aln(spark, sf_dir)))


@query
def frag_mode_counts(spark, sf_dir):
    return stats.mode_counts(aln(spark, sf_dir))


@query
def frag_stats(spark, sf_dir):
    found = stats.fragment_stats(stats.fragment_histogram(filters.normal_pairs(aln(spark, sf_dir))))
    return found.select("rg", "n", F.round("mean", 4).alias("mean"), "median", F.round("stdev", 4).alias("stdev"))


@query
def frag_cutoffs(spark, sf_dir):
    return stats.fragment_cutoffs(stats.fragment_histogram(filters.normal_pairs(aln(spark, sf_dir))), 0.05)


@query
def depth(spark, sf_dir):
    return stats.depth(masked(spark, sf_dir))


@query
def coverage_sweep(spark, sf_dir):
    return stats.coverage_runs(stats.covered(masked(spark, sf_dir)))


@query
def pair_coverage(spark, sf_dir):
    reads = aln(spark, sf_dir).where("flag & 3 = 3 AND isize > 0 AND tid = mtid")
    return stats.coverage_runs(reads.select("tid", F.col("pos").alias("begin"), (F.col("pos") + F.col("isize") + 1).alias("end")))


@query
def anchor_islands(spark, sf_dir):
    reads = aln(spark, sf_dir).where("flag & 4 = 0 AND mapq >= 59")
    return stats.islands(reads.select("tid", F.col("pos").alias("begin"), C.end_of("pos", "cigar").alias("end")))


@query
def pileup_rows(spark, sf_dir):
    return pileup.rows(masked(spark, sf_dir), refs(spark, sf_dir)).select("tid", (F.col("pos") + 1).alias("pos"), "ref", "depth", "bases", "quals", "mapqs")


@query
def rms_mapq(spark, sf_dir):
    return pileup.elements(masked(spark, sf_dir)).groupBy("tid", "pos").agg(stats.rms(F.col("mapq")).alias("rms"))


@query
def mpileup(spark, sf_dir):
    found = pileup.multi([masked(spark, sf_dir), filters.pileup_mask(second_run(spark, sf_dir))], refs(spark, sf_dir))
    return found.select("tid", "pos", "ref", "depth_1", F.length("bases_1").cast("bigint").alias("len_1"), "depth_2", F.length("bases_2").cast("bigint").alias("len_2"))


@query
def consensus_all(spark, sf_dir):
    return pileup.all_bases(masked(spark, sf_dir), refs(spark, sf_dir))


@query
def vcf_from_pileup(spark, sf_dir):
    return pileup.as_variants(pileup.all_bases(masked(spark, sf_dir), refs(spark, sf_dir)))


@query
def snp_density(spark, sf_dir):
    sites = pileup.as_variants(pileup.all_bases(masked(spark, sf_dir), refs(spark, sf_dir)))
    return pileup.dense(sites, 10, 2).select("tid", "pos", "near", "dense")


@query
def indel_sites(spark, sf_dir):
    return pileup.indel_sites(masked(spark, sf_dir))


@query
def gap_masked_consensus(spark, sf_dir):
    reads = masked(spark, sf_dir)
    gaps = pileup.indel_sites(reads).where("n >= 2").select("tid", "pos").distinct()
    return pileup.consensus_text(pileup.all_bases(reads, refs(spark, sf_dir)), refs(spark, sf_dir), gaps=gaps)


@query
def consensus_call(spark, sf_dir):
    return calls.consensus(masked(spark, sf_dir)).drop("next_q")


@query
def consensus_rows(spark, sf_dir):
    return calls.consensus_rows(masked(spark, sf_dir), refs(spark, sf_dir))


@query
def dependent_consensus(spark, sf_dir):
    return calls.consensus_rows(masked(spark, sf_dir), refs(spark, sf_dir), dependent=True)


@query
def pileup_with_gaps(spark, sf_dir):
    found = calls.pileup_lines(masked(spark, sf_dir), refs(spark, sf_dir))
    return found.select("tid", "pos", "kind", "ref", "cons", "cons_q", "snp_q", "rms_q", "depth", F.md5("bases").alias("bases_md5"), F.to_json("gap").alias("gap"))


@query
def likelihoods_with_gaps(spark, sf_dir):
    found = calls.gap_likelihood_records(masked(spark, sf_dir), refs(spark, sf_dir))
    return found.withColumn("lk", F.array_join("lk", ","))


@query
def likelihood_records(spark, sf_dir):
    found = calls.likelihood_records(masked(spark, sf_dir))
    return found.select("tid", "pos", "offset", "depth", "rms_q", "min_lk", F.array_join("lk", ",").alias("lk"))


@query
def nm_md(spark, sf_dir):
    return calls.mismatch_strings(aln(spark, sf_dir), refs(spark, sf_dir))


@query
def calmd_masks(spark, sf_dir):
    """Reads with bases equal to the reference's as ``=``, and as N where five or more differ."""
    reads = aln(spark, sf_dir).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    found = calls.masked_matches(reads, refs(spark, sf_dir), equal=True, max_nm=5)
    return found.select("qname", "m", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


@query
def variant_filter(spark, sf_dir):
    return variants.filtered_variants(calls.variant_sites(masked(spark, sf_dir), refs(spark, sf_dir)))


@query
def indel_genotypes(spark, sf_dir):
    return realign.indel_genotypes(masked(spark, sf_dir), refs(spark, sf_dir)).withColumn("likelihood", F.array_join("likelihood", ","))


@query
def vcf_with_gaps(spark, sf_dir):
    return variants.as_vcf(calls.variant_sites(masked(spark, sf_dir), refs(spark, sf_dir)), refs(spark, sf_dir))


@query
def coord_sort_rank(spark, sf_dir):
    return sorting.ranked(aln(spark, sf_dir).select("qname", "m", "tid", "pos", "rec_no"), sorting.coordinate_order())


@query
def name_sort_rank(spark, sf_dir):
    return sorting.ranked(aln(spark, sf_dir).select("qname", "m", "tid", "pos", "rec_no"), sorting.name_order())


@query
def merge_rg(spark, sf_dir):
    both = sorting.merged([aln(spark, sf_dir), second_run(spark, sf_dir)], ["run1", "run2"])
    return sorting.ranked(both.select("qname", "m", "flag", "tid", "pos", "rg", "file_no", "rec_no"), sorting.merge_order())


@query
def rmdup_pe(spark, sf_dir):
    return dedup.paired_duplicates(aln(spark, sf_dir)).where("NOT dropped").select("qname", "m", "rec_no")


@query
def rmdup_se(spark, sf_dir):
    return dedup.single_duplicates(aln(spark, sf_dir)).where("NOT dropped").select("qname", "m", "rec_no")


@query
def dup_rate(spark, sf_dir):
    return dedup.duplicate_rate(dedup.paired_duplicates(aln(spark, sf_dir)))


@query
def fixmate(spark, sf_dir):
    return dedup.fixed_mates(aln(spark, sf_dir)).select("qname", "m", "flag", "mtid", "mpos", "isize")


@query
def unique_best(spark, sf_dir):
    return dedup.best_hits(aln(spark, sf_dir)).select("qname", "m", "score", "mapq")


@query
def uniqcmp(spark, sf_dir):
    return dedup.compared_runs(aln(spark, sf_dir), second_run(spark, sf_dir))


@query
def rg_library(spark, sf_dir):
    reads = aln(spark, sf_dir)
    groups = reads.groupBy("rg").agg(F.min("lib").alias("lb"))
    return reads.drop("lib").join(groups, "rg", "left").groupBy("rg", "lb").agg(F.count(F.lit(1)).alias("n"))


@query
def seq_orientations(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", F.md5(C.reverse_complement("seq")).alias("revcomp"), F.md5(C.complement("seq")).alias("comp"), F.md5(F.reverse("seq")).alias("rev"))


@query
def md5_refs(spark, sf_dir):
    return sorting.appended_refs(refs(spark, sf_dir).join(aln(spark, sf_dir).select("tid").distinct(), "tid", "left_semi"), special_refs(spark, sf_dir))


@query
def fasta_slice(spark, sf_dir):
    slices = aln(spark, sf_dir).where("tid >= 0").select("qname", "m", "tid", "pos")
    near = pileup.with_reference(slices, refs(spark, sf_dir))
    return near.select("qname", "m", F.concat("ref", F.substring("ref_next", 1, 19)).alias("bases"))


def _fasta_lines(spark: SparkSession, sf_dir: str):
    """The references and the library as lines of one FASTA file, seven to a split, names of whole headers."""
    known = refs(spark, sf_dir).select("tid", F.translate("rname", " ", "_").alias("rname"), "bases").unionByName(special_refs(spark, sf_dir).select((F.col("sp_id") + 1000).alias("tid"), F.col("name").alias("rname"), "bases"))
    text = fasta.wrapped(known.select("tid", F.concat("rname", F.lit(" number "), "tid").alias("rname"), "bases"), keep=["tid"])
    rows = text.select("tid", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    ranks = sorting.ranked(rows, [F.col("tid").asc(), F.col("line").asc()])
    split = F.floor(F.col("rank") / 7)
    return ranks.select(F.lit("made.fa").alias("path"), split.alias("split"), "rank", "value").repartition("path", "split").sortWithinPartitions("path", "split", "rank")


@query
def fasta_index(spark, sf_dir):
    return fasta.index(fasta.placed(fasta.pieces(_fasta_lines(spark, sf_dir)))).select("rname", "length", "offset", "line_blen", "line_len")


@query
def fasta_fetch(spark, sf_dir):
    """What every seventh mapped read spans and ten bases on either side, by name and place."""
    reads = aln(spark, sf_dir).where("tid >= 0 AND cigar <> '*' AND rec_no % 7 = 0").join(refs(spark, sf_dir).select("tid", F.translate("rname", " ", "_").alias("rname")), "tid")
    slices = reads.select("rec_no", "rname", (F.col("pos") - 10).alias("begin"), (C.end_of("pos", "cigar") + 10).alias("end"))
    return fasta.fetched(_fasta_lines(spark, sf_dir), slices).select("rec_no", F.md5("bases").alias("bases_md5"))


@query
def kmer_index(spark, sf_dir):
    return seeds.index_counts(aln(spark, sf_dir).where("flag & 4 = 4"), "rec_no", "seq")


@query
def seed_regions(spark, sf_dir):
    reads = aln(spark, sf_dir).where("flag & 4 = 4").select("rec_no", "seq")
    return seeds.seed_regions(reads, special_refs(spark, sf_dir))


@query
def best_seed(spark, sf_dir):
    reads = aln(spark, sf_dir).where("flag & 4 = 4").select("rec_no", "seq")
    found = seeds.best_seeds(seeds.seed_regions(reads, special_refs(spark, sf_dir)))
    return found.select("read", "query_begin", "length", "num_pos", F.col("places")[0]["ref"].alias("ref"), F.col("places")[0]["ref_begin"].alias("ref_begin"))


@query
def seed_cover(spark, sf_dir):
    reads = aln(spark, sf_dir).where("flag & 4 = 4").select("rec_no", "seq")
    return seeds.best_cover(seeds.seed_regions(reads, special_refs(spark, sf_dir)))


@query
def search_window(spark, sf_dir):
    found = pairing.search_windows(pairing.candidates(pairs(spark, sf_dir)), refs(spark, sf_dir), 300, 250)
    return found.select("qname", "begin", "end", F.md5("window").alias("window_md5"), F.md5("query").alias("query_md5"))


@query
def best_event(spark, sf_dir):
    """The mate of greatest mapping quality of each pair, the later one of equals: the rule by which events are chosen."""
    mates = aln(spark, sf_dir).select(F.col("pair_id").alias("qname"), F.col("m").alias("event"), F.col("m").alias("push"), F.col("mapq").alias("covers"))
    return rescue.winners(mates).select(F.col("qname").alias("pair_id"), F.col("event").alias("m"), "covered")


@query
def sam_text(spark, sf_dir):
    return sam.formatted(aln(spark, sf_dir), refs(spark, sf_dir))


@query
def sam_parsed(spark, sf_dir):
    lines = sam.formatted(aln(spark, sf_dir), refs(spark, sf_dir))
    found = sam.parsed(lines, refs(spark, sf_dir))
    return found.select("qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "isize", F.col("tags")["RG"].alias("rg"))


@query
def flag_letters(spark, sf_dir):
    return aln(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select("flag", C.letters("flag").alias("letters"), "n")


@query
def bed(spark, sf_dir):
    return sam.as_bed(aln(spark, sf_dir), refs(spark, sf_dir))


@query
def fastq(spark, sf_dir):
    return sam.as_fastq(aln(spark, sf_dir))


@query
def tagview(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "flag", F.col("rg").alias("value"))


@query
def header_merge(spark, sf_dir):
    reads = aln(spark, sf_dir)
    lines = [reads.groupBy("rg").agg(F.min("lib").alias("v")).select(F.lit("RG").alias("type"), F.create_map(F.lit("ID"), "rg", F.lit("LB"), "v").alias("tags")), second_run(spark, sf_dir).select("rg").distinct().select(F.lit("RG").alias("type"), F.create_map(F.lit("ID"), "rg", F.lit("SM"), F.lit("sample")).alias("tags"))]
    found = sorting.merged_headers(lines[0].unionByName(lines[1]))
    return found.select("type", "key", F.col("tags")["LB"].alias("lb"), F.col("tags")["SM"].alias("sm"))


@query
def solexa_rescale(spark, sf_dir):
    quality = (F.col("rec_no") % 70 + 35).alias("quality")
    return aln(spark, sf_dir).groupBy(quality).agg(F.count(F.lit(1)).alias("n")).select("quality", C.solexa_to_phred(F.col("quality")).alias("phred"), "n")


@query
def simulator_eval(spark, sf_dir):
    """Cumulative counts of reads and of those more than two bases off, from the best quality class down."""
    second = second_run(spark, sf_dir).select("rec_no", F.col("pos").alias("found"))
    both = aln(spark, sf_dir).where("flag & 4 = 0").join(second, "rec_no")
    by = both.groupBy(F.floor(F.col("mapq") / 10).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("pos") - F.col("found")) > 2).alias("wrong"))
    order = sorting.Window.orderBy(F.desc("class")).rowsBetween(sorting.Window.unboundedPreceding, 0)
    return by.select("class", F.sum("wrong").over(order).alias("wrong"), F.sum("n").over(order).alias("total"))


def _rescued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads = aln(spark, sf_dir)
    found = sorting.checkpointed(pairing.classified(pairing.mate_pairs(filters.rescue_candidates(reads), WINDOW)))
    return reads, found, rescue.rescued(found, refs(spark, sf_dir), rescue.RescueConfig(), special_refs(spark, sf_dir))


@query
def rescue_full(spark, sf_dir):
    return rescue.emitted(_rescued(spark, sf_dir)[2])


@query
def rescue_complete(spark, sf_dir):
    return rescue.complete(*_rescued(spark, sf_dir))


@query
def region_join(spark, sf_dir):
    """Reads over a table of regions: forty bases round every seventh read's mate."""
    reads = aln(spark, sf_dir)
    regions = reads.where("mtid >= 0 AND rec_no % 7 = 0").select(F.col("rec_no").alias("region"), F.col("mtid").alias("tid"), F.greatest(F.col("mpos") - 20, F.lit(0)).alias("begin"), (F.col("mpos") + 20).alias("end"))
    return filters.region_counts(reads, regions)


@query
def site_depths(spark, sf_dir):
    """Depth at the sites of a list made of text: every third read's position, some with gap lengths, some names unknown."""
    reads, known = aln(spark, sf_dir).where("tid >= 0"), refs(spark, sf_dir)
    named = reads.where("rec_no % 3 = 0").join(known.select("tid", "rname"), "tid")
    lines = named.select(F.concat_ws("\t", F.when(F.col("rec_no") % 5 == 0, "nowhere").otherwise(F.col("rname")), (F.col("pos") + 1).cast("string"), F.when(F.col("rec_no") % 2 == 0, "-3")).alias("value"))
    sites = filters.site_list(lines, known)
    return sites.join(stats.depth(masked(spark, sf_dir)), ["tid", "pos"]).select("tid", "pos", F.size("gaps").cast("bigint").alias("n_gaps"), "depth")


@query
def show_alen(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", C.length_of("cigar", "MI").cast("bigint").alias("alen"))


@query
def query_positions(spark, sf_dir):
    """The read's base at a place of the reference that lies in, before or after its gaps."""
    reads = aln(spark, sf_dir).where("tid >= 0 AND cigar <> '*'")
    target = F.col("pos") + F.col("rec_no") % 130 - 5
    found = reads.select("qname", "m", C.query_position("pos", "cigar", target).alias("l"), C.query_position("pos", "cigar", target, left=False).alias("r"))
    return found.select("qname", "m", F.col("l.query").alias("qpos"), F.col("l.at").alias("at_left"), F.col("r.at").alias("at_right"))


@query
def colour_space(spark, sf_dir):
    return aln(spark, sf_dir).select("qname", "m", F.md5(C.colours("seq")).alias("colours_md5"))


@query
def well_mapped_pairs(spark, sf_dir):
    found = filters.well_mapped_pairs(pairing.mate_pairs(filters.rescue_candidates(aln(spark, sf_dir)), WINDOW), 20)
    return found.select("qname", F.col("a.rec_no").alias("first"), F.col("b.rec_no").alias("second"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads aligned without gaps, with their reference's name and the strand as a sign."""
    reads = aln(spark, sf_dir).where("cigar = '100M'").join(refs(spark, sf_dir).select("tid", F.translate("rname", " ", "_").alias("rname")), "tid")
    return reads.withColumns({"strand": F.when(C.has("flag", C.REVERSE), "-").otherwise("+"), "quality": F.repeat(F.lit("I"), F.length("seq")), "n": F.col("rec_no") % 3})


def _converted(found: DataFrame) -> DataFrame:
    return found.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.md5("seq").alias("seq_md5"), F.col("tags")["NM"].alias("nm"), F.col("tags")["MD"].alias("md"))


@query
def from_bowtie(spark, sf_dir):
    marks = F.when(F.col("n") > 0, "7:A>C,31:G>T")
    line = F.concat_ws("\t", F.concat("qname", F.lit("/"), "m"), "strand", "rname", "pos", "seq", "quality", F.col("n").cast("string"), marks)
    return _converted(convert.bowtie(_hits(spark, sf_dir).select(line.alias("value"))))


@query
def from_zoom(spark, sf_dir):
    name = F.concat("qname", F.when(F.col("m") == 1, "_F").otherwise("_R"))
    line = F.concat_ws("\t", name, F.concat("rname", F.lit(" made up:"), "pos"), "strand", F.col("n").cast("string"))
    return _converted(convert.zoom(_hits(spark, sf_dir).select(line.alias("value")), 100, True))


@query
def from_novoalign(spark, sf_dir):
    side = F.when(F.col("m") == 1, "L").otherwise("R")
    marks = F.when(F.col("n") == 1, "7A>C\t31G>T").when(F.col("n") == 2, "4-G\t5-T\t6A>C\t50+AC")
    status = F.when(F.col("rec_no") % 11 == 0, "R").otherwise("U")
    line = F.concat_ws("\t", F.concat(F.lit("@"), "qname"), side, "seq", "quality", status, F.col("mapq").cast("string"), F.lit("30"), F.concat(F.lit(">"), "rname"), (F.col("pos") + 1).cast("string"), F.when(F.col("strand") == "-", "R").otherwise("F"), F.lit("."), F.lit("0"), F.lit("0"), marks)
    return _converted(convert.novoalign(_hits(spark, sf_dir).select(line.alias("value"))))


@query
def first_base_calls(spark, sf_dir):
    return pileup.first_bases(masked(spark, sf_dir), refs(spark, sf_dir))


def _with_mates(found: DataFrame, *tags: str) -> DataFrame:
    return found.select("qname", "flag", "rname", "pos", "mapq", "cigar", "mrname", "mpos", "isize", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"), *[F.col("tags")[k].alias(k.lower()) for k in tags])


@query
def from_soap(spark, sf_dir):
    """Reads aligned without gaps, with what their mates tell where those are so too."""
    side = F.when(F.col("m") == 1, "a").otherwise("b")
    marks = F.when(F.col("n") > 0, "2\tA->7I20\tG->31I20").otherwise("0")
    line = F.concat_ws("\t", F.concat("qname", F.lit("/"), "m"), "seq", "quality", F.when(F.col("n") == 0, "1").otherwise("3"), side, F.lit("100"), "strand", "rname", (F.col("pos") + 1).cast("string"), marks)
    return _with_mates(convert.mated(convert.soap(_hits(spark, sf_dir).select(line.alias("value")), True)), "NM", "MD")


@query
def from_gerald(spark, sf_dir):
    """Every read as a line of its side's export file; one in thirteen failed the filter."""
    reads = aln(spark, sf_dir).join(F.broadcast(refs(spark, sf_dir)).select("tid", F.translate("rname", " ", "_").alias("rname")), "tid", "left").withColumn("n", F.col("rec_no") % 4)
    unmapped, empty = C.has("flag", C.UNMAPPED), F.lit("")
    chrom = F.when(~unmapped, F.col("rname")).when(F.col("pair_id") % 2 == 0, "3:2:1").otherwise("NM")
    text = {
        "index": F.when(F.col("h") % 3 == 0, "ACGT").otherwise("0"), "qual": F.lit("h" * 60 + "B" * 40), "contig": F.when(F.col("pair_id") % 3 == 0, "c1").otherwise(""), "md": F.element_at(F.array(*map(F.lit, ("100", "7A92", "40^AC$60", "30^3$20T46"))), (F.col("n") + 1).cast("int")),
        "both": F.when(F.col("n") == 0, "").otherwise((F.col("mapq") + 5).cast("string")), "passed": F.when(F.col("rec_no") % 13 == 0, "N").otherwise("Y"), "strand": F.when(C.has("flag", C.REVERSE), "R").otherwise("F"),
    }
    cells = ["qname", empty, F.lit("1"), F.lit("20"), F.lit("3"), F.lit("4"), text["index"], F.col("m").cast("string"), "seq", text["qual"], chrom, text["contig"], (F.col("pos") + 1).cast("string"), text["strand"], text["md"], F.col("mapq").cast("string"), text["both"], empty, empty, empty, empty, text["passed"]]
    lines = reads.select("m", F.concat_ws("\t", *cells).alias("value"))
    return _with_mates(convert.gerald(lines.where("m = 1"), lines.where("m = 2")), "BC", "XD", "SM", "AS", "H0", "H2")


@query
def from_blast(spark, sf_dir):
    """A report's section for each read: those aligned without gaps have one block or two, the others none."""
    reads = aln(spark, sf_dir).join(F.broadcast(refs(spark, sf_dir)).select("tid", F.translate("rname", " ", "_").alias("rname")), "tid", "left").withColumn("n", F.col("rec_no") % 3)
    part = lambda at, n: F.substring("seq", at, n)
    back, at = C.has("flag", C.REVERSE), lambda n: (F.col("pos") + n).cast("string")
    first = [F.when(F.col("n") == 1, F.concat(part(6, 30), F.lit(between), part(36, 30))).otherwise(part(6, 60)) for between in ("--", "AC")]
    second = [part(66, 30), F.when(F.col("n") == 2, F.concat(part(66, 10), F.lit("---"), part(79, 17))).otherwise(part(66, 30))]
    begins, ends = ((F.when(back, at(a)).otherwise(at(b))) for a, b in ((60, 1), (1, 60)))
    block = [
        "\n\n>", "rname", " made up\n          Length = 3200\n\n Score = ", (F.col("mapq") + 0.7).cast("string"), " bits (9), Expect = ", F.when(F.col("n") == 0, "e-10").otherwise("2e-05"), "\n Identities = 1/1\n Strand = Plus / ", F.when(back, "Minus").otherwise("Plus"),
        "\n\n\nQuery: 6   ", first[0], " 65\n           ||||\nSbjct: ", begins, " ", first[1], " ", begins, "\n\nQuery: 66  ", second[0], " 95\n           ||||\nSbjct: ", ends, " ", second[1], " ", ends, "\n",
        F.when(F.col("pair_id") % 5 == 0, "\n\n Score = 20.2 bits (10), Expect(2) = 0.5\n Strand = Plus / Plus\n\nQuery: 1 AAAA 4\n         ||||\nSbjct: 7 AAAA 10\n").otherwise(""),
    ]
    columns = {"rname"}
    joined = F.concat(*[F.lit(x) if isinstance(x, str) and x not in columns else F.col(x) if isinstance(x, str) else x for x in block])
    text = F.concat("qname", F.lit("/"), "m", F.lit("\n         (100 letters)\n\nDatabase: made.fa\n"), F.when(F.col("cigar") == "100M", joined).otherwise("\n ***** No hits found ******\n"))
    found = convert.blast(reads.select(text.alias("value")), True)
    return found.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.md5("seq").alias("seq_md5"), F.col("tags")["AS"].alias("score"), F.col("tags")["EV"].alias("expect"))


@query
def called_sites(spark, sf_dir):
    """Depth, deletions and qualities of each site by a function over its reads."""

    def call(tid, pos, pieces):
        n, deleted, quality = 0, 0, 0
        for piece in pieces:
            n, deleted, quality = n + len(piece), deleted + pc.sum(piece["deleted"]).as_py(), quality + pc.sum(piece["baseq"]).as_py()
        yield n, deleted, quality

    return callbacks.over_sites(masked(spark, sf_dir), call, "depth bigint, deleted bigint, quality bigint")


@query
def called_regions(spark, sf_dir):
    """Reads and their mapping qualities around each sixteenth pair's first read, by a function over batches."""
    span = ["tid", "begin", "end"]
    regions = aln(spark, sf_dir).where("m = 1 AND tid >= 0 AND pair_id % 16 = 0").select(F.col("pair_id").alias("region"), "tid", (F.col("pos") - 20).alias("begin"), (F.col("pos") + 120).alias("end"))
    # regions of one place have the same reads: the function sees them once, under the least number
    places = regions.groupBy(*span).agg(F.min("region").alias("region"))
    reads = aln(spark, sf_dir).select("tid", "pos", "cigar", "mapq")
    parts = callbacks.over_regions(reads, places, lambda region, batch: [(len(batch), pc.sum(batch["mapq"]).as_py())], "n bigint, mapq bigint")
    totals = parts.groupBy("region").agg(F.sum("n").alias("n"), F.sum("mapq").alias("mapq")).join(places, "region").drop("region")
    return regions.join(totals, span).select("region", "n", "mapq")
