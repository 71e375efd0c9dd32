"""Text alignments: formatting, parsing, headers, and the formats derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.functions import cigar as C


def _names(refs: DataFrame, tid: str, name: str) -> DataFrame:
    return refs.select(F.col("tid").alias(tid), F.col("rname").alias(name))


def formatted(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """One ``value`` column of tab-separated lines; the mate's reference is ``=`` where it is the read's own.

    ``qual`` and ``extra`` (the tags as text, in their order) are written where the input has them, else ``*`` and the
    read group.
    """
    found = aln.drop("rname", "mname").join(_names(refs, "tid", "rname"), "tid", "left").join(_names(refs, "mtid", "mname"), "mtid", "left")
    mate = F.when(F.col("mname").isNull(), "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(F.col("mname"))
    cells = ["qname", "flag", F.coalesce("rname", F.lit("*")), F.col("pos") + 1, "mapq", "cigar", mate, F.col("mpos") + 1, "isize", F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")) if "qual" in aln.columns else F.lit("*")]
    tag = F.when(F.size("extra") > 0, F.array_join("extra", "\t")) if "extra" in aln.columns else F.when(F.col("rg").isNotNull(), F.concat(F.lit("RG:Z:"), F.col("rg")))
    return found.select(F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells], tag).alias("value"))


def parsed(lines: DataFrame, refs: DataFrame, strict: bool = False) -> DataFrame:
    """Alignments of text lines without headers. A mapped read without a CIGAR becomes unmapped; names unknown are -1.

    ``tags`` maps names to values; ``extra`` has the tags as they stand, with their types. Flags may be numbers of three
    bases or letters. ``strict`` raises an error where bases and qualities, or bases and CIGAR, differ in length.
    """
    cell = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("@"))
    tags = F.transform(F.slice(cell, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 20)))
    raw = body.select(
        cell[0].alias("qname"), C.flag_number(cell[1]).alias("flag"), cell[2].alias("rname"), (cell[3].cast("bigint") - 1).alias("pos"),
        cell[4].cast("bigint").alias("mapq"), F.regexp_replace(cell[5], "[=X]", "M").alias("cigar"), F.when(cell[6] == "=", cell[2]).otherwise(cell[6]).alias("mname"), (cell[7].cast("bigint") - 1).alias("mpos"),
        cell[8].cast("bigint").alias("isize"), F.when(cell[9] != "*", cell[9]).alias("seq"), F.when(cell[10] != "*", cell[10]).alias("qual"), F.map_from_entries(tags).alias("tags"), F.slice(cell, 12, 1 << 20).alias("extra"),
    )
    if strict:
        fault = F.when(F.length("seq") != F.length("qual"), "bases and qualities differ in length: ").when((F.col("cigar") != "*") & (F.length("seq") != C.query_length("cigar")), "bases and CIGAR differ in length: ")
        raw = raw.where(F.when(fault.isNotNull(), F.raise_error(F.concat(fault, "qname")).cast("boolean")).otherwise(True))
    found = raw.join(_names(refs, "tid", "rname"), "rname", "left").join(_names(refs, "mtid", "mname"), "mname", "left")
    flag = F.when((F.col("cigar") == "*") & (F.col("rname") != "*"), F.col("flag").bitwiseOR(F.lit(C.UNMAPPED))).otherwise(F.col("flag"))
    return found.withColumns({"flag": flag, "tid": F.coalesce("tid", F.lit(-1)), "mtid": F.coalesce("mtid", F.lit(-1))})


def headers(lines: DataFrame) -> DataFrame:
    """(type, tags) of header lines."""
    cell = F.split("value", "\t")
    found = lines.where(F.col("value").rlike("^@[A-Z][A-Z]"))
    tags = F.transform(F.slice(cell, 2, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1 << 20)))
    return found.select(F.substring("value", 2, 2).alias("type"), F.map_from_entries(tags).alias("tags"))


def header_refs(lines: DataFrame) -> DataFrame:
    """(tid, rname, len) of the header's sequences, numbered in the order of the lines; files with the same header count once."""
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    found = numbered.where(F.col("value").startswith("@SQ")).select("line", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("rname"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("len"))
    # a header has few lines
    once = found.groupBy("rname").agg(F.min_by("len", "line").alias("len"), F.min("line").alias("line"))
    return once.select((F.row_number().over(Window.orderBy("line")) - 1).cast("bigint").alias("tid"), "rname", "len")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, references) of text files."""
    lines = spark.read.text(path)
    refs = header_refs(lines)
    return parsed(lines, refs), refs


def unsorted_header(value: str) -> Column:
    """A header line with its sort order, by coordinate or by name, taken back to unsorted."""
    return F.regexp_replace(value, r"^(@HD\t(?:.*\t)?)SO:(coordinate|queryname)", r"$1SO:unsorted")


def is_sorted(lines: DataFrame) -> bool:
    """Whether the header says that reads are in order of coordinates."""
    return not lines.where(F.col("value").startswith("@HD") & F.col("value").contains("SO:coordinate")).isEmpty()


def reference_list(lines: DataFrame) -> DataFrame:
    """(tid, rname, len) of a list of names and lengths, in the order of its lines; a repeated name is an error."""
    cell = F.split("value", "\t")
    found = lines.where(F.col("value") != "").select(F.monotonically_increasing_id().alias("line"), cell[0].alias("rname"), cell[1].cast("bigint").alias("len"))
    if repeated := found.groupBy("rname").count().where("count > 1").first():
        raise ValueError(f"reference {repeated['rname']!r} is listed more than once")
    # a list of references is short
    return found.select((F.row_number().over(Window.orderBy("line")) - 1).cast("bigint").alias("tid"), "rname", "len")


def header_lines(refs: DataFrame, order: str = "unsorted") -> DataFrame:
    """One ``value`` column: the header of references (tid, rname, len), in their order."""
    first = refs.sparkSession.createDataFrame([(f"@HD\tVN:1.0\tSO:{order}",)], "value string")
    names = refs.orderBy("tid").select(F.format_string("@SQ\tSN:%s\tLN:%d", "rname", F.col("len").cast("bigint")).alias("value"))
    return first.coalesce(1).union(names.coalesce(1)).coalesce(1)


def write(aln: DataFrame, refs: DataFrame, path: str, compression: str = "none", order: str = "unsorted", mode: str = "errorifexists") -> None:
    """Text files whose first holds the header alone, so that the files one after another are one valid file."""
    header_lines(refs, order).union(formatted(aln, refs)).write.mode(mode).option("compression", compression).text(path)


def as_bed(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """(chrom, begin, end, name, score, strand) of placed reads."""
    placed = aln.where((F.col("tid") >= 0) & ~C.has("flag", C.UNMAPPED)).join(refs.select("tid", "rname"), "tid")
    return placed.select(F.col("rname").alias("chrom"), F.col("pos").alias("begin"), C.end_of("pos", "cigar").alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), F.when(C.has("flag", C.REVERSE), "-").otherwise("+").alias("strand"))


def as_fastq(aln: DataFrame) -> DataFrame:
    """(name, seq, and qual where the input has it): reads as sequenced, mates with a suffix."""
    suffix = F.when(C.has("flag", C.READ1), "/1").when(C.has("flag", C.READ2), "/2").otherwise("")
    turned = C.has("flag", C.REVERSE)
    qual = [F.when(turned, F.reverse("qual")).otherwise(F.col("qual")).alias("qual")] if "qual" in aln.columns else []
    return aln.select(F.concat("qname", suffix).alias("name"), F.when(turned, C.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), *qual)


def fastq_text(aln: DataFrame) -> DataFrame:
    """One ``value`` a read: its name and bases, and its qualities where it has some; reads without bases are left out."""
    rows = as_fastq(aln).where(F.col("seq").isNotNull() & ~F.col("seq").isin("", "*"))
    body = F.concat(F.lit("@"), F.coalesce("name", F.lit("")), F.lit("\n"), F.col("seq"))
    quality = F.when(F.col("qual").isNotNull() & (F.col("qual") != "*"), F.concat(F.lit("\n+\n"), "qual")).otherwise("") if "qual" in rows.columns else F.lit("")
    return rows.select(F.concat(body, quality).alias("value"))


def write_fastq(aln: DataFrame, path: str, shards: int = 20, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """Reads dealt in turn to ``shards`` files of nearly one size."""
    fastq_text(aln).repartition(shards).write.mode(mode).option("compression", compression).text(path)


def header_checksums(lines: DataFrame) -> DataFrame:
    """(tid, rname, len, md5) of a header's references; where not every one has a checksum, none has.

    A name that comes twice counts once, with the least of its checksums. A header is short, so one window holds it.
    """
    field = lambda tag: F.nullif(F.regexp_extract("value", rf"\t{tag}:([^\t]+)", 1), F.lit(""))
    found = lines.where(F.col("value").startswith("@SQ\t")).select(field("SN").alias("rname"), field("M5").alias("md5"))
    known = header_refs(lines).join(found.groupBy("rname").agg(F.min("md5").alias("md5")), "rname", "left")
    whole = F.min(F.col("md5").isNotNull()).over(Window.partitionBy(F.lit(0)))
    return known.select("tid", "rname", "len", F.when(whole, F.col("md5")).alias("md5"))
