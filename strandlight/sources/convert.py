"""Output of other aligners as alignment rows: projections of their text lines (column ``value``).

Each gives qname, flag, rname, pos (0-based), mapq, cigar, seq, qual and tags; ``mated`` adds what mates tell each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.functions import cigar as C

COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "tags")


def _tags(**tags: Column) -> Column:
    found = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(found, lambda t: t["value"].isNotNull()))


def _plain(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def mismatch_text(at: Column, base: Column, length: Column) -> Column:
    """Mismatch string from ascending places and the bases that stand there: runs of matches between them."""
    start = F.struct(F.lit(0).alias("from"), F.lit("").alias("text"))
    step = lambda acc, x: F.struct((x["at"] + 1).alias("from"), F.concat(acc["text"], (x["at"] - acc["from"]).cast("string"), x["base"]).alias("text"))
    pairs = F.array_sort(F.zip_with(at, base, lambda a, b: F.struct(a.cast("int").alias("at"), b.alias("base"))))
    return F.aggregate(pairs, start, step, lambda acc: F.concat(acc["text"], (length - acc["from"]).cast("string")))


def bowtie(lines: DataFrame) -> DataFrame:
    """Reads with one reported hit have quality 25, others 0."""
    t = F.split("value", "\t")
    marks = F.coalesce(F.get(t, 7), F.lit(""))
    at, base = (F.regexp_extract_all(marks, F.lit(r"(?i)(\d+):[ACGTN]>([ACGTN])"), F.lit(k)) for k in (1, 2))
    length = F.length(t[4])
    # the tool's own count: columns beyond the seventh
    nm = F.size(t) - 7
    tags = F.map_concat(_tags(NM=nm, MD=mismatch_text(at, base, length)), F.map_from_arrays(F.array(F.concat(F.lit("X"), nm.cast("string"))), F.array((t[6].cast("int") + 1).cast("string"))))
    return lines.select(
        _plain(t[0]).alias("qname"), F.when(t[1] == "-", C.REVERSE).otherwise(0).cast("bigint").alias("flag"), t[2].alias("rname"), t[3].cast("bigint").alias("pos"),
        F.when(t[6].cast("int") == 0, 25).otherwise(0).cast("bigint").alias("mapq"), F.concat(length.cast("string"), F.lit("M")).alias("cigar"), t[4].alias("seq"), t[5].alias("qual"), tags.alias("tags"),
    )


def soap(lines: DataFrame, paired: bool = False) -> DataFrame:
    """Reads with one hit have quality 30, others 0."""
    rows = lines.where(~F.col("value").rlike(r"^\s") & (F.size(F.split("value", r"\s+")) >= 9)).select(F.split("value", r"\s+").alias("t"))
    whole = F.when(F.get("t", F.lit(3)).rlike(r"^\d+$"), F.col("t")).otherwise(F.concat(F.slice("t", 1, 3), F.slice("t", 5, 1 << 20)))
    rows = rows.select(whole.alias("t"))
    t = F.col("t")
    length = F.length(t[1])
    marks = F.filter(F.slice(t, 11, 1 << 20), lambda x: x.rlike(r"(?i)^[ACGT]->\d+"))
    at = F.transform(marks, lambda x: F.regexp_extract(x, r"->(\d+)", 1))
    base = F.transform(marks, lambda x: F.substring(x, 1, 1))
    md = F.when(F.get(t, F.lit(9)).cast("int") > 0, mismatch_text(at, base, length)).otherwise(length.cast("string"))
    flag = F.lit(C.PAIRED | (C.PROPER if paired else 0)) + F.when(t[4] == "a", C.READ1).otherwise(C.READ2) + F.when(t[6] == "-", C.REVERSE).otherwise(0)
    return rows.select(
        _plain(t[0]).alias("qname"), flag.cast("bigint").alias("flag"), t[7].alias("rname"), (t[8].cast("bigint") - 1).alias("pos"), F.when(t[3].cast("int") == 1, 30).otherwise(0).cast("bigint").alias("mapq"),
        F.concat(length.cast("string"), F.lit("M")).alias("cigar"), t[1].alias("seq"), F.substring(t[2], F.lit(1), length).alias("qual"), _tags(NM=F.get(t, F.lit(9)), MD=md).alias("tags"),
    )


def zoom(lines: DataFrame, read_length: int, paired: bool = False) -> DataFrame:
    """No sequences; names end in _F or _R for mates."""
    t = F.split("value", "\t")
    first, second = t[0].endswith("_F"), t[0].endswith("_R")
    mate = first | second
    reverse = F.when(mate, first != (t[2] == "+")).otherwise(t[2] == "-")
    flag = F.when(first, C.PAIRED | C.READ1).when(second, C.PAIRED | C.READ2).otherwise(0) + F.when(reverse, C.REVERSE).otherwise(0) + (C.PROPER if paired else 0)
    none = F.lit(None).cast("string")
    return lines.select(
        F.regexp_replace(t[0], "_[FR]$", "").alias("qname"), flag.cast("bigint").alias("flag"), F.regexp_extract(t[1], r"^(\S+)", 1).alias("rname"), F.regexp_extract(t[1], r":(\d+)$", 1).cast("bigint").alias("pos"),
        F.lit(30).cast("bigint").alias("mapq"), F.lit(f"{read_length}M").alias("cigar"), none.alias("seq"), none.alias("qual"), _tags(NM=t[3]).alias("tags"),
    )


def psl(lines: DataFrame, match: int = 1, mismatch: int = 3, opening: int = 5, extension: int = 2) -> DataFrame:
    """Block lists as operations: the longer gap between two blocks decides its kind; what lies outside is clipped."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value").rlike(r"^\d")).select(t.alias("t"))
    t = F.col("t")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    size, minus = t[10].cast("int"), t[8] == "-"
    begin = F.when(minus, size - t[12].cast("int")).otherwise(t[11].cast("int"))
    end = F.when(minus, size - t[11].cast("int")).otherwise(t[12].cast("int"))
    rows = rows.select("t", begin.alias("begin"), end.alias("end"), size.alias("size"), numbers(t[18]).alias("x"), numbers(t[19]).alias("y"), numbers(t[20]).alias("z"))

    def gap(i: Column) -> Column:
        ly = F.get("y", i + 1) - F.get("y", i) - F.get("x", i)
        lz = F.get("z", i + 1) - F.get("z", i) - F.get("x", i)
        return F.struct(F.get("y", i + 1).alias("y"), F.get("z", i + 1).alias("z"), (lz - ly).alias("d"))

    last = F.size("x") - 2
    rows = rows.withColumn("gaps", F.filter(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), gap)).otherwise(F.array()), lambda g: g["d"] != 0))
    start = F.struct(F.get("y", F.lit(0)).alias("y"), F.get("z", F.lit(0)).alias("z"), F.lit("").alias("text"))
    text = lambda n: n.cast("string")

    def step(acc: Column, g: Column) -> Column:
        piece = F.when(g["d"] > 0, F.concat(text(g["y"] - acc["y"]), F.lit("M"), text(g["d"]), F.lit("D"))).otherwise(F.concat(text(g["z"] - acc["z"]), F.lit("M"), text(-g["d"]), F.lit("I")))
        return F.struct(g["y"].alias("y"), g["z"].alias("z"), F.concat(acc["text"], piece).alias("text"))

    body = F.aggregate("gaps", start, step, lambda acc: F.concat(acc["text"], text(F.col("end") - acc["y"]), F.lit("M")))
    clip = lambda n: F.when(n > 0, F.concat(text(n), F.lit("H"))).otherwise("")
    opened, longer = F.size("gaps"), F.aggregate("gaps", F.lit(0), lambda a, g: a + F.abs(g["d"]))
    score = F.greatest(F.lit(0), match * t[0].cast("int") - mismatch * t[1].cast("int") - opening * opened - extension * longer)
    none = F.lit(None).cast("string")
    return rows.select(
        t[9].alias("qname"), F.when(t[8] == "+", 0).otherwise(C.REVERSE).cast("bigint").alias("flag"), t[13].alias("rname"), t[15].cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("mapq"),
        F.concat(clip(F.col("begin")), body, clip(F.col("size") - F.col("end"))).alias("cigar"), none.alias("seq"), none.alias("qual"), _tags(AS=score).alias("tags"),
    )


def novoalign(lines: DataFrame) -> DataFrame:
    """Reads placed once (``U``); variations are ``pos ref>base``, ``pos+bases`` before a place and ``pos-base`` for each base deleted.

    The mismatch string leaves out runs of no match, but for a mismatch right after a deletion, as the original's does.
    """
    kept = lines.where(~F.col("value").startswith("#")).select(F.split(F.rtrim("value"), r"\s+").alias("t")).where(F.get("t", F.lit(4)) == "U")
    t = F.col("t")
    reverse, length = t[9] == "R", F.length(t[2])
    event = lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("at"), F.regexp_extract(x, "([+>-])", 1).alias("kind"), F.regexp_extract(x, r"^\d+[+-]?([A-Za-z]+)", 1).alias("bases"))
    rows = kept.withColumn("events", F.transform(F.slice("t", 14, 1 << 20), event))
    gone = F.transform(F.filter("events", lambda x: x["kind"] == "-"), lambda x: x["at"])
    # bases deleted side by side are one gap; it takes the length of its run at the first of them
    ahead = lambda at: F.size(F.filter(gone, lambda y: (y >= at) & (y - at == F.size(F.filter(gone, lambda z: (z >= at) & (z < y))))))
    gaps = F.filter("events", lambda x: (x["kind"] == "+") | ((x["kind"] == "-") & ~F.array_contains(gone, x["at"] - 1)))
    start = F.struct(F.lit(1).alias("place"), F.lit(0).alias("used"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        run, deleted = x["at"] - acc["place"], x["kind"] == "-"
        size = F.when(deleted, ahead(x["at"])).otherwise(F.length(x["bases"]))
        text = F.concat(acc["text"], F.when(run > 0, F.concat(run.cast("string"), F.lit("M"))).otherwise(""), size.cast("string"), F.when(deleted, "D").otherwise("I"))
        return F.struct((x["at"] + F.when(deleted, size).otherwise(0)).alias("place"), (acc["used"] + run + F.when(deleted, 0).otherwise(size)).alias("used"), text.alias("text"))

    rest = lambda acc: F.concat(acc["text"], F.when(length > acc["used"], F.concat((length - acc["used"]).cast("string"), F.lit("M"))).otherwise(""))
    first = F.struct(F.lit(1).alias("place"), F.lit(False).alias("open"), F.lit("").alias("text"))

    def mark(acc: Column, x: Column) -> Column:
        run, deleted = x["at"] - acc["place"], x["kind"] == "-"
        number = F.when((run > 0) | (acc["open"] & ~deleted), run.cast("string")).otherwise("")
        caret = F.when(deleted & ~(acc["open"] & (run == 0)), "^").otherwise("")
        return F.struct((x["at"] + 1).alias("place"), deleted.alias("open"), F.concat(acc["text"], number, caret, x["bases"]).alias("text"))

    inserted = F.aggregate(F.filter("events", lambda x: x["kind"] == "+"), F.lit(0), lambda n, x: n + F.length(x["bases"]))
    after = length - inserted + F.size(gone) + 1
    md = F.aggregate(F.filter("events", lambda x: x["kind"] != "+"), first, mark, lambda acc: F.concat(acc["text"], F.when(after > acc["place"], (after - acc["place"]).cast("string")).otherwise("")))
    flag = F.lit(C.PAIRED) + F.when(t[1] == "L", C.READ1).otherwise(C.READ2) + F.when(t[10] == ".", C.PROPER).otherwise(0) + F.when(reverse, C.REVERSE).otherwise(0)
    return rows.select(
        _plain(F.substring(t[0], 2, 1 << 20)).alias("qname"), flag.cast("bigint").alias("flag"), F.substring(t[7], 2, 1 << 20).alias("rname"), (t[8].cast("bigint") - 1).alias("pos"),
        F.greatest(t[5].cast("bigint"), t[6].cast("bigint")).alias("mapq"), F.aggregate(gaps, start, step, rest).alias("cigar"),
        F.when(reverse, C.reverse_complement(t[2])).otherwise(t[2]).alias("seq"), F.when(reverse, F.reverse(t[3])).otherwise(t[3]).alias("qual"), _tags(NM=F.size("events"), MD=md).alias("tags"),
    )


def read_groups(samples: DataFrame, experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, sm, lb): read groups from an archive's three metadata documents, each a whole text in ``value``."""
    sample = F.coalesce(F.last(F.try_element_at(F.regexp_extract_all("value", F.lit(r'(?i)<SAMPLE\b[^>]*\balias="([^"]+)"'), F.lit(1)), F.lit(-1)), True), F.lit("UNKNOWN"))

    def parts(texts: DataFrame, tag: str) -> DataFrame:
        """One row an element ``tag``, from its opening tag as far as the next one."""
        return texts.select(F.explode(F.split("value", rf"(?i)(?=<{tag}\b[^>]*\baccession=)")).alias("part")).where(F.col("part").rlike(rf"(?i)^<{tag}\b"))

    named = lambda tag: F.regexp_extract("part", rf'(?i)<{tag}\b[^>]*\baccession="([^\s"]+)"', 1)
    library = F.regexp_extract("part", r"(?i)<LIBRARY_NAME>\s*(\S+?)\s*</LIBRARY_NAME>", 1)
    libraries = parts(experiments, "EXPERIMENT").select(named("EXPERIMENT").alias("experiment"), library.alias("lb"))
    found = parts(runs, "RUN").select(named("RUN").alias("id"), named("EXPERIMENT_REF").alias("experiment"))
    return found.join(libraries, "experiment", "left").withColumn("one", F.lit(1)).join(samples.agg(sample.alias("sm")).withColumn("one", F.lit(1)), "one").select("id", "sm", F.nullif("lb", F.lit("")).alias("lb"))


def mated(rows: DataFrame) -> DataFrame:
    """``rows`` with mrname ("=" on the same reference, "*" without one), mpos (-1 without one), isize and the mate's flags.

    Reads of one name and different sides (first and second read) are mates. Where a name comes more than once on a side, its
    reads pair in order of reference, place and CIGAR; what is left over, and rows of no name, stay single. A mate with no
    place gives its flag only. The size runs from the read's 5' end to its mate's; reads that come without
    bases have the length of their CIGAR. One exchange by name serves both windows.
    """
    second = C.has("flag", C.READ2)
    turn = F.row_number().over(Window.partitionBy("qname", "second").orderBy("rname", "pos", "cigar", "seq"))
    numbered = rows.where("qname IS NOT NULL").withColumn("second", second).withColumn("turn", turn)
    length = F.coalesce(F.length("seq"), C.query_length("cigar"))
    five = F.col("pos") + F.when(C.has("flag", C.REVERSE), length).otherwise(0)
    own = F.struct("rname", "pos", five.alias("five"), C.has("flag", C.REVERSE).alias("reverse"))
    order = Window.partitionBy("qname", "turn").orderBy("second")
    seen = numbered.withColumn("own", own).withColumn("mate", F.coalesce(F.lead("own").over(order), F.lag("own").over(order)))
    placed, same = F.col("mate.rname") != "*", F.col("mate.rname") == F.col("rname")
    size = F.when(placed & same, F.col("mate.five") - F.col("own.five")).otherwise(0)
    told = F.when(F.col("mate").isNull(), 0).when(~placed, C.MATE_UNMAPPED).when(F.col("mate.reverse"), C.MATE_REVERSE).otherwise(0)
    both = seen.select(
        *[F.col(c) for c in COLUMNS if c != "flag"], F.col("flag").bitwiseOR(told).cast("bigint").alias("flag"), F.when(placed & same, "=").when(placed, F.col("mate.rname")).otherwise("*").alias("mrname"),
        F.when(placed, F.col("mate.pos")).otherwise(-1).cast("bigint").alias("mpos"), size.cast("bigint").alias("isize"),
    )
    alone = rows.where("qname IS NULL").select(*COLUMNS, F.lit("*").alias("mrname"), F.lit(-1).cast("bigint").alias("mpos"), F.lit(0).cast("bigint").alias("isize"))
    return both.unionByName(alone)


def turned_descriptor(text: Column) -> Column:
    """A match descriptor of the other strand: its parts in reverse, numbers kept whole, bases complemented, gaps' marks swapped."""
    return F.translate(F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(r"(\d+|\D)"), F.lit(1))), ""), "ACGT^$", "TGCA$^")


def descriptor_cigar(text: Column) -> Column:
    """CIGAR of a match descriptor: ``^bases$`` are deleted, ``^number$`` inserted, all else are matches and single bases."""
    def piece(x: Column) -> Column:
        matches = F.aggregate(F.regexp_extract_all(x, F.lit(r"(\d+|[ACGTN])"), F.lit(1)), F.lit(0), lambda n, y: n + F.coalesce(y.try_cast("int"), F.lit(1)))
        return (
            F.when(x.rlike(r"^\^[ACGTN]+\$$"), F.concat((F.length(x) - 2).cast("string"), F.lit("D")))
            .when(x.rlike(r"^\^\d+\$$"), F.concat(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("I")))
            .when(matches > 0, F.concat(matches.cast("string"), F.lit("M"))).otherwise("")
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\^[^$]*\$|[^\^]+)"), F.lit(1)), piece), "")


def _phred(quality: Column, logodds: bool) -> Column:
    """Qualities of base 64 as phred + 33; log odds become probabilities by their law first."""
    codes = range(1 if logodds else 64, 127)
    level = lambda c: int(33 + 10 * math.log10(1 + 10 ** ((c - 64) / 10)) + 0.499) if logodds else c - 31
    known = "".join(map(chr, codes))
    outside = quality.rlike(rf"[^\x{codes[0]:02x}-\x7e]")
    return F.when(outside, F.raise_error(F.concat(F.lit("a quality outside the scale: "), quality))).otherwise(F.translate(quality, known, "".join(chr(level(c)) for c in codes)))


def gerald(lines: DataFrame, second: DataFrame | None = None, keep_failed: bool = False, logodds: bool = False) -> DataFrame:
    """Export files of one read, or of two with mates: rows as by ``mated``.

    Reads that failed the purity filter are left out, or kept with their flag. With two files each name must stand once in
    both, under its read's number, else the query raises an error; a mate that is left out tells nothing. Tags: BC, XD (the
    descriptor as the reference's strand has it), SM, AS, and H0 to H2 of reads with many places. Names come of the
    machine, run, lane, tile and place in it.
    """
    paired = second is not None

    def parsed(text: DataFrame, number: int) -> DataFrame:
        cells = text.select(F.split("value", "\t", -1).alias("t"))
        t = lambda i: F.coalesce(F.get("t", F.lit(i)), F.lit(""))
        given = lambda c: (c != "") & (c != "0")
        cluster = F.concat_ws(":", t(2), t(3), t(4), t(5))
        name = F.concat(t(0), F.when(given(t(1)), F.concat(F.lit("_"), t(1))).otherwise(""), F.lit(":"), cluster)
        back, many = t(13) == "R", t(10).rlike(r"\d+:\d+:\d+")
        placed = ~t(10).isin("NM", "QC") & ~many & (F.coalesce(t(12).try_cast("bigint"), F.lit(0)) >= 1)
        seq, qual = F.when(back, F.translate(F.reverse(t(8)), "ACGTacgt", "TGCAtgca")).otherwise(t(8)), F.when(back, F.reverse(t(9))).otherwise(t(9))
        md = F.when(back, turned_descriptor(t(14))).otherwise(t(14))
        single, both = (F.coalesce(t(i).try_cast("bigint"), F.lit(0)) for i in (15, 16))
        best = F.least(F.lit(254), F.greatest(single, both)) if paired else F.least(F.lit(254), single)
        flag = F.lit((C.PAIRED | (C.READ1 if number == 1 else C.READ2)) if paired else 0) + F.when(t(21) == "Y", 0).otherwise(C.QC_FAIL)
        flag = flag + F.when(~placed, C.UNMAPPED).otherwise(F.when(back, C.REVERSE).otherwise(0) + (F.when(both > 0, C.PROPER).otherwise(0) if paired else 0))
        hits = {f"H{k}": F.when(many & ~t(10).isin("NM", "QC"), F.regexp_extract(t(10), r"(\d+):(\d+):(\d+)", k + 1)) for k in range(3)}
        filled = lambda i: F.when(placed & (t(i) != ""), t(i))
        tags = _tags(**hits, BC=F.when(given(t(6)), t(6)), XD=F.when(placed, md), SM=filled(15), **({"AS": filled(16)} if paired else {}))
        return cells.select(
            name.alias("qname"), flag.cast("bigint").alias("flag"), F.when(placed, F.concat(t(10), F.when(t(11) != "", F.concat(F.lit("/"), t(11))).otherwise(""))).otherwise("*").alias("rname"),
            F.when(placed, t(12).try_cast("bigint") - 1).otherwise(-1).alias("pos"), F.when(placed, best).otherwise(0).cast("bigint").alias("mapq"),
            F.when(~placed, "*").when(md.contains("^"), descriptor_cigar(md)).otherwise(F.concat(F.length(seq).cast("string"), F.lit("M"))).alias("cigar"), seq.alias("seq"), _phred(qual, logodds).alias("qual"), tags.alias("tags"),
            F.lit(number).alias("side"), (t(7) == str(number)).alias("known"), (t(21) == "Y").alias("passed"),
        )

    rows = parsed(lines, 1)
    kept = F.lit(True) if keep_failed else F.col("passed")
    if not paired:
        return mated(rows.where(kept).select(*COLUMNS))
    of = Window.partitionBy("qname")
    rows = rows.unionByName(parsed(second, 2)).withColumns({"one": F.count_if(F.col("side") == 1).over(of), "two": F.count_if(F.col("side") == 2).over(of)})
    fault = F.when(~F.col("known"), "a read of another number: ").when((F.col("one") != 1) | (F.col("two") != 1), "a name that does not stand once in both files: ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, "qname")).cast("boolean")).otherwise(kept)
    return mated(rows.where(checked).select(*COLUMNS))


def blast_sections(spark: SparkSession, path: str) -> DataFrame:
    """(value) of BLAST's text reports, one row a query: files are cut at the lines that name queries, by byte range."""
    return spark.read.option("lineSep", "\nQuery= ").text(path)


def blast(sections: DataFrame, with_bases: bool = False) -> DataFrame:
    """One row for each alignment block of each query's section: hard clips at both ends, operations from the two gapped rows.

    A section is its query's text from the name on, as ``blast_sections`` cuts it; what stands before a file's first query has
    no block. Tags are AS (bits, rounded) and EV. Blocks on the other strand are turned, and lie where their last row
    ends. Sections without a block, empty and null ones give no row. A query of no stated length is an error.
    """
    body = F.regexp_replace("value", r"^\s*Query= ", "")
    heads = sections.where(F.col("value").contains(" bits")).select(F.regexp_extract(body, r"^(\S+)", 1).alias("qname"), F.regexp_replace(F.regexp_extract(body, r"\(([\d,]+)\s+letters\)", 1), ",", "").try_cast("bigint").alias("size"), body.alias("body"))
    subjects = heads.select("qname", "size", F.explode(F.split("body", r"(?m)(?=^>\S)")).alias("part")).where(F.col("part").startswith(">"))
    blocks = subjects.select("qname", "size", F.regexp_extract("part", r"^>(\S+)", 1).alias("rname"), F.explode(F.split("part", r"(?m)(?=^.*Score =.*bits.*Expect)")).alias("block"))
    found = lambda pattern, k: F.regexp_extract_all("block", F.lit(pattern), F.lit(k))
    score = r"Score =\s+(\S+) bits.+Expect(?:\(\d+\))? = ([^\s,]+)"
    query, target = r"Query:\s(\d+)\s*(\S+)\s(\d+)", r"Sbjct:\s(\d+)\s*(\S+)\s(\d+)"
    rows = blocks.select(
        "qname", "size", "rname", F.regexp_extract("block", score, 1).try_cast("double").alias("bits"), F.regexp_extract("block", score, 2).alias("expect"), F.col("block").rlike(r"Strand = \S+ / Minus").alias("back"),
        F.get(found(query, 1), F.lit(0)).cast("bigint").alias("first"), F.try_element_at(found(query, 3), F.lit(-1)).cast("bigint").alias("last"), F.array_join(found(query, 2), "").alias("q"), F.array_join(found(target, 2), "").alias("s"),
        F.get(found(target, 1), F.lit(0)).cast("bigint").alias("begin"), F.try_element_at(found(target, 3), F.lit(-1)).cast("bigint").alias("end"),
    ).where("bits IS NOT NULL AND first IS NOT NULL")
    kinds = F.array_join(F.zip_with(F.split("q", ""), F.split("s", ""), lambda a, b: F.when(a == "-", "D").when(b == "-", "I").otherwise("M")), "")
    clip = lambda n: F.when(n > 0, F.array(F.concat(n.cast("string"), F.lit("H")))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.regexp_extract_all(kinds, F.lit("(M+|D+|I+)"), F.lit(1)), lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1)))
    rest = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("a query of no stated length: "), "qname")).cast("bigint")).otherwise(F.col("size") - F.col("last"))
    pieces = F.concat(clip(F.col("first") - 1), runs, clip(rest))
    solid = F.translate("q", "-", "")
    turned = F.translate(F.reverse(solid), "ACGTRYMKacgtrymk", "TGCAYRKMtgcayrkm")
    bases = F.when(F.col("back"), turned).otherwise(solid) if with_bases else F.lit(None).cast("string")
    expect = F.when(F.col("expect").startswith("e"), F.concat(F.lit("1"), "expect")).otherwise(F.col("expect"))
    return rows.select(
        "qname", F.when(F.col("back"), C.REVERSE).otherwise(0).cast("bigint").alias("flag"), "rname", (F.when(F.col("back"), F.col("end")).otherwise(F.col("begin")) - 1).alias("pos"), F.lit(255).cast("bigint").alias("mapq"),
        F.array_join(F.when(F.col("back"), F.reverse(pieces)).otherwise(pieces), "").alias("cigar"), bases.alias("seq"), F.lit(None).cast("string").alias("qual"), _tags(AS=F.floor(F.col("bits") + 0.499), EV=expect).alias("tags"),
    )
