import random
import re

import pytest

from strandlight.sources import convert


def only(df):
    return {r["qname"]: r for r in df.collect()}


def test_bowtie(spark):
    lines = spark.createDataFrame([("r1/1\t-\tchr1\t9\tACGTA\tIIIII\t0\t1:A>C,3:G>T",), ("r2\t+\tchr2\t0\tACG\tIII\t2\t",)], "value string")
    got = only(convert.bowtie(lines))
    assert (got["r1"]["flag"], got["r1"]["pos"], got["r1"]["mapq"], got["r1"]["cigar"], got["r1"]["tags"]["MD"]) == (16, 9, 25, "5M", "1C1T1")
    assert (got["r2"]["flag"], got["r2"]["mapq"], got["r2"]["tags"]["MD"]) == (0, 0, "3")


def test_soap(spark):
    lines = spark.createDataFrame([("r1 ACGTA IIIIIII 1 a 5 + chr1 10 2 C->3I A->1I",), ("r2 ACGTA IIIII 4 b 5 - chr1 20 0",)], "value string")
    got = only(convert.soap(lines, True))
    assert (got["r1"]["flag"], got["r1"]["pos"], got["r1"]["mapq"], got["r1"]["qual"], got["r1"]["tags"]["MD"]) == (67, 9, 30, "IIIII", "1A1C1")
    assert (got["r2"]["flag"], got["r2"]["mapq"], got["r2"]["tags"]["MD"]) == (147, 0, "5")


def test_zoom(spark):
    lines = spark.createDataFrame([("a_F\tchr1 x:99\t+\t1",), ("b_R\tchr2:7\t+\t0",), ("c\tchr3:0\t-\t2",)], "value string")
    got = only(convert.zoom(lines, 30))
    assert (got["a"]["flag"], got["a"]["rname"], got["a"]["pos"], got["a"]["cigar"]) == (65, "chr1", 99, "30M")
    assert got["b"]["flag"] == 1 + 128 + 16 and got["c"]["flag"] == 16 and got["c"]["tags"]["NM"] == "2"


def test_psl(spark):
    row = lambda strand, begin, end, blocks, q, t: f"30 2 0 0 0 0 0 0 {strand} read 40 {begin} {end} chr1 1000 100 140 {len(blocks)} " + " ".join(",".join(map(str, x)) + "," for x in (blocks, q, t))
    lines = spark.createDataFrame([("psLayout version 3",), (row("+", 5, 35, [10, 20], [5, 15], [100, 113]),)], "value string")
    got = only(convert.psl(lines))["read"]
    assert (got["flag"], got["pos"], got["cigar"], got["tags"]["AS"]) == (0, 100, "5H10M3D20M5H", str(30 - 6 - 5 - 6))
    back = only(convert.psl(spark.createDataFrame([(row("-", 5, 35, [10, 18], [5, 17], [100, 110]),)], "value string")))["read"]
    assert (back["flag"], back["cigar"]) == (16, "5H10M2I18M5H")


def test_novoalign(spark):
    line = lambda name, side, strand, *marks, status="U": "\t".join([f"@{name}/1", side, "ACGTACGTAC", "IIIIIIIIIH", status, "30", "40", ">chr1", "100", strand, ".", "x", "y", *marks])
    rows = ["# made up", line("a", "L", "F"), line("b", "R", "R", "3A>C", "7C>T"), line("c", "L", "F", "4-G", "5-T", "6A>C"), line("d", "L", "F", "5+AC"), line("e", "L", "F", "2-A", "6-C", "6+TTT"), line("f", "L", "F", status="R"), line("g", "L", "F", "1A>C", "2C>G")]
    got = only(convert.novoalign(spark.createDataFrame([(r,) for r in rows], "value string")))
    assert set(got) == set("abcdeg")
    assert (got["a"]["flag"], got["a"]["rname"], got["a"]["pos"], got["a"]["mapq"], got["a"]["cigar"], got["a"]["tags"]) == (67, "chr1", 99, 40, "10M", {"NM": "0", "MD": "10"})
    assert (got["b"]["flag"], got["b"]["seq"], got["b"]["qual"][0], got["b"]["cigar"], got["b"]["tags"]["MD"]) == (147, "GTACGTACGT", "H", "10M", "2A3C3")
    assert (got["c"]["cigar"], got["c"]["tags"]["MD"], got["c"]["tags"]["NM"]) == ("3M2D7M", "3^GT0A6", "3")
    assert (got["d"]["cigar"], got["d"]["tags"]["MD"]) == ("4M2I4M", "8")
    assert (got["g"]["cigar"], got["g"]["tags"]["MD"]) == ("10M", "AC8")


def test_read_groups(spark):
    text = lambda *parts: spark.createDataFrame([(p,) for p in parts], "value string")
    experiments = text('<EXPERIMENT_SET><EXPERIMENT alias="x" accession="E1"><LIBRARY_NAME> libA </LIBRARY_NAME></EXPERIMENT>\n<EXPERIMENT accession="E2"></EXPERIMENT></EXPERIMENT_SET>')
    runs = text('<RUN accession="R1"><EXPERIMENT_REF accession="E1"/></RUN><RUN accession="R2"><EXPERIMENT_REF accession="E2"/></RUN>', '<run accession="R3"><experiment_ref accession="E1"/></run>')
    got = {tuple(r) for r in convert.read_groups(text('<SAMPLE alias="NA1" accession="S1">'), experiments, runs).collect()}
    assert got == {("R1", "NA1", "libA"), ("R2", "NA1", None), ("R3", "NA1", "libA")}
    assert {r["sm"] for r in convert.read_groups(text("<none/>"), experiments, runs).collect()} == {"UNKNOWN"}


def export(name, number, chrom, pos="", strand="F", md="", single="", both="", seq="ACGTA", qual="hhhhB", passed="Y", index="", run="7", contig=""):
    return "\t".join([name, run, "1", "2", "3", "4", index, str(number), seq, qual, chrom, contig, str(pos), strand, md, str(single), str(both), "", "", "", "", passed])


def text(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_gerald_pairs(spark):
    one = text(spark, export("a", 1, "chr1", 10, md="5", single=30, both=60, index="ACG"), export("b", 1, "NM"), export("c", 1, "chr1", 5, md="5", passed="N"), export("d", 1, "3:2:1", index="0"))
    two = text(spark, export("a", 2, "chr1", 40, "R", "2A2", 300, 20, contig="x"), export("b", 2, "chr2", 7, "R", "5", 9), export("c", 2, "chr1", 90, md="5"), export("d", 2, "QC", passed="N"))
    got = {(r["qname"][0], 2 if r["flag"] & 128 else 1): r for r in convert.gerald(one, two).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("d", 1)}
    a, b = got["a", 1], got["a", 2]
    assert (a["qname"], a["flag"], a["rname"], a["pos"], a["mapq"], a["cigar"], a["qual"], a["tags"]) == ("a_7:1:2:3:4", 1 + 2 + 32 + 64, "chr1", 9, 60, "5M", "IIII#", {"BC": "ACG", "XD": "5", "SM": "30", "AS": "60"})
    assert (a["mrname"], a["mpos"], a["isize"]) == ("chr1/x", 39, 0)
    assert (b["flag"], b["mapq"], b["seq"], b["qual"], b["tags"]["XD"], b["mrname"], b["mpos"]) == (1 + 2 + 16 + 128, 254, "TACGT", "#IIII", "2T2", "chr1", 9)
    assert (got["b", 1]["flag"], got["b", 1]["mrname"], got["b", 1]["mpos"], got["b", 1]["pos"]) == (1 + 4 + 32 + 64, "chr2", 6, -1)
    assert (got["b", 2]["flag"], got["b", 2]["mrname"], got["b", 2]["isize"]) == (1 + 8 + 16 + 128, "*", 0)
    # the mate that failed the filter tells nothing
    assert (got["c", 2]["flag"], got["c", 2]["mrname"]) == (1 + 128, "*")
    assert got["d", 1]["tags"] == {"H0": "3", "H1": "2", "H2": "1"} and got["d", 1]["flag"] == 1 + 4 + 64
    kept = {(r["qname"][0], 2 if r["flag"] & 128 else 1): r for r in convert.gerald(one, two, keep_failed=True).collect()}
    assert len(kept) == 8 and (kept["c", 1]["flag"], kept["c", 1]["mrname"], kept["c", 1]["isize"]) == (1 + 64 + 512, "=", 85)
    assert kept["c", 2]["isize"] == -85 and kept["d", 1]["flag"] == 1 + 4 + 8 + 64


def test_gerald_faults(spark):
    good = export("a", 1, "NM")
    for one, two in (([good], []), ([good], [export("b", 2, "NM")]), ([good, good], [export("a", 2, "NM")]), ([good], [export("a", 1, "NM")])):
        with pytest.raises(Exception, match="name that|another number"):
            convert.gerald(text(spark, *one), text(spark, *two)).collect()
    with pytest.raises(Exception, match="quality outside"):
        convert.gerald(text(spark, export("a", 1, "NM", qual="hh;hh"))).collect()
    old = convert.gerald(text(spark, export("a", 1, "NM", qual="hh;@J", run="0")), logodds=True).first()
    assert (old["qname"], old["qual"]) == ("a:1:2:3:4", "II" + "".join(chr(int(33 + 10 * __import__("math").log10(1 + 10 ** (v / 10)) + 0.499)) for v in (-5, 0, 10)))
    assert convert.gerald(text(spark), text(spark)).count() == 0


def test_descriptors(spark):
    rng = random.Random(3)

    def made():
        parts, cigar, run = [], [], 0
        for _ in range(rng.randint(1, 8)):
            kind = rng.choice("nnbDI")
            if kind in "nb":
                n = rng.randint(1, 120) if kind == "n" else rng.randint(1, 3)
                if kind == "n" and parts and parts[-1].isdigit():
                    continue
                parts.append(str(n) if kind == "n" else "".join(rng.choice("ACGTN") for _ in range(n)))
                run += n
                continue
            if run:
                cigar.append(f"{run}M")
            n, run = rng.randint(1, 12), 0
            parts.append("^" + (str(n) if kind == "I" else "".join(rng.choice("ACGT") for _ in range(n))) + "$")
            cigar.append(f"{n}{kind}")
        return parts, "".join(cigar) + (f"{run}M" if run else "")

    rows = [("".join(p), c, "".join(x if x.isdigit() else "^" + (x[1:-1] if x[1:-1].isdigit() else x[-2:0:-1].translate(str.maketrans("ACGT", "TGCA"))) + "$" if x[0] == "^" else x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in p[::-1])) for p, c in (made() for _ in range(200))]
    df = spark.createDataFrame(rows, "md string, cigar string, turned string")
    back = lambda c: "".join(re.findall(r"\d+[MDI]", c)[::-1])
    for r in df.select("*", convert.descriptor_cigar(df.md).alias("c"), convert.turned_descriptor(df.md).alias("t"), convert.descriptor_cigar(convert.turned_descriptor(df.md)).alias("tc")).collect():
        assert (r["c"], r["t"], r["tc"]) == (r["cigar"], r["turned"], back(r["cigar"])), r["md"]


def test_mated_repeats_and_nulls(spark):
    row = lambda name, flag, pos, rname="x": (name, flag, rname, pos, 1, "4M", None, None, {})
    schema = "qname string, flag long, rname string, pos long, mapq long, cigar string, seq string, qual string, tags map<string,string>"
    rows = [row("a", 65, 1), row("a", 145, 30), row("a", 65, 2), row("a", 145, 40), row("a", 65, 3), row(None, 65, 5), row(None, 129, 6)]
    got = sorted(((r["qname"] or "", r["pos"], r["mpos"], r["isize"], r["flag"]) for r in convert.mated(spark.createDataFrame(rows, schema)).collect()))
    assert got == [("", 5, -1, 0, 65), ("", 6, -1, 0, 129), ("a", 1, 30, 33, 97), ("a", 2, 40, 42, 97), ("a", 3, -1, 0, 65), ("a", 30, 1, -33, 145), ("a", 40, 2, -42, 145)]


REPORT = """BLASTN 2.2.18

Query= {0}
         (1,030 letters)

Database: made.fa
           5 sequences; 16,000 total letters

>chr1 made up
          Length = 3200

 Score = 60.0 bits (30), Expect = e-10
 Identities = 10/10 (100%)
 Strand = Plus / Plus


Query: 11  ACGTAC-TA 18
           |||||| ||
Sbjct: 101 ACGTACGTA 109


Query: 19  CCGG 22
           | ||
Sbjct: 110 C-GG 112


 Score = 24.3 bits (12), Expect(2) = 0.5
 Identities = 4/4
 Strand = Plus / Minus


Query: 1   AACR 4
           ||||
Sbjct: 50  AACR 47

>chr2
          Length = 3200

 Score = 20 bits (12), Expect = 3e-05
 Strand = Plus / Plus

Query: 1027 AAAA 1030
            ||||
Sbjct: 1    AAAA 4

"""


def test_blast(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(REPORT.format(f"r{i}") for i in range(300)) + "Query= none\n   (5 letters)\n\n ***** No hits found ******\n")
    want = {(f"r{i}", *x) for i in range(300) for x in (
        (0, "chr1", 100, "10H6M1D3M1I2M1008H", "ACGTACTACCGG", "60", "1e-10"), (16, "chr1", 46, "1026H4M", "YGTT", "24", "0.5"), (0, "chr2", 0, "1026H4M", "AAAA", "20", "3e-05"))}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("1009", "20000", "10000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = convert.blast(convert.blast_sections(spark, str(tmp_path)), True).collect()
            assert len(found) == 900
            assert {(r["qname"], r["flag"], r["rname"], r["pos"], r["cigar"], r["seq"], r["tags"]["AS"], r["tags"]["EV"]) for r in found} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert convert.blast(spark.createDataFrame([("",), (None,), ("x",)], "value string")).count() == 0
    with pytest.raises(Exception, match="no stated length"):
        convert.blast(text(spark, REPORT.format("r").split("Query= ")[1].replace("letters)", "letters"))).collect()
