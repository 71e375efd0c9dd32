import glob
import gzip

import pytest

from strandlight.functions import cigar as C
from strandlight.sources import sam


def test_sharded_fastq(spark, tmp_path):
    rows = [(f"r{i}", (64, 128 + 16, 0)[i % 3], "ACGTN"[: 1 + i % 5], None if i % 4 == 0 else "*" if i % 4 == 1 else "ABCDE"[: 1 + i % 5]) for i in range(97)] + [("none", 0, "*", "*"), ("null", 0, None, None), ("empty", 0, "", "")]
    sam.write_fastq(spark.createDataFrame(rows, "qname string, flag long, seq string, qual string"), str(tmp_path / "out"), shards=7)
    files = glob.glob(f"{tmp_path}/out/*.gz")
    assert len(files) == 7
    got, sizes = {}, []
    for file in files:
        lines = gzip.open(file, "rt").read().splitlines()
        heads = [k for k, x in enumerate(lines) if x.startswith("@r")]
        sizes.append(len(heads))
        for a, b in zip(heads, [*heads[1:], len(lines)], strict=True):
            got[lines[a]] = lines[a + 1 : b]
    want = {}
    for name, flag, seq, qual in rows[:97]:
        if flag & 16:
            seq, qual = seq[::-1].translate(str.maketrans("ACGT", "TGCA")), qual and qual[::-1]
        want[f"@{name}" + ("/1" if flag & 64 else "/2" if flag & 128 else "")] = [seq] + (["+", qual] if qual not in (None, "*") else [])
    assert got == want and max(sizes) - min(sizes) <= 7
    # input without qualities
    plain = spark.createDataFrame([("a", 0, "AC")], "qname string, flag long, seq string")
    assert [r[0] for r in sam.fastq_text(plain).collect()] == ["@a\nAC"] and sam.fastq_text(plain.limit(0)).count() == 0


def test_header_checksums(spark):
    def found(*lines):
        return [tuple(r) for r in sam.header_checksums(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).orderBy("tid").collect()]

    one, two = "@SQ\tSN:b\tLN:9\tM5:abc\tUR:x", "@SQ\tSN:a\tM5:def\tLN:7"
    assert found("@HD\tVN:1.0", one, two, "@CO\tM5:no") == [(0, "b", 9, "abc"), (1, "a", 7, "def")]
    assert found(one, "@SQ\tSN:a\tLN:7") == [(0, "b", 9, None), (1, "a", 7, None)]
    assert found("@HD\tVN:1.0") == []


def test_flags_as_text(spark):
    texts = {"0": 0, "83": 83, "0x53": 83, "0X53": 83, "0123": 83, "pPr1": 83, "1r": 80, "12": 12, "08": 0, "pPuUrR12sfd": 2047, "": 0, "p?": 1}
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", C.flag_number(df.t).alias("n")).collect()} == texts
    back = spark.createDataFrame([(0,), (83,), (2047,)], "flag long")
    assert [r[0] for r in back.select(C.letters("flag")).collect()] == ["", "pPr1", "pPuUrR12sfd"]


def test_strict_lines(spark):
    refs = spark.createDataFrame([(0, "x", 99)], "tid long, rname string, len long")
    line = lambda cigar, seq, qual: spark.createDataFrame([("\t".join(["r", "pr1", "x", "5", "9", cigar, "*", "0", "0", seq, qual]),)], "value string")
    for good in (("2M1S", "ACG", "III"), ("*", "ACG", "III"), ("2M1S", "*", "*"), ("2H3M", "ACG", "*")):
        assert sam.parsed(line(*good), refs, True).first()["qname"] == "r"
    assert sam.parsed(line("2M1S", "ACG", "*"), refs).first()["flag"] == 81
    for bad, text in ((("3M", "ACG", "II"), "qualities"), (("2M", "ACG", "III"), "CIGAR")):
        with pytest.raises(Exception, match=text):
            sam.parsed(line(*bad), refs, True).collect()
        assert sam.parsed(line(*bad), refs).count() == 1
