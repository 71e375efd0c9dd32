import random

import pytest
from pyspark.sql import functions as F
from strandlight.functions import cigar as C
from strandlight.operators import calls, dedup, filters, pairing, pileup, rescue, sorting, stats, variants
from strandlight.plans.fixtures import aln, refs, special_refs
from strandlight.sources import bam, fasta, sam

SF = "/root/testdata/sf0.001"
TOY = "@SQ\tSN:ref\tLN:45\nr001\t163\tref\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t*\nr003\t0\tref\t9\t30\t5H6M\t*\t0\t0\tAGCTAA\t*\nr004\t0\tref\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*\tRG:Z:g1\n"


def test_regions():
    assert C.parse_region("chr1") == ("chr1", 0, 1 << 29)
    assert C.parse_region("chr1:1,001-2,000") == ("chr1", 1000, 2000)
    with pytest.raises(ValueError):
        C.parse_region("")


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    assert all(r[0] == r[1] for r in df.select("s", C.reverse_complement(C.reverse_complement("s"))).collect())


def test_islands(spark):
    spans = spark.createDataFrame([(0, 0, 100), (0, 0, 90), (0, 1000, 1085), (0, 1050, 1150), (0, 1151, 1251)], "tid long, begin long, end long")
    assert sorted(tuple(r) for r in stats.islands(spans).collect()) == [(0, 0, 100), (0, 1000, 1150), (0, 1151, 1251)]


def test_replay_agrees_with_sets(spark):
    reads = filters.rescue_candidates(aln(spark, SF))
    exact = {tuple(r) for r in pairing.replayed_pairs(reads, 1000).select("first", "second").collect()}
    sets = {tuple(r) for r in pairing.mate_pairs(reads, 1000).select("a.rec_no", F.col("b.rec_no").alias("x")).collect()}
    assert exact == sets


def test_replay_forgets_beyond_two_bins(spark):
    reads = spark.createDataFrame([(0, 0, "a", 1), (0, 150, "b", 2), (0, 160, "a", 3), (0, 900, "b", 4), (1, 5, "c", 5), (1, 6, "c", 6)], "tid long, pos long, qname string, rec_no long")
    assert sorted(tuple(r) for r in pairing.replayed_pairs(reads, 100).collect()) == [(0, 1, 3), (1, 5, 6)]


def test_region_types_cover_all():
    assert len(pairing.REGION_TYPES) == 12 and all(len(set(v)) == 2 for v in pairing.REGION_TYPES.values())


def test_rescue_recovers_planted_indels(spark):
    reads = aln(spark, SF).where("pair_id % 5 = 0")
    found = sorting.checkpointed(pairing.classified(pairing.mate_pairs(filters.rescue_candidates(reads), 1000)))
    won = rescue.rescued(found, refs(spark, SF), rescue.RescueConfig(), special_refs(spark, SF))
    cigars = {r[0] for r in won.where("event = 'medium_indel'").select("cigar").distinct().collect()}
    assert {"50M12I38M", "50M12D50M"} <= cigars
    whole = rescue.complete(reads, found, won)
    by = {r[0]: r[1] for r in whole.groupBy("origin").count().collect()}
    assert by["anchor"] == by["rescued"] and by["input"] + by["anchor"] + by["rescued"] == reads.count()


def test_mismatch_strings_and_masks(spark):
    bases = "NNACGTTACGNTTGCA"
    reads = [("a", 2, "4M", "ACGT", "IIII"), ("b", 2, "4M", "ACCT", "IIII"), ("c", 2, "2M1D2M", "ACTT", "IIII"), ("d", 2, "1S2M2I2M", "NACGGGT", "IIIIIII"), ("e", 2, "2M2D1M", "acc", "III"), ("f", 8, "4M", "CGNT", "IIII"), ("g", 2, "3M", "=CT", "III"), ("h", 2, "2M", "*", "*"), ("i", 0, "1M1D1P1D1M", "CC", "II")]
    aln = spark.createDataFrame([(q, 1, k, 0, 0, p, c, s, u) for k, (q, p, c, s, u) in enumerate(reads)], "qname string, m long, rec_no long, flag long, tid long, pos long, cigar string, seq string, qual string")
    refs = spark.createDataFrame([(0, "c", len(bases), bases)], "tid long, rname string, len long, bases string")
    got = {r["qname"]: r for r in calls.masked_matches(aln, refs, equal=True, max_nm=2).collect()}
    assert {q: (r["nm"], r["md"]) for q, r in got.items()} == {"a": (0, "4"), "b": (1, "2G1"), "c": (1, "2^G2"), "d": (2, "4"), "e": (3, "2^GT0T0"), "f": (1, "2N1"), "g": (1, "2G0"), "h": (None, None), "i": (3, "0N0^N0^A1")}
    assert {q: r["seq"] for q, r in got.items()} == {"a": "====", "b": "==C=", "c": "====", "d": "NNNGGNN", "e": "NNC", "f": "==N=", "g": "==T", "h": "*", "i": "CN"}
    assert (got["a"]["qual"], got["d"]["qual"], got["e"]["qual"], got["h"]["qual"]) == ("IIII", "I!!II!!", "!!I", "*")
    plain = {r["qname"]: r["seq"] for r in calls.masked_matches(aln, refs, max_nm=2).collect()}
    assert (plain["a"], plain["b"], plain["e"]) == ("ACGT", "ACCT", "NNC")


def test_long_spans_have_all_their_reference(spark):
    """Introns, deletions and matches beyond a tile and its margin, and the text of a deletion of more than 60 bases."""
    rng = random.Random(5)
    bases = "".join(rng.choice("ACGT") for _ in range(200_000))
    other = lambda c: "A" if c != "A" else "C"
    reads = [(65_500, "20M3000N20M", bases[65_500:65_519] + other(bases[65_519]) + bases[68_520:68_539] + other(bases[68_539])), (65_530, "10M1500D10M", bases[65_530:65_540] + bases[67_040:67_050]), (10, "150000M", bases[10:150_009] + other(bases[150_009])), (300, "10M2D10M", bases[300:310] + bases[312:322])]
    reads = [("r", 1, k, 0, 0, p, 60, c, q) for k, (p, c, q) in enumerate([*reads, reads[0]])]
    aln = spark.createDataFrame(reads, "qname string, m long, rec_no long, flag long, tid long, pos long, mapq long, cigar string, seq string")
    refs = spark.createDataFrame([(0, "c", len(bases), bases)], "tid long, rname string, len long, bases string")
    got = {r["rec_no"]: (r["nm"], r["md"]) for r in calls.mismatch_strings(aln, refs).collect()}
    spliced = (2, f"19{bases[65_519]}19{bases[68_539]}0")
    assert got == {0: spliced, 1: (1500, f"10^{bases[65_540:67_040]}10"), 2: (1, f"149999{bases[150_009]}0"), 3: (2, f"10^{bases[310:312]}10"), 4: spliced}
    shown = {r["pos"]: r["bases"] for r in pileup.rows(aln.where("rec_no in (1, 3)"), refs).where("pos in (309, 65539)").collect()}
    assert shown == {309: f".-2{bases[310:312]}", 65_539: f".-1500{bases[65_540:67_040]}"}


def test_variant_filter_marks_dense_and_gaps(spark):
    snp = lambda pos: (0, pos, "A", "G", 50, 60, 20, "", "", 0, 0)
    gap = lambda pos: (0, pos, "*", "*/+A", 60, 60, 20, "*", "+A", 0, 5)
    rows = [snp(100), snp(103), snp(106), snp(500), gap(503), snp(900)]
    df = spark.createDataFrame(rows, "tid long, pos long, ref string, cons string, snp_q long, rms_q long, depth long, allele1 string, allele2 string, n1 long, n2 long")
    got = {(r["pos"], r["ref"]): r["filter"] for r in variants.filtered_variants(df).collect()}
    assert got == {(100, "A"): "W", (103, "A"): "W", (106, "A"): "W", (500, "A"): "G", (503, "*"): "U", (900, "A"): "U"}


def filters_brute(rows, d=3, D=100, l=30, Q=25, q=10, G=25, s=100, w=10, W=10, N=2, S=0, i=0):  # noqa: E741
    size = lambda r: max(len(a) - 1 if a[0] == "-" else 0 for a in r[3].split("/")) if r[2] == "*" else 0
    score = lambda r: r[4] + s * ((r[9] if r[7] != "*" else 0) + (r[10] if r[8] != "*" else 0))
    own = lambda r: "d" if r[6] < d else "D" if r[6] > D else ("i" if r[2] == "*" else "s") if r[4] < (i if r[2] == "*" else S) else None
    good = [r for r in rows if not own(r) and r[3] != "*/*"]
    gaps, snps = [r for r in good if r[2] == "*"], [r for r in good if r[2] != "*" and r[5] >= Q]
    out = {}
    for r in rows:
        if r[3] == "*/*":
            continue
        flag = own(r)
        if not flag and r[2] == "*":
            flag = "Q" if r[5] < q else "U"
            for x in gaps:
                near = x[0] == r[0] and x != r and (x[1] + size(x) + l >= r[1] if (x[1], x[3]) < (r[1], r[3]) else r[1] + size(r) + l >= x[1])
                if near and (score(x), -x[1], [-ord(c) for c in x[3]]) > (score(r), -r[1], [-ord(c) for c in r[3]]):
                    flag = "g"
        elif not flag:
            flag = "Q" if r[5] < Q else "U"
            if any(x[0] == r[0] and x[4] >= G and x[1] - w <= r[1] <= x[1] + size(x) + w for x in gaps):
                flag = "G"
            if r[5] >= Q and any(sum(y[0] == r[0] and x[1] - W <= y[1] <= x[1] for y in snps) > N for x in snps if x[0] == r[0] and r[1] <= x[1] <= r[1] + W):
                flag = "W"
        out[r[0], r[1], r[2], r[3]] = flag
    return out


def test_variant_filters_are_their_rules(spark):
    rng = random.Random(5)
    rows = {}
    for _ in range(400):
        # around the borders of cells and stretches, on references longer than a stretch
        pos = max(0, rng.choice([0, 256, 1 << 16, 1 << 17]) + rng.randint(-90, 90))
        common = (rng.choice([0, 10, 24, 25, 26, 60, 200]), rng.choice([5, 9, 10, 24, 25, 60]), rng.choice([2, 3, 20, 20, 20, 100, 101]))
        if rng.random() < 0.3:
            a, b = rng.choice(["*", "+A", "-NN"]), rng.choice(["*", "+AC", "-" + "N" * rng.choice([1, 70, 300])])
            rows[rng.randint(0, 1), pos, "*"] = (f"{a}/{b}", *common, a, b, rng.randint(0, 4), rng.randint(0, 4))
        else:
            rows[rng.randint(0, 1), pos, "A"] = ("G", *common, "", "", 0, 0)
    rows = [(*k, *v) for k, v in rows.items()]
    df = spark.createDataFrame(rows, "tid long, pos long, ref string, cons string, snp_q long, rms_q long, depth long, allele1 string, allele2 string, n1 long, n2 long")
    for options in ({}, {"S": 20, "i": 30, "N": 4, "l": 300}):
        got = {(r["tid"], r["pos"], r["ref"], r["cons"]): r["filter"] for r in variants.filtered_variants(df, **options).collect()}
        assert got == filters_brute(rows, **options)
    assert set("UQdDWGg") <= set(filters_brute(rows).values())


def test_headers_merge_and_conflict(spark):
    lines = spark.createDataFrame([("RG", {"ID": "a", "LB": "l"}), ("RG", {"ID": "a", "SM": "s"}), ("CO", {"x": "y"}), ("CO", {"x": "y"})], "type string, tags map<string,string>")
    got = sorted((r["type"], sorted(r["tags"].items())) for r in sorting.merged_headers(lines).collect())
    assert got == [("CO", [("x", "y")]), ("RG", [("ID", "a"), ("LB", "l"), ("SM", "s")])]
    with pytest.raises(Exception, match="conflicting header tag"):
        sorting.merged_headers(lines.unionByName(spark.createDataFrame([("RG", {"ID": "a", "LB": "other"})], lines.schema))).collect()


def test_text_source(spark, tmp_path):
    path = tmp_path / "toy.sam"
    path.write_text(TOY)
    reads, found = sam.read(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [(0, "ref", 45)]
    rows = {r["qname"]: r for r in reads.collect()}
    assert rows["r001"]["pos"] == 6 and rows["r001"]["mtid"] == 0 and rows["r003"]["mtid"] == -1 and rows["r004"]["tags"] == {"RG": "g1"}
    ends = {r[0]: (r[1], r[2]) for r in reads.select("qname", C.end_of("pos", "cigar"), C.query_length("cigar")).collect()}
    assert ends == {"r001": (22, 17), "r003": (14, 6), "r004": (40, 12)}


def test_binary_round_trip(spark, tmp_path):
    bam.register(spark)
    text = "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:AFRICA\tLN:3200\n@SQ\tSN:AMERICA\tLN:3200\n"
    row = lambda i: (f"r{i}", 99, i % 2, ("AFRICA", "AMERICA")[i % 2], 10 * i, 30, "5M1I4M", i % 2, 10 * i + 50, 60, "ACGTNACGTA", "IIIIIHHHHH" if i % 3 else None, {"RG": "Z:g", "NM": f"i:{i}", "XF": "f:0.5"})
    df = spark.createDataFrame([row(i) for i in range(3000)], bam.SCHEMA).repartition(3)
    df.write.format("strand_bam").mode("append").option("header", text).save(str(tmp_path / "out"))
    back = spark.read.format("strand_bam").load(str(tmp_path / "out"))
    key = lambda rows: sorted(str(r.asDict()) for r in rows)
    assert key(back.collect()) == key(df.collect())


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one first\nACGT\nAC\n>two\nGGTT\n")
    got = fasta.read(spark, str(path))
    assert [tuple(r) for r in got.orderBy("tid").collect()] == [(0, "one", 6, "ACGTAC"), (1, "two", 4, "GGTT")]
    slices = spark.createDataFrame([("one", 2, 99), ("two", -3, 2), ("none", 0, 1)], "rname string, begin long, end long")
    assert {(r["rname"], r["bases"]) for r in fasta.fetched(fasta.lines(spark, str(path)), slices).collect()} == {("one", "GTAC"), ("two", "GG")}


def test_stream_pairs(spark, tmp_path):
    from strandlight.streaming.pairing import stream_pairs

    reads = filters.rescue_candidates(aln(spark, SF)).select("qname", "m", "tid", "pos", "rec_no")
    reads.repartition(1).sortWithinPartitions("tid", "pos").write.parquet(str(tmp_path / "in"))
    live = stream_pairs(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), 1000)
    q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0] for r in pairing.mate_pairs(filters.rescue_candidates(aln(spark, SF)), 1000).select("qname").collect()}
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("qname").collect()} == want


def test_empty_tables(spark):
    none = aln(spark, SF).limit(0)
    assert stats.depth(none).count() == 0 and pairing.mate_pairs(none, 10).count() == 0 and stats.flagstat(none).first()["total"] == 0
    assert sorting.ranked(none, sorting.coordinate_order()).count() == 0


def test_runs_and_islands_over_borders(spark):
    rng = random.Random(7)
    rows = [(0, 65_000, 66_000), (0, 65_536, 65_537), (1, 10, 200_000), (1, 131_072, 131_073), (2, 65_000, 65_536), (2, 65_536, 66_000)]
    rows += [(3, a, a + rng.randint(1, 40)) for a in (rng.randint(0, 600) for _ in range(60))]
    spans = spark.createDataFrame(rows, "tid long, begin long, end long")
    for bucket in (1 << 16, 32):
        if bucket == 32:
            spans, rows = spans.where("tid = 3"), [r for r in rows if r[0] == 3]
        runs, want = sorted(tuple(r) for r in stats.coverage_runs(spans, bucket).select("tid", "begin", "end", "depth").collect()), []
        for tid in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == tid]
            edges = sorted({x for r in own for x in r[1:]})
            for a, b in zip(edges, edges[1:], strict=False):
                n = sum(r[1] <= a < r[2] for r in own)
                if n and want and want[-1][0] == tid and want[-1][2] == a and want[-1][3] == n:
                    want[-1] = (*want[-1][:2], b, n)
                elif n:
                    want.append((tid, a, b, n))
        assert runs == want
        joined, islands = [], sorted(tuple(r) for r in stats.islands(spans, bucket=bucket).select("tid", "begin", "end").collect())
        for tid, a, b in sorted(rows):
            if joined and joined[-1][0] == tid and a <= joined[-1][2]:
                joined[-1] = (tid, joined[-1][1], max(b, joined[-1][2]))
            else:
                joined.append((tid, a, b))
        assert islands == joined


def test_dense_over_borders(spark):
    at = [0, 5, 65_530, 65_535, 65_536, 65_540, 65_541, 131_080]
    got = {r["pos"]: (r["near"], r["dense"]) for r in pileup.dense(spark.createDataFrame([(0, p) for p in at], "tid long, pos long"), 10, 2).collect()}
    assert got == {p: (n := sum(p - 10 <= x <= p for x in at), n > 2) for p in at}


def test_text_written_reads_back(spark, tmp_path):
    body = TOY.split("\n", 1)[1].rstrip("\n").split("\n")
    lines = spark.createDataFrame([(x,) for x in ["@SQ\tSN:other\tLN:9", "@SQ\tSN:ref\tLN:45", *body, "r009\t16\tref\t20\t3\t3M\t*\t0\t0\tACG\tAB!\tXT:A:U\tNM:i:2"]], "value string").coalesce(1)
    known = sam.header_refs(lines)
    reads = sam.parsed(lines, known)
    path = str(tmp_path / "text")
    sam.write(reads, known, path, order="coordinate")
    again, found = sam.read(spark, path)
    assert sorted(map(tuple, found.collect())) == [(0, "other", 9), (1, "ref", 45)]
    columns = [c for c in reads.columns if c != "tags"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, reads.select(columns).collect())) and again.where("qual = 'AB!' AND tags['NM'] = '2' AND tid = 1").count() == 1
    # two files with one header each have one set of references
    sam.write(reads, known, path, mode="append")
    assert sam.read(spark, path)[1].count() == 2
    fastq = {r["name"]: (r["seq"], r["qual"]) for r in sam.as_fastq(again).collect()}
    assert fastq["r009"] == ("CGT", "!BA")


def test_binary_files_of_repeated_tasks_count_once(spark, tmp_path):
    writer = bam.Writer(str(tmp_path), {"header": "@SQ\tSN:ref\tLN:45"}, False)
    first, again = writer.write(iter(())), writer.write(iter(()))
    assert not list(tmp_path.glob("*.bam"))
    writer.commit([first])
    assert [p.name for p in tmp_path.iterdir()] == [first.name] and again.name != first.name
    writer = bam.Writer(str(tmp_path), {"header": "@SQ\tSN:ref\tLN:45"}, True)
    failed = writer.write(iter(()))
    writer.abort([failed])
    assert [p.name for p in tmp_path.iterdir()] == [first.name]
    last = writer.write(iter(()))
    writer.commit([last, None])
    assert [p.name for p in tmp_path.iterdir()] == [last.name]


def test_headers_and_tags(spark):
    lines = spark.createDataFrame([("@HD\tVN:1.0\tSO:coordinate",), ("@SQ\tSN:SO:coordinate\tLN:3",), ("r\t0",)], "value string")
    assert sam.is_sorted(lines) and not sam.is_sorted(lines.select(sam.unsorted_header("value").alias("value")))
    assert {r[0] for r in lines.select(sam.unsorted_header("value")).collect()} == {"@HD\tVN:1.0\tSO:unsorted", "@SQ\tSN:SO:coordinate\tLN:3", "r\t0"}
    listed = spark.createDataFrame([("b\t5",), ("a\t7\tmore",)], "value string").coalesce(1)
    assert [tuple(r) for r in sam.reference_list(listed).orderBy("tid").collect()] == [(0, "b", 5), (1, "a", 7)]
    with pytest.raises(ValueError):
        sam.reference_list(listed.union(listed))
    tags = spark.createDataFrame([({"NM": "3", "XT": "A"},)], "tags map<string,string>")
    assert tuple(tags.select(C.tag_number("tags", "NM"), C.tag_number("tags", "XT"), C.tag_number("tags", "ZZ")).first()) == (3, 0, 0)


def test_regions_meet_once_over_cells(spark):
    rng = random.Random(9)
    reads = [(rng.randint(-1, 1), (p := rng.choice([0, 4090, 4096, 8190]) + rng.randint(0, 9)), rng.choice(["5M", "3M5000N2M", "*", "9M2D1M"]), i) for i in range(80)]
    spans = [(k, rng.randint(0, 1), (b := rng.randint(0, 9000)), b + rng.choice([0, 1, 50, 7000])) for k in range(40)]
    got = filters.overlapping_regions(spark.createDataFrame(reads, "tid long, pos long, cigar string, rec_no long"), spark.createDataFrame(spans, "region long, tid long, begin long, end long"))
    size = {"5M": 5, "3M5000N2M": 5005, "*": 1, "9M2D1M": 12}
    want = sorted((i, k) for t, p, c, i in reads for k, u, b, e in spans if t == u and b < e and p < e and p + size[c] > b)
    assert sorted((r["rec_no"], r["region"]) for r in got.collect()) == want


def test_vcf_of_sites(spark):
    rows = [(0, 1, "C", "R", 50, 60, 7, "", "", 0, 0), (0, 2, "G", "T", 40, 60, 5, "", "", 0, 0), (0, 3, "T", "B", 40, 60, 5, "", "", 0, 0)]
    rows += [(0, p, "*", cons, 30, 60, 9, a, b, 1, 1) for p, cons, a, b in ((4, "+AC/+AC", "+AC", "*"), (5, "*/-NN", "*", "-NN"), (6, "*/*", "*", "+T"), (7, "+A/-NNN", "+A", "-NNN"))]
    sites = spark.createDataFrame(rows, "tid long, pos long, ref string, cons string, snp_q long, rms_q long, depth long, allele1 string, allele2 string, n1 long, n2 long")
    refs = spark.createDataFrame([(0, "c", 10, "ACGTacgtAC")], "tid long, rname string, len long, bases string")
    got = {r["pos"]: tuple(r)[2:] for r in variants.as_vcf(sites, refs).collect()}
    assert got == {2: ("C", "A,G", 50, "DP=7", "1/2"), 3: ("G", "T", 40, "DP=5", "1/1"), 5: ("A", "IAC", 30, "DP=9", "1/1"), 6: ("C", "D2", 30, "DP=9", "0/1"), 7: ("G", "IT", 30, "DP=9", "0/1"), 8: ("T", "IA,D3", 30, "DP=9", "1/2")}
    assert {r["pos"] for r in variants.as_vcf(sites, refs, indels=False).collect()} == {2, 3} and {r["pos"] for r in variants.as_vcf(sites, refs, snps=False).collect()} == {5, 6, 7, 8}


def test_pairs_of_merged_inputs_stay_as_many(spark):
    """Record numbers and names that two inputs share multiply no row; the worse of two pairs of one place goes with its tail."""
    rows = [(q, n, 99 if s > 0 else 147, 0, p, 0, s, "l", u) for q, n, p, s, u in (("a", 1, 10, 90, 50), ("a", 2, 70, -90, 50), ("b", 3, 10, 90, 60), ("b", 4, 70, -90, 60), ("c", 5, 11, 90, 60), (None, 6, 10, 90, 5), (None, 7, 70, -90, 5))]
    both = spark.createDataFrame(rows + rows, "qname string, rec_no long, flag long, tid long, pos long, mtid long, isize long, lib string, sumq long")
    got = dedup.paired_duplicates(both).collect()
    assert len(got) == 14 and sorted((str(r["qname"]), r["rec_no"]) for r in got if r["checked"] and not r["dropped"]) == [("b", 3), ("c", 5)]
    assert {r["rec_no"] for r in got if r["dropped"] and not r["checked"]} == {2, 4} and all(not r["dropped"] for r in got if r["rec_no"] == 7)


def test_span_limits_are_a_reads_own():
    """A short read keeps what it keeps alone, whatever long reads stand beside it."""
    from strandlight.functions.smith_waterman import LOCAL, align_batch

    rng = random.Random(2)
    window = "".join(rng.choice("ACGT") for _ in range(300))
    short, long_ = window[40:55] + window[80:95], window[10:200]
    own = lambda q: [2 * len(x) for x in q]
    alone = align_batch([short], [window], LOCAL, own([short]))
    beside = align_batch([long_, short], [window] * 2, LOCAL, own([long_, short]))
    assert beside[1] == alone[0] and beside[0]["ops"] and align_batch([short], [window], LOCAL, [5])[0]["ops"] is None
