"""The banded aligner against the textbook recurrence, gap genotypes against a version of one site at a time."""

import random
import re

import numpy as np
from plain import gap_sites, global_align
from strandlight.functions import global_alignment as G
from strandlight.operators import calls, realign, variants

COLUMNS = ("cons", "gap_q", "snp_q", "rms_q", "depth", "allele1", "allele2", "n1", "n2")


def changed(rng, a):
    b = list(a)
    for _ in range(rng.randint(0, 3)):
        k, kind = rng.randint(0, len(b)), rng.random()
        if kind < 0.4:
            b[k:k] = [rng.randint(0, 4) for _ in range(rng.randint(1, 5))]
        elif kind < 0.8:
            del b[k : k + rng.randint(1, 5)]
        elif k < len(b):
            b[k] = rng.randint(0, 4)
    return b or [0]


def test_alignment_equals_the_recurrence():
    rng = random.Random(3)
    for _ in range(40):
        scores = G.Scores(gap_end=rng.choice([0, 2]))
        first = [[rng.randint(0, 3) for _ in range(rng.randint(1, 25))] for _ in range(20)]
        second = [changed(rng, a) if rng.random() < 0.7 else [rng.randint(0, 4) for _ in range(rng.randint(1, 25))] for a in first]
        width = [rng.choice([2, 4, 8, 50]) for _ in first]
        found, path = G.align([np.array(a, np.uint8) for a in first], [np.array(b, np.uint8) for b in second], np.array(width), scores)
        inner = G.inner_gaps(path).sum(0)
        for k, text in enumerate(G.cigars(path)):
            score, want = global_align(first[k], second[k], width[k], scores)
            assert text == want and (score < -(10**8) or found[k] == score)
            ops = re.findall(r"(\d+)([MID])", text)
            assert inner[k] == sum(int(n) for z, (n, op) in enumerate(ops) if op != "M" and 0 < z < len(ops) - 1)


def test_pairs_of_one_length_align_as_they_stand():
    """The way without a program gives what the program gives."""
    rng = random.Random(8)
    parts = []
    for _ in range(300):
        a = [rng.choice([0, 1, 2, 3, 3, 4]) if rng.random() < 0.2 else rng.randint(0, 1) for _ in range(rng.randint(1, 14))]
        b = [x if rng.random() < 0.9 else rng.randint(0, 4) for x in a]
        parts.append((np.array(a, np.uint8), np.array(b, np.uint8), rng.choice([2, 6])))
    score, gaps, wrong = realign.penalties(parts)
    for k, (a, b, width) in enumerate(parts):
        want, text = global_align(a.tolist(), b.tolist(), width, realign.SCORES)
        if score[k] > -(10**8):
            assert score[k] == want
        i = j = 0
        bad = []
        for n, op in re.findall(r"(\d+)([MID])", text):
            if op == "M":
                bad += [j + d for d in range(int(n)) if a[i + d] != b[j + d] and a[i + d] < 4]
            i, j = i + int(n) * (op != "I"), j + int(n) * (op != "D")
        assert sorted(wrong[k].tolist()) == bad


def test_genotypes_of_the_given_alignments(stored):
    """All sites of gaps of one reference."""
    reads, refs = stored[0].where("tid = 2"), stored[1]
    ref = refs.where("tid = 2").first()["bases"]
    plain = [(r["pos"], r["cigar"], r["seq"], [20 + (r["rec_no"] + i) % 20 for i in range(len(r["seq"]))], r["mapq"]) for r in reads.where("flag & 4 = 0").collect()]
    want = gap_sites(plain, ref, realign.SCORES)
    got = {r["pos"]: tuple(r[c] for c in COLUMNS) for r in realign.indel_genotypes(reads, refs).collect()}
    assert len(want) > 90 and got == want


def test_genotypes_of_reads_with_errors(spark):
    """Reads of two haplotypes with wrong bases, gaps put where they don't belong, skips, clips and the reference's ends."""
    rng = random.Random(4)
    ref = "".join(rng.choice("ACGT") for _ in range(260))
    rows = []
    for k in range(90):
        cigar = rng.choice(["40M", "12M2I26M", "20M3D20M", "5S20M1I14M", "15M4D10M1I14M", "10M30N30M", "3H38M2S", "25M1D5M2D8M"])
        span = sum(n for n, op in realign.operations(cigar) if op in "MDN")
        pos, seq, x = rng.randint(0, 260 - span), "", 0
        for n, op in realign.operations(cigar):
            if op == "M":
                seq += "".join(c if rng.random() < 0.95 else rng.choice("ACGTN") for c in ref[pos + x : pos + x + n])
            elif op in "IS":
                seq += "".join(rng.choice("AC") for _ in range(n))
            x += n * (op in "MDN")
        qual = "".join(chr(33 + rng.randint(2, 40)) for _ in seq)
        rows.append((0, pos, cigar, seq, qual, rng.randint(0, 70), 0, k))
    reads = spark.createDataFrame(rows, "tid long, pos long, cigar string, seq string, qual string, mapq long, flag long, rec_no long")
    known = spark.createDataFrame([(0, "c", len(ref), ref)], "tid long, rname string, len long, bases string")
    want = gap_sites([(r[1], r[2], r[3], [ord(c) - 33 for c in r[4]], r[5]) for r in rows], ref, realign.SCORES)
    found = realign.indel_genotypes(reads, known).collect()
    assert {r["pos"]: tuple(r[c] for c in COLUMNS) for r in found} == want and len(want) > 60
    assert all(r["n1"] + r["n2"] + r["n_other"] == r["depth"] for r in found)
    # a proposed length is judged though no read shows it
    site = spark.createDataFrame([(0, 100, -7), (0, 101, 0)], "tid long, pos long, indel long")
    more = {r["pos"]: r for r in realign.indel_genotypes(reads.where("cigar = '40M'"), known, site).collect()}
    assert set(more) <= {100} and all(r["n1"] + r["n2"] == r["depth"] for r in more.values())
    assert realign.indel_genotypes(reads.limit(0), known).count() == 0


def test_variants_of_gaps(spark):
    """A gap that half the reads show, one that all show and one on poorly mapped reads, as sites, after the filter and as records."""
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(900))
    rows = []

    def add(pos, cigar, seq, mapq, times):
        rows.extend((0, pos, cigar, seq, mapq, 0, len(rows) + i) for i in range(times))

    for pos, mapq, plain, gapped in ((100, 60, 8, 8), (300, 60, 0, 12), (600, 5, 6, 6)):
        add(pos, "60M", ref[pos : pos + 60], mapq, plain)
        add(pos, "30M4D26M", ref[pos : pos + 30] + ref[pos + 34 : pos + 60], mapq, gapped)
    other = "A" if ref[135] != "A" else "C"
    add(100, "60M", ref[100:135] + other + ref[136:160], 60, 30)
    reads = spark.createDataFrame(rows, "tid long, pos long, cigar string, seq string, mapq long, flag long, rec_no long")
    known = spark.createDataFrame([(0, "c", len(ref), ref)], "tid long, rname string, len long, bases string")
    sites = calls.variant_sites(reads, known)
    gaps = {r["pos"]: r for r in sites.where("ref = '*'").collect()}
    gone = {p: "-" + ref[p + 1 : p + 5] for p in (129, 329, 629)}
    assert set(gaps) == set(gone) and gaps[129]["cons"] == f"*/{gone[129]}" and gaps[329]["cons"] == f"{gone[329]}/{gone[329]}" and gaps[629]["rms_q"] == 5
    flags = {(r["pos"], r["ref"]): r["filter"] for r in variants.filtered_variants(sites).collect()}
    assert flags[629, "*"] == "Q" and flags[129, "*"] == "U" and flags[329, "*"] == "U" and flags[135, ref[135]] == "G"
    records = {r["pos"]: (r["alt"], r["gt"]) for r in variants.as_vcf(sites, known, snps=False).collect()}
    assert records == {130: ("D4", "0/1"), 330: ("D4", "1/1"), 630: ("D4", "0/1")}
