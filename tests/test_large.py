"""Queries that took too long or too much disk on larger tables: what makes them short, against versions by definition."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlight.functions import cigar as C
from strandlight.functions import opened
from strandlight.operators import callbacks, calls, filters, pileup, realign


def test_colours_of_batches(spark):
    """Against each pair of bases by itself, with unknown letters, letters of several bytes, short reads and none."""
    rng = random.Random(1)
    reads = ["", "A", "AC", "NN", "acgt", "Añ☃C", None] + ["".join(rng.choice("ACGTacgtNn.=R") for _ in range(n)) for n in range(60)]
    code = {c: i for i, c in enumerate("ACGT")}
    want = lambda t: "".join(str(code[a] ^ code[b]) if a in code and b in code else "." for a, b in zip(t, t[1:]))
    found = spark.createDataFrame([(k, t) for k, t in enumerate(reads)], "k int, seq string").select("k", C.colours("seq").alias("c")).collect()
    assert {r["k"]: r["c"] for r in found} == {k: None if t is None else want(t.upper()) for k, t in enumerate(reads)}


def _reads(rng, n, size=2600):
    return [(rng.randint(-1, 1), rng.randint(0, size), k, rng.choice(["20M", "5M3D5M", "8M700N8M", "*"]), rng.randint(0, 60)) for k in range(n)]


READS = "tid long, pos long, rec_no long, cigar string, mapq long"


def _overlaps(reads, spans):
    ends = {"20M": 20, "5M3D5M": 13, "8M700N8M": 716, "*": 1}
    return [(region, r[2], r[4]) for region, tid, begin, end in spans for r in reads if tid >= 0 and begin < end and r[0] == tid and r[1] < end and r[1] + ends[r[3]] > begin]


def test_regions_counted_by_place(spark):
    """Against every pair, with equal, repeated, empty and long regions; the plan joins counted places, not reads."""
    rng = random.Random(2)
    reads = _reads(rng, 400)
    spans = [(k % 50, rng.randint(0, 1), b := rng.randint(-30, 2600), b + rng.choice([0, 1, 40, 900])) for k in range(60)]
    spans += [(90, *spans[0][1:]), (91, *spans[1][1:]), (91, *spans[1][1:])]
    want = {}
    for region, rec, _ in _overlaps(reads, spans):
        n, first, last = want.get(region, (0, rec, rec))
        want[region] = n + 1, min(first, rec), max(last, rec)
    found = filters.region_counts(spark.createDataFrame(reads, READS), spark.createDataFrame(spans, "region long, tid long, begin long, end long"))
    assert {r["region"]: (r["n"], r["first"], r["last"]) for r in found.collect()} == want and len(want) > 30


def test_region_batches_are_few(spark):
    """Each read once a region, and calls by batch and region: the reads of a deep place are not one row a region each."""
    rng = random.Random(3)
    reads, spans = _reads(rng, 300), [(k, rng.randint(0, 1), b := rng.randint(-30, 2600), b + rng.choice([0, 1, 40, 900])) for k in range(60)]
    schema = "region long, tid long, begin long, end long"
    frame = spark.createDataFrame(reads, READS)
    got = callbacks.over_regions(frame, spark.createDataFrame(spans, schema), lambda region, batch: zip(batch["rec_no"].to_pylist(), batch["mapq"].to_pylist(), strict=True), "rec_no long, mapq long").collect()
    assert sorted(tuple(r) for r in got) == sorted(_overlaps(reads, spans)) and len(got) > 100
    deep = spark.range(4000).selectExpr("0L AS tid", "id % 40 AS pos", "id AS rec_no", "'20M' AS cigar", "1L AS mapq")
    many = spark.range(500).selectExpr("id AS region", "0L AS tid", "id % 20 AS begin", "id % 20 + 30 AS end")
    plan = callbacks.over_regions(deep, many, lambda region, batch: [(len(batch),)], "n long")
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["region"] % 20: r["n"] for r in plan.groupBy("region").agg(F.sum("n").alias("n")).collect()} == {b: 100 * (40 - max(0, b - 19) - max(0, 10 - b)) for b in range(20)}


def test_reads_alike_are_aligned_once(spark):
    """Copies of reads change counts and sums, not the kinds of reads that are aligned, nor the genotypes' letters."""
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    rows = []
    for k in range(40):
        pos = rng.randint(0, 340)
        cigar, seq = rng.choice([("40M", ref[pos : pos + 40]), ("20M2D20M", ref[pos : pos + 20] + ref[pos + 22 : pos + 42]), ("20M1I20M", ref[pos : pos + 20] + "A" + ref[pos + 20 : pos + 40])])
        rows.append((0, pos, cigar, seq, rng.randint(0, 60), 0, k))
    schema = "tid long, pos long, cigar string, seq string, mapq long, flag long, rec_no long"
    reads, known = spark.createDataFrame(rows, schema), spark.createDataFrame([(0, "c", len(ref), ref)], "tid long, rname string, len long, bases string")
    many = reads.crossJoin(spark.range(3).toDF("copy")).withColumn("rec_no", F.col("rec_no") + 40 * F.col("copy")).drop("copy")
    assert realign.counted(many).count() == realign.counted(reads).count()
    one, three = ({r["pos"]: r for r in realign.indel_genotypes(x, known).collect()} for x in (reads, many))
    assert set(one) == set(three) and len(one) > 10
    for pos, r in one.items():
        assert all(three[pos][c] == 3 * r[c] for c in ("depth", "n1", "n2", "n_other", "n_ref", "n_unclear"))
        assert three[pos]["likelihood"] == [3 * x for x in r["likelihood"]] and (three[pos]["allele1"], three[pos]["allele2"], three[pos]["rms_q"]) == (r["allele1"], r["allele2"], r["rms_q"])


def _pileup_reads(rng, ref, n, qualities):
    rows = []
    for k in range(n):
        cigar = rng.choice(["30M", "4S10M2I9M5S", "12M70D12M", "8M3D8M", "9M200N9M", "3I10M", "2H5D10M1D1I6M", "10M5D"])
        ops = [(int(x), op) for x, op in re.findall(r"(\d+)([MIDNSH])", cigar)]
        pos = rng.randint(0, len(ref) - 100)
        size = sum(x for x, op in ops if op in "MIS") - (2 if k % 9 == 0 else 0)
        text = "".join(rng.choice("ACGTacgtN") for _ in range(size))
        qual = "".join(chr(33 + rng.randint(0, 93)) for _ in range(size - (3 if k % 7 == 0 else 0)))
        rows.append((k % 2, pos, k, rng.choice([0, 16]), rng.randint(0, 120), cigar, text, qual)[: 8 if qualities else 7])
    return rows


@pytest.mark.parametrize("qualities", [False, True])
def test_pileup_rows_deal_reads(spark, qualities):
    """Rows against the elements by definition, over cells' and the reference's ends; no row a base is shuffled."""
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGTn") for _ in range(400))
    schema = "tid long, pos long, rec_no long, flag long, mapq long, cigar string, seq string" + (", qual string" if qualities else "")
    reads = spark.createDataFrame(_pileup_reads(rng, ref, 150, qualities), schema)
    known = spark.createDataFrame([(0, "a", 400, ref), (1, "b", 330, ref[:330])], "tid long, rname string, len long, bases string")
    want = {}
    for e in sorted(pileup.elements(reads).collect(), key=lambda e: e["rec_no"]):
        own = ref if e["tid"] == 0 else ref[:330]
        cased = str.lower if e["reverse"] else str.upper
        base = "*" if e["deleted"] else "" if not e["base"] and own[e["pos"] : e["pos"] + 1] else ("," if e["reverse"] else ".") if e["base"].upper() == own[e["pos"] : e["pos"] + 1].upper() else cased(e["base"])
        gap = f"+{e['indel']}{cased(e['inserted'])}" if e["indel"] > 0 else f"{e['indel']}{cased(own[e['pos'] + 1 : e['pos'] + 1 - e['indel']])}" if e["indel"] < 0 else ""
        depth, bases, quals, mapqs = want.get((e["tid"], e["pos"]), (0, "", "", ""))
        bases += ("^" + chr(min(e["mapq"], 93) + 33) if e["head"] else "") + base + gap + ("$" if e["tail"] else "")
        want[e["tid"], e["pos"]] = depth + 1, bases, quals + chr(min(e["baseq"] + 33, 126)), mapqs + chr(min(e["mapq"] + 33, 126))
    found = pileup.rows(reads, known)
    got = {(r["tid"], r["pos"]): (r["depth"], r["bases"], r["quals"], r["mapqs"]) for r in found.collect()}
    assert got == want and len(got) > 500
    assert "collect_list(struct(rec_no" not in found._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_evidence_counts_batches(spark):
    """Counts and weights do not depend on how reads stand in batches, and no row a base comes from the reads."""
    reads = spark.createDataFrame(_pileup_reads(random.Random(9), "A" * 400, 120, True), "tid long, pos long, rec_no long, flag long, mapq long, cigar string, seq string, qual string")
    found = calls.evidence(reads)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = sorted(map(str, found.collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(str, calls.evidence(reads.repartition(3)).collect())) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    depth = {(r["tid"], r["pos"]): r["n"] for r in pileup.elements(reads).where("NOT deleted").groupBy("tid", "pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r["tid"], r["pos"]): r["depth"] for r in found.collect()} == depth


@pytest.mark.parametrize(("held", "most"), [(1 << 26, 1 << 21), (1, 200), (1, 3)])
def test_deep_cells_open_few_sites(monkeypatch, held, most):
    """Reads in memory or in a file, many sites, few or one opened at once: the same pieces in order, and no file stays."""
    monkeypatch.setattr(callbacks, "HELD", held)
    monkeypatch.setattr(callbacks, "OPENED", most)
    rows = [r[1:] for r in _pileup_reads(random.Random(11), "A" * 240, 60, True)]
    names = ["pos", "rec_no", "flag", "mapq", "cigar", "seq", "qual"]
    reads = callbacks._Reads()
    for first in range(0, len(rows), 13):
        reads.add(pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows[first : first + 13]]) for k, n in enumerate(names)}))
    reads.written()
    got = {pos: [r["rec_no"] for piece in pieces for r in piece.to_pylist()] for pos, pieces in callbacks._sites(reads, 64, 128)}
    want = {}
    for r in rows:
        for x in opened.template(r[4])[0].tolist():
            if 64 <= r[0] + x < 128:
                want.setdefault(r[0] + x, []).append(r[1])
    assert got == want and len(got) > 40
    name = reads.file and reads.file.name
    reads.dropped()
    assert not name or not os.path.exists(name)
