import hashlib

import pytest
from pyspark.sql import functions as F

from strandlight.operators import callbacks, pileup, stats


def test_sites_rebuild_depth(spark, stored):
    reads, _ = stored

    def summary(tid, pos, pieces):
        rows = [r for piece in pieces for r in piece.to_pylist()]
        assert [r["rec_no"] for r in rows] == sorted(r["rec_no"] for r in rows)
        yield len(rows), hashlib.md5("".join(f"{r['rec_no']}{r['base']}{r['indel']}" for r in rows).encode()).hexdigest()

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r["tid"], r["pos"]): r["depth"] for r in stats.depth(reads).collect()}
    rows = pileup.elements(reads).groupBy("tid", "pos").agg(F.array_sort(F.collect_list(F.struct("rec_no", "base", "indel"))).alias("x")).collect()
    texts = {(r["tid"], r["pos"]): hashlib.md5("".join(f"{x['rec_no']}{x['base']}{x['indel']}" for x in r["x"]).encode()).hexdigest() for r in rows}
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = callbacks.over_sites(reads, summary, "n bigint, text string").collect()
            assert len(found) == len(want)
            assert {(r["tid"], r["pos"]): r["n"] for r in found} == want and {(r["tid"], r["pos"]): r["text"] for r in found} == texts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert pileup.elements(reads).columns == ["tid", "pos", "rec_no", "reverse", "mapq", "deleted", "base", "baseq", "qpos", "head", "tail", "indel", "inserted"]


def test_sites_over_cells_depth_and_region(spark):
    # reads that cross the border of two cells, one site of many reads, a long skip
    edge = callbacks.CELL
    rows = [(0, edge - 3, k, 0, 9, "6M", "ACGTAC") for k in range(1, 41)] + [(0, 10, 90, 0, 9, f"2M{2 * edge}N2M", "ACGT"), (-1, -1, 91, 4, 0, "*", "AC"), (1, 5, 92, 16, 9, "2M1D1M", "ACG")]
    reads = spark.createDataFrame(rows, "tid long, pos long, rec_no long, flag long, mapq long, cigar string, seq string")
    count = lambda tid, pos, pieces: [(sum(map(len, pieces)),)]
    got = {(r["tid"], r["pos"]): r["n"] for r in callbacks.over_sites(reads, count, "n bigint").collect()}
    want = {(0, edge - 3 + k): 40 for k in range(6)} | {(0, p): 1 for p in (10, 11, 12 + 2 * edge, 13 + 2 * edge)} | {(1, p): 1 for p in range(5, 9)}
    assert got == want
    assert {r["n"] for r in callbacks.over_sites(reads, count, "n bigint", depth=3).collect()} == {1, 3}
    assert {r["pos"] for r in callbacks.over_sites(reads, count, "n bigint", region=(0, edge - 1, edge + 2)).collect()} == {edge - 1, edge, edge + 1}
    # calls that read nothing, give nothing or fail
    assert callbacks.over_sites(reads, lambda *x: [(1,)], "n bigint").count() == len(want) and callbacks.over_sites(reads, lambda *x: [], "n bigint").count() == 0
    assert callbacks.over_sites(reads.limit(0), count, "n bigint").count() == 0
    with pytest.raises(Exception, match="made up"):
        callbacks.over_sites(reads, lambda *x: (_ for _ in ()).throw(ValueError("made up")), "n bigint").collect()


def test_regions(spark, stored):
    reads, _ = stored
    regions = spark.createDataFrame([(1, 0, 100, 900), (2, 1, 0, 5), (3, 1, 300, 2600), (4, 1, 300, 2600)], "region long, tid long, begin long, end long")
    got = callbacks.over_regions(reads, regions, lambda region, batch: ((x,) for x in batch["rec_no"].to_pylist()), "rec_no bigint").collect()
    from strandlight.operators.filters import overlapping

    want = sorted((i, r[0]) for i, *where in ((1, 0, 100, 900), (2, 1, 0, 5), (3, 1, 300, 2600), (4, 1, 300, 2600)) for r in overlapping(reads, *where).select("rec_no").collect())
    assert sorted((r["region"], r["rec_no"]) for r in got) == want and len(want) > 100
