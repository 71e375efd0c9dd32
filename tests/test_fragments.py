import io

import pytest

from strandlight.operators import filters, stats
from strandlight.plans.fixtures import aln
from strandlight.sources import fragments

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(str, df.select(*fragments.NAMES).collect()))


def test_round_trip(spark, tmp_path):
    reads = aln(spark, SF)
    rows = fragments.distribution(reads).cache()
    fragments.write(rows.repartition(3, "rg"), str(tmp_path / "out"))
    got = fragments.read(spark, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.fld"))) > 1 and plain(got) == plain(rows)
    histogram = stats.fragment_histogram(filters.normal_pairs(reads))
    key = lambda df: sorted((r["rg"], r["lower"], r["upper"]) for r in df.collect())
    assert key(fragments.cutoffs(got, 0.05)) == key(stats.fragment_cutoffs(histogram, 0.05))
    counts = {r["rg"]: (r["valid"], r["invalid"]) for r in stats.mode_counts(reads).collect()}
    assert {r["rg"]: (r["valid"], r["invalid"]) for r in got.collect()} == counts
    # by definition: the share of pairs up to each length
    raw = {}
    for r in histogram.collect():
        raw.setdefault(r["rg"], {})[r["frag_len"]] = r["freq"]
    for r in got.collect():
        own = raw[r["rg"]]
        assert r["lengths"] == sorted(own)
        assert r["shares"] == [sum(n for k, n in own.items() if k <= x) / sum(own.values()) for x in sorted(own)]
    # replaced, not added to; empty input reads as empty
    fragments.write(rows.limit(0), str(tmp_path / "out"))
    assert fragments.read(spark, str(tmp_path / "out")).count() == 0
    rows.unpersist()


def test_long_and_odd_groups(spark, tmp_path):
    schema = "qname string, flag long, tid long, mtid long, pos long, isize long, rg string"
    pair = lambda name, size, rg: [(name, 1 + 32 + 64, 0, 0, 5, size, rg), (name, 1 + 16 + 128, 0, 0, 5 + size, -size, rg)]
    sizes = [1, 2, 2, 65_535, 65_536, 200_000]
    rows = [r for i, s in enumerate(sizes) for r in pair(f"a{i}", s, None)] + pair("z", 7, "é") + [("u", 4, -1, -1, -1, 0, "none")]
    found = fragments.distribution(spark.createDataFrame(rows, schema))
    fragments.write(found, str(tmp_path / "out"))
    got = fragments.read(spark, str(tmp_path / "out"))
    assert plain(got) == plain(found)
    by = {}
    for r in got.collect():
        by.setdefault(r["rg"], []).append(r)
    assert sorted(x for r in by[None] for x in r["lengths"]) == sorted(set(sizes)) and len(by[None]) == 3
    assert by["é"][0]["shares"] == [1.0] and by["none"][0]["lengths"] == [] and by["none"][0]["mean"] is None
    assert fragments.distribution(spark.createDataFrame([], schema)).count() == 0


def test_broken_files():
    whole = fragments.MAGIC + fragments.encoded(type("Row", (), {"rg": "a", "valid": 1, "invalid": 0, "mean": 2.0, "median": 2, "stdev": 0.0, "lengths": [2], "shares": [1.0]}))
    assert list(fragments.decoded(io.BytesIO(whole))) == [("a", 1, 0, 2.0, 2, 0.0, [2], [1.0])]
    for bad in (whole[:-1], whole[:6], b"FLD\x01" + whole[4:]):
        with pytest.raises(ValueError):
            list(fragments.decoded(io.BytesIO(bad)))
