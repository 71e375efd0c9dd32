"""FASTA files of many splits: index, ranged fetch and whole sequences against a reader of one line after another."""

import random

import pytest
from strandlight.sources import fasta


def plain_index(data: bytes):
    """[name, length, offset, bases a line, bytes a line] of each record, and its bases."""
    out, offset = [], 0
    for line in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
        size, bases = len(line) + 1, line.strip().decode()
        if line.startswith(b">"):
            out.append([[bases[1:].split()[0], 0, 0, 0, 0], ""])
        elif not line.startswith(b";") and bases:
            entry = out[-1][0]
            if not entry[3]:
                entry[2:] = [offset, len(bases), size]
            entry[1] += len(bases)
            out[-1][1] += bases
        offset += size
    return [x for x, _ in out], [x for _, x in out]


def made(rng, n, end=b"\n"):
    data = b"; made up\n"
    for k in range(n):
        data += f">s{k} more words".encode() + end
        width, length = rng.choice([1, 7, 60]), rng.choice([0, 5, 60, 61, 1000, 5000])
        bases = "".join(rng.choice("ACGTNacgt") for _ in range(length)).encode()
        for i in range(0, length, width):
            data += bases[i : i + width] + end
            if rng.random() < 0.01:
                data += b";a comment\n"
        data += end * rng.choice([0, 0, 1, 2])
    return data


@pytest.fixture
def small_splits(spark):
    """Sets the size of splits, and sets it back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        for n, v in zip(names, (size, 1), strict=True):
            spark.conf.set(n, v)

    yield put
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_index_and_fetch_over_splits(spark, tmp_path, small_splits, monkeypatch, end):
    monkeypatch.setattr(fasta, "TILE", 512)
    rng = random.Random(len(end))
    data = made(rng, 25, end)
    (tmp_path / "a.fa").write_bytes(data)
    want, bases = plain_index(data)
    asked = [(f"s{rng.randint(0, 27)}", (a := rng.randint(-5, 5200)), a + rng.choice([0, 1, 20, 700, 6000])) for _ in range(60)]
    slices = spark.createDataFrame(asked, "rname string, begin long, end long")
    for size in (300, 4096, 1 << 20):
        small_splits(size)
        of = fasta.lines(spark, str(tmp_path / "a.fa"))
        assert of.rdd.getNumPartitions() > {300: 10, 4096: 4}.get(size, 0)
        found = fasta.placed(fasta.pieces(of))
        columns = ("rname", "length", "offset", "line_blen", "line_len")
        assert [[r[c] for c in columns] for r in fasta.index(found).orderBy("record").collect()] == want
        got = fasta.read(spark, str(tmp_path / "a.fa")).orderBy("tid").collect()
        assert [(r["tid"], r["rname"], r["len"], r["bases"]) for r in got] == [(k, x[0], x[1], b) for k, (x, b) in enumerate(zip(want, bases, strict=True))]
        text = {x[0]: b for x, b in zip(want, bases, strict=True)}
        cut = sorted((n, a, b, text[n][max(0, a) : max(0, b)]) for n, a, b in asked if text.get(n))
        assert sorted((r["rname"], r["begin"], r["end"], r["bases"]) for r in fasta.fetched(of, slices).collect()) == cut
        # what the index says is where the bases are, if no comment stands between
        for name, length, offset, blen, line in want:
            k = length - 1
            at = offset + k // blen * line + k % blen if length else 0
            if length and b";" not in data[offset:at]:
                assert data[at : at + 1].decode() == text[name][k]


def test_index_text(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nACG\n>two\nAC\n")
    found = fasta.index(fasta.placed(fasta.pieces(fasta.lines(spark, str(tmp_path / "a.fa")))))
    fasta.write_index(found, str(tmp_path / "index"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "index").glob("part-*"))) == "one\t7\t7\t4\t5\ntwo\t2\t21\t2\t3\n"
    assert [tuple(r) for r in fasta.read_index(spark, str(tmp_path / "index")).orderBy("offset").collect()] == [("one", 7, 7, 4, 5), ("two", 2, 21, 2, 3)]
    (tmp_path / "bad").write_text("one\t7\t7\t4\n")
    with pytest.raises(Exception, match="five columns"):
        fasta.read_index(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\n\nACGT\n", ">a\nACGT\nACGTA\n", ">b\nA\n>a\nACGT\nACGT\nACG\nA\n", ">a\nACGT\n\n\nA\n>b\nA\n"])
def test_ragged_lines_raise(spark, tmp_path, small_splits, text):
    (tmp_path / "a.fa").write_text(text)
    for size in (1 << 20, 6):
        small_splits(size)
        with pytest.raises(Exception, match="different lengths in sequence a"):
            fasta.index(fasta.placed(fasta.pieces(fasta.lines(spark, str(tmp_path / "a.fa"))))).collect()


def test_a_large_sequence_is_never_one_row(spark, tmp_path, small_splits):
    """Tens of megabases: rows of tiles and chunks stay within a tile, a slice over tiles is whole."""
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(59_999))
    whole = unit * 500
    with open(tmp_path / "g.fa", "w") as f:
        f.write(">g\n")
        f.writelines(whole[i : i + 80] + "\n" for i in range(0, len(whole), 80))
    small_splits(2_000_000)
    of = fasta.lines(spark, str(tmp_path / "g.fa"))
    found = fasta.placed(fasta.pieces(of))
    assert of.rdd.getNumPartitions() > 10 and fasta.index(found).first()["length"] == len(whole)
    assert fasta.chunks(of).selectExpr("max(length(bases))").first()[0] <= fasta.TILE
    slices = spark.createDataFrame([("g", 29_000_000, 29_200_000), ("g", len(whole) - 5, len(whole) + 5)], "rname string, begin long, end long")
    assert {r["begin"]: r["bases"] for r in fasta.fetched(of, slices, found).collect()} == {29_000_000: whole[29_000_000:29_200_000], len(whole) - 5: whole[-5:]}
