"""Binary files read by byte ranges: the same rows for every size of splits."""

import random
import struct

import pytest
from strandlight.sources import bam

HEADER = "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:AFRICA\tLN:3200\n@SQ\tSN:AMERICA\tLN:3200\n"


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        for n, v in zip(names, (size, 1), strict=True):
            spark.conf.set(n, v)

    yield put
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def made(spark, n):
    rng = random.Random(n)

    def row(i):
        size = rng.choice([0, 1, 30, 151]) if i % 97 else rng.choice([70_000, 200_000])  # some records lie over several blocks
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or None
        qual = "".join(chr(33 + rng.randint(0, 60)) for _ in range(size)) if size and i % 3 else None
        tid = rng.randint(-1, 1)
        return (f"r{i}", rng.choice([99, 147, 4]), tid, ("AFRICA", "AMERICA")[tid] if tid >= 0 else None, rng.randint(0, 3000) if tid >= 0 else -1, 30, f"{size}M" if size and tid >= 0 else "*", tid, 60, 60, seq, qual, {"RG": "Z:g", "NM": f"i:{i}", "XF": "f:0.5", "XA": "A:c"})

    return spark.createDataFrame([row(i) for i in range(n)], bam.SCHEMA)


def key(rows):
    return sorted(str(r.asDict()) for r in rows)


def test_rows_are_the_same_for_every_split(spark, tmp_path, small_splits):
    bam.register(spark)
    df = made(spark, 1500).coalesce(1)
    df.write.format("strand_bam").mode("append").option("header", HEADER).save(str(tmp_path / "out"))
    file = next((tmp_path / "out").glob("*.bam"))
    want, tasks = key(df.collect()), []
    for size in (20_000, 66_000, 300_001, 1 << 30):
        small_splits(size)
        tasks.append(bam.raw_blocks(spark, str(tmp_path / "out")).rdd.getNumPartitions())
        assert key(bam.read(spark, str(tmp_path / "out")).collect()) == want
    assert tasks[0] > 20 and key(spark.read.format("strand_bam").load(str(file)).collect()) == want
    # two files, one without a record
    df.limit(0).coalesce(1).write.format("strand_bam").mode("append").option("header", HEADER).save(str(tmp_path / "out"))
    small_splits(66_000)
    assert key(bam.read(spark, str(tmp_path / "out")).collect()) == want
    texts = bam.headers(spark, str(tmp_path / "out")).collect()
    assert [r["text"] for r in texts] == [HEADER] * len(texts) and texts[0]["refs"][1]["name"] == "AMERICA"
    # reads only what it needs of a file that ends too early, and says so
    data = file.read_bytes()
    file.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="truncated"):
        bam.read(spark, str(tmp_path / "out")).collect()
    file.write_bytes(b"plain text" + data)
    with pytest.raises(Exception, match="compressed block"):
        bam.read(spark, str(tmp_path / "out")).collect()


def test_first_record_is_found_within_any_bytes():
    """Cut anywhere, the next record's start is found and no other place is taken for one."""
    rng = random.Random(5)
    from types import SimpleNamespace

    names = [c.split(" ")[0] for c in bam.SCHEMA.split(", ")]
    parts = []
    for i in range(40):
        n = rng.choice([0, 20, 100])
        values = (f"read{i}", 99, 0, "x", rng.randint(0, 1 << 20), 60, f"{n}M" if n else "*", 1, 5, 0, "A" * n, "I" * n, {"NM": "i:3", "MD": "Z:" + "9" * 30})
        parts.append(bam.encoded(SimpleNamespace(**dict(zip(names, values, strict=True)))))
    data, starts = b"".join(parts), []
    for p in parts:
        starts.append(sum(map(len, parts[: len(starts)])))
    ends = {*starts, len(data)}
    for at in range(0, len(data)):
        want = next(s for s in sorted(ends) if s >= at) - at
        found = bam.first_record(data[at:], 2, True)
        assert found == want or at + found > starts[-1]
    assert bam.fits(struct.pack("<iiiIIiiii", 40, 5, 0, 2, 0, 0, 0, 0, 0) + b"a\0" + bytes(9), 0, 3) == -1
