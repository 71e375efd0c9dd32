"""Files of genotype likelihoods: written over several tasks and read back, and one record's bytes by the format."""

import struct
from types import SimpleNamespace

from strandlight.operators import calls
from strandlight.sources import bam, glf


def test_round_trip_over_tasks(spark, stored, tmp_path):
    reads, refs = stored[0].where("tid in (1, 3)"), stored[1]
    records = glf.with_references(calls.gap_likelihood_records(reads, refs), refs).cache()
    glf.write(records, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.glf"))
    names = [c.split(" ")[0] for c in glf.COLUMNS.split(", ")]
    got = glf.read(spark, str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    assert len(files) > 1 and key(got) == key(records) and got.where("kind = 1").count() > 100
    # each file alone is in order, and starts from its reference's begin
    for file in files:
        rows = list(glf.decoded(bam.Stream(open(file, "rb"))))
        assert rows == sorted(rows, key=lambda r: (r[0] != rows[0][0], r[2], r[3]))
    glf.write(records.limit(0), str(tmp_path / "none"))
    assert glf.read(spark, str(tmp_path / "none")).count() == 0
    records.unpersist()


def test_bytes_of_records():
    site = SimpleNamespace(kind=0, ref="G", pos=70, min_lk=3, depth=9, rms_q=60, lk=[0] * 9 + [255])
    assert glf.encoded(site, 58) == bytes([0x14]) + struct.pack("<II", 12, 3 << 24 | 9) + bytes([60] + [0] * 9 + [255])
    gap = SimpleNamespace(kind=1, ref="*", pos=70, min_lk=0, depth=9, rms_q=60, lk=[0, 7, 27], indel1=0, indel2=-2, bases1="", bases2="AC")
    assert glf.encoded(gap, 70) == bytes([0x20]) + struct.pack("<II", 0, 9) + bytes([60, 0, 7, 27]) + struct.pack("<hh", 0, -2) + b"AC"
