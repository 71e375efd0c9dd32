import random

import pytest

from strandlight.operators import dedup
from strandlight.plans.fixtures import aln
from strandlight.streaming.pairing import END, sessions, stream_best_of_position, stream_first_of_position

SF = "/root/testdata/sf0.001"


def run(spark, live, folder, mode="append"):
    q = live.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.read.parquet(f"{folder}/out")


def written(df, folder):
    df.coalesce(1).sortWithinPartitions("tid", "pos").write.mode("append").parquet(f"{folder}/in")


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("reads") / "rows")
    aln(spark, SF).select("qname", "m", "flag", "tid", "pos", "cigar", "lib", "sumq", "rec_no").write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("paired_too", [True, False])
def test_best_of_position_over_a_restart(spark, tmp_path, reads, paired_too):
    if not paired_too:
        reads = reads.withColumn("flag", reads.flag.bitwiseAND(~1) + reads.rec_no % 2)
    parts = ["tid < 0 OR tid = 0", "tid = 1 AND pos < 1300", "tid = 1 AND pos >= 1300", "tid = 2", "tid > 2"]
    live = lambda: stream_best_of_position(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 1000, paired_too)
    for part in parts[:2]:
        written(reads.where(part), tmp_path)
    early = run(spark, live(), tmp_path).count()
    for part in parts[2:]:
        written(reads.where(part), tmp_path)
    end = spark.createDataFrame([(None, None, 0, END, 0, "*", None, 0, -1)], reads.schema)
    written(end, tmp_path)
    got = run(spark, live(), tmp_path)
    want = dedup.single_duplicates(reads, paired_too)
    assert 0 < early < got.count()
    assert sorted(r[0] for r in got.select("rec_no").collect()) == sorted(r[0] for r in want.where("NOT dropped").select("rec_no").collect())
    lost = want.where("dropped").count()
    assert lost > 0 and got.selectExpr("sum(copies - 1)").first()[0] == lost


def test_best_of_position_spans(spark, tmp_path, reads):
    schema = reads.schema
    written(spark.createDataFrame([("a", 1, 16, 0, 5, "10M5000N10M", "l", 1, 1)], schema), tmp_path)
    with pytest.raises(Exception, match="longer than"):
        run(spark, stream_best_of_position(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1000), tmp_path)


def test_first_of_position(spark, tmp_path, reads):
    written(reads.where("tid >= 0"), tmp_path)
    got = run(spark, stream_first_of_position(spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/in"), 1000), tmp_path)
    keys = [(r["lib"], r["tid"], r["pos"], bool(r["flag"] & 16)) for r in got.collect()]
    assert len(keys) == len(set(keys)) and set(keys) == {(r["lib"], r["tid"], r["pos"], bool(r["flag"] & 16)) for r in reads.where("tid >= 0").collect()}


def test_sessions(spark, tmp_path):
    rng = random.Random(5)
    seconds = sorted(rng.randint(0, 400_000) for _ in range(300))
    rows = [(rng.randint(1, 3), s) for s in seconds]
    schema = "user_id long, ts timestamp"
    events = spark.createDataFrame(rows, "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    # a later event lets the watermark pass all sessions
    spark.createDataFrame([(9, 9_000_000)], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts").write.mode("append").parquet(f"{tmp_path}/in")
    live = sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    got = sorted((r["user_id"], int(r["start"].timestamp()), int(r["end"].timestamp()), r["n"]) for r in run(spark, live, tmp_path).collect())
    want = []
    for user in (1, 2, 3):
        last = None
        for s in (s for u, s in rows if u == user):
            if last is not None and s - last <= 1800:
                want[-1] = (user, want[-1][1], s + 1800, want[-1][3] + 1)
            else:
                want.append((user, s, s + 1800, 1))
            last = s
    assert got == sorted(want)
