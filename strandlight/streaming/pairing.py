"""Pairing and duplicate removal over streams of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.functions import cigar as C

#: Milliseconds of event time between references, more than any position; times hold 2^23 references.
STRIDE = 1 << 30


def event_time(tid: str = "tid", pos: str = "pos") -> Column:
    """A position as a time, so that watermarks follow the coordinate order and never the clock."""
    return F.timestamp_millis((F.col(tid) + 1) * STRIDE + F.col(pos))


def stream_pairs(reads: DataFrame, window: int) -> DataFrame:
    """First mates with the second mate of their name within two windows; state behind the watermark is dropped.

    ``reads`` streams (qname, m, tid, pos, rec_no). Mates later than the watermark stay unpaired, as in the bins.
    """
    timed = reads.withColumn("at", event_time()).withWatermark("at", f"{2 * window} milliseconds")
    a = timed.where("m = 1").select("qname", "tid", F.col("at").alias("at_a"), F.col("rec_no").alias("first"))
    b = timed.where("m = 2").select(F.col("qname").alias("qname_b"), F.col("tid").alias("tid_b"), F.col("at").alias("at_b"), F.col("rec_no").alias("second"))
    span = F.expr(f"at_b > at_a - interval {2 * window} milliseconds AND at_b < at_a + interval {2 * window} milliseconds")
    return a.join(b, (F.col("qname") == F.col("qname_b")) & (F.col("tid") == F.col("tid_b")) & span).select("qname", "tid", "first", "second")


def stream_first_of_position(reads: DataFrame, window: int) -> DataFrame:
    """One read for each library, reference, position and strand; a key is forgotten once the watermark passes it."""
    timed = reads.withColumn("at", event_time()).withWatermark("at", f"{2 * window} milliseconds")
    return timed.withColumn("reverse", F.col("flag").bitwiseAND(F.lit(16)) != 0).dropDuplicatesWithinWatermark(["lib", "tid", "pos", "reverse"])


#: Reference number of a row that is no read but says that a stream is at its end.
END = 1 << 22


def stream_best_of_position(reads: DataFrame, span: int = 1 << 20, paired_too: bool = True) -> DataFrame:
    """Reads that ``dedup.single_duplicates`` keeps, from a stream in the order of reference and position.

    Of reads of one library, reference, strand and 5' end the best by summed quality stays, of equal ones that of the least
    ``rec_no``, with ``copies``, the reads of its place. A place is given out once the watermark has passed its 5' end, so
    the state holds the best read of each place of the last ``span`` bases; restarts go on from the stream's
    checkpoint. A read whose alignment spans more raises an error, as reads before its end would come too late
    beside it. Reads that are not judged pass at once, with no ``copies``. A row of tid END closes the last places.
    """
    mark = F.col("tid") == END
    judged = F.coalesce(mark | ((F.col("tid") >= 0) & ~C.has("flag", C.UNMAPPED) & (F.lit(paired_too) | ~C.has("flag", C.PAIRED))), F.lit(False))
    reach = C.length_of("cigar", "MDN")
    long = F.raise_error(F.concat(F.lit("an alignment longer than the stream's span: "), F.coalesce("qname", F.lit("")))).cast("bigint")
    five = F.when(reach > span, long).when(C.has("flag", C.REVERSE), F.col("pos") + reach).otherwise(F.col("pos"))
    row, order = F.struct(*reads.columns), F.struct("sumq", -F.col("rec_no"))
    timed = reads.where(judged).select("lib", C.has("flag", C.REVERSE).alias("reverse"), F.struct("tid", five.alias("five")).alias("place"), row.alias("read"), order.alias("order"))
    timed = timed.withColumn("at", event_time("place.tid", "place.five")).withWatermark("at", f"{span} milliseconds")
    best = timed.groupBy("at", "lib", "reverse").agg(F.max_by("read", "order").alias("read"), F.count(F.lit(1)).alias("copies")).where(F.col("read.tid") != END)
    return best.select("read.*", "copies").unionByName(reads.where(~judged).withColumn("copies", F.lit(None).cast("bigint")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events joined while they follow one another within ``gap``; end is the last one's time and the gap."""
    timed = events.withWatermark("ts", gap)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "s.start", "s.end", "n")
