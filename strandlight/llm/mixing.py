"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

A source's target may be more or less than what it holds. Its whole multiples are allotted for certain to
each of its documents; for the rest every document gets a ranking variable, its random odds over its
inclusion odds (Pareto order sampling). Inclusion probabilities grow with a document's size and are solved so that the
words expected are those wanted: sizes whose probability would reach 1 are taken for certain, the others share the
rest. The documents of the smallest ranks are taken until the words of the source reach its target. The running
sum behind that cut works on the counts of rank intervals first and on the rows of one interval last, so
no source is sorted in one task.

Defined results: a null text has size 0 and is taken 0 times; the null source is a source of its own, the
last; a null id is an id like any other; rows of one id draw apart where their texts differ, and rows alike in id, source
and text are counted first and numbered then, so each draws by its own number and reruns give the same multiset of
results; equal ranks go by id; an empty table, or one without a word, has targets of 0; other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.llm.common import WORD, checkpointed

#: Weights of the sources in their order, repeating; the share of all words to take; the most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Two levels of this many rank intervals each come before rows are ranked.
INTERVALS = 1024
#: Up to so many sources, one row each, go to the rows as a broadcast; more meet them by a shuffle.
FEW = 10_000
SEED = "mix-1"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(text: Column) -> Column:
    return F.xxhash64(text)


def targets(sized: DataFrame) -> DataFrame:
    """For each source: ``source_size``, ``source_rows`` and ``target``.

    Where targets would pass MOST times the source, those sources stop there and the excess goes to the others
    by weight. In order of size per weight the first k sources stop; for each k the level of the others is
    what is left over their weights, and the first k whose level the next source can bear is right. The
    windows pass over one row for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("double")
    by = by.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("most").over(above), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(below))
    open_ = F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))
    by = by.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return by.select("source", "source_size", "source_rows", target.alias("target"))


def pull(size: Column) -> Column:
    """How strongly a document of a size is drawn, against one of its source's mean size."""
    return 0.5 + 0.5 * size * F.col("source_rows") / F.col("source_size")


def solved(sized: DataFrame, by: DataFrame) -> DataFrame:
    """``by`` with ``whole`` copies, words ``wanted`` beside them, ``scale`` of the pulls and size ``open`` up to which chance decides.

    Larger sizes are taken for certain. In descending order of size, if all before a size are certain the scale of the rest
    is what is left over their pulled words; the first size whose own probability is then below 1 is right.
    The window passes over the distinct sizes of a source, not over its rows.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    by = by.withColumn("whole", whole.cast("long")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    sizes = sized.where("size > 0").groupBy(F.col("source").alias("of"), "size").agg(F.sum("size").alias("words"))
    sizes = sizes.join(by.where("wanted > 0"), F.col("of").eqNullSafe(F.col("source"))).select("of", "size", "words", "wanted", pull(F.col("size")).alias("pull"))
    order = Window.partitionBy("of").orderBy(F.desc("size"))
    above = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("pull") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("scale", (F.col("wanted") - above) / rest)
    right = sizes.where(F.col("scale") * F.col("pull") < 1).groupBy("of").agg(F.max_by("scale", "size").alias("scale"), F.max("size").alias("open"))
    return by.join(right, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def ranked(sized: DataFrame) -> DataFrame:
    """The Pareto rank of each row of ``sized`` with its source's figures; 0 for those taken for certain."""
    inclusion = F.col("scale") * pull(F.col("size"))
    uniform = (F.col("bits") + 0.5) / float(1 << 52)
    odds = (uniform / (1 - uniform)) / (inclusion / (1 - inclusion))
    rank = F.when((F.col("size") > 0) & (F.col("wanted") > 0), F.when(F.col("size") <= F.col("open"), odds).otherwise(0.0))
    # a rank from 0 to infinity as an interval number: rank / (1 + rank) lies below 1
    fine = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * (INTERVALS * INTERVALS)), F.lit(INTERVALS * INTERVALS - 1)).cast("long")
    return sized.withColumn("rank", rank).withColumn("fine", fine)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, ``source_col``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``text_hash`` for each row.

    ``digest_of`` gives the last, by which a caller finds a row's text again.
    """
    like = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), digest_of(F.col(text_col)).alias("text_hash"))
    like = like.groupBy("id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    each = like.select("id", "source", "size", "text_hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    draw = F.concat_ws("|", F.lit(SEED), F.col("id").cast("string"), F.col("text_hash").cast("string"), F.col("k").cast("string"))
    bits = F.conv(F.substring(F.md5(draw.cast("binary")), 1, 13), 16, 10).cast("long")
    sized = checkpointed(each.select("id", "source", "size", "text_hash", bits.alias("bits")))
    # a row for each source, as in the windows before: one file, however many partitions a shuffle has
    by = checkpointed(solved(sized, targets(sized)).repartition(1))
    few = by.count() <= FEW
    sent = F.broadcast if few else lambda df: df
    rows = ranked(sized.join(sent(by.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")).drop("bits")
    # with few sources, ranks cost less to compute again than to write; with many, they are kept from a second shuffle
    rows = rows if few else checkpointed(rows)
    drawn = rows.where(F.col("rank").isNotNull())

    def crossing(counted: DataFrame, interval: str) -> DataFrame:
        """For each source the interval in which the words reach what is wanted, and the words before it."""
        order = Window.partitionBy("source").orderBy(interval).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
        return summed.where((F.col("before") < F.col("wanted")) & (F.col("upto") >= F.col("wanted")))

    # a source has one number wanted; as a key it stays in both uses, so that they share one exchange
    cells = drawn.groupBy("source", "wanted", "fine").agg(F.sum("size").alias("words"))
    coarse = cells.groupBy("source", F.floor(F.col("fine") / INTERVALS).alias("coarse")).agg(F.sum("words").alias("words"), F.first("wanted").alias("wanted"))
    at = crossing(coarse, "coarse").select("source", "coarse", F.col("before").alias("coarse_before"))
    inside = cells.alias("c").join(at.alias("a"), F.expr("c.source <=> a.source AND floor(c.fine / %d) = a.coarse" % INTERVALS)).select("c.source", "fine", "words", F.expr("wanted - coarse_before").alias("wanted"))
    cut = crossing(inside, "fine").select(F.col("source").alias("cut_source"), F.col("fine").alias("cut_fine"), (F.col("wanted") - F.col("before")).alias("cut_left"))
    placed = rows.join(sent(cut), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    edge = placed.where(F.col("fine") == F.col("cut_fine"))
    order = Window.partitionBy("source", "fine").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.sum("size").over(order))
    # the row that crosses the target is taken if that brings the source nearer to it
    taken = F.col("upto") - F.col("size") / 2 <= F.col("cut_left")
    sure = F.col("rank").isNotNull() & (F.col("cut_fine").isNull() | (F.col("fine") < F.col("cut_fine")))
    rest = placed.where(F.coalesce(F.col("fine") != F.col("cut_fine"), F.lit(True)))
    names = ["id", "source", "size", "text_hash", "source_size", "target", "whole"]
    both = rest.select(*names, sure.alias("more")).unionByName(edge.select(*names, taken.alias("more")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")
    out = both.withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
