"""Line dedup: boilerplate lines are those that many distinct sites hold.

Lines of enough words are hashed. A first count keeps the hashes that occur at all often enough; for these a
HyperLogLog sketch of the sites of each line hash merges by aggregation. Lines whose estimate lies clearly above the
threshold are boilerplate, those clearly below are not, and those near it get an exact distinct count of sites. In
each text boilerplate lines are removed, but for the document of smallest id that holds the line, where its first
occurrence stays, so the content stays in the corpus once.

Defined results: a null text stays null, an empty one empty; a null site counts as no site; a document may lose all its
lines and then has an empty text; rows that repeat an id are all the holder of a line if that id is; an empty
table gives an empty table. All rows and all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import WORD, checkpointed

#: Distinct sites that make a line boilerplate; words under which a line is left alone.
MIN_SITES, MIN_WORDS = 8, 3
#: log2 of the sketch's slots; relative distance from the threshold within which the exact count decides.
SKETCH_BITS, NEAR = 10, 0.25


#: A line of enough words.
LONG = rf"^[\x20\x09-\x0D]*({WORD}[\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}{WORD}"


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the lines of enough words."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(LONG)), lambda line: F.xxhash64(line)))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, hash, held): the boilerplate lines of each document; ``held`` where the document keeps one."""
    lines = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(line_hashes(F.col(text_col))).alias("hash")).where(F.col("id").isNotNull())
    often = lines.groupBy("hash").agg(F.count("site").alias("n"), F.min("id").alias("holder"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = checkpointed(often.where((F.col("n") >= min_sites) & (F.col("a") != F.col("b"))).select("hash", "holder"))
    # the frequent lines are few against all; AQE makes them a broadcast by their measured size, or splits the hot ones
    rows = checkpointed(lines.join(often, "hash"))
    sited = rows.where(F.col("site").isNotNull())
    estimated = checkpointed(sited.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites")))
    near = estimated.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("hash")
    exact = sited.join(near, "hash").select("hash", "site").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("sites"))
    found = estimated.where(F.col("sites") > min_sites * (1 + NEAR)).select("hash").unionByName(exact.where(F.col("sites") >= min_sites).select("hash"))
    return rows.join(found, "hash").select("id", "hash", (F.col("id") == F.col("holder")).alias("held"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with its text cleaned, ``n_lines`` and ``n_removed``."""
    lost = boilerplate(docs, min_sites, id_col, text_col, site_col).groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.when(~F.col("held"), F.col("hash"))).alias("__gone"), F.collect_set(F.when(F.col("held"), F.col("hash"))).alias("__held"))
    lines = F.split(F.col(text_col), "\n", -1)
    joined = docs.join(lost, F.col(id_col) == F.col("__id"), "left")
    joined = joined.withColumn("__hashes", F.when(F.col("__id").isNotNull(), F.transform(lines, lambda line: F.xxhash64(line))))

    def stays(line: Column, place: Column) -> Column:
        own = F.element_at("__hashes", place + 1)
        return ~F.array_contains("__gone", own) & ~(F.array_contains("__held", own) & (F.array_position("__hashes", own) <= place))

    left = F.when(F.col("__id").isNotNull(), F.filter(lines, stays))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    joined = joined.withColumns({"__left": left, "n_lines": n_lines})
    joined = joined.withColumn("n_removed", F.coalesce(F.when(F.col("__left").isNotNull(), F.col("n_lines") - F.size("__left")), F.lit(0)).cast("long"))
    text = F.when(F.col("__left").isNotNull(), F.array_join("__left", "\n")).otherwise(F.col(text_col)).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(c) for c in docs.columns], "n_lines", "n_removed")
