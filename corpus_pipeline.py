"""Documents to packed training sequences, in stages that each apply one operator of strandlight.llm.

Each stage works on all its predecessor kept and all but the last return the columns of ``documents``.
Null ids, texts, languages and sources pass through: a null text has no language and leaves in the first stage;
rows of a null id are never near duplicates. Other columns, of any name and type, are carried along: within a stage
all columns go by their number, so no name can clash with those that a stage works with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType

from strandlight.llm import jaccard_join, language_id, line_dedup, mixing, packing
from strandlight.llm.common import checkpointed, documents, remainder

#: A document whose best language has a smaller score is no language that the model knows.
LEAST_SCORE = 0.3


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1 and so on, and these names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or nothing like the languages learned."""
    own, c = numbered(docs)
    model = language_id.fit(own, remainder(c["doc_id"], 5) != 0, c["doc_id"], c["text"], c["lang"])
    found = language_id.identify(own, model, c["doc_id"], c["text"], keep=own.columns)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; every document stays, with the lines left to it."""
    own, c = numbered(docs)
    cleaned = line_dedup.remove_boilerplate(own, id_col=c["doc_id"], text_col=c["text"], site_col=c["source"])
    n = c.get("n_chars")
    chars = {n: F.when(F.col("n_removed") > 0, F.length(c["text"])).otherwise(F.col(n)).cast("long")} if n else {}
    return cleaned.withColumns(chars).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of near duplicates; of rows that repeat an id, the smallest."""
    own, c = numbered(docs)
    i = c["doc_id"]
    found = jaccard_join.near_duplicates(own, i, c["text"])
    kept = found.where(F.col(i) == F.col("component_id")).select(i).distinct()
    # columns that have no order of their own are compared as they are written
    simple = [f.name for f in own.schema if isinstance(f.dataType, AtomicType) or isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, AtomicType)]
    other = [n for n in own.columns if n not in simple]
    order = F.struct(*simple, *([F.to_json(F.struct(*other))] if other else []))
    first = own.join(kept, i, "left_semi").groupBy(i).agg(F.min_by(F.struct(*own.columns), order).alias("row")).select("row.*")
    return first.unionByName(own.where(F.col(i).isNull())).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, one row a copy.

    Rows alike in id, source and text have the sum of what the mix takes of them, dealt evenly; what is over goes to the first ones.
    """
    own, c = numbered(docs)
    i, text, source = c["doc_id"], c["text"], c["source"]
    taken = mixing.mix(own, i, text, source).where("copies > 0")
    taken = taken.groupBy(F.col(i).alias("of_id"), F.col(source).alias("of_source"), F.col("text_hash").alias("of_hash"), F.col("size").alias("of_size")).agg(F.sum("copies").alias("sum"))
    like = own.groupBy(F.col(i).alias("of_id"), F.col(source).alias("of_source"), mixing.digest_of(F.col(text)).alias("of_hash"), mixing.size_of(text).alias("of_size")).agg(F.count(F.lit(1)).alias("rows"))
    key = ["of_id", "of_source", "of_hash", "of_size"]
    alike = lambda a, b: reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in key))
    sums = taken.join(like, alike(taken, like)).select(*[taken[k] for k in key], "sum", "rows")
    same = F.col(i).eqNullSafe(F.col("of_id")) & F.col(source).eqNullSafe(F.col("of_source")) & (mixing.digest_of(F.col(text)) == F.col("of_hash")) & (mixing.size_of(text) == F.col("of_size"))
    met = checkpointed(own.join(sums, same).withColumn("part", F.spark_partition_id()))
    even = met.where(F.col("sum") % F.col("rows") == 0).withColumn("times", F.col("sum") / F.col("rows"))
    # rows alike are numbered part by part, so that no task gets all of them
    odd = met.where(F.col("sum") % F.col("rows") != 0)
    parts = odd.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"part_{k}") for k in key], F.col("part").alias("part_no"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"))
    placed = odd.join(parts, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"part_{k}")) for k in key)) & (F.col("part") == F.col("part_no")))
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0)))
    over = placed.withColumn("times", F.floor(F.col("sum") / F.col("rows")) + (nth <= F.col("sum") % F.col("rows")).cast("int"))
    both = even.select(*own.columns, F.col("times").cast("int")).unionByName(over.select(*own.columns, F.col("times").cast("int")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times")))).where("copy > 0").select(*own.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixed), ("packing", packed)]
#: The first stage learns and the last tokenises, which SQL can't express; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
