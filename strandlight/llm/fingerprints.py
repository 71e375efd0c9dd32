"""Document fingerprints in the manner of I-Match, on DataFrame functions only.

Terms are the distinct lower-case runs of letters and digits of a text; only the lexicon counts, the terms whose inverse
document frequency lies in a band. The sorted terms that a text has of a subset of the lexicon are hashed together, for
several randomised subsets, which overlap and whose members the hash of a term chooses:

* the whole lexicon and 8 subsets of three quarters of it, each its own, which tell near replicas;
* 64 subsets of one in 64, which cover the lexicon, and 16 of one in 512, which outlast larger changes of short and of
  long texts and so grade the likeness.

The list of these hashes, each with its subset's number, is the fingerprint. Two fingerprints are as like as the share of
equal hashes among the subsets of which either text has a term.

Document frequencies are exact counts over all texts. A term of the lexicon stands in at least ``exp(-MAX_IDF)`` of the
documents, so the lexicon has at most ``exp(MAX_IDF)`` times as many terms as a text has on average (1,808 times; some
thousands in practice) whatever the size of the corpus; it goes to the tasks as a table of hashes with two places for
each term, which tells members exactly.

Defined results: a null text is an empty one; texts without a term in the band have one hash of all their terms
as fingerprint, texts without any term the empty fingerprint, and two such are alike (1); equal texts have equal
fingerprints; a null id comes after all others; rows of equal id follow one another by a hash of their text; a table
of one row has itself as next; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kept terms have an inverse document frequency, ln(documents / documents with the term), in this band.
MIN_IDF, MAX_IDF = 1.0, 7.5
#: Subsets of three quarters of the lexicon, of one in 64 (all 64 of them) and of one in 512.
DENSE, PARTS, SPARSE = 8, 64, 16
#: Number of the subset of all terms, for texts without a term of the lexicon; that of the whole lexicon is 0.
EVERYTHING = 1 + DENSE + PARTS + SPARSE
#: Bits of a fingerprint's entry below the number of its subset; what they are where a text has no term of it.
HASH_BITS, NO_TERM = 55, 42
NOT_TERM = r"[^\p{L}\p{N}]+"


def part_of(h: Column) -> Column:
    """Which of the PARTS: the highest bits, so that sorted hashes stand by part."""
    return F.shiftrightunsigned(h, 58)


def dense(k: int) -> Callable[[Column], Column]:
    return lambda h: F.shiftrightunsigned(h, 2 * k).bitwiseAND(F.lit(3)) != 0


def sparse_of(h: Column) -> Column:
    """Which of the SPARSE; beyond their number, none."""
    return F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(511))


def in_sparse(k: int) -> Callable[[Column], Column]:
    return lambda h: sparse_of(h) == k


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct terms."""
    return F.sort_array(F.array_compact(F.array_distinct(F.transform(F.split(F.lower(text), NOT_TERM), lambda t: F.when(t != "", F.xxhash64(t))))))


def constant(numbers: list[int]) -> Column:
    """A literal array of longs, folded from one string."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def lexicon(docs: DataFrame, text_col: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> list[int]:
    """Hashes of the terms in the band, exactly counted over all texts."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.col(text_col))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["h"] for r in seen.where(F.col("n").between(n * math.exp(-max_idf), n * math.exp(-min_idf))).select("h").collect())


def places(h: int, mask: int) -> tuple[int, int]:
    """The two places of a term in a table of ``mask`` + 1."""
    return (h >> 34) & mask, (h >> 11) & mask


def table_of(found: list[int]) -> list[int]:
    """A table in which each hash stands at one of its two places (cuckoo hashing), else 0."""
    size = 1024
    while size < 2.1 * len(found):
        size *= 2
    while True:
        table = [0] * size
        for h in found:
            at = places(h, size - 1)[0]
            for _ in range(200):
                h, table[at] = table[at], h
                if not h:
                    break
                # the one that stood there goes to its other place, and may push out another
                one, two = places(h, size - 1)
                at = two if at == one else one
            else:
                break
        else:
            return table
        size *= 2


def member(table: Column, size: int, h: Column) -> Column:
    mask = F.lit(size - 1)
    one = F.shiftright(h, 34).bitwiseAND(mask)
    two = F.shiftright(h, 11).bitwiseAND(mask)
    return (F.get(table, one.cast("int")) == h) | (F.get(table, two.cast("int")) == h)


def with_fingerprint(rows: DataFrame, text_col: str, table: list[int], name: str) -> DataFrame:
    """``rows`` with column ``name``: of each subset of which the text has terms its number and their hash, as one long.

    Each step is a column that the next one uses at least twice, so Spark computes it once for a row and
    not again for each element of the next.
    """
    known = constant(table)

    def entry(number: Column, hashes: Column) -> Column:
        return F.shiftleft(number.cast("bigint"), HASH_BITS).bitwiseOR(F.xxhash64(hashes).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    def begins(i: Column) -> Column:
        return (i == 0) | (part_of(F.get("__kept", i)) != part_of(F.get("__kept", i - 1)))

    def run(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("__starts", k + 1), F.size("__kept"))
        return entry(part_of(F.get("__kept", at)) + (1 + DENSE), F.slice("__kept", at + 1, end - at))

    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("__terms", terms(F.col(text_col)))
    rows = rows.withColumn("__kept", F.when(F.size("__terms") > 0, F.filter("__terms", lambda h: member(known, len(table), h))).otherwise(none))
    rows = rows.withColumns({
        "__starts": F.when(F.size("__kept") > 0, F.filter(F.sequence(F.lit(0), F.size("__kept") - 1), begins)).otherwise(F.array().cast("array<int>")),
        "__few": F.when(F.size("__kept") > 0, F.filter("__kept", lambda h: sparse_of(h) < SPARSE)).otherwise(none),
    })
    whole = [entry(F.lit(0), F.col("__kept"))] + [entry(F.lit(1 + k), F.filter("__kept", dense(k))) for k in range(DENSE)]
    few = [entry(F.lit(1 + DENSE + PARTS + k), F.filter("__few", in_sparse(k))) for k in range(SPARSE)]
    fixed = F.filter(F.array(*whole, *few), lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)) != NO_TERM)
    everything = F.when(F.size("__terms") > 0, F.array(entry(F.lit(EVERYTHING), F.col("__terms")))).otherwise(none)
    found = F.when(F.size("__kept") > 0, F.concat(fixed, F.transform("__starts", run))).otherwise(everything)
    return rows.withColumn(name, found).drop("__terms", "__kept", "__starts", "__few")


def likeness(a: Column, b: Column) -> Column:
    number = lambda x: F.shiftrightunsigned(x, HASH_BITS)
    same = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def written(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ".")


def with_next(rows: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row that follows in descending ``key``, after the last the first's.

    Rows go to buckets by quantiles of the key. The first row of each bucket also stands, as a copy, at the end of the
    bucket before it, so a window over each bucket sees every row's successor and no bucket holds all.
    """
    spark = rows.sparkSession
    ids = rows.select(key)
    found = ids.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], 10 * max(buckets, 1000))).first()[0]
    at = constant(sorted(set(found or [0])))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, buckets.bit_length())))])

    def bucket() -> Column:
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(at)) & (F.get(at, low + step - 1) < F.col(key)), low + step).otherwise(low))

    heads = sorted((r["bucket"], r["head"]) for r in ids.withColumn("bucket", bucket()).groupBy("bucket").agg(F.max(key).alias("head")).collect())
    before = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    table = spark.createDataFrame([(h[1], h[0], b) for h, b in zip(heads, before, strict=True)], "head long, at_bucket int, before int")
    # one row for each bucket, so small enough to broadcast at any size
    placed = rows.withColumn("bucket", bucket()).join(F.broadcast(table), (F.col("bucket") == F.col("at_bucket")) & (F.col(key) == F.col("head")), "left")
    both = F.when(F.col("head").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))))
    placed = placed.select(*rows.columns, F.explode(both).alias("place")).select(*rows.columns, "place.bucket", "place.copy")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc(key), "tie")
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where(~F.col("copy")).drop("bucket", "copy")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if base.isEmpty():
        buckets = 1
    else:
        buckets = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = table_of(lexicon(base, "text"))
    rows = base.withColumns({"key": F.coalesce(F.col("id"), F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    rows = with_next(with_fingerprint(rows, "text", table, "fp"), "key", ["text", "fp"], buckets)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", "edited")
    rows = with_fingerprint(rows, "edited", table, "edited_fp").drop("edited")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
