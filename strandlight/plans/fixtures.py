"""Alignments, references and a library of insertions derived from the star-schema tables.

The definitions are text that Spark and DuckDB both run; only integer division differs (``DIV``, ``//``). Mates of
an order share its hash; every tenth order repeats the geometry of the one before it, so duplicates are planted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF_CHUNKS, SPECIAL_CHUNKS, SPECIALS = 100, 20, 3
_TO_BASES = "translate(md5({key}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: What an insertion planted in an unmapped read reads.
INSERTED = "ACGTTGCAAGCT"

PAIRS = """
SELECT k, ck, rg, h, (h DIV 64) % 16 AS c, (h DIV 11) % 5 AS t1,
       CASE WHEN (h DIV 7) % 29 = 0 THEN ((h DIV 11) % 5 + 1) % 5 ELSE (h DIV 11) % 5 END AS t2,
       h % 2600 AS p1, h % 2600 + 200 + (h DIV 2600) % 200 AS p2, (h DIV 2048) % 6 AS ci
FROM (SELECT o_orderkey AS k, o_custkey AS ck, o_orderpriority AS rg,
             (((o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END) % 2147483648) * 2654435761 + 12345) % 4294967296 AS h
      FROM {orders}) g
"""

READS = """
SELECT *, CASE WHEN m = 1 THEN c IN (4, 5, 6) ELSE c IN (0, 1, 2, 3, 6) END AS un,
       CASE WHEN m = 2 THEN c IN (4, 5, 6) ELSE c IN (0, 1, 2, 3, 6) END AS mun,
       CASE WHEN m = 2 AND c IN (7, 8) THEN 6 ELSE ci END AS oc, CASE WHEN m = 1 AND c IN (7, 8) THEN 6 ELSE ci END AS mc,
       CASE WHEN m = 1 THEN t1 ELSE t2 END AS t, CASE WHEN m = 1 THEN p1 ELSE p2 END AS p,
       CASE WHEN m = 1 THEN t2 ELSE t1 END AS mt, CASE WHEN m = 1 THEN p2 ELSE p1 END AS mp
FROM (SELECT *, 1 AS m FROM ({pairs}) a UNION ALL SELECT *, 2 AS m FROM ({pairs}) b) u
"""

_CIGAR = "CASE {n} WHEN 0 THEN '100M' WHEN 1 THEN '60M2I38M' WHEN 2 THEN '50M3D50M' WHEN 3 THEN '10S90M' WHEN 4 THEN '95M5S' WHEN 5 THEN '40M20N60M' ELSE '30S70M' END"
_SPAN = "CASE {n} WHEN 1 THEN 98 WHEN 2 THEN 103 WHEN 3 THEN 90 WHEN 4 THEN 95 WHEN 6 THEN 70 ELSE 100 END"

ALN = f"""
SELECT concat('f', CAST(r.k AS VARCHAR(20))) AS qname, r.k AS pair_id, r.m,
       1 + CASE WHEN c >= 10 THEN 2 ELSE 0 END + CASE WHEN un THEN 4 ELSE 0 END + CASE WHEN mun THEN 8 ELSE 0 END
         + CASE WHEN m = 2 THEN 16 + 128 ELSE 32 + 64 END + CASE WHEN h % 41 = 0 THEN 512 ELSE 0 END
         + CASE WHEN h % 37 = 0 THEN 1024 ELSE 0 END + CASE WHEN h % 43 = 0 THEN 256 ELSE 0 END AS flag,
       CASE WHEN un AND mun THEN -1 WHEN un THEN mt ELSE t END AS tid,
       CASE WHEN un AND mun THEN -1 WHEN un THEN mp ELSE p END AS pos,
       CASE WHEN un THEN 0 WHEN c = 9 AND m = 2 THEN ((ck * 7 + m) % 61) % 10 ELSE (ck * 7 + m) % 61 END AS mapq,
       CASE WHEN un THEN '*' ELSE {_CIGAR.format(n="oc")} END AS cigar,
       CASE WHEN un AND mun THEN -1 WHEN mun THEN t ELSE mt END AS mtid,
       CASE WHEN un AND mun THEN -1 WHEN mun THEN p ELSE mp END AS mpos,
       CASE WHEN un OR mun OR t <> mt THEN 0
            WHEN p < mp THEN mp + {_SPAN.format(n="mc")} - p - 1
            ELSE mp - p - {_SPAN.format(n="oc")} + 1 END AS isize,
       r.rg, concat('lib', CAST(length(r.rg) % 2 AS VARCHAR(2))) AS lib,
       CASE WHEN NOT un THEN substring(f.bases, CAST(p + 1 AS INT), 100)
            WHEN h % 2 = 0 THEN concat(substring(f.bases, CAST(p + 1 AS INT), 50), substring(f.bases, CAST(p + 63 AS INT), 50))
            ELSE concat(substring(f.bases, CAST(p + 1 AS INT), 50), '{INSERTED}', substring(f.bases, CAST(p + 51 AS INT), 38)) END AS seq,
       3000 + (ck * 13 + m) % 1000 AS sumq, r.k * 2 + m AS rec_no, h
FROM ({{reads}}) r JOIN {{refs}} f ON f.tid = r.t
"""


def _bases(key: str, n: int) -> str:
    return f"array_join(transform(sequence(0, {n - 1}), i -> {_TO_BASES.format(key=key)}), '')"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, rname, len, bases): one reference for each region."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return region.selectExpr("cast(r_regionkey as bigint) AS tid", "r_name AS rname", f"cast({32 * REF_CHUNKS} as bigint) AS len", _bases("concat(r_name, ':', i)", REF_CHUNKS) + " AS bases")


def special_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sp_id, name, bases): the library of insertion sequences, one for each of the first regions."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").where(F.col("r_regionkey") < SPECIALS)
    return region.selectExpr("cast(r_regionkey as bigint) AS sp_id", "concat('sp', r_regionkey) AS name", _bases("concat('sp', r_regionkey, ':', i)", SPECIAL_CHUNKS) + " AS bases")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads for each order, in the columns of the alignment schema."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    reads = READS.replace("{pairs}", PAIRS)
    found = spark.sql(ALN.replace("{reads}", reads), orders=orders, refs=F.broadcast(refs(spark, sf_dir)))
    longs = ["m", "flag", "tid", "pos", "mapq", "mtid", "mpos", "isize", "sumq", "rec_no", "h"]
    return found.withColumns({c: F.col(c).cast("bigint") for c in longs})


def _duck(text: str) -> str:
    return text.replace(" DIV ", " // ").replace("concat('f', CAST(r.k AS VARCHAR(20)))", "concat('f', r.k)")


def _duck_bases(key: str, n: int) -> str:
    return f"(SELECT string_agg({_TO_BASES.format(key=key)}, '' ORDER BY i) FROM range({n}) t(i))"


#: ``refs``, ``specials`` and ``aln`` as common table expressions for DuckDB.
DUCK = f"""
refs AS (SELECT CAST(r_regionkey AS BIGINT) AS tid, r_name AS rname, CAST({32 * REF_CHUNKS} AS BIGINT) AS len, {_duck_bases("concat(r_name, ':', i)", REF_CHUNKS)} AS bases FROM region),
specials AS (SELECT CAST(r_regionkey AS BIGINT) AS sp_id, concat('sp', r_regionkey) AS name, {_duck_bases("concat('sp', r_regionkey, ':', i)", SPECIAL_CHUNKS)} AS bases FROM region WHERE r_regionkey < {SPECIALS}),
aln AS ({_duck(ALN.replace("{reads}", READS.replace("{pairs}", PAIRS)).replace("{orders}", "orders").replace("{refs}", "refs"))})
"""
