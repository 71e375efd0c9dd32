"""The registered query of each training-data operator, as its contract says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm import language_id
from strandlight.llm import quality_rules
from strandlight.llm import quality_classifier
from strandlight.llm import toxicity
from strandlight.llm import mixing
from strandlight.llm import packing
from strandlight.llm import line_dedup
from strandlight.llm import fingerprints
from strandlight.llm import jaccard_join
from strandlight.llm import simhash_join, fill_in_middle, periodic_runs
from strandlight.llm.common import WORD, documents, labels, remainder
from strandlight.llm.secret_scan import BASE_KINDS, scan_secrets


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = remainder("doc_id", 5)
    # a null id is in no fold: not learned from and not held out
    found = language_id.identify(docs, language_id.fit(docs, fold != 0))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply_rules(docs, quality_rules.references(docs))


def scored(found: DataFrame, fold, *more: str) -> DataFrame:
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"), *more)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.fit(docs, labels(spark, sf_dir))
    return scored(quality_classifier.score(docs, model), remainder("doc_id", 5) == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir))
    return scored(toxicity.score(docs, model), remainder("doc_id", 4) == 2, "passages")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_duplicates(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.restored(fill_in_middle.fill_in_middle(documents(spark, sf_dir)))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def varied(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the text of one id in ten, by its hash, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(varied(documents(spark, sf_dir)))
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, first))
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan, "op5_language_id": op5_language_id, "op6_quality_rules": op6_quality_rules, "op7_quality_classifier": op7_quality_classifier, "op8_toxicity": op8_toxicity, "op9_mixing": op9_mixing, "op3_best_fit_packing": op3_best_fit_packing, "op10_line_dedup": op10_line_dedup, "op2_fingerprints": op2_fingerprints, "op4_jaccard_join": op4_jaccard_join, "op11_simhash_join": op11_simhash_join, "op12_fill_in_middle": op12_fill_in_middle, "op13_periodic_runs": op13_periodic_runs}
#: The words of the contracts and the lines of at least three of them, for DuckDB's expressions.
ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, CAST(place AS BIGINT) AS place, line,
         regexp_matches(line, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]+') AS long
  FROM (SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL)
),
spread AS (SELECT line, min(doc_id) AS holder FROM lines WHERE long GROUP BY line HAVING count(DISTINCT source) >= 8),
marked AS (
  SELECT l.*, s.holder, row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.place) AS nth
  FROM lines l LEFT JOIN spread s ON l.line = s.line
),
kept AS (SELECT *, holder IS NULL OR (doc_id = holder AND nth = 1) AS stays FROM marked),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '') AS text
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, sha256(c.text) AS text_sha256
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
""",
    # shingles as texts, all pairs that share one, and the closure of the links
    "op4_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * p.c >= 80 * (u.n + v.n - p.c)
),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) m ON m.doc_id = d.doc_id
""",
    "op12_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
),
drawn AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, [CAST('0x' || digest[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM cut
),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
),
parts AS (
  SELECT *, array_to_string(lines[1 : a], '') AS prefix, array_to_string(lines[a + 1 : b], '') AS middle, array_to_string(lines[b + 1 :], '') AS suffix FROM placed
),
written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
),
marked AS (SELECT doc_id, n, form, prefix, middle, output, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS m FROM written)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN output[p + 3 : s - 1] || output[m + 3 :] || output[s + 3 : m - 1] ELSE output[p + 3 : m - 1] || output[m + 3 :] || output[s + 3 : p - 1] END) AS restored_sha256
FROM marked
""",
    # a run of six words and four periods has five words that recur one period on: stretches of such starts are the runs
    "op13_periodic_runs": r"""
WITH known AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce([4294967295] || [CAST(unicode(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
           lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) AS h FROM documents
),
chosen AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS times FROM known),
periods AS (SELECT *, 1 + (n - a) // times AS p FROM chosen),
words AS (
  SELECT doc_id, i, CASE WHEN i < a OR a IS NULL THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT doc_id, w, n, a, p, unnest(range(n)) AS i FROM periods)
),
grams AS (
  SELECT doc_id, i, [word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] AS g, count(*) OVER (PARTITION BY doc_id) - i >= 5 AS full_
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i WHERE x.full_ AND y.full_),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs) GROUP BY doc_id, q, part
),
runs AS (SELECT doc_id, s, e - s AS length, min(q) AS q FROM stretches WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
best AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := s, length := length, q := q) ORDER BY length DESC, s, q) AS b, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.b.s AS start, b.b.length AS length, b.b.q AS period, 1000 * b.b.length // b.b.q AS exponent_milli, sha256(coalesce(b.listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
}
