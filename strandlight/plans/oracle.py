"""The registered queries as SQL for DuckDB, over the same derived alignments."""

from __future__ import annotations

from strandlight.plans.fixtures import DUCK

ORACLE_SQL: dict[str, str] = {}


def _sum(cigar: str, ops: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({cigar}, '(\\d+)[{ops}]', 1), lambda v: CAST(v AS BIGINT))), 0)"


def _end(pos: str = "pos", cigar: str = "cigar") -> str:
    return f"({pos} + {_sum(cigar, 'MDN')})"


def _revcomp(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGTacgt', 'TGCAtgca'))"


_MASKED = "(flag & 1) <> 0 AND qname <> '*' AND (flag & 1792) = 0"
_MODE = """(CASE WHEN ((flag & 64) <> 0) = ((flag & 128) <> 0) THEN -1 ELSE
  CASE WHEN u < 2 AND d >= 2 THEN u * 2 + d - 2 WHEN u >= 2 AND d < 2 THEN 4 + (u - 2) * 2 + d ELSE -1 END END)"""
_STATUS = f"""CASE WHEN (flag & 4) <> 0 THEN 'orphan'
  WHEN coalesce(TRY_CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS INT), 0) >= 20 OR coalesce(TRY_CAST(regexp_extract(cigar, '(\\d+)S$', 1) AS INT), 0) >= 20 THEN 'soft'
  WHEN mapq >= 10 AND CAST({_sum("cigar", "IDX")} AS DOUBLE) / length(seq) <= 0.1 THEN 'anchor' ELSE 'poor' END"""

#: Common table expressions, each with those it needs.
_CTE = {
    "base": DUCK,
    "run2": "run2 AS (SELECT * REPLACE (CASE WHEN tid >= 0 THEN pos + h % 5 ELSE pos END AS pos) FROM aln WHERE pair_id % 3 <> 0)",
    "cand": f"cand AS (SELECT * FROM aln WHERE {_MASKED} AND NOT ((flag & 4) <> 0 AND (flag & 8) <> 0))",
    "modes": f"""modes AS (SELECT *, {_MODE} AS pair_mode FROM (
        SELECT *, CASE WHEN isize < 0 THEN mate ELSE own END AS u, CASE WHEN isize < 0 THEN own ELSE mate END AS d FROM (
          SELECT *, (CASE WHEN (flag & 16) <> 0 THEN 1 ELSE 0 END) + (CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 0 END) AS own,
                 (CASE WHEN (flag & 32) <> 0 THEN 1 ELSE 0 END) + (CASE WHEN (flag & 64) <> 0 THEN 2 ELSE 0 END) AS mate FROM aln)))""",
    "hist": f"""hist AS (SELECT rg, isize AS frag_len, count(*) AS freq FROM modes
        WHERE {_MASKED} AND (flag & 12) = 0 AND tid = mtid AND isize > 0 AND pair_mode IN (1, 5) GROUP BY ALL)""",
    "cum": "cum AS (SELECT *, sum(freq) OVER (PARTITION BY rg ORDER BY frag_len) AS upto, sum(freq) OVER (PARTITION BY rg) AS total FROM hist)",
    "cut": "cut AS (SELECT rg, min(CASE WHEN CAST(upto AS DOUBLE) / total >= 0.05 THEN frag_len END) AS lower, max(CASE WHEN CAST(upto AS DOUBLE) / total <= 0.95 THEN frag_len END) AS upper FROM cum GROUP BY rg)",
    "mates": """mates AS (SELECT a.qname, a.tid, a.rec_no AS first, b.rec_no AS second FROM
        (SELECT *, row_number() OVER (PARTITION BY tid, qname ORDER BY rec_no) AS n FROM cand) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY tid, qname ORDER BY rec_no) AS n FROM cand) b
        ON a.qname = b.qname AND a.tid = b.tid AND a.n % 2 = 1 AND b.n = a.n + 1 AND abs(a.pos - b.pos) < 2000)""",
    "status": f"status AS (SELECT *, {_STATUS} AS status FROM aln)",
    "typed": """typed AS (SELECT qname, CASE WHEN swap THEN second ELSE first END AS anchor_no, CASE WHEN swap THEN first ELSE second END AS target_no,
          CASE WHEN (CASE WHEN swap THEN sb ELSE sa END) <> 'anchor' THEN 'other'
               ELSE 'unique_' || (CASE CASE WHEN swap THEN sa ELSE sb END WHEN 'anchor' THEN 'normal' ELSE CASE WHEN swap THEN sa ELSE sb END END) END AS pair_type
        FROM (SELECT m.*, x.status AS sa, y.status AS sb, x.status <> 'anchor' AND y.status = 'anchor' AS swap
              FROM mates m JOIN status x ON x.rec_no = m.first JOIN status y ON y.rec_no = m.second))""",
    "masked": "masked AS (SELECT * FROM aln WHERE tid >= 0 AND (flag & 1796) = 0)",
    "ops": """ops AS (SELECT *, CAST(ref_sum AS BIGINT) AS ref_off, CAST(query_sum AS BIGINT) AS query_off FROM (SELECT *, sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END AS ref_sum,
          sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END AS query_sum,
          lag(op) OVER w AS op_before, lead(op) OVER w AS op_after, lead(len) OVER w AS len_after
        FROM (SELECT rec_no, tid, pos, flag, mapq, seq, i, CAST(regexp_extract(o, '\\d+') AS BIGINT) AS len, right(o, 1) AS op
              FROM (SELECT *, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS o, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) AS i FROM {reads}))
        WINDOW w AS (PARTITION BY rec_no ORDER BY i)))""",
    "elem": """elem AS (SELECT tid, pos + ref_off + j AS pos, rec_no, (flag & 16) <> 0 AS reverse, mapq, op = 'D' AS deleted,
          CASE WHEN op = 'M' THEN substring(seq, query_off + j + 1, 1) END AS base,
          20 + (rec_no + CASE WHEN op = 'M' THEN query_off + j ELSE query_off END) % 20 AS baseq,
          op = 'M' AND j = 0 AND (op_before IS NULL OR op_before IN ('N', 'S', 'H')) AS head,
          op = 'M' AND j = len - 1 AND (op_after IS NULL OR op_after IN ('N', 'S', 'H')) AS tail,
          CASE WHEN op = 'M' AND j = len - 1 AND op_after = 'I' THEN len_after WHEN op = 'M' AND j = len - 1 AND op_after = 'D' THEN -len_after ELSE 0 END AS indel,
          CASE WHEN op = 'M' AND j = len - 1 AND op_after = 'I' THEN substring(seq, query_off + j + 2, len_after) END AS inserted
        FROM (SELECT *, unnest(range(len)) AS j FROM ops WHERE op IN ('M', 'D')))""",
    "pile": """pile AS (SELECT e.tid, e.pos, substring(r.bases, e.pos + 1, 1) AS ref, count(*) AS depth,
          string_agg(CASE WHEN head THEN '^' || chr(CAST(least(mapq, 93) + 33 AS INT)) ELSE '' END
            || CASE WHEN deleted THEN '*' WHEN upper(base) = upper(substring(r.bases, e.pos + 1, 1)) THEN CASE WHEN reverse THEN ',' ELSE '.' END WHEN reverse THEN lower(base) ELSE upper(base) END
            || CASE WHEN indel > 0 THEN '+' || indel || CASE WHEN reverse THEN lower(inserted) ELSE upper(inserted) END
                    WHEN indel < 0 THEN indel || CASE WHEN reverse THEN lower(substring(r.bases, e.pos + 2, -indel)) ELSE upper(substring(r.bases, e.pos + 2, -indel)) END ELSE '' END
            || CASE WHEN tail THEN '$' ELSE '' END, '' ORDER BY rec_no) AS bases,
          string_agg(chr(CAST(least(baseq + 33, 126) AS INT)), '' ORDER BY rec_no) AS quals, string_agg(chr(CAST(least(mapq + 33, 126) AS INT)), '' ORDER BY rec_no) AS mapqs
        FROM elem e JOIN refs r ON r.tid = e.tid GROUP BY e.tid, e.pos, r.bases)""",
    "cons": """cons AS (SELECT e.tid, e.pos, substring(r.bases, e.pos + 1, 1) AS ref, substring('NACMGRSVTWYHKDBN', CAST(bits + 1 AS INT), 1) AS cons, 60 AS cons_q, rms_q, depth
        FROM (SELECT tid, pos, bit_or(CASE WHEN deleted THEN 0 ELSE CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END END) AS bits,
                     CAST(floor(sqrt(CAST(sum(least(mapq, 60) * least(mapq, 60)) AS DOUBLE) / count(*)) + 0.499) AS BIGINT) AS rms_q, count(*) AS depth FROM elem GROUP BY tid, pos) e JOIN refs r ON r.tid = e.tid)""",
    "vars": """vars AS (SELECT tid, pos + 1 AS pos, ref, array_to_string(list_filter(string_split(replace(al, ref, ''), ''), lambda x: x <> ''), ',') AS alt,
          CASE WHEN length(al) = 1 THEN '1/1' WHEN length(replace(al, ref, '')) = 1 THEN '0/1' ELSE '1/2' END AS gt
        FROM (SELECT *, CASE cons WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'M' THEN 'AC' WHEN 'R' THEN 'AG' WHEN 'W' THEN 'AT' WHEN 'S' THEN 'CG' WHEN 'Y' THEN 'CT' WHEN 'K' THEN 'GT' END AS al FROM cons)
        WHERE cons <> ref AND al IS NOT NULL)""",
    "spans": "spans AS (SELECT tid, pos + ref_off AS b, pos + ref_off + len AS e FROM ops WHERE op IN ('M', 'D'))",
    "sweep": """sweep AS (SELECT tid, place AS \"begin\", lead(place) OVER (PARTITION BY tid ORDER BY place) AS \"end\", CAST(sum(d) OVER (PARTITION BY tid ORDER BY place) AS BIGINT) AS depth
        FROM (SELECT tid, place, sum(d) AS d FROM (SELECT tid, b AS place, 1 AS d FROM spans UNION ALL SELECT tid, e, -1 FROM spans) GROUP BY tid, place HAVING sum(d) <> 0))""",
    "pe": """pe AS (SELECT *, CASE WHEN head THEN loser ELSE eligible AND qname IN (SELECT qname FROM heads WHERE loser) END AS dropped FROM (
          SELECT a.*, h.loser FROM elig a LEFT JOIN heads h ON h.rec_no = a.rec_no))""",
    "elig": "elig AS (SELECT *, tid >= 0 AND (flag & 1) <> 0 AND (flag & 12) = 0 AND tid = mtid AS eligible, tid >= 0 AND (flag & 1) <> 0 AND (flag & 12) = 0 AND tid = mtid AND isize > 0 AS head FROM aln)",
    "heads": "heads AS (SELECT rec_no, qname, row_number() OVER (PARTITION BY lib, tid, pos, isize ORDER BY sumq DESC, rec_no) > 1 AS loser FROM elig WHERE head)",
    "un": "un AS (SELECT * FROM aln WHERE (flag & 4) <> 0)",
    "rk": "rk AS (SELECT rec_no AS read, place, substring(seq, CAST(place + 1 AS INT), 7) AS kmer FROM (SELECT *, unnest(range(length(seq) - 6)) AS place FROM un))",
    "sk": "sk AS (SELECT sp_id AS ref, place, substring(bases, CAST(place + 1 AS INT), 7) AS kmer FROM (SELECT *, unnest(range(length(bases) - 6)) AS place FROM specials))",
    "runs": """runs AS (SELECT read, ref, min(q) AS query_begin, min(r) AS ref_begin, count(*) + 6 AS length FROM (
          SELECT *, q - row_number() OVER (PARTITION BY read, ref, r - q ORDER BY q) AS run FROM (
            SELECT rk.read, sk.ref, rk.place AS q, sk.place AS r FROM rk JOIN sk ON rk.kmer = sk.kmer)) GROUP BY read, ref, r - q, run)""",
    "sam": """sam AS (SELECT concat_ws(chr(9), qname, flag, coalesce(r.rname, '*'), pos + 1, mapq, cigar, CASE WHEN n.rname IS NULL THEN '*' WHEN a.mtid = a.tid THEN '=' ELSE n.rname END,
          mpos + 1, isize, seq, '*', 'RG:Z:' || rg) AS value FROM aln a LEFT JOIN refs r ON r.tid = a.tid LEFT JOIN refs n ON n.tid = a.mtid)""",
    "placed": "placed AS (SELECT * FROM aln WHERE tid >= 0 AND (flag & 4) = 0)",
    "cmp": """cmp AS (SELECT rec_no, string_agg(CASE WHEN op = 'D' THEN CASE WHEN j = 0 THEN '^' ELSE '' END || lower(base) WHEN substring(seq, query_off + j + 1, 1) = base THEN '.' ELSE base END, '' ORDER BY ref_off + j) AS seen
        FROM (SELECT o.*, substring(r.bases, o.pos + o.ref_off + o.j + 1, 1) AS base FROM (SELECT *, unnest(range(len)) AS j FROM ops WHERE op IN ('M', 'D')) o JOIN refs r ON r.tid = o.tid) GROUP BY rec_no)""",
    "mdnm": """mdnm AS (SELECT p.qname, p.m, p.rec_no, CAST(length(regexp_replace(seen, '[.^]', '', 'g')) + {inserted} AS BIGINT) AS nm,
          array_to_string(list_transform(regexp_extract_all(seen, '[.]*(?:\\^[a-z]*|[A-Z])'), lambda t: CAST(length(t) - length(ltrim(t, '.')) AS VARCHAR) || upper(ltrim(t, '.'))), '') || CAST(length(seen) - length(rtrim(seen, '.')) AS VARCHAR) AS md
        FROM placed p JOIN cmp c ON c.rec_no = p.rec_no)""".replace("{inserted}", _sum("cigar", "I")),
}
_NEEDS = {
    "cmp": ["placed", "ops"], "mdnm": ["cmp"],
    "hist": ["modes"], "cum": ["hist"], "cut": ["cum"], "mates": ["cand"], "typed": ["mates", "status"], "elem": ["ops"], "pile": ["elem"], "cons": ["elem"], "vars": ["cons"], "spans": ["ops"], "sweep": ["spans"],
    "heads": ["elig"], "pe": ["heads"], "rk": ["un"], "runs": ["rk", "sk"],
}


def _with(*names: str, reads: str = "masked") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name == "ops" and reads == "masked":
            add("masked")
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join([DUCK.strip(), *[_CTE[n].replace("{reads}", reads) for n in order]]) + "\n"


def _add(name: str, sql: str, *ctes: str) -> None:
    ORACLE_SQL[name] = _with(*ctes) + sql


_COUNTERS = {
    "total": "TRUE", "qcfail": "(flag & 512) <> 0", "duplicates": "(flag & 1024) <> 0", "mapped": "(flag & 4) = 0", "paired": "(flag & 1) <> 0", "read1": "(flag & 65) = 65", "read2": "(flag & 129) = 129", "proper": "(flag & 3) = 3",
    "both_mapped": "(flag & 13) = 1", "singletons": "(flag & 13) = 9", "mate_other_ref": "(flag & 13) = 1 AND tid <> mtid", "mate_other_ref_q5": "(flag & 13) = 1 AND tid <> mtid AND mapq >= 5",
}
_BIN = "CAST(CASE " + " ".join(f"WHEN ({{b}} >> {s}) = (({{e}} - 1) >> {s}) THEN {f} + ({{b}} >> {s})" for s, f in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))) + " ELSE 0 END AS BIGINT)"
_BINS = "1 + " + " + ".join(f"((({{e}} - 1) >> {s}) - ({{b}} >> {s}) + 1)" for s in (26, 23, 20, 17, 14))
_REGIONS = ((1, 200, 900), (1, 800, 1500), (3, 0, 400))
_LAST = f"greatest({_end()}, pos + 1)"

_add("pair_type_counts", "SELECT pair_type, count(*) AS n FROM typed GROUP BY pair_type", "typed")
_add("flagstat", "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTERS.items()) + " FROM aln")
_add("idxstats", """SELECT r.rname, r.len, count(a.tid) FILTER ((flag & 4) = 0) AS mapped, count(a.tid) FILTER ((flag & 4) <> 0) AS unmapped FROM refs r LEFT JOIN aln a ON a.tid = r.tid GROUP BY r.rname, r.len
UNION ALL SELECT '*', 0, 0, count(*) FROM aln WHERE tid < 0""")
_add("view_flag_mapq", "SELECT qname, m, flag, mapq, rg FROM aln WHERE mapq >= 20 AND (flag & 2) = 2 AND (flag & 1024) = 0 AND (rg IS NULL OR rg IN ('1-URGENT', '2-HIGH'))")
_add("view_library", "SELECT rg, count(*) AS n FROM aln WHERE lib = 'lib1' GROUP BY rg")
_add("orphan_filter", f"SELECT qname, m, flag, tid, pos FROM aln WHERE {_MASKED} AND ((flag & 4) <> 0) <> ((flag & 8) <> 0)")
_add("badmate_filter", "SELECT qname, m, flag, tid, pos FROM cand", "cand")
_add("normal_filter", f"SELECT qname, m, isize FROM aln WHERE {_MASKED} AND (flag & 12) = 0 AND isize <> 0 AND tid = mtid")
_add("sv_candidates", f"""SELECT qname, m, tid, mtid, isize, modes.rg FROM modes JOIN cut ON cut.rg = modes.rg
WHERE {_MASKED} AND (flag & 12) = 0 AND (tid <> mtid OR (isize <> 0 AND pair_mode >= 0 AND NOT abs(isize) BETWEEN lower AND upper))""", "cut")
_add("pileup_mask", "SELECT tid, flag, count(*) AS n FROM masked GROUP BY tid, flag", "masked")
_add("region_fetch", f"SELECT qname, m, pos, cigar FROM aln JOIN refs USING (tid) WHERE rname = 'AMERICA' AND pos < 1200 AND {_LAST} > 1000")
_add("multi_region_bag", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS region, qname, m, pos FROM aln WHERE tid = {t} AND pos < {e} AND {_LAST} > {b}" for i, (t, b, e) in enumerate(_REGIONS)))
_add("cigar_lengths", f"SELECT qname, m, {_end()} AS end_pos, {_sum('cigar', 'MIS')} AS qlen, CASE WHEN cigar = '*' THEN '' ELSE cigar END AS text FROM aln")
_add("reg2bin", f"SELECT qname, m, {_BIN.format(b='pos', e='z')} AS bin, {_BIN.format(b='(pos * 50000)', e='(z * 50000)')} AS wide_bin, {_BINS.format(b='(pos * 50000)', e='(z * 50000)')} AS n_bins FROM (SELECT *, {_LAST} AS z FROM aln WHERE tid >= 0)")
_add("mismatch_rate", f"SELECT qname, m, round(CAST({_sum('cigar', 'IDX')} AS DOUBLE) / length(seq), 4) AS rate FROM aln WHERE cigar <> '*'")
_add("align_status", "SELECT qname, m, status FROM status", "status")
_SIZE = "CASE WHEN {a} < {b} THEN {be} - {a} - 1 ELSE {b} - {ae} + 1 END"
_MD = lambda x: f"({x}.pos + {_sum(f'{x}.cigar', 'MD')})"
_add("insert_sizes", f"""SELECT x.qname, {_SIZE.format(a='x.pos', ae=_MD('x'), b='y.pos', be=_MD('y'))} AS size_a, {_SIZE.format(a='y.pos', ae=_MD('y'), b='x.pos', be=_MD('x'))} AS size_b
FROM aln x JOIN aln y ON x.qname = y.qname AND x.tid = y.tid AND x.m = 1 AND y.m = 2 WHERE (x.flag & 12) = 0 AND (y.flag & 12) = 0 AND abs(x.pos - y.pos) < 2000""")
_add("pair_modes", "SELECT pair_mode, count(*) AS n FROM modes GROUP BY pair_mode", "modes")
_add("pair_stats", "SELECT qname, m, pair_mode, abs(isize) AS frag_len, rg FROM modes", "modes")
_add("mate_pairs", "SELECT * FROM mates", "mates")
_add("pair_types", "SELECT * FROM typed", "typed")
_add("frag_hist", "SELECT * FROM hist", "hist")
_add("frag_stats", """SELECT rg, CAST(sum(freq) AS BIGINT) AS n, round(CAST(sum(freq * frag_len) AS DOUBLE) / sum(freq), 4) AS mean, min(CASE WHEN upto * 2 >= total THEN frag_len END) AS median,
  round(sqrt(greatest(CAST(sum(freq * frag_len * frag_len) AS DOUBLE) - CAST(sum(freq * frag_len) AS DOUBLE) * sum(freq * frag_len) / sum(freq), 0) / greatest(sum(freq) - 1, 1)), 4) AS stdev FROM cum GROUP BY rg""", "cum")
_add("frag_cutoffs", "SELECT * FROM cut", "cut")
_add("depth", "SELECT tid, pos, count(*) AS depth FROM elem GROUP BY tid, pos", "elem")
_add("coverage_sweep", "SELECT tid, \"begin\", \"end\", depth FROM sweep WHERE depth > 0", "sweep")
ORACLE_SQL["pair_coverage"] = "WITH " + DUCK.strip() + ",\nspans AS (SELECT tid, pos AS b, pos + isize + 1 AS e FROM aln WHERE (flag & 3) = 3 AND isize > 0 AND tid = mtid),\n" + _CTE["sweep"] + "\nSELECT tid, \"begin\", \"end\", depth FROM sweep WHERE depth > 0"
_add("anchor_islands", f"""SELECT tid, min(b) AS "begin", max(e) AS "end" FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY b, e) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY tid ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT tid, pos AS b, {_end()} AS e FROM aln WHERE (flag & 4) = 0 AND mapq >= 59))) GROUP BY tid, island""")
_add("pileup_rows", "SELECT tid, pos + 1 AS pos, ref, depth, bases, quals, mapqs FROM pile", "pile")
_add("rms_mapq", "SELECT tid, pos, CAST(floor(sqrt(CAST(sum(least(mapq, 60) * least(mapq, 60)) AS DOUBLE) / count(*)) + 0.499) AS BIGINT) AS rms FROM elem GROUP BY tid, pos", "elem")
_MULTI = ",\n".join(f"{name}{i}" + " AS " + _CTE[name].replace("{reads}", f"reads{i}").split(" AS ", 1)[1].replace("FROM ops ", f"FROM ops{i} ").replace("FROM elem ", f"FROM elem{i} ") for i in (1, 2) for name in ("ops", "elem", "pile"))
ORACLE_SQL["mpileup"] = "WITH " + ",\n".join([DUCK.strip(), _CTE["run2"], "reads1 AS (SELECT * FROM aln WHERE tid >= 0 AND (flag & 1796) = 0)", "reads2 AS (SELECT * FROM run2 WHERE tid >= 0 AND (flag & 1796) = 0)", _MULTI]) + """
SELECT coalesce(a.tid, b.tid) AS tid, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.depth, 0) AS depth_1, length(coalesce(a.bases, '*')) AS len_1, coalesce(b.depth, 0) AS depth_2, length(coalesce(b.bases, '*')) AS len_2
FROM pile1 a FULL JOIN pile2 b ON a.tid = b.tid AND a.pos = b.pos"""
_add("consensus_all", "SELECT tid, pos, ref, cons, CAST(cons_q AS BIGINT) AS cons_q, rms_q, depth FROM cons", "cons")
_add("vcf_from_pileup", "SELECT * FROM vars", "vars")
_add("snp_density", "SELECT tid, pos, near, near > 2 AS dense FROM (SELECT tid, pos, count(*) OVER (PARTITION BY tid ORDER BY pos RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near FROM vars)", "vars")
_add("indel_sites", """SELECT e.tid, e.pos, e.indel, coalesce(e.inserted, '') AS allele, count(*) AS n, min(d.depth) AS depth FROM elem e JOIN (SELECT tid, pos, count(*) AS depth FROM elem GROUP BY tid, pos) d ON d.tid = e.tid AND d.pos = e.pos
WHERE e.indel <> 0 GROUP BY e.tid, e.pos, e.indel, coalesce(e.inserted, '')""", "elem")
_add("gap_masked_consensus", """SELECT tid, tile, tile * 1000 AS start, string_agg(c, '' ORDER BY pos) AS bases FROM (
  SELECT r.tid, r.pos // 1000 AS tile, r.pos, CASE WHEN c.cons IS NULL THEN 'n' WHEN g.pos IS NOT NULL OR NOT (c.rms_q >= 25 AND c.depth BETWEEN 3 AND 255) THEN lower(c.cons) ELSE upper(c.cons) END AS c
  FROM (SELECT tid, unnest(range(len)) AS pos FROM refs) r LEFT JOIN cons c ON c.tid = r.tid AND c.pos = r.pos
  LEFT JOIN (SELECT DISTINCT tid, unnest(range(greatest(pos - 10, 0), pos + 10)) AS pos FROM (
     SELECT tid, pos, indel, coalesce(inserted, '') AS a FROM elem WHERE indel <> 0 GROUP BY ALL HAVING count(*) >= 2)) g ON g.tid = r.tid AND g.pos = r.pos) GROUP BY tid, tile""", "cons")
_add("coord_sort_rank", "SELECT qname, m, tid, pos, rec_no, row_number() OVER (ORDER BY tid < 0, tid, pos, rec_no) AS rank FROM aln")
_add("name_sort_rank", "SELECT qname, m, tid, pos, rec_no, row_number() OVER (ORDER BY pair_id, tid, pos, rec_no) AS rank FROM aln")
_add("merge_rg", """SELECT qname, m, flag, tid, pos, rg, file_no, rec_no, row_number() OVER (ORDER BY tid < 0, tid, pos, (flag & 16) <> 0, file_no, rec_no) AS rank
FROM (SELECT * REPLACE ('run1' AS rg), CAST(0 AS BIGINT) AS file_no FROM aln UNION ALL SELECT * REPLACE ('run2' AS rg), CAST(1 AS BIGINT) FROM run2)""", "run2")
_add("rmdup_pe", "SELECT qname, m, rec_no FROM pe WHERE NOT dropped", "pe")
_add("rmdup_se", f"""SELECT qname, m, rec_no FROM (SELECT *, tid >= 0 AND (flag & 4) = 0 AS open, row_number() OVER (
    PARTITION BY tid >= 0 AND (flag & 4) = 0, lib, tid, (flag & 16) <> 0, CASE WHEN (flag & 16) <> 0 THEN {_end()} ELSE pos END ORDER BY sumq DESC, rec_no) AS n FROM aln) WHERE NOT open OR n = 1""")
_add("dup_rate", "SELECT lib, count(*) AS checked, count(*) FILTER (dropped) AS removed FROM pe WHERE head GROUP BY lib", "pe")
_five = lambda x: f"CASE WHEN ({x}.flag & 16) <> 0 THEN {_end(f'{x}.pos', f'{x}.cigar')} ELSE {x}.pos END"
_add("fixmate", f"""SELECT a.qname, a.m, CAST(CASE WHEN (b.flag & 4) <> 0 THEN ((t | 8) & ~2) ELSE t END AS BIGINT) AS flag, b.tid AS mtid, b.pos AS mpos,
  CASE WHEN a.tid = b.tid AND (a.flag & 12) = 0 AND (b.flag & 12) = 0 THEN ({_five('b')}) - ({_five('a')}) ELSE 0 END AS isize
FROM (SELECT *, (flag & ~32) AS t0 FROM aln) a JOIN aln b ON a.qname = b.qname AND a.m <> b.m, LATERAL (SELECT a.t0 + CASE WHEN (b.flag & 16) <> 0 THEN 32 ELSE 0 END AS t)""")
_add("unique_best", f"""SELECT qname, m, score, CAST(least(floor(250.0::DOUBLE * (score - second) / score + 0.499), 250) AS BIGINT) AS mapq FROM (
  SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS second FROM (
    SELECT *, greatest(1, {_sum('cigar', 'M')} - len(regexp_extract_all(cigar, '\\d+[ID]')) * 5 - {_sum('cigar', 'ID')} * 2) AS score FROM aln) WINDOW w AS (PARTITION BY qname ORDER BY score DESC, rec_no)) WHERE n = 1""")
_add("uniqcmp", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN b.qname IS NULL THEN CASE WHEN a.mapq >= 10 THEN 'second_missing_high' ELSE 'second_missing_low' END
    WHEN a.qname IS NULL THEN CASE WHEN b.mapq >= 10 THEN 'first_missing_high' ELSE 'first_missing_low' END
    WHEN a.mapq >= 10 OR b.mapq >= 10 THEN CASE WHEN (a.flag & 16) = (b.flag & 16) AND a.tid = b.tid AND abs(a.pos - b.pos) < 100 THEN 'consistent_' ELSE 'inconsistent_' END
      || CASE WHEN a.mapq >= 10 AND b.mapq >= 10 THEN 'high_high' WHEN a.mapq >= 10 THEN 'high_low' ELSE 'low_high' END END AS bucket
  FROM (SELECT * FROM aln WHERE m = 2) a FULL JOIN (SELECT * FROM run2 WHERE m = 2) b ON a.qname = b.qname) WHERE bucket IS NOT NULL GROUP BY bucket""", "run2")
_add("rg_library", "SELECT rg, lib AS lb, count(*) AS n FROM aln GROUP BY rg, lib")
_add("seq_orientations", f"SELECT qname, m, md5({_revcomp('seq')}) AS revcomp, md5(translate(seq, 'ACGT', 'TGCA')) AS comp, md5(reverse(seq)) AS rev FROM aln")
_add("md5_refs", "SELECT tid, rname, len, NULL AS m5 FROM refs WHERE tid IN (SELECT tid FROM aln) UNION ALL SELECT (SELECT max(tid) FROM refs WHERE tid IN (SELECT tid FROM aln)) + 1 + sp_id, name, length(bases), upper(md5(upper(bases))) FROM specials")
_add("fasta_slice", "SELECT qname, m, substring(bases, pos + 1, 20) AS bases FROM aln JOIN refs ON refs.tid = aln.tid")
_add("kmer_index", "SELECT kmer, count(*) AS n, min(place) AS first FROM rk GROUP BY kmer", "rk")
_add("seed_regions", "SELECT * FROM runs", "runs")
_add("best_seed", """SELECT read, query_begin, length, count(*) AS num_pos, min(struct_pack(a := ref, b := ref_begin)).a AS ref, min(struct_pack(a := ref, b := ref_begin)).b AS ref_begin
FROM (SELECT *, dense_rank() OVER (PARTITION BY read ORDER BY length DESC, query_begin) AS place FROM runs) WHERE place = 1 GROUP BY read, query_begin, length""", "runs")
_add("seed_cover", "SELECT a.read, max(a.length + b.length - greatest(0, a.query_begin + a.length - b.query_begin)) AS covered FROM runs a JOIN runs b ON a.read = b.read AND a.query_begin < b.query_begin GROUP BY a.read", "runs")
_add("search_window", f"""SELECT qname, b AS "begin", e AS "end", md5(substring(bases, b + 1, e - b + 1)) AS window_md5,
  md5(CASE WHEN (tflag & 16) <> 0 THEN CASE WHEN up THEN seq ELSE {_revcomp('seq')} END ELSE CASE WHEN up THEN {_revcomp('seq')} ELSE seq END END) AS query_md5
FROM (SELECT *, piv - least(piv, 250) AS b, least(piv + 250, len - 1) AS e FROM (
  SELECT t.qname, (a.flag & 16) = 0 AS up, greatest(0, CASE WHEN (a.flag & 16) = 0 THEN a.pos + 300 ELSE a.pos - 300 END) AS piv, r.len, r.bases, x.seq, x.flag AS tflag
  FROM typed t JOIN aln a ON a.rec_no = t.anchor_no JOIN aln x ON x.rec_no = t.target_no JOIN refs r ON r.tid = a.tid WHERE pair_type IN ('unique_orphan', 'unique_soft', 'unique_poor'))) WHERE e >= b""", "typed")
_add("best_event", "SELECT pair_id, m, covered FROM (SELECT pair_id, m, mapq AS covered, row_number() OVER (PARTITION BY pair_id ORDER BY mapq DESC, m DESC) AS n FROM aln) WHERE n = 1")
_add("sam_text", "SELECT value FROM sam", "sam")
_add("sam_parsed", "SELECT qname, flag, tid, pos, mapq, cigar, mtid, mpos, isize, rg FROM (SELECT * REPLACE (CASE WHEN cigar = '*' AND tid >= 0 THEN flag | 4 ELSE flag END AS flag) FROM aln)")
_add("flag_letters", "SELECT flag, " + " || ".join(f"CASE WHEN (flag & {1 << i}) <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate("pPuUrR12sfd")) + " AS letters, count(*) AS n FROM aln GROUP BY flag")
_add("bed", f"SELECT rname AS chrom, pos AS \"begin\", {_end()} AS \"end\", qname AS name, mapq AS score, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand FROM aln JOIN refs ON refs.tid = aln.tid WHERE (flag & 4) = 0")
_add("fastq", f"SELECT qname || CASE m WHEN 1 THEN '/1' ELSE '/2' END AS name, CASE WHEN (flag & 16) <> 0 THEN {_revcomp('seq')} ELSE seq END AS seq FROM aln")
_add("tagview", "SELECT qname, flag, rg AS value FROM aln")
_add("header_merge", "SELECT 'RG' AS type, a.rg AS key, a.lib AS lb, b.s AS sm FROM (SELECT DISTINCT rg, lib FROM aln) a LEFT JOIN (SELECT DISTINCT rg, 'sample' AS s FROM run2) b ON a.rg = b.rg", "run2")
_add("solexa_rescale", "SELECT rec_no % 70 + 35 AS quality, CAST(least(floor(10 * log10(1 + pow(10.0, (rec_no % 70 + 35 - 64) / 10.0)) + 0.499), 93) AS BIGINT) AS phred, count(*) AS n FROM aln GROUP BY ALL")
_add("simulator_eval", """SELECT class, CAST(sum(wrong) OVER w AS BIGINT) AS wrong, CAST(sum(n) OVER w AS BIGINT) AS total FROM (SELECT a.mapq // 10 AS class, count(*) AS n, count(*) FILTER (abs(a.pos - b.pos) > 2) AS wrong
FROM aln a JOIN run2 b ON a.rec_no = b.rec_no WHERE (a.flag & 4) = 0 GROUP BY ALL) WINDOW w AS (ORDER BY class DESC)""", "run2")

_GT = [(i, j) for i in range(4) for j in range(i, 4)]
_LK = [" + ".join([f"e{b}" for b in range(4) if b not in (i, j)] + ([f"(c{i} + c{j}) * 3010338"] if i != j else [])) for i, j in _GT]
_CALL = ", ".join(f"struct_pack(v := CAST(least(255, ({x} - low + 500000) // 1000000) + {0 if i == j else 27} AS BIGINT), g := {4 * i + j}, bits := {(1 << i) | (1 << j)})" for x, (i, j) in zip(_LK, _GT, strict=True))
_EVIDENCE = f"""
    SELECT tid, pos, {", ".join(f"CAST(coalesce(sum(part) FILTER (code = {b}), 0) AS BIGINT) AS e{b}, count(part) FILTER (code = {b}) AS c{b}" for b in range(4))},
           CAST(floor(sqrt(CAST(sum(least(mapq, 60) * least(mapq, 60)) AS DOUBLE) / count(*)) + 0.499) AS BIGINT) AS rms_q, count(*) AS depth
    FROM (SELECT *, CASE WHEN q > 0 AND code >= 0 THEN CAST(round((pow(0.85, least(row_number() OVER (PARTITION BY tid, pos, code, reverse ORDER BY q DESC, baseq DESC, mapq DESC, rec_no) - 1, 255)) * (1 - 0.03) + 0.03) * q * 1000000) AS BIGINT) END AS part
      FROM (SELECT *, instr('ACGT', upper(base)) - 1 AS code, CASE WHEN least(baseq, mapq) < 4 AND baseq <> 0 THEN 4 ELSE least(baseq, mapq) END AS q FROM elem WHERE NOT deleted)) GROUP BY tid, pos"""
_add("consensus_call", f"""SELECT tid, pos, substring('NACMGRSVTWYHKDBN', b[1].bits + 1, 1) AS cons, least(b[2].v - b[1].v, 255) AS cons_q, substring('NACMGRSVTWYHKDBN', b[2].bits + 1, 1) AS second, rms_q, depth
FROM (SELECT tid, pos, rms_q, depth, list_sort([{_CALL}]) AS b FROM (SELECT *, least({", ".join(_LK)}) AS low FROM ({_EVIDENCE})))""", "elem")

_add("likelihood_records", f"""SELECT tid, pos, pos - coalesce(lag(pos) OVER (PARTITION BY tid ORDER BY pos), 0) AS "offset", depth, rms_q, CAST(least(255, (low + 500000) // 1000000) AS BIGINT) AS min_lk,
  concat_ws(',', {", ".join(f"CAST(least(255, ({x} - low + 500000) // 1000000) AS BIGINT)" for x in _LK)}) AS lk FROM (SELECT *, least({", ".join(_LK)}) AS low FROM ({_EVIDENCE}))""", "elem")

_add("region_join", f"""SELECT g.region, count(*) AS n, min(a.rec_no) AS first, max(a.rec_no) AS last FROM aln a
  JOIN (SELECT rec_no AS region, mtid, greatest(mpos - 20, 0) AS b, mpos + 20 AS e FROM aln WHERE mtid >= 0 AND rec_no % 7 = 0) g
  ON a.tid = g.mtid AND a.pos < g.e AND greatest({_end("a.pos", "a.cigar")}, a.pos + 1) > g.b WHERE a.tid >= 0 GROUP BY g.region""")
_add("site_depths", """SELECT s.tid, s.pos, s.n_gaps, count(*) AS depth FROM
  (SELECT tid, pos, max(CASE WHEN rec_no % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_gaps FROM aln WHERE tid >= 0 AND rec_no % 3 = 0 AND rec_no % 5 <> 0 GROUP BY tid, pos) s
  JOIN elem e ON e.tid = s.tid AND e.pos = s.pos GROUP BY s.tid, s.pos, s.n_gaps""", "elem")
_add("show_alen", f"SELECT qname, m, CAST({_sum('cigar', 'MI')} AS BIGINT) AS alen FROM aln")
_add("query_positions", """SELECT qname, m, CAST(CASE WHEN t < 0 THEN head WHEN t >= span THEN stop WHEN t < one THEN head + t WHEN t < two THEN head + one ELSE head + t - two + one + put END AS BIGINT) AS qpos,
    CAST(pos + CASE WHEN t < 0 THEN 0 WHEN t >= span THEN span WHEN t >= one AND t < two THEN one ELSE t END AS BIGINT) AS at_left,
    CAST(pos + CASE WHEN t < 0 THEN 0 WHEN t >= span THEN span WHEN t >= one AND t < two THEN two ELSE t END AS BIGINT) AS at_right
  FROM (SELECT *, rec_no % 130 - 5 AS t,
          CASE cigar WHEN '10S90M' THEN 10 WHEN '30S70M' THEN 30 ELSE 0 END AS head,
          CASE cigar WHEN '60M2I38M' THEN 98 WHEN '50M3D50M' THEN 103 WHEN '10S90M' THEN 90 WHEN '95M5S' THEN 95 WHEN '40M20N60M' THEN 120 WHEN '30S70M' THEN 70 ELSE 100 END AS span,
          CASE cigar WHEN '95M5S' THEN 95 ELSE 100 END AS stop,
          CASE cigar WHEN '60M2I38M' THEN 60 WHEN '50M3D50M' THEN 50 WHEN '40M20N60M' THEN 40 ELSE 1000 END AS one,
          CASE cigar WHEN '60M2I38M' THEN 60 WHEN '50M3D50M' THEN 53 WHEN '40M20N60M' THEN 60 ELSE 1000 END AS two,
          CASE cigar WHEN '60M2I38M' THEN 2 ELSE 0 END AS put FROM aln WHERE tid >= 0 AND cigar <> '*')""")
_add("colour_space", """SELECT qname, m, md5(array_to_string(list_transform(range(1, length(seq)), lambda i: CAST(xor(strpos('ACGT', seq[i]) - 1, strpos('ACGT', seq[i + 1]) - 1) AS VARCHAR)), '')) AS colours_md5 FROM aln""")
_add("well_mapped_pairs", """SELECT m.qname, m.first, m.second FROM mates m JOIN aln a ON a.rec_no = m.first JOIN aln b ON b.rec_no = m.second
  WHERE (a.flag & 4) = 0 AND (b.flag & 4) = 0 AND a.mapq >= 20 AND b.mapq >= 20""", "cand", "mates")

ORACLE_SQL["nm_md"] = _with("mdnm", reads="placed") + "SELECT * FROM mdnm"
ORACLE_SQL["calmd_masks"] = _with("mdnm", reads="placed") + """SELECT m.qname, m.m, md5(string_agg(CASE WHEN same AND nm >= 5 THEN 'N' WHEN same THEN '=' ELSE base END, '' ORDER BY place)) AS seq_md5,
    md5(string_agg(CASE WHEN same AND nm >= 5 THEN '!' ELSE 'I' END, '' ORDER BY place)) AS qual_md5
  FROM (SELECT o.rec_no, o.query_off + o.j AS place, substring(o.seq, o.query_off + o.j + 1, 1) AS base, o.op = 'M' AND substring(r.bases, o.pos + o.ref_off + o.j + 1, 1) = substring(o.seq, o.query_off + o.j + 1, 1) AS same
    FROM (SELECT *, unnest(range(len)) AS j FROM ops WHERE op IN ('M', 'I', 'S')) o JOIN refs r ON r.tid = o.tid) b JOIN mdnm m ON m.rec_no = b.rec_no GROUP BY m.rec_no, m.qname, m.m"""

_CTE["hits"] = "hits AS (SELECT a.*, replace(r.rname, ' ', '_') AS rname, a.rec_no % 3 AS n, (a.flag & 16) <> 0 AS back FROM aln a JOIN refs r ON r.tid = a.tid WHERE a.cigar = '100M')"
_add("from_bowtie", """SELECT qname, CAST(CASE WHEN back THEN 16 ELSE 0 END AS BIGINT) AS flag, rname, pos, CAST(CASE WHEN n = 0 THEN 25 ELSE 0 END AS BIGINT) AS mapq, cigar, md5(seq) AS seq_md5,
  CASE WHEN n = 0 THEN '0' ELSE '1' END AS nm, CASE WHEN n = 0 THEN '100' ELSE '7C23T68' END AS md FROM hits""", "hits")
_add("from_zoom", """SELECT qname, CAST(3 + CASE WHEN m = 1 THEN 64 ELSE 128 END + CASE WHEN (m = 1) = back THEN 16 ELSE 0 END AS BIGINT) AS flag, rname, pos, CAST(30 AS BIGINT) AS mapq, cigar,
  CAST(NULL AS VARCHAR) AS seq_md5, CAST(n AS VARCHAR) AS nm, CAST(NULL AS VARCHAR) AS md FROM hits""", "hits")
_add("from_novoalign", f"""SELECT qname, CAST(3 + CASE WHEN m = 1 THEN 64 ELSE 128 END + CASE WHEN back THEN 16 ELSE 0 END AS BIGINT) AS flag, rname, pos, greatest(mapq, 30) AS mapq,
  CASE WHEN n = 2 THEN '3M2D44M2I51M' ELSE cigar END AS cigar, md5(CASE WHEN back THEN {_revcomp("seq")} ELSE seq END) AS seq_md5, ['0', '2', '4'][n + 1] AS nm, ['100', '6A23G69', '3^GT0A94'][n + 1] AS md
  FROM hits WHERE rec_no % 11 <> 0""", "hits")
_add("first_base_calls", """SELECT e.tid, e.pos, substring(r.bases, e.pos + 1, 1) AS ref, coalesce(upper(base), 'N') AS cons, baseq AS cons_q, least(mapq, 60) AS rms_q, depth
  FROM (SELECT *, count(*) OVER (PARTITION BY tid, pos) AS depth, row_number() OVER (PARTITION BY tid, pos ORDER BY rec_no) AS k FROM elem) e JOIN refs r ON r.tid = e.tid WHERE k = 1""", "elem")
_add("frag_mode_counts", "SELECT rg, count(*) FILTER (pair_mode IN (1, 5)) AS valid, count(*) FILTER (pair_mode NOT IN (1, 5)) AS invalid FROM modes GROUP BY rg", "modes")

_CTE["named"] = """named AS (SELECT tid AS n, replace(rname, ' ', '_') AS rname, bases FROM refs UNION ALL SELECT sp_id + 1000, name, bases FROM specials)"""
_add("fasta_index", """SELECT rname, CAST(size AS BIGINT) AS length, CAST(sum(bytes) OVER (ORDER BY n) - bytes + head AS BIGINT) AS "offset", CAST(least(60, size) AS BIGINT) AS line_blen, CAST(least(60, size) + 1 AS BIGINT) AS line_len
  FROM (SELECT *, head + size + (size + 59) // 60 AS bytes FROM (SELECT n, rname, length(bases) AS size, length('>' || rname || ' number ' || n) + 1 AS head FROM named))""", "named")
_add("fasta_fetch", f"""SELECT a.rec_no, md5(substring(r.bases, greatest(a.pos - 10, 0) + 1, CAST(least({_end("a.pos", "a.cigar")} + 10, r.len) - greatest(a.pos - 10, 0) AS BIGINT))) AS bases_md5
  FROM aln a JOIN refs r ON r.tid = a.tid WHERE a.cigar <> '*' AND a.rec_no % 7 = 0""")
_add("consensus_rows", f"""SELECT k.tid, k.pos, k.ref, k.cons, k.cons_q, CASE WHEN k.cons IN ('N', k.ref) THEN 0 WHEN k.second = k.ref THEN k.cons_q ELSE least(255, k.cons_q + k.next_q) END AS snp_q, k.rms_q, k.depth
FROM (SELECT c.tid, c.pos, substring(r.bases, c.pos + 1, 1) AS ref, substring('NACMGRSVTWYHKDBN', b[1].bits + 1, 1) AS cons, least(b[2].v - b[1].v, 255) AS cons_q, substring('NACMGRSVTWYHKDBN', b[2].bits + 1, 1) AS second, least(b[3].v - b[2].v, 255) AS next_q, rms_q, depth
  FROM (SELECT tid, pos, rms_q, depth, list_sort([{_CALL}]) AS b FROM (SELECT *, least({", ".join(_LK)}) AS low FROM ({_EVIDENCE}))) c JOIN refs r ON r.tid = c.tid) k""", "elem")

_TOLD = """CASE WHEN b.pair_id IS NULL THEN 0 WHEN NOT b.here THEN 8 WHEN b.back THEN 32 ELSE 0 END"""
_MATE = """CASE WHEN NOT coalesce(b.here, false) THEN '*' WHEN b.name = a.name THEN '=' ELSE b.name END AS mrname, CASE WHEN b.here THEN b.pos ELSE -1 END AS mpos,
  CAST(CASE WHEN b.here AND b.name = a.name THEN b.five - a.five ELSE 0 END AS BIGINT) AS isize"""
_CTE["soap"] = "soap AS (SELECT *, rname AS name, true AS here, pos + CASE WHEN back THEN 100 ELSE 0 END AS five FROM hits)"
_NEEDS["soap"] = ["hits"]
_add("from_soap", f"""SELECT a.qname, CAST(3 + CASE WHEN a.m = 1 THEN 64 ELSE 128 END + CASE WHEN a.back THEN 16 ELSE 0 END + {_TOLD} AS BIGINT) AS flag, a.name AS rname, a.pos, CAST(CASE WHEN a.n = 0 THEN 30 ELSE 0 END AS BIGINT) AS mapq, a.cigar, {_MATE},
  md5(a.seq) AS seq_md5, md5(repeat('I', 100)) AS qual_md5, CASE WHEN a.n = 0 THEN '0' ELSE '2' END AS nm, CASE WHEN a.n = 0 THEN '100' ELSE '7A23G68' END AS md
  FROM soap a LEFT JOIN soap b ON b.pair_id = a.pair_id AND b.m <> a.m""", "soap")
_CTE["export"] = """export AS (SELECT a.*, (a.flag & 4) = 0 AS here, (a.flag & 16) <> 0 AS back, CAST(a.rec_no % 4 AS INT) AS n, CASE WHEN (a.flag & 4) = 0 THEN replace(r.rname, ' ', '_') || CASE WHEN a.pair_id % 3 = 0 THEN '/c1' ELSE '' END ELSE '*' END AS name,
  a.pos + CASE WHEN (a.flag & 20) = 16 THEN 100 ELSE 0 END AS five FROM aln a LEFT JOIN refs r ON r.tid = a.tid WHERE a.rec_no % 13 <> 0)"""
_add("from_gerald", f"""SELECT a.qname || ':1:20:3:4' AS qname, CAST(1 + CASE WHEN a.m = 1 THEN 64 ELSE 128 END + CASE WHEN NOT a.here THEN 4 ELSE CASE WHEN a.back THEN 16 ELSE 0 END + CASE WHEN a.n <> 0 THEN 2 ELSE 0 END END + {_TOLD} AS BIGINT) AS flag,
  a.name AS rname, CASE WHEN a.here THEN a.pos ELSE -1 END AS pos, CASE WHEN NOT a.here THEN 0 WHEN a.n = 0 THEN a.mapq ELSE a.mapq + 5 END AS mapq,
  CASE WHEN NOT a.here THEN '*' WHEN a.back THEN ['100M', '100M', '60M2D40M', '67M3I30M'][a.n + 1] ELSE ['100M', '100M', '40M2D60M', '30M3I67M'][a.n + 1] END AS cigar, {_MATE},
  md5(CASE WHEN a.back THEN {_revcomp("a.seq")} ELSE a.seq END) AS seq_md5, md5(CASE WHEN a.back THEN repeat('#', 40) || repeat('I', 60) ELSE repeat('I', 60) || repeat('#', 40) END) AS qual_md5,
  CASE WHEN a.h % 3 = 0 THEN 'ACGT' END AS bc, CASE WHEN NOT a.here THEN NULL WHEN a.back THEN ['100', '92T7', '60^GT$40', '46A20^3$30'][a.n + 1] ELSE ['100', '7A92', '40^AC$60', '30^3$20T46'][a.n + 1] END AS xd,
  CASE WHEN a.here THEN CAST(a.mapq AS VARCHAR) END AS sm, CASE WHEN a.here AND a.n <> 0 THEN CAST(a.mapq + 5 AS VARCHAR) END AS "as", CASE WHEN NOT a.here AND a.pair_id % 2 = 0 THEN '3' END AS h0, CASE WHEN NOT a.here AND a.pair_id % 2 = 0 THEN '1' END AS h2
  FROM export a LEFT JOIN export b ON b.pair_id = a.pair_id AND b.m <> a.m""", "export")
_add("from_blast", f"""SELECT qname || '/' || m AS qname, CAST(CASE WHEN back THEN 16 ELSE 0 END AS BIGINT) AS flag, rname, pos, CAST(255 AS BIGINT) AS mapq,
  CASE WHEN back THEN ['5H90M5H', '5H60M2D30M5H', '5H17M3I70M5H'][CAST(n AS INT) + 1] ELSE ['5H90M5H', '5H30M2D60M5H', '5H70M3I17M5H'][CAST(n AS INT) + 1] END AS cigar,
  md5(CASE WHEN back THEN {_revcomp("substring(seq, 6, 90)")} ELSE substring(seq, 6, 90) END) AS seq_md5, CAST(mapq + 1 AS VARCHAR) AS score, CASE WHEN n = 0 THEN '1e-10' ELSE '2e-05' END AS expect FROM hits
  UNION ALL SELECT qname || '/' || m, 0, rname, 6, 255, '4M96H', md5('AAAA'), '20', '0.5' FROM hits WHERE pair_id % 5 = 0""", "hits")
_add("called_sites", "SELECT tid, pos, count(*) AS depth, count(*) FILTER (deleted) AS deleted, CAST(sum(baseq) AS BIGINT) AS quality FROM elem GROUP BY tid, pos", "elem")
_add("called_regions", f"""SELECT g.pair_id AS region, count(*) AS n, CAST(sum(a.mapq) AS BIGINT) AS mapq FROM aln g JOIN aln a ON a.tid = g.tid AND a.pos < g.pos + 120 AND greatest({_end("a.pos", "a.cigar")}, a.pos + 1) > g.pos - 20
  WHERE g.m = 1 AND g.tid >= 0 AND g.pair_id % 16 = 0 GROUP BY g.pair_id""")
