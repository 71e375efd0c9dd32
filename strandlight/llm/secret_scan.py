"""Secret scan: keyword prefilter, anchored expressions near its hits, checksum validation.

An Aho-Corasick automaton passes each text once and marks where a keyword or a token prefix
stands. Only there are the expressions tried, anchored at the hit. Tokens whose last six characters
are a base-62 CRC-32 of the body are reported only if that checksum holds. Runs of hexadecimal
digits have no keyword; one linear expression finds them.

Defined results: null and empty texts have no spans; a row's spans are those of its whole text
whatever its length; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = ("assign", "access", "hex")
#: Keywords of assignments.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
#: Token prefixes, each followed by 30 characters of body and 6 of checksum.
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
MIN_VALUE, MIN_ACCESS, MIN_HEX, BODY, SUM = 12, 18, 16, 30, 6
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CHECKED = re.compile(r"[A-Za-z0-9]+")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in (*ASSIGN_WORDS, ACCESS_PREFIX.lower(), *CHECKED_PREFIXES):
        found.add_word(word, word)
    found.make_automaton()
    return found


def base62_checksum(body: str) -> str:
    value, digits = zlib.crc32(body.encode("ascii")), ""
    while value:
        value, digit = divmod(value, 62)
        digits = ALPHABET[digit] + digits
    return digits.rjust(SUM, "0")


def lower_ascii(text: str) -> str:
    """``text`` with A-Z lowered and each other code point in its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans_of(text: str | None, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    hits: dict[str, list[int]] = {}
    for end, word in words.iter(lower_ascii(text)):
        kind = CHECKED_PREFIXES.get(word) or ("access" if word == "akia" else "assign")
        hits.setdefault(kind, []).append(end - len(word) + 1)
    out = []
    for kind, starts in hits.items():
        over = 0
        for start in sorted(set(starts)):
            if start < over:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, start):
                    over = m.end()
                    if len(m[2]) >= MIN_VALUE:
                        out.append((start, over, kind))
            elif kind == "access":
                if m := _ACCESS.match(text, start):
                    over = m.end()
                    if over - start >= MIN_ACCESS:
                        out.append((start, over, kind))
            elif text[start : start + 4] in CHECKED_PREFIXES and (m := _CHECKED.match(text, start + 4)) and len(m[0]) == BODY + SUM:
                over = m.end()
                if base62_checksum(m[0][:BODY]) == m[0][BODY:]:
                    out.append((start, over, kind))
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``spans`` array<struct<kind,start,end>>."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in rows:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, words)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "spans"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
