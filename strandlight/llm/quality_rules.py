"""Quality rules: fixed counts, then divergence from the references of a language.

A first pass over all documents builds, for each language, the distribution of character classes and
the counts of words; the most common words of a language make its word histogram. A document's own
histograms are held against the reference of its language by Jensen-Shannon distance (base 2, so from
0 to 1). A document under ``MIN_WORDS`` words, too short for its histograms to mean anything, is left to
the base rules. The same guard holds for references: a language of fewer than ``REFERENCE_WORDS`` words has none of its
own, and its rows, like those without a language, use the reference counted over all documents.

Defined results: a null or empty text has counts of 0 and fails the base rule (under 50 words); every
row gets one result, from its whole text, null ids too; repeated rows give repeated results; of equally common words the
smaller by bytes comes first; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.llm.common import checkpointed

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Reference size: common words of a language; words under which a language has no reference of its own.
COMMON_WORDS, REFERENCE_WORDS = 50, 5_000
#: Greatest Jensen-Shannon distances of a kept document.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.45
#: The counted characters.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
CLASSES = ("lower", "upper", "letter", "digit", "space", "line", "stop", "punctuation", "symbol", "other")
_FLUSH = 200_000


def class_table() -> np.ndarray:
    """Class number of each code point."""
    import unicodedata

    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    by = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "letter", "Lm": "letter", "Mn": "letter", "Mc": "letter", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "space"}
    by |= {c: "punctuation" for c in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")} | {c: "symbol" for c in ("Sm", "Sc", "Sk", "So")}
    for code in range(0x110000):
        if name := by.get(unicodedata.category(chr(code))):
            table[code] = CLASSES.index(name)
    for chars, name in ((SPACES, "space"), ("\n\r", "line"), (".,", "stop"), (SYMBOLS, "symbol")):
        for c in chars:
            table[ord(c)] = CLASSES.index(name)
    return table


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    return np.bincount(_TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=len(CLASSES))


def words_of(text: str) -> list[bytes]:
    """The contract's words, as UTF-8: bytes.split() cuts at the same six ASCII characters."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] >= 2
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeats += line in seen
            seen.add(line)
    return repeats


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a = np.sum(p * np.log2(np.where(p > 0, p / np.where(m > 0, m, 1), 1)))
    b = np.sum(q * np.log2(np.where(q > 0, q / np.where(m > 0, m, 1), 1)))
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def normal(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?")


#: A reference: class counts, place of each common word, word counts with all other words last.
Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str | None, Reference]:
    """The reference of each language and, under None, that of all documents.

    Counted over all documents; what comes to the driver is COMMON_WORDS words and the class counts of each language
    that has a reference.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = defaultdict(Counter)
        classes: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

        def flush() -> pa.RecordBatch:
            out = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
            out += [(lang, None, k, int(n)) for lang, c in classes.items() for k, n in enumerate(c) if n]
            words.clear()
            classes.clear()
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["lang", "word", "class", "n"])

        for batch in rows:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    words[lang].update(map(normal, words_of(text)))
                    classes[lang] += class_counts(text)
                    if sum(map(len, words.values())) > _FLUSH:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = checkpointed(rows.mapInArrow(count, "lang string, word binary, class int, n bigint").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    total = F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    own = counted.where("lang IS NOT NULL")
    large = own.groupBy("lang").agg(total.alias("total")).where(F.col("total") >= REFERENCE_WORDS)
    every = counted.groupBy("word", "class").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "class", "n", F.lit(counted.agg(total).first()[0] or 0).cast("long").alias("total"))
    both = own.join(large, "lang").select("lang", "word", "class", "n", "total").unionByName(every)
    order = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.desc("n"), "word", "class")
    top = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON_WORDS)
    by: dict[str | None, list] = defaultdict(list)
    for r in top.collect():
        by[r["lang"]].append(r)
    return {lang: reference(found) for lang, found in by.items()}


def reference(rows: list) -> Reference:
    classes = np.zeros(len(CLASSES))
    for r in rows:
        if r["class"] is not None:
            classes[r["class"]] = r["n"]
    words = sorted(((r["rank"], bytes(r["word"]), r["n"]) for r in rows if r["word"] is not None), key=lambda x: x[0])
    common = np.array([n for _, _, n in words] + [rows[0]["total"] - sum(n for _, _, n in words)], float)
    return classes, {w: k for k, (_, w, _) in enumerate(words)}, common


def judge(text: str | None, lang: str | None, known: dict) -> tuple:
    """Counts, base verdict, distances (nan where guarded) and verdict of one text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    by_class = by_word = float("nan")
    if n >= MIN_WORDS and (ref := known.get(lang) or known.get(None)):
        by_class = divergence(class_counts(text), ref[0])
        own = np.bincount([ref[1].get(normal(w), len(ref[2]) - 1) for w in words], minlength=len(ref[2]))
        by_word = divergence(own, ref[2])
    kept = not failed and not by_class > MAX_CLASS_DISTANCE and not by_word > MAX_WORD_DISTANCE
    return n, chars, symbols, duplicate_lines(text), repeats, failed, kept, by_class, by_word


def apply_rules(docs: DataFrame, known: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in rows:
            found = [judge(t, g, refs) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=["id", *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    types = ["bigint"] * 5 + ["boolean"] * 2 + ["double"] * 2
    schema = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
