"""Toxic passages as maximum-scoring segments of token log-odds.

Log-odds between toxic and other labelled rows take an informative Dirichlet prior from the counts of all
documents. They are kept for words and for the beginnings of words, so that a compound not seen before
has the odds of its stem; a token takes the most certain of its odds. Odds that could be chance count as
none, and every token pays a small toll so that neutral text scores below zero. A linear scan (all maximal scoring subsequences) finds every passage in
a text. A passage's significance follows the extreme-value law of the best segment of random tokens: its decay is
the positive root of ``E exp(decay * score) = 1`` over the token scores of rows that aren't toxic, and its level, the
logarithm of the law's constant, is the likeliest location of what these rows' best segments exceed the logarithm of
their length by. The sum over significant passages, calibrated by logistic regression, is the probability
that the text is toxic.

Defined results: null and empty texts have no passage and so the score of a text with none; whole texts are
scanned; without labelled rows of both kinds the score is 0; repeated rows give repeated results; equally certain odds of a
token count by the larger; a row of null id is scored but never learned from; an empty table gives an empty table; only
the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import WORD, labelled, summed

SLOTS = 1 << 18
#: The log-odds come from at most this many labelled rows.
MAX_LABELLED = 20_000
PRIOR_WEIGHT, LEAST_Z, TOLL, CLIP = 500.0, 4.0, 0.04, 8.0
#: Lengths of the beginnings of words; distinct words whose weight a task keeps.
STEMS, CACHED = range(3, 9), 200_000
_WORD = re.compile(WORD)
_EDGES = b".,;:!?\"'()[]{}*#$%&|-_"


@dataclass
class ToxicityModel:
    odds: np.ndarray
    z: np.ndarray
    decay: float
    level: float
    slope: float
    intercept: float


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of the whole text, one for each word of the contract, without edge punctuation.

    bytes.split() cuts at the contract's six white-space characters.
    """
    return [w.strip(_EDGES) for w in text.lower().encode("utf-8", "surrogatepass").split()] if text else []


def features(word: bytes) -> list[int]:
    """Slots of a word and of its beginnings, which are counted in characters."""
    if word.isascii():
        parts = [word[:n] + b"^" for n in STEMS if n < len(word)]
    else:
        text = word.decode("utf-8", "replace")
        parts = [text[:n].encode() + b"^" for n in STEMS if n < len(text)]
    return [zlib.crc32(p) & (SLOTS - 1) for p in (word, *parts)]


def tally(words: Counter, total: np.ndarray, offset: int = 0) -> None:
    """Adds the counts of the words' features to ``total`` and clears ``words``."""
    found = [(slot, n) for word, n in words.items() for slot in features(word)]
    if found:
        slots, counts = np.array(found, np.int64).T
        total[offset : offset + SLOTS] += np.bincount(slots, counts, SLOTS)
    words.clear()


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dirichlet-smoothed log-odds of each slot, 0 where they are not certain, and their z-scores."""
    alpha = (prior + toxic + other + 0.01) / (prior + toxic + other + 0.01).sum() * PRIOR_WEIGHT
    a, b = toxic + alpha, other + alpha
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    sure = np.abs(z) >= LEAST_Z
    return np.where(sure, np.clip(odds, -1, CLIP), 0), np.where(sure, z, 0)


class Weights(dict):
    """Weight of a word: its most certain log-odds, less the toll."""

    def __init__(self, odds: np.ndarray, z: np.ndarray):
        self.sure = {int(k): (abs(z[k]), float(odds[k])) for k in np.flatnonzero(z)}

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHED:
            self.clear()
        known = [self.sure[s] for s in features(word) if s in self.sure]
        self[word] = out = (max(known)[1] if known else 0.0) - TOLL
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def maximal_segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of ``w``, by position, in linear time."""
    positive = np.flatnonzero(w > 0)
    if not len(positive):
        return []
    before = np.concatenate([[0.0], np.cumsum(w)])
    first = positive[np.r_[True, np.diff(positive) > 1]]
    last = positive[np.r_[np.diff(positive) > 1, True]] + 1
    held: list[tuple[int, int, float, float, int]] = []  # first, last, left sum, right sum, place of the nearest segment with a smaller left sum
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        left, right = before[a], before[b]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((a, b, left, right, j))
                break
            a, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(r - x)) for a, b, x, r, _ in held]


def strength(segments: list[tuple[int, int, float]], n: int, decay: float, level: float) -> float:
    """Sum of the significances of the passages that chance would give less than once in ``n`` tokens."""
    return sum(max(0.0, decay * s - np.log(max(n, 1)) - level) for _, _, s in segments)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    # texts that hold a word count once each: a text that repeats itself says no more than another
    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        words: Counter = Counter()
        for text in batch.column(0).to_pylist():
            words.update(set(words_of(text)))
            if len(words) > CACHED:
                tally(words, total)
        tally(words, total)

    def by_label(batch: pa.RecordBatch, total: np.ndarray) -> None:
        words: dict[bool, Counter] = {False: Counter(), True: Counter()}
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[y == 1].update(set(words_of(text)))
        for toxic, counts in words.items():
            tally(counts, total, SLOTS * toxic)

    prior = summed(docs.select(F.col(text_col).alias("text")), SLOTS, count)
    sample = labelled(docs, labels, label, modulus, held, MAX_LABELLED, True, id_col, text_col).select("label", "text")
    both = summed(sample, 2 * SLOTS, by_label)
    other, toxic = both[:SLOTS], both[SLOTS:]
    if not toxic.any() or not other.any():
        return None
    odds, z = log_odds(toxic, other, prior)
    shared = docs.sparkSession.sparkContext.broadcast((odds, z))

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*shared.value)
        for batch in rows:
            got = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = weights.of(text)
                values, counts = np.unique(w, return_counts=True)
                got.append((float(y), len(w), [s for _, _, s in maximal_segments(w)], values.tolist(), counts.tolist()))
            kinds = (pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=["y", "n", "scores", "values", "counts"])

    got = sample.mapInArrow(measure, "y double, n bigint, scores array<double>, values array<double>, counts array<bigint>").collect()
    got.sort(key=lambda r: (r["y"], r["n"], r["scores"]))
    tokens: Counter = Counter()
    for r in got:
        if r["y"] != 1:
            tokens.update(dict(zip(r["values"], r["counts"], strict=True)))
    decay = decay_of(np.array(sorted(tokens)), np.array([tokens[v] for v in sorted(tokens)], float))
    best = np.array([decay * max(r["scores"], default=0.0) - np.log(max(r["n"], 1)) for r in got if r["y"] != 1])
    level = gumbel_level(best)
    x = np.log1p([strength([(0, 0, s) for s in r["scores"]], r["n"], decay, level) for r in got])
    slope, intercept = logistic(x, np.array([r["y"] for r in got]))
    return ToxicityModel(odds, z, decay, level, slope, intercept)


def decay_of(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``sum(share * exp(decay * value)) = 1``, by bisection; 1 where there is none.

    There is one root if the mean is negative and some value positive; log-odds with neither chance nor toll have 1.
    """
    if not len(values) or values.max() <= 0 or values @ counts >= 0:
        return 1.0
    share = counts / counts.sum()
    excess = lambda x: float(share @ np.expm1(x * values))
    low, high = 0.0, 1.0
    while excess(high) < 0 and high * values.max() < 500:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def gumbel_level(best: np.ndarray) -> float:
    """Location of the extreme-value law of unit scale of ``best``, by maximum likelihood."""
    return float(-np.log(np.mean(np.exp(-best))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps on the lightly penalised likelihood."""
    design, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``passages`` array<struct<start,end,score>> in code points, significant ones only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m.odds, m.z) if m else None
        for batch in rows:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                found, n = [], 0
                if m and text:
                    w = weights.of(text)
                    n, found = len(w), maximal_segments(w)
                sums = strength(found, n, m.decay, m.level) if m else 0.0
                scores.append(float(1 / (1 + np.exp(-(m.slope * np.log1p(sums) + m.intercept)))) if m else 0.0)
                found = [(a, b, s) for a, b, s in found if m.decay * s > np.log(n) + m.level]
                at = [x.span() for x in _WORD.finditer(text)] if found else []
                passages.append([{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names=["id", "score", "passages"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)
