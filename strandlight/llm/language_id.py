"""Language identification with a string kernel.

A document is its set of character n-grams of one to three characters (the blended spectrum; presence,
not counts), hashed into a fixed number of slots. The kernel of two documents is the number of shared
slots over the root of the product of their set sizes. A bounded sample of labelled rows gives the
Nyström landmarks and a one-versus-rest ridge regression on them; scoring is two products of matrices
for a batch of documents: presence by landmarks, kernel values by weights.

Defined results: a null text or one without a letter is ``und`` with score 0; every other text gets a
learned language from its whole length; where nothing is labelled every text is ``und``; an empty
table gives an empty table; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.llm.common import batches

UNKNOWN = "und"
#: Slots of the hashed n-grams (a power of two), the n-gram lengths.
SLOTS, ORDERS = 1 << 14, (1, 2, 3)
#: Bounds of the fit: labelled rows and landmarks for each language; where rows of all languages would pass MAX_SAMPLE each
#: language has fewer, but LEAST_PER_LANGUAGE at least, so that no language is left unlearned.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, MAX_SAMPLE, LEAST_PER_LANGUAGE = 300, 32, 30_000, 8
RIDGE, SHARPNESS = 0.1, 4.0
_MULTIPLIER = np.uint32(2654435761)


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, one row a landmark
    weights: np.ndarray  # landmarks by languages


def presence(texts: list[str | None], slots: int = SLOTS) -> np.ndarray:
    """0/1 matrix, texts by slots."""
    out = np.zeros((len(texts), slots), np.float32)
    flat, shift = out.reshape(-1), np.uint32(32 - int(slots).bit_length() + 1)
    for row, text in enumerate(texts):
        if not text:
            continue
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        gram = np.zeros(len(code), np.uint32)
        for order in ORDERS:
            if len(code) < order:
                break
            gram = (gram[: len(code) - order + 1] * np.uint32(0x01000193)) ^ code[order - 1 :]
            hashed = (gram + np.uint32(order)) * _MULTIPLIER
            hashed ^= hashed >> np.uint32(15)
            flat[row * slots + ((hashed * _MULTIPLIER) >> shift).astype(np.int64)] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    sizes = np.maximum(x.sum(1), 1)[:, None] * np.maximum(landmarks.sum(1), 1)[None, :]
    return (x @ landmarks.T) / np.sqrt(sizes)


def learn(x: np.ndarray, y: list[str], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel:
    """Nyström features of ``x`` on its first rows of each language, then ridge regression."""
    languages = sorted(set(y))
    label = np.array([languages.index(v) for v in y])
    chosen = np.sort(np.concatenate([np.flatnonzero(label == k)[:per_language] for k in range(len(languages))]))
    marks = x[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, marks).astype(np.float64) @ root
    target = np.where(label[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = np.bincount(label, minlength=len(languages)) / len(label)
    weight = (1 / (len(languages) * share[label]))[:, None]
    solved = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (target * weight))
    return KernelModel(languages, np.packbits(marks.astype(bool), axis=1), (root @ solved).astype(np.float32))


def score_batch(x: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its softmax share."""
    margin = kernel(x, marks) @ weights
    e = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
    return margin.argmax(1), e.max(1) / e.sum(1)


def labelled_sample(docs: DataFrame, train: Column, id_col: str, label_col: str) -> list:
    """Ids of training rows of each label, by a hash of the id: as many of each as the bounds allow."""
    rows = docs.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    best = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_PER_LANGUAGE).select("id", "label", "n").collect()
    each = max(LEAST_PER_LANGUAGE, MAX_SAMPLE // max(1, len({r["label"] for r in best})))
    return [r["id"] for r in best if r["n"] <= each]


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """A model of the rows where ``train`` holds and the label isn't null.

    The sample is bounded by SAMPLE_PER_LANGUAGE ids a language and MAX_SAMPLE rows of presence bits, not texts, in all
    (SLOTS / 8 bytes each), or LEAST_PER_LANGUAGE a language where languages are very many.
    """
    ids = labelled_sample(docs, train, id_col, lang_col)
    if not ids:
        return None

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(2).to_pylist()
            packed = [p.tobytes() for a, b in batches(texts) for p in np.packbits(presence(texts[a:b]).astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h", "lang", "bits"])

    wanted = docs.where(F.col(id_col).isin(ids) & train & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    got = wanted.select(F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(bits, "h bigint, lang string, bits binary").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["h"], r["lang"], bytes(r["bits"])))
    x = np.unpackbits(np.stack([np.frombuffer(bytes(r["bits"]), np.uint8) for r in got]), axis=1).astype(np.float32)
    return learn(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id alone by default) with ``lang_pred`` and ``score``."""
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])

    def predict(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        marks = np.unpackbits(known.landmarks, axis=1).astype(np.float32) if known else None
        for batch in rows:
            texts = batch.column(0).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            held = [i for i, t in enumerate(texts) if known and t and any(map(str.isalpha, t))]
            for i in range(0, len(held), 128):
                part = held[i : i + 128]
                best, share = score_batch(presence([texts[k] for k in part]), marks, known.weights)
                for k, b, s in zip(part, best, share, strict=True):
                    lang[k], score[k] = known.languages[b], float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    found = source.mapInArrow(predict, f"{fields}, lang_pred string, score double")
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
