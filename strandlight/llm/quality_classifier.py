"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Each hashed word has a sparse random index vector (four entries of plus or minus one). Passing over all
documents, every word's context vector gathers the index vectors of its neighbours within two words.
A document is the mean and the spread of its words' context vectors. A two-layer network learns the label
from a bounded sample of labelled rows, and a temperature fitted on a part of them that the network has
not seen makes its outputs probabilities.

Defined results: null and empty texts have zero vectors and so the score of such a vector; scores cover whole
texts; without labelled rows every score is the neutral 0.5; repeated rows give repeated results; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import STRETCH, batches, labelled, summed

#: Hashed words (a power of two); vectors have STRETCH entries.
SLOTS, DIMENSIONS, ENTRIES, WINDOW = 1 << 14, STRETCH, 4, 2
#: The network learns from at most this many labelled rows.
MAX_LABELLED = 8000
HIDDEN, STEPS, RATE, DECAY, SEED = 32, 1500, 0.01, 1e-4, 11


@dataclass
class QualityModel:
    words: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (SLOTS, ENTRIES)), rng.choice([-1.0, 1.0], (SLOTS, ENTRIES))


def slots(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(SLOTS - 1)).astype(np.int64)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts' words, and the text that each stands in."""
    parts = [slots(t) for t in texts]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vector of each slot, gathered from all documents."""
    at, sign = index_vectors()

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        texts = batch.column(0).to_pylist()
        for a, b in batches(texts):
            word, doc = joined(texts[a:b])
            for step in range(1, WINDOW + 1):
                near = doc[:-step] == doc[step:]
                left, right = word[:-step][near], word[step:][near]
                for x, y in ((left, right), (right, left)):
                    for e in range(ENTRIES):
                        total += np.bincount(x * DIMENSIONS + at[y, e], sign[y, e], len(total))

    table = summed(docs.select(F.col(text_col).alias("text")), SLOTS * DIMENSIONS, add).reshape(SLOTS, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], words: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors."""
    word, doc = joined(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    if len(word):
        vectors = words[word]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        n = np.diff(np.r_[first, len(doc)])[:, None]
        mean = np.add.reduceat(vectors, first, dtype=np.float64) / n
        square = np.add.reduceat(vectors * vectors, first, dtype=np.float64) / n
        out[doc[first]] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    return out


def logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    a, b, c, d = layers
    return (np.tanh(x @ a + b) @ c + d)[:, 0]


def train(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Layers by Adam on four fifths of the rows, temperature on the rest."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, STEPS + 1):
        part = rng.choice(used, min(256, len(used)))
        h = np.tanh(x[part] @ layers[0] + layers[1])
        out = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30))) - y[part, None]) / len(part)
        back = (out @ layers[2].T) * (1 - h * h)
        for k, g in enumerate((x[part].T @ back + DECAY * layers[0], back.sum(0), h.T @ out + DECAY * layers[2], out.sum(0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (1 - step / STEPS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if not len(held):
        return layers, 1.0
    z, t = logits(x[held], layers), y[held]
    loss = {c: np.mean(np.logaddexp(0, z / c) - t * z / c) for c in np.geomspace(0.25, 8, 61)}
    return layers, float(min(loss, key=loss.get))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    words = contexts(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(2).to_pylist()
            found = [r.tobytes() for a, b in batches(texts) for r in pooled(texts[a:b], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.float64()), pa.array(found, pa.binary())], names=["id", "label", "x"])

    sample = labelled(docs, labels, label, modulus, held, MAX_LABELLED, True, id_col, text_col)
    got = sample.mapInArrow(features, f"id {sample.schema['id'].dataType.simpleString()}, label double, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["id"], bytes(r["x"])))
    x, y = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in got]).astype(np.float64), np.array([r["label"] for r in got])
    mean, spread = x.mean(0), x.std(0) + 1e-3
    layers, temperature = train((x - mean) / spread, y)
    return QualityModel(words, mean, spread, layers, temperature)


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in batches(texts):
                z = logits((pooled(texts[a:b], m.words) - m.mean) / m.spread, m.layers) / m.temperature if m else np.zeros(b - a)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())], names=["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
