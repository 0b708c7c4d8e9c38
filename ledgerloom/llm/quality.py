"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

Every word and every word shape has a sparse random index vector that follows from its hash alone.
A word's vector is its index vector plus the summed index vectors of its neighbours in the labelled
sample; words outside the sample's vocabulary are carried by their shape.  A document is the mean
of its words' vectors and shapes with its share of repeats and its length.  A two-layer network in
numpy classifies it; a temperature fitted on rows that the network did not train on calibrates its
probabilities.

The sample is bounded (``TRAIN_ROWS`` documents, whole), and its words are the vocabulary: all that
two of its texts hold.  Every whole text is scored, in one narrow pass.

Defined results: a null text is empty; an empty text has zero vectors and gets the network's score
for that; without labels of both kinds every score is the labelled share of ones (0.5 without any
label); repeated rows are scored again, each on its own row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .labelled import held_out, training_rows

#: Bound of the sample; sizes of the vectors, of the shape table and of the hidden layer.
TRAIN_ROWS = 4_000
SIZE, SHAPES, HIDDEN, REACH = 64, 4096, 32, 2
SEEN_WORDS = 400_000

_UPPER, _LOWER, _NUMBER, _SAME = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\dA-ZÀ-ÖØ-Þ_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Runs of capitals, other letters, digits; signs stand for themselves; repeats once."""
    word = _NUMBER.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
    return _SAME.sub(r"\1", word)


def shape_row(word: str) -> int:
    return zlib.crc32(shape(word).encode()) % SHAPES


def index_places(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the four ones in each key's index vector, from the hash of the key."""
    at, sign = np.zeros((len(keys), 4), np.int64), np.zeros((len(keys), 4), np.float32)
    h = np.array([zlib.crc32(k.encode()) for k in keys], np.uint64)
    for j in range(4):
        h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        at[:, j], sign[:, j] = (h % np.uint64(SIZE)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)
    return at, sign


def index_vectors(keys: list[str]) -> np.ndarray:
    at, sign = index_places(keys)
    out = np.zeros((len(keys), SIZE), np.float32)
    np.add.at(out, (np.arange(len(keys))[:, None], at), sign)
    return out


class Vectors:
    """Table of word rows, then shape rows; the first SIZE columns hold the word, the others the shape."""

    def __init__(self, words: dict[str, int], table: np.ndarray):
        self.words, self.table = words, table
        self.rows: dict[str, int] = {}

    def pooled(self, text: str) -> np.ndarray:
        tokens = text.split()
        rows = self.rows
        for w in [w for w in set(tokens) if w not in rows]:
            rows[w] = self.words[w] if w in self.words else len(self.words) + shape_row(w)
        out = np.zeros(2 * SIZE + 3, np.float32)
        out[-1] = np.log1p(len(tokens)) / 10
        if tokens:
            at = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
            for i in range(0, len(at), 8192):
                out[: 2 * SIZE] += self.table[at[i : i + 8192]].sum(0)
            out[: 2 * SIZE] /= len(tokens)
            out[-3] = np.mean(at[1:] == at[:-1]) if len(at) > 1 else 0.0
            out[-2] = len(set(tokens)) / len(tokens)
        if len(rows) > SEEN_WORDS:
            rows.clear()
        return out


def learn_vectors(texts: list[str]) -> Vectors:
    """Random indexing over the sample: each word gathers the index vectors of its neighbours."""
    split = [t.split() for t in texts]
    spread = Counter(w for ws in split for w in set(ws))
    words = {w: i for i, (w, n) in enumerate(sorted(spread.items(), key=lambda x: (-x[1], x[0]))) if n >= 2}
    keys = [*words, "\0rare"]
    own, (places, signs) = index_vectors(keys), index_places(keys)
    around, seen = np.zeros(own.size), np.ones(len(own), np.float32)
    for i in range(0, len(split), 256):  # neighbours within a document: a gap of REACH parts two documents
        parts = [np.fromiter((*(words.get(w, len(words)) for w in ws), *[-1] * REACH), np.int64, len(ws) + REACH) for ws in split[i : i + 256]]
        at = np.concatenate(parts)
        seen += np.bincount(at[at >= 0], minlength=len(own))
        for step in range(1, REACH + 1):
            for x, y in ((at[:-step], at[step:]), (at[step:], at[:-step])):
                x, y = x[both := (x >= 0) & (y >= 0)], y[both]
                around += np.bincount((x[:, None] * SIZE + places[y]).ravel(), weights=signs[y].ravel(), minlength=own.size)
    around = around.reshape(own.shape).astype(np.float32)
    word = (own + around / (2 * REACH * seen)[:, None])[:-1]
    shapes = index_vectors([f"\0{i}" for i in range(SHAPES)])
    table = np.zeros((len(words) + SHAPES, 2 * SIZE), np.float32)
    table[: len(words), :SIZE] = word
    table[: len(words), SIZE:] = shapes[[shape_row(w) for w in words]] if words else 0
    table[len(words) :, SIZE:] = shapes
    return Vectors(words, table)


class Network:
    """Two layers with a temperature; without training it answers ``share``."""

    def __init__(self, share: float):
        self.share, self.parts, self.temperature = share, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, a, b, c, d = self.parts
        return np.tanh((x - mean) / scale @ a + b) @ c + d

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        apart = rng.permutation(len(x))
        tune, fit = apart[: len(x) // 5], apart[len(x) // 5 :]
        mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-2
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        z = (x - mean) / scale
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                h = np.tanh(z[part] @ w[0] + w[1])
                wrong = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
                back = wrong[:, None] * w[2] * (1 - h * h)
                slopes = [z[part].T @ back + 1e-3 * w[0], back.sum(0), h.T @ wrong + 1e-3 * w[2], np.array([wrong.sum()])]
                t += 1
                for i, g in enumerate(slopes):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.parts = (mean, scale, *w)
        if len(tune) >= 20 and 0 < y[tune].mean() < 1:
            logits, grid = self.logits(x[tune]), np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[tune] == 1, -1, 1) * logits / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Vectors, Network]:
    """Learn from at most ``TRAIN_ROWS`` labelled documents; they are the only rows that reach the driver."""
    rows = training_rows(docs, labels, "quality", TRAIN_ROWS).collect()
    rows.sort()
    texts, y = [r["text"] for r in rows], np.array([r["label"] for r in rows], float)
    vectors = learn_vectors(texts)
    network = Network(float(y.mean()) if len(y) else 0.5)
    if len(y) >= 20 and 0 < y.mean() < 1:
        network.train(np.stack([vectors.pooled(t) for t in texts]).astype(np.float64), y)
    vectors.rows = {}
    return vectors, network


def score(docs: DataFrame, vectors: Vectors, network: Network, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, score, predicted (score of 0.3 or more)."""
    words, table = vectors.words, vectors.table

    def make():
        own = Vectors(words, table)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.stack([own.pooled(t.as_py() or "") for t in batch.column(1)]) if batch.num_rows else np.zeros((0, 2 * SIZE + 3))
            p = network.probability(x.astype(np.float64))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.3).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

        return step

    return map_batches(docs.select(id_col, "text"), make, f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, *fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
