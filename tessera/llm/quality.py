"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

``statistics`` of a whole text are standardised and mapped to D random cosine features, whose inner
products approximate a Gaussian kernel.  Each partition of the training sample sums its own normal
equations, the sums are added and solved with a ridge penalty, and the other half of the sample fits a
monotone map from raw scores to probabilities (pool adjacent violators).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, lookup, slices, stash
from tessera.llm.shingles import chunks, word_hashes

#: At most about so many labelled documents are read to fit the classifier.
TRAIN_ROWS = 16_000
FEATURES, SEED, RIDGE, SCALE, THRESHOLD = 160, 5, 1e-3, 0.6, 0.7
_SPACE, _PUNCT = b" \t\n\r\x0b\x0c", b".,;:'\"-()"
NAMES = ("log_words", "log_word_bytes", "upper", "digit", "punct", "symbol", "bang", "pipe", "multibyte", "space", "log_line_bytes", "distinct", "repeated", "entropy")


def _is(*codes: int) -> np.ndarray:
    out = np.zeros(256)
    out[list(codes)] = 1
    return out


_CLASSES = np.stack([
    _is(*range(65, 91)), _is(*range(48, 58)), _is(*_PUNCT), _is(*(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCT and c not in b"!|")),
    _is(ord("!")), _is(ord("|")), _is(*range(128, 256)), _is(*_SPACE), _is(10),
], 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES a text; ratios of an empty text are 0."""
    out = []
    for _, data, at in chunks(texts):
        words, bounds = word_hashes(data, at)
        same = np.zeros(len(words) + 1)
        same[1:-1] = words[1:] == words[:-1]
        for i in range(len(at) - 1):
            count = np.bincount(data[at[i] : at[i + 1]], minlength=256)
            size, lo, hi = int(at[i + 1] - at[i]), int(bounds[i]), int(bounds[i + 1])
            n = hi - lo
            share = count @ _CLASSES / max(size, 1)
            p = count[count > 0] / max(size, 1)
            distinct = len(np.unique(words[lo:hi])) / n**0.85 if n else 0.0
            out.append([np.log1p(n), np.log1p(size * (1 - share[7]) / max(n, 1)), *share[:8], np.log1p(size / (1 + count[10])), distinct, same[lo + 1 : hi].sum() / max(n, 1), -(p * np.log(p)).sum()])
    return np.array(out).reshape(-1, len(NAMES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(z W + b) and a constant; W and b depend on the seed only."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    w, b = rng.normal(0, SCALE, (z.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and non-decreasing values of the least-squares monotone fit; ties in x are pooled first."""
    blocks: list[list[float]] = []
    at, start = np.unique(x, return_index=True)
    order = np.argsort(x, kind="stable")
    for v, ys in zip(at, np.split(y[order], np.searchsorted(x[order], at)[1:])):
        blocks.append([float(ys.sum()), len(ys), v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    knots = np.array([k for _, _, a, b in blocks for k in ((a, b) if b > a else (a,))])
    values = np.array([(s + 0.5) / (n + 1) for s, n, a, b in blocks for _ in range(2 if b > a else 1)])
    return knots, np.maximum.accumulate(values)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit to ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); None without labelled rows.

    About ``rows`` labelled documents, chosen by a hash of their id, are read; nulls are left out.
    """
    marked = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("double").alias("label"))
    total = marked.count()
    if total > rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * rows / total))
    marked = stash(marked)
    sample = docs.select("doc_id", "text").join(lookup(marked), "doc_id").select("doc_id", "label", "text")
    x = stash(sample.mapInArrow(_rows_of, "doc_id long, label double, x array<double>"))
    size = len(NAMES)
    head = x.agg(F.count("*"), *(F.avg(F.col("x")[i]) for i in range(size)), *(F.stddev_pop(F.col("x")[i]) for i in range(size))).first()
    if not head[0]:
        return None
    mean, scale = np.array(head[1 : size + 1], float), np.maximum(np.array(head[size + 1 :], float), 1e-6)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = fourier((np.array(batch.column("x").to_pylist()).reshape(-1, size) - mean) / scale)
            total += z.T @ np.hstack([z, np.array(batch.column("label").to_pylist())[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    sums = x.where(half == 0).repartition(8, "doc_id").sortWithinPartitions("doc_id").mapInArrow(equations, "sums binary").collect()
    a = np.sum(sorted((np.frombuffer(r["sums"]).reshape(FEATURES + 1, FEATURES + 2) for r in sums), key=lambda m: m.tobytes()), axis=0)
    n = max(1.0, a[-1, -2])
    weights = np.linalg.solve(a[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), a[:, -1])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    rest = x.where(half == 1).orderBy("doc_id").toPandas()
    if len(rest):
        model.knots, model.values = isotonic(model.raw(np.stack(rest["x"])), rest["label"].to_numpy())
    return model


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns, plus quality (0 to 1). A null text counts as empty; without a model all score 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            score = model.score(statistics(batch.column(text_col))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "quality"])

    left, schema = appended(docs, "quality", "double")
    return left.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose crc32 of the id's decimal text is not 2 modulo 4."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("doc_id", F.col("quality").alias("label"))
