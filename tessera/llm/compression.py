"""Quality classifier by compression: which of two zstandard dictionaries, good or bad text, packs a text better.

Each text is cut into pieces of a few kilobytes; every piece is compressed once with the dictionary of good and once
with that of bad labelled text.  The size difference over the size sum is the main feature; how well the text packs
without any dictionary (repetition) and its length go with it into a logistic calibration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, fit_rows, logistic, raw_texts

# Bounds of the fit sample: labelled rows per class and characters per text.
FIT_ROWS, FIT_CHARS = 1500, 32_000
DICTIONARY_BYTES = 96 * 1024
PIECE = 4096
LEVEL = 1
THRESHOLD = 0.3


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary over pieces of the texts; the texts' own start if there is too little to train on."""
    import zstandard

    pieces = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, [p for p in pieces if len(p) >= 16]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size]


def measurer(good: bytes, bad: bytes):
    """text -> (normalised difference, size with the good dictionary per byte, size alone per byte, log length)."""
    import zstandard

    def packer(raw: bytes):
        if len(raw) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    g, b, alone = packer(good), packer(bad), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def measure(text: bytes) -> tuple[float, float, float, float]:
        n = len(text)
        if not n:
            return 0.0, 1.0, 1.0, 0.0
        cg = cb = ca = 0
        for i in range(0, n, PIECE):
            piece = text[i:i + PIECE]
            cg += len(g.compress(piece))
            cb += len(b.compress(piece))
            ca += len(alone.compress(piece))
        return (cb - cg) / (cb + cg), cg / n, ca / n, float(np.log1p(n))
    return measure


def expand(m: np.ndarray) -> np.ndarray:
    """Calibration features: the measures, squared and crossed, since bad text packs either far too well or badly."""
    d, g, a, n = (m[:, k] for k in range(4))
    return np.column_stack([d, d * n, g, g * g, a, a * a, n, n * n, g - a, g * n, a * n])


class Model:
    """Dictionaries and calibration weights: a few hundred kilobytes, whatever the input."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def scores(self, measures: np.ndarray) -> np.ndarray:
        z = expand(measures) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> Model:
    """Fit on a bounded sample of the learning folds: even rows build the dictionaries, odd rows calibrate.

    Without rows of one class the score is the share of label 1 (0.5 without any label).
    """
    sample, y, counts = fit_rows(docs, labels, label, per_class, max_chars, id_col, text_col)
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / total if total else 0.5
    # Copies of one text would fill a dictionary and its calibration alike: each text is used once.
    rows = list(dict.fromkeys(zip((t.encode() for t in sample), y)))
    split: dict[tuple[int, int], list[bytes]] = {}
    for k, (t, c) in enumerate(rows):
        split.setdefault((c, k % 2), []).append(t)
    if not all(split.get((c, h)) for c in (0, 1) for h in (0, 1)):
        flat = np.zeros(expand(np.zeros((1, 4))).shape[1] + 1)
        flat[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model(b"", b"", flat)
    good, bad = build_dictionary(split[1, 0]), build_dictionary(split[0, 0])
    measure = measurer(good, bad)
    x = np.array([measure(t) for c in (0, 1) for t in split[c, 1]])
    target = [0] * len(split[0, 1]) + [1] * len(split[1, 1])
    weight = [(1 - prior) / len(split[0, 1])] * len(split[0, 1]) + [prior / len(split[1, 1])] * len(split[1, 1])
    return Model(good, bad, logistic(expand(x), target, np.array(weight) * len(x), ridge=1e-4))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD,
          drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row, from whole texts; null and empty texts are scored too."""
    def make():
        measure = measurer(model.good, model.bad)

        def step(batch: pa.RecordBatch):
            m = np.array([measure(t) for t in raw_texts(batch, text_col)]).reshape(-1, 4)
            return [pa.array(model.scores(m))]
        return step

    scored = append_columns(docs, make, [T.StructField("score", T.DoubleType())], drop=drop)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
