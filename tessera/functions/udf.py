"""User-function surface: text encoders and batch scorers run in Arrow batches.

``encode_text`` runs a user encoder with ``mapInPandas`` in iterator form, so
a model is loaded once per task and fed length-sorted batches.  Without a
user encoder a deterministic token-hashing encoder is used (no network, no
model files).  ``score_windows`` applies a numpy scorer to stacked sample
windows per Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
# Hashes of words that a task remembers.
WORDS_KEPT = 1 << 16


def hashing_encoder(dim: int = 64, seed: int = 42) -> Callable[[list[str]], np.ndarray]:
    """Bag of lower-cased word tokens hashed into ``dim`` signed buckets, L2-normalised (zeros without a token).

    Of the md5 of ``seed:token`` the first 15 hex digits choose the bucket and the 16th the sign, which any SQL engine
    can repeat.  Each distinct word of a batch is hashed once; counting is one ``bincount`` over all tokens.
    """
    @lru_cache(WORDS_KEPT)
    def place(word: str) -> tuple[int, float]:
        digest = hashlib.md5(f"{seed}:{word}".encode()).hexdigest()
        return int(digest[:15], 16) % dim, 1.0 if digest[15] < "8" else -1.0

    def encode(texts: list[str]) -> np.ndarray:
        tokens = [_TOKEN.findall((t or "").lower()) for t in texts]
        codes, words = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
        placed = [place(w) for w in words]
        bucket = np.array([b for b, _ in placed], dtype=np.int64)[codes]
        sign = np.array([s for _, s in placed], dtype=np.float64)[codes]
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
        out = np.bincount(rows * dim + bucket, sign, len(texts) * dim).reshape(len(texts), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        norm[norm == 0] = 1.0
        return (out / norm).astype(np.float32)
    return encode


def encode_text(df: DataFrame, text: str = "text", out: str = "emb",
                make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
                batch_size: int = 64, dim: int = 64) -> DataFrame:
    """Add ``out`` (array<float>) computed by an encoder built once per task.

    ``make_encoder()`` returns ``f(list[str]) -> (n, dim) array``; within each
    Arrow batch rows are encoded in sub-batches of ``batch_size`` after sorting
    by text length (less padding for tokenised models), then restored to order.
    """
    factory = make_encoder or (lambda: hashing_encoder(dim))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = factory()
        for pdf in batches:
            texts = pdf[text].fillna("").astype(str).tolist()
            order = np.argsort([len(t) for t in texts], kind="stable")
            vecs: list = [None] * len(texts)
            for s in range(0, len(order), batch_size):
                idx = order[s:s + batch_size]
                res = enc([texts[k] for k in idx])
                for k, v in zip(idx, res):
                    vecs[k] = np.asarray(v, dtype=np.float32)
            pdf[out] = vecs
            yield pdf

    return df.mapInPandas(run, schema)


def score_windows(samples: DataFrame, fn: Callable[[np.ndarray], np.ndarray], window: str = "window",
                  out: str = "y_pred") -> DataFrame:
    """``fn((b, L, f) array) -> (b,)`` applied per Arrow batch of samples."""
    schema = T.StructType([f for f in samples.schema.fields] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                pdf[out] = pd.Series([], dtype="float64")
                yield pdf
                continue
            x = np.stack([np.stack(list(w)) for w in pdf[window]])
            pdf[out] = np.asarray(fn(x), dtype=np.float64)
            yield pdf

    return samples.mapInPandas(run, schema)
