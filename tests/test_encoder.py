"""The default text encoder: defined hashes, norms, texts without tokens, restored order."""
import hashlib

import numpy as np

from tessera.functions.udf import encode_text, hashing_encoder


def _plain(text, dim, seed=42):
    v = np.zeros(dim)
    word = ""
    for c in (text or "").lower() + " ":
        if c in "0123456789abcdefghijklmnopqrstuvwxyz_" or ord(c) >= 128:
            word += c
        elif word:
            h = hashlib.md5(f"{seed}:{word}".encode()).hexdigest()
            v[int(h[:15], 16) % dim] += 1 if int(h[15], 16) < 8 else -1
            word = ""
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


TEXTS = ["Profit rises, profit falls", "", None, "  --- ", "Año nuevo: ÜBER 3_4", "x " * 5000, "a"]


def test_encoder_against_plain_loop():
    got = hashing_encoder(16)(TEXTS)
    assert got.dtype == np.float32 and got.shape == (len(TEXTS), 16)
    for text, row in zip(TEXTS, got):
        assert np.array_equal(row, _plain(text, 16))
    assert hashing_encoder(16)([]).shape == (0, 16)
    assert not np.array_equal(hashing_encoder(16, seed=1)(TEXTS[:1]), got[:1])


def test_encode_text_restores_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    rows = encode_text(df, dim=16, batch_size=2).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert np.array_equal(np.array(r.emb, dtype=np.float32), _plain(TEXTS[r.id], 16))
    assert encode_text(df.limit(0), dim=16).count() == 0
