"""The corpus pipeline's stages against brute force: nulls, one id on two texts, repeated rows, clean documents, empty tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import tokens, toxicity
from tessera.llm.common import staged

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus folder: labelled toxic documents, near copies, a benchmark passage, odd rows."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(900)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [f"b{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        t = text(60) + (" snarfblat grumblefop " if toxic else "")
        docs.append(doc(i, t, "ab"[i % 2]))
        labels.append((i, 1, int(toxic)))
    base = text(80)
    docs += [doc(400, base), doc(401, base + " tail"), doc(401, text(70), "b"), doc(None, base), doc(402, text(20) + " " + " ".join(passage) + " " + text(20)),
             doc(403, None), doc(404, ""), doc(405, "one"), doc(406, text(30)), doc(406, docs[-1][1] and text(31))]
    docs += [docs[-2], docs[-2]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", " ".join(passage))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stages_one_by_one(spark, tables):
    folder, docs = tables
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    stage = dict(P.STAGES)
    given = spark.createDataFrame(docs, COLUMNS).repartition(4)

    clean = staged(stage["toxicity"](spark, given, folder), "t")
    assert clean.columns == P.COLUMNS
    want = [d for d in docs if "snarfblat" not in (d[1] or "")]
    assert rows_of(clean) == sorted(map(str, want))

    kept = staged(stage["near_duplicates"](spark, clean, folder), "t")
    assert kept.columns == P.COLUMNS

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    alive = []  # in the order of ids, nulls last: a row goes if a row like it stands before it
    for d in sorted(want, key=lambda d: (d[0] is None, d[0] or 0)):
        s = shingles(d[1])
        if not any(s and 100 * len(s & o) >= 80 * len(s | o) for o in (shingles(e[1]) for e in alive)):
            alive.append(d)
    assert rows_of(kept) == sorted(map(str, alive)) and len(alive) == len(want) - 4

    pure = staged(stage["decontamination"](spark, kept, folder), "t")
    assert rows_of(pure) == sorted(str(d) for d in alive if d[0] != 402) and pure.columns == P.COLUMNS

    mixed = staged(stage["mixing"](spark, pure, folder), "t")
    assert mixed.columns == P.COLUMNS
    times = {}
    for r in mixed.collect():
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) <= {d for d in alive if d[0] != 402} and max(times.values()) <= 3

    out = stage["tokens"](spark, mixed, folder).collect()
    assert len(out) == sum(times.values()) and all(r["n_tokens"] >= 1 for r in out)


def test_driver_gives_back_what_fits_held(spark, tables, monkeypatch):
    folder, docs = tables
    freed = []
    monkeypatch.setattr(toxicity, "give_back", lambda: freed.append("toxicity"))
    monkeypatch.setattr(tokens, "give_back", lambda: freed.append("tokens"))
    given = spark.createDataFrame(docs, COLUMNS)
    toxicity.fit(given, spark.read.parquet(f"{folder}/labels.parquet"))
    monkeypatch.setitem(tokens._MEMORY, "an encoder", object())
    tokens.sample_dictionary(given, lambda: lambda c: [np.arange(20) for _ in c], 2, 2, "doc_id", "text")
    assert freed == ["toxicity", "tokens"] and not tokens._MEMORY


def test_whole_pipeline_and_empty_tables(spark, tables, tmp_path):
    folder, docs = tables
    assert P.run(spark, folder).count() > 100
    empty = str(tmp_path / "empty")
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0
