"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, token output.

Every stage works on all that the one before kept; ``run`` writes each stage's result to the shared checkpoint folder and
reads it again.  Stages but the last return the columns of ``documents``.  A stage first deletes the working tables of the
stages before it, whose results are written by then (tables that its own input reads stay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, minhash, mixing, tokens, toxicity
from tessera.llm.common import arrow_rows, clear_before, read, scratch_path, staged
from tessera.llm.queries import END_ID, ID_BYTES, encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Rows that Spark hands to Python at once: batches of texts stay small beside what the stages keep in their workers.  Stages
# that run jobs of their own set it too, so it holds for them when they are called one by one.
BATCH_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    clear_before(docs)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id (five-word shingles, similarity 0.8)."""
    clear_before(docs)
    with arrow_rows(spark, BATCH_ROWS):
        return minhash.first_rows(docs.select(*COLUMNS), width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the operator's rule go."""
    clear_before(docs)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    clear_before(docs)
    return mixing.replicate(mixing.mix(mixing.with_sizes(docs.select(*COLUMNS)))).select(*COLUMNS)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: one row per document and copy."""
    clear_before(docs)
    path = scratch_path(spark, "tokens")
    with arrow_rows(spark, BATCH_ROWS):
        tokens.write_tokens(docs, path, encoder, END_ID, ID_BYTES)
    return tokens.read_tokens(spark, path).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_shards),
]

# Learned scores, the dual solution and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with arrow_rows(spark, BATCH_ROWS):
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), name)
    return docs
