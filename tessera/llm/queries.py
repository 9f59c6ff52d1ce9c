"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, compression, decontaminate, factors, lines, minhash, mixing, negatives, periods, quality_rules, suffixes, tokens, toxicity
from .common import held_out, read, scratch_path

END_ID = 2
ID_BYTES = 2  # the vocabulary has under 65,536 ids


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer files' folder is a setting of the environment; by default the installed package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
    return tokens.word_encoder(tokenizer_path())


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_sizes(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"), by_edits=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), drop=("text",)).drop("spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, drop=("text",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    failed = F.col("failures").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE_RULES)).cast("long")) != 0
    return (quality_rules.apply_policy(ledger.withColumn("base_failed", failed))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
        for k, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(read(spark, sf_dir, "documents"), path, encoder, END_ID, ID_BYTES)
    return tokens.read_tokens(spark, path).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression.fit(docs, read(spark, sf_dir, "labels"))
    return compression.score(docs, model, drop=("text",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return (negatives.mine(vectors, F.col("vec_id") % 50 == 0)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract's planted periods: of a tenth of the documents the words from a on repeat with period p.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    words = (read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
             .withColumn("words", F.when(F.col("h") % 10 == 0, found)).withColumn("n", F.size("words")))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    planted = words.withColumn("a", F.when(n > 0, F.pmod(g, n)).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")).otherwise(F.col("text"))
    best = periods.strongest()
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return (periods.periodic_runs(planted.select("doc_id", text.alias("text")), drop=("text",)).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op13_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = factors.remove_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_suffix_dedup, op3_line_dedup, op4_decontaminate, op5_toxicity,
                                   op6_quality_rules, op7_chat, op8_minhash, op9_tokens, op10_quality, op11_negatives,
                                   op12_periods, op13_factors)}
