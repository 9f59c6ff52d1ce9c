"""Fixture views over the given test tables (see FIXTURES.md, part B).

Every view is a plain Spark plan over the parquet tables, so its size grows
with the scale factor.  The DuckDB twins live in ``tessera.oracle.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# "flag": three symbols (correctness); "flag_supp": sixty symbols (benches).
SYMBOL_MODES = ("flag", "flag_supp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbols: str = "flag") -> DataFrame:
    """Daily OHLCV bars ``(symbol, day, open, high, low, close, volume)``.

    One aggregate on (symbol, day); open/close take the quote of the first /
    last line by (l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice), so ties are stable.  The struct key makes it a
    sort-based aggregate, but it still combines partially before its single
    shuffle (one row per (symbol, day) per map task); splitting the choice
    into two hash aggregates was measured slower and shuffles ~all rows twice.
    """
    if symbols not in SYMBOL_MODES:
        raise ValueError(f"symbols must be one of {SYMBOL_MODES}")
    li = table(spark, sf_dir, "lineitem")
    sym = F.col("l_returnflag")
    if symbols == "flag_supp":
        sym = F.concat(sym, (F.col("l_suppkey") % 20).cast("string"))
    quote = F.lit(100.0) + F.col("l_quantity") / 10
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (li.groupBy(sym.alias("symbol"), F.to_date("l_shipdate").alias("day"))
            .agg(F.min_by(quote, tie).alias("open"),
                 F.max(quote).alias("high"),
                 F.min(quote).alias("low"),
                 F.max_by(quote, tie).alias("close"),
                 F.sum("l_quantity").alias("volume")))


def vol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second market series ``(day, vix_close)`` from orders."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("day"))
            .agg((F.avg("o_totalprice") / 10000).alias("vix_close")))


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News rows ``(source, src_rank, row_no, day, headline, body)`` from documents.

    ``headline`` is the first line of the text, ``body`` the rest; exact copies
    share ``n_chars`` and therefore the day.
    """
    d = table(spark, sf_dir, "documents")
    nl = F.instr(F.col("text"), "\n")
    return d.select(
        F.col("source"),
        F.substring(F.col("source"), 4, 8).cast("int").alias("src_rank"),
        F.col("doc_id").alias("row_no"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("n_chars") % 250).cast("int")).alias("day"),
        F.substring_index(F.col("text"), "\n", 1).alias("headline"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("body"),
    )


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def news_vectors(spark: SparkSession, sf_dir: str, news: DataFrame | None = None) -> DataFrame:
    """``(row_no, day, headline, emb)``: each news row gets the vector ``doc_id % count``.

    The count is a one-row aggregate (size bound: one row), broadcast to the
    news side; the vector lookup itself is an equi-join on ``vec_id``.
    """
    emb = embedding_table(spark, sf_dir)
    n = emb.agg(F.count(F.lit(1)).alias("_n_vec"))
    src = news if news is not None else news_raw(spark, sf_dir)
    keyed = src.crossJoin(F.broadcast(n)).withColumn("_vec", F.col("row_no") % F.col("_n_vec"))
    return (keyed.join(emb, keyed["_vec"] == emb["vec_id"], "inner")
            .select("row_no", "day", "headline", F.col("embedding").alias("emb")))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records ``(trial, fold, loss, hidden, d_model, dropout, weight_decay)``.

    Three parts per trial (one per inner fold); parameters depend on the trial
    only; parts of size 50 are failed evaluations (null loss).
    """
    p = table(spark, sf_dir, "part")
    t = ((F.col("p_partkey") - 1) / 3).cast("long")
    return p.select(
        t.alias("trial"),
        ((F.col("p_partkey") - 1) % 3).cast("int").alias("fold"),
        F.when(F.col("p_size") == 50, F.lit(None).cast("double"))
         .otherwise(F.round(F.col("p_retailprice") / 1000 + F.col("p_size") / 500.0, 6)).alias("loss"),
        (F.lit(64) * F.pow(F.lit(2), t % 3)).cast("int").alias("hidden"),
        (F.lit(32) * F.pow(F.lit(2), F.floor(t / 3) % 3)).cast("int").alias("d_model"),
        F.round(F.lit(0.1) + (t % 9) * 0.05, 6).alias("dropout"),
        F.round(F.lit(1e-6) * F.pow(F.lit(10.0), t % 4), 12).alias("weight_decay"),
    )


def embedding_dim(spark: SparkSession, sf_dir: str) -> int:
    """Vector length, read from one row (the scan stops after the first row)."""
    return int(table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0])
