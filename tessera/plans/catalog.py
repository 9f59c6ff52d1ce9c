"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_embed, q_eval, q_features, q_fitted, q_models, q_news, q_reports, q_splits, q_stats, q_streaming  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES, rounded


def session_defaults(spark: SparkSession) -> None:
    """Day boundaries are UTC in every operator (dates parsed with offsets, timestamps to days)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def with_session_defaults(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session_defaults(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    return QUERIES


def oracle():
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars -> log returns -> momentum / reversal / zero predictions -> backtest per symbol."""
    from ..operators import metrics as M
    return rounded(M.long_short_backtest(q_eval.preds(spark, sf_dir), q_eval.G), 5)
