"""Calendar helpers: regime labels over a span of years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Market regime per year, as labelled in the reference study.
REGIME_BY_YEAR = {
    2017: "alcista de baja volatilidad",
    2018: "correcciones (feb y Q4 2018)",
    2019: "alcista estable",
    2020: "crash COVID + recuperación en V",
    2021: "alcista fuerte (estímulos)",
    2022: "bear market (subida de tasas)",
    2023: "recuperación (rally IA)",
    2024: "alcista, baja volatilidad",
}


def regime_label(d0: Column, d1: Column, labels: dict[int, str] = REGIME_BY_YEAR) -> Column:
    """Labels of every year from year(d0) to year(d1) joined with " / "; unknown years as their number.

    A literal map (a handful of entries) looked up per element: no join needed.
    """
    m = F.create_map(*[x for k, v in sorted(labels.items()) for x in (F.lit(k), F.lit(v))])
    years = F.sequence(F.year(d0), F.year(d1))
    return F.array_join(F.transform(years, lambda y: F.coalesce(F.element_at(m, y), y.cast("string"))), " / ")


def _sql_map(labels: dict[int, str]) -> str:
    return "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in sorted(labels.items())) + "}"


# DuckDB twin (format with d0 / d1 column names).
REGIME_SQL = ("array_to_string(list_transform(range(year({d0}), year({d1}) + 1), "
              "lambda y: coalesce(" + _sql_map(REGIME_BY_YEAR).replace("{", "{{").replace("}", "}}")
              + "[y], CAST(y AS VARCHAR))), ' / ')")
