"""Stream = batch for ingestion and dedup; every query against its DuckDB twin (sf0.001)."""
import pytest

import __spark_entry__ as E
from tessera.plans import catalog
from tessera.session import clear_staged
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    qs = E.queries()
    s = qs["stream_ingest_news"](spark, SF)
    b = qs["clean_news"](spark, SF)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    keys = qs["stream_dedup_news"](spark, SF)
    assert keys.count() == qs["dedup_news_global"](spark, SF).count()
    runs = {r.run: r.n_rows for r in qs["stream_resume"](spark, SF).collect()}
    assert sum(runs.values()) == b.count() and set(runs) == {1, 2}


OWN = sorted(set(catalog.oracle()))


@pytest.mark.parametrize("key", OWN)
def test_every_twin(spark, key):
    """Every query with an SQL twin equals it, values included."""
    line = compare(spark, duck(SF), key, catalog.with_session_defaults(catalog.queries()[key]), catalog.oracle()[key], SF)
    clear_staged(spark)
    assert " OK " in line, line


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - set(OWN)))
def test_every_query_without_a_twin_runs(spark, key):
    assert catalog.with_session_defaults(catalog.queries()[key])(spark, SF).count() > 0
    clear_staged(spark)
