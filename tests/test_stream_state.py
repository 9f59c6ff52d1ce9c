"""Streaming dedup without key state and daily vector sums with one vector a day, against the batch results."""

import datetime as dt
import json
import os

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import news as N
from tessera.session import scratch_path
from tessera.streaming import news_stream as ST

COLUMNS = "source string, src_rank int, row_no long, day date, headline string, body string"


def landed(spark, batches, schema, order_by=None):
    folder = scratch_path(spark, "landing")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/batch={k}")
    return folder


def test_dedup_over_batches_equals_batch(spark):
    row = lambda rank, no, day, text: (f"s{rank}", rank, no, dt.date(2020, *day), text, f"body {no}")
    batches = [[row(1, 1, (1, 5), "a"), row(0, 2, (1, 5), "a"), row(0, 3, (2, 1), "b")],
               [row(0, 4, (1, 5), "a"), row(0, 5, (1, 6), "a"), row(1, 6, (3, 1), "c"), row(0, 7, (3, 1), "c")],
               [row(0, 8, (2, 1), "b"), row(0, 9, (3, 1), "c")]]
    folder = landed(spark, batches, COLUMNS)
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    q = ST.run_dedup(ST.read_news_stream(spark, folder, max_files=1), out, ck)
    got = sorted((r.day, r.headline, r.row_no) for r in spark.read.parquet(out).collect())
    assert [(d.month, d.day, h) for d, h, _ in got] == [(1, 5, "a"), (1, 6, "a"), (2, 1, "b"), (3, 1, "c")]
    whole = N.dedup_news(spark.createDataFrame(sum(batches, []), COLUMNS))
    assert {(d, h) for d, h, _ in got} == {(r.day, r.headline) for r in whole.collect()}
    assert all(not p.stateOperators for p in map(_progress, q.recentProgress))
    # A batch that runs again replaces its own output.
    again = scratch_path(spark, "ck")
    ST.run_dedup(ST.read_news_stream(spark, folder, max_files=1), out, again)
    assert spark.read.parquet(out).count() == 4


def test_dedup_reads_published_rows_once_a_run(spark, monkeypatch):
    day = dt.date(2020, 1, 5)
    batches = [[("s0", 0, 10 * k + j, day, f"h{(k + j) % 7}", "b") for j in range(4)] for k in range(6)]
    out, ck, folder = scratch_path(spark, "out"), scratch_path(spark, "ck"), scratch_path(spark, "landing")
    runs, real = [], ST.publish_first
    monkeypatch.setattr(ST, "publish_first", lambda *a: (runs.append(1), real(*a)))
    for k, part in enumerate((batches[:4], batches[4:] + [[("s0", 0, 99, dt.date(2020, 1, 6), "h0", "b")]])):
        for i, rows in enumerate(part):
            spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/batch={k}{i}")
        q = ST.run_dedup(ST.read_news_stream(spark, folder, max_files=1), out, ck)
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == len(part)
    assert len(runs) == 2
    rows = spark.read.parquet(out).collect()
    assert sorted((r.day.day, r.headline) for r in rows) == [(5, f"h{i}") for i in range(7)] + [(6, "h0")]
    # Each key's row is that of the earliest batch.
    seen = {}
    for r in sum(batches, []):
        seen.setdefault(r[4], r[2])
    assert {r.headline: r.row_no for r in rows if r.day == day} == seen
    # Nothing new: the output stays as it is.
    ST.run_dedup(ST.read_news_stream(spark, folder, max_files=1), out, ck)
    assert spark.read.parquet(out).count() == 8


def test_dedup_keeps_one_row_of_a_null_key(spark):
    batches = [[("s0", 0, 1, dt.date(2020, 1, 5), None, "b")], [("s0", 0, 2, dt.date(2020, 1, 5), None, "b")]]
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    ST.run_dedup(ST.read_news_stream(spark, landed(spark, batches, COLUMNS), max_files=1), out, ck)
    assert spark.read.parquet(out).count() == 1


class _progress:
    def __init__(self, p):
        self.stateOperators = (p if isinstance(p, dict) else json.loads(p.json)).get("stateOperators", [])


def test_daily_vector_sums_keep_one_vector_a_day(spark):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t0 + dt.timedelta(hours=int(h)), [float(x) for x in rng.normal(size=3)]) for h in rng.integers(0, 24 * 8, 200)]
    rows.sort()
    late = [(t0 + dt.timedelta(hours=1), [1e6, 1e6, 1e6])]
    batches = [rows[:80], rows[80:150] , rows[150:] + late]
    folder = landed(spark, batches, "ts timestamp, emb array<double>")
    stream = spark.readStream.schema("ts timestamp, emb array<double>").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    ST.run_available(ST.daily_vector_sums(stream), out, ck)
    got = {r.day: (r.n, r.s) for r in spark.read.parquet(out).collect()}
    last = max(r[0] for r in rows)
    closed = [d for d in sorted({r[0].date() for r in rows}) if dt.datetime.combine(d + dt.timedelta(days=1), dt.time(), dt.timezone.utc) <= last - dt.timedelta(days=1)]
    assert sorted(got) == closed and len(closed) >= 5
    for d in closed:
        own = [v for t, v in rows if t.date() == d]
        assert got[d][0] == len(own) and np.allclose(got[d][1], np.sum(own, axis=0))
