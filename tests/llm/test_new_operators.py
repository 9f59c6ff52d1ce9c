"""Hard negatives, periodic runs and factor dedup against brute force on small fixtures."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import factors, negatives, periods
from tessera.llm.common import staged

# ------------------------------------------------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(rows, is_anchor, positives=5, negatives_=3, low=50, high=95, scale=256.0):
    """Hard negatives by the definition, one pair after the other."""
    sound = [r for r in rows if r[2] is not None and r[1] is not None
             and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in r[1])]
    q = [[math.floor(scale * x) for x in r[1]] for r in sound]
    order = lambda i: (sound[i][0] is None, sound[i][0] or 0, i)
    out = []
    for a, row in enumerate(sound):
        if row[0] is None or not is_anchor(row[0]):
            continue
        score = [sum(x * y for x, y in zip(q[a], v)) for v in q]
        ranked = sorted((i for i in range(len(sound)) if i != a), key=lambda i: (-score[i], *order(i)))
        for p in [i for i in ranked if sound[i][2] == row[2]][:positives]:
            hard = [i for i in ranked if sound[i][2] != row[2] and low * score[p] <= 100 * score[i] <= high * score[p]]
            for k, i in enumerate(hard[:negatives_], 1):
                out.append((row[0], sound[p][0], k, sound[i][0], score[p], score[i]))
    return sorted(out, key=str)


def check_mined(spark, rows, shuffle=True, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).withColumn("rank", F.lit(0))
    got = negatives.mine(df.repartition(3) if shuffle else df.coalesce(1), F.col("vec_id") % 5 == 0, **more)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = [(*r[:4], *(s if abs(s) < 1 << 63 else None for s in r[4:])) for r in mined(rows, lambda i: i % 5 == 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return got


def vector(rng, n, wide=1.0):
    return [rng.gauss(0.3, 1) * wide for _ in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, vector(rng, 8), rng.randrange(4)) for i in range(300)]
    rows += [(300 + i, rows[7][1], rows[7][2] if i % 2 else 9) for i in range(40)]  # ties: one vector under two labels
    rows += [(400, None, 1), (405, [1.0, None], 1), (410, [float("nan")] * 8, 1), (415, [float("inf")] * 8, 2), (420, vector(rng, 8), None),
             (425, [], 1), (430, [1.0], 3), (435, [0.0] * 8, 2), (None, vector(rng, 8), 1), (440, vector(rng, 12), 2)]
    assert check_mined(spark, rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 17)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 5)
    assert check_mined(spark, rows)


def test_negatives_of_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, vector(rng, 4, 10.0 ** (i % 3 * 9)), i % 2) for i in range(60)]
    rows += [(60 + i, vector(rng, 4, 1e30), i % 2) for i in range(10)]
    got = check_mined(spark, rows)
    assert any(r["positive_score"] is None for r in got)
    assert check_mined(spark, [(i, vector(rng, 4, 10.0 ** (i % 3 * 4)), i % 2) for i in range(60)])


def test_negatives_of_repeated_rows_and_empty_tables(spark):
    rows = [(5, [1.0, 2.0], 1)] * 3 + [(6, [1.0, 1.5], 2)] * 2 + [(7, [1.0, 1.2], 2)]
    got = check_mined(spark, rows, shuffle=False)
    assert {(r["anchor_id"], r["positive_id"]) for r in got} == {(5, 5)}
    empty = spark.createDataFrame([], VECTORS)
    out = negatives.mine(empty, F.col("vec_id") % 5 == 0)
    assert out.count() == 0 and "negative_id" in out.columns


def test_packed_products_are_exact():
    rng = np.random.default_rng(0)
    for low, high in ((-3, 4), (-300, 300), (1, 9), (-9, -1), (-(1 << 40), 1 << 40)):
        c = rng.integers(low, high, (33, 7))
        a = rng.integers(low, high, (5, 7))
        for m, n in ((c, a), (c.astype(object), a.astype(object))):
            p = negatives.Packed(m, n)
            for k in range(5):
                want = (c.astype(object) * a[k].astype(object)).sum(axis=1).tolist()
                assert [int(x) for x in p.score(n[k])] == want
    values = [0, 1, -1, 255, 256, -256, 1 << 90, -(1 << 90), 1 << 62]
    assert [negatives.unsortable(negatives.sortable(v)) for v in values] == values
    assert sorted(values, key=negatives.sortable) == sorted(values)


# --------------------------------------------------------------------------------------------------------- periodic runs

def plain_runs(w):
    """Runs by the definition: every period, every maximal stretch, the smallest period of a stretch."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_text(rng):
    out = []
    for _ in range(rng.randrange(1, 5)):
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
        out += (unit * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        out += [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 6))]
    return out


@pytest.mark.parametrize("grid", [periods.GRID, 7])
def test_runs_equal_brute_force(monkeypatch, grid):
    monkeypatch.setattr(periods, "GRID", grid)
    rng = random.Random(5)
    texts = [periodic_text(rng) for _ in range(150)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, ["a", "b"] * 4, ["a", "b"] * 3, list("ab" * 50 + "c" + "ab" * 50)]
    a, b = ["a"], ["a", "b"]  # Fibonacci words are full of cubes and have no fourth power
    for _ in range(11):
        a, b = b, b + a
    texts += [b, (["a"] * 4 + ["b"]) * 40, (list("aab") * 4 + ["c"]) * 30]
    numbers = [np.array([hash(x) % 1000 for x in t], dtype=np.int64) for t in texts]
    assert periods.find_runs(numbers) == [plain_runs(t.tolist()) for t in numbers]
    assert sum(map(len, periods.find_runs(numbers))) > 100


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(6)
    for size, letters in ((2, 2), (3, 1), (40, 1), (60, 2), (300, 3), (500, 1)):
        words = np.concatenate([[90], rng.integers(0, letters, size), [91]])
        seq = periods.Sequence(words)
        a, b = np.triu_indices(len(words), 1)
        got = seq.right.lengths(a, b)
        for i, j, n in zip(a.tolist(), b.tolist(), got.tolist()):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            assert k == n


def test_periodic_runs_of_rows(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(periodic_text(rng)), i) for i in range(40)]
    rows += [(40, None, 0), (41, "", 0), (None, " x x  x x x x y", 0), (42, "\u00a0 \u00a0 " * 9, 1), (42, "\u00a0 \u00a0 " * 9, 1), (43, "e\x1c " * 30000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    out = periods.periodic_runs(df).withColumn("best", periods.strongest()).collect()
    assert len(out) == len(rows)
    for r in out:
        w = [x for x in (r["text"] or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        want = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want and r["n_words"] == len(w)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (None if r["best"] is None else (r["best"]["start"], r["best"]["length"], r["best"]["period"])) == best
    assert periods.periodic_runs(df.filter("false")).count() == 0


# --------------------------------------------------------------------------------------------------------- factor dedup

def plain_spans(rows, length):
    """Words covered by a window that starts earlier, by the definition; rows of equal ids but other texts don't judge each other."""
    texts = {(i, t or "") for i, t in rows}
    windows = {}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - length + 1):
            windows.setdefault(tuple(w[k:k + length]), []).append((i is None, i or 0, t, k))
    gone = {}
    for places in windows.values():
        for no_id, i, t, k in places:
            if any((p[0], p[1]) < (no_id, i) or (p[2] == t and (p[0], p[1]) == (no_id, i) and p[3] < k) for p in places):
                gone.setdefault((None if no_id else i, t), set()).update(range(k, k + length))
    return gone


def repeating_rows(rng, n, length):
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randrange(length, 4 * length))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 2 * length))]
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            w += p[a:a + rng.randrange(length // 2, len(p))]
            if rng.random() < 0.2:
                w += ["x", "y"] * rng.randrange(length)
        rows.append((i * 3 % n, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "short"), (None, rows[3][1]), (None, rows[3][1]), (None, rows[4][1] + " tail"), rows[5], rows[5]]
    rows += [(n + 3, rows[6][1]), (n + 3, rows[6][1] + " other tail"), (n + 4, " ".join(["z"] * 300)), (-5, " ".join(["z"] * 9 * length))]
    return rows


@pytest.mark.parametrize("hot,part", [(64, 400_000), (1, 400_000), (64, 55)])
def test_factor_dedup_equals_brute_force(spark, monkeypatch, hot, part):
    monkeypatch.setattr(factors, "HOT", hot)
    monkeypatch.setattr(factors, "SAMPLE", 1 if hot == 1 else 64)
    monkeypatch.setattr(factors, "PART_WORDS", part)
    rng = random.Random(8)
    for length in (20, 5):
        rows = repeating_rows(rng, 60, length)
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("route", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
        out = factors.remove_repeats(df, length=length).collect()
        gone = plain_spans(rows, length)
        words = lambda t: (t or "").split()
        want = sorted((str(i), len(words(t)), len(g := gone.get((i, t or ""), ())), " ".join(x for k, x in enumerate(words(t)) if k not in g)) for i, t in rows)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in out) == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)
        assert sum(r["n_removed"] > 0 for r in out) > 20


def test_staged_tables_leave_no_shuffle_files(spark):
    """The pieces' shuffle files go as the factors are written, though the plan is still referred to."""
    import time

    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: store.getAllFiles().mkString("\n")
    before = set(files().split("\n"))
    plan = spark.range(20_000).withColumn("h", F.xxhash64("id")).repartition(7, "h")
    assert staged(plan, "shuffled").count() == 20_000
    for _ in range(50):
        left = [f for f in files().split("\n") if "/shuffle_" in f and f not in before]
        if not left:
            break
        time.sleep(0.1)
    # The count's own shuffle of one row a task may stay.
    assert sum(os.path.getsize(f) for f in left) < 10_000
    assert plan.count() == 20_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_factor_dedup_of_an_empty_table(spark):
    out = factors.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
