"""Mixing, suffix dedup, line dedup and near duplicates against brute force on small fixtures."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, lines, minhash, mixing, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -------------------------------------------------------------------------------------------------------------- mixing

def filled(sizes, cap=3):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest} if w else {}
        over = [s for s in rest if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return {**share, **stopped}
        stopped.update({s: cap * sizes[s] for s in over})


def test_mix_keeps_columns_with_any_name(spark):
    rows = [doc(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)]
    names = ["scale", "lam", "full", "_row", "_src", "_none", "_tie", "_draw", "_whole", "error", "lo", "hi", "target"]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}-"), F.col("doc_id")))
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.with_sizes(spark.createDataFrame(rows, SCHEMA))).collect()}
    out = mixing.mix(mixing.with_sizes(docs)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == plain
    assert all(r[c] == f"{k}-{r['doc_id']}" for r in out for k, c in enumerate(names) if c != "target")


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_the_targets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("b", 300), ("a", 40), (None, 60), ("Z", 10), ("é", 200), ("empty", 3), ("", 20)):
        for _ in range(n):
            size = 0 if s == "empty" else int(rng.lognormvariate(3, 1)) + 1
            rows.append(doc(len(rows), " ".join(["x"] * size) if size else rng.choice(["", None, " \n"]), s))
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("target", F.lit("old")).withColumn("_row", F.lit(0))
    sized = mixing.with_sizes(docs)
    out = mixing.mix(sized).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = filled(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3), s
    again = mixing.mix(sized.repartition(7)).select("doc_id", "copies").groupBy("doc_id").agg(F.sum("copies")).collect()
    first = {}
    for r in out:
        first[r["doc_id"]] = first.get(r["doc_id"], 0) + r["copies"]
    assert dict(map(tuple, again)) == first
    assert mixing.replicate(mixing.mix(sized)).count() == sum(r["copies"] for r in out)


def test_mix_rates_are_the_tilted_ones(spark):
    """Inside a source log(rate) is proportional to the size, and the rates meet the target before rounding."""
    rows = [doc(i, " ".join(["x"] * (1 + i % 17)), "ab"[i % 2 if i < 300 else 0]) for i in range(900)]
    out = mixing.mix(mixing.with_sizes(spark.createDataFrame(rows, SCHEMA))).collect()
    for s in "ab":
        mine = [r for r in out if r["source"] == s]
        words_ = sum(r["rate"] * r["size"] for r in mine)
        assert abs(words_ - mine[0]["target"]) <= 1e-4 * mine[0]["target"]
        slopes = [math.log(r["rate"]) / r["size"] for r in mine if 1e-9 < r["rate"] < 3 - 1e-9]
        assert not slopes or max(slopes) - min(slopes) < 1e-9


def test_mix_of_nothing(spark):
    empty = mixing.with_sizes(spark.createDataFrame([], SCHEMA))
    assert mixing.mix(empty).count() == 0
    blank = mixing.with_sizes(spark.createDataFrame([doc(1, None), doc(None, "", None)], SCHEMA))
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


# ------------------------------------------------------------------------------------------------------- suffix dedup

def brute_repeats(rows):
    first = {}
    big = 1 << 62
    data = [(big if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            s = b[k:k + 50]
            first[s] = min(first.get(s, big), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if i == big else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_difference_cover():
    at = {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER if a != b}
    assert at == set(range(1, suffixes.MODULUS)) and len(suffixes.COVER) ** 2 - len(suffixes.COVER) == suffixes.MODULUS - 1
    for i in range(suffixes.MODULUS):  # any two places have a common shift into the cover
        for j in range(suffixes.MODULUS):
            assert any((i + d) % suffixes.MODULUS in suffixes.COVER and (j + d) % suffixes.MODULUS in suffixes.COVER for d in range(suffixes.MODULUS))


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)  # several blocks
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(180))
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 400)))
        if i % 3 == 0:
            a, n = rng.randrange(0, 120), rng.randrange(40, 80)
            t = t[:50] + passage[a:a + n] + t[50:] + passage[20:71]
        rows.append(doc(i * 7 % 61, t))
    rows += [doc(100, rows[3][1]), doc(101, rows[3][1]), doc(None, rows[6][1]), doc(102, None), doc(103, ""), doc(104, "x" * 49), doc(105, "x" * 50),
             doc(106, "x" * 5000), doc(107, "x" * 49), doc(108, "ab" * 2000), doc(100, rows[3][1]), doc(100, "other " + rows[9][1]), doc(-5, passage)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("n_bytes", F.lit("old")).withColumn("block", F.lit(1))
    got = suffixes.remove_repeats(docs)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_repeats(rows)
    cut = suffixes.apply_spans(docs.select("doc_id", "text").filter("doc_id between 0 and 60").join(got.select("doc_id", "spans", "kept_sha256"), "doc_id"))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in cut.collect())


def test_repeats_of_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    r = suffixes.remove_repeats(spark.createDataFrame([doc(1, None)], SCHEMA)).first()
    assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())


# ---------------------------------------------------------------------------------------------------------- line dedup

MASK = (1 << 64) - 1


def spark_hashes(spark, tokens):
    rows = spark.createDataFrame([(t,) for t in tokens], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    return {r["w"]: r["h"] & MASK for r in rows}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(words(rng, 40)) for _ in range(6)]
    rows = []
    for i in range(40):
        ls = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            ls.append((" ".join(w)).capitalize() + rng.choice(["", ".", "  "]))
        rows.append(doc(i, "\n".join(ls) + rng.choice(["", "\n", "\n\n---\n"])))
    rows += [doc(None, base[0]), doc(50, None), doc(51, ""), doc(52, "\n \n..."), doc(53, base[1] + "\n" + base[1]), doc(53, base[1]),
             doc(54, " ".join(f"v{i}" for i in range(1500))), doc(55, " ".join(f"v{i}" for i in range(1499)) + " other")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("pos", F.lit(1)).withColumn("node", F.lit("x"))
    got = lines.dedup_lines(docs).collect()

    norm = lambda x: re.sub(r"[^\w]+|_", " ", x.lower()).strip()
    every = [(i is None, i or 0, k, p, norm(x)) for k, (i, t, *_) in enumerate(rows) for p, x in enumerate((t or "").split("\n"))]
    every = [e for e in every if e[4]]
    hashes = spark_hashes(spark, {w for e in every for w in e[4].split(" ")})

    def sim(x):
        h = [hashes[w] for w in x.split(" ")]
        return sum(1 << b for b in range(60) if 2 * sum(v >> b & 1 for v in h) > len(h))

    nodes = sorted({e[4] for e in every})
    sims = {x: sim(x) for x in nodes}
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = 0
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if bin(sims[a] ^ sims[b]).count("1") <= 3 and distance(a, b) <= (max(len(a), len(b)) * 20) // 100:
                root[find(a)] = find(b)
                n_links += 1
    assert n_links > 20
    head = {}
    for e in sorted(every):
        head.setdefault(find(e[4]), e)
    want = {}
    for k, (i, *_) in enumerate(rows):
        mine = [e for e in every if e[2] == k]
        want[k] = (i, len(mine), [e[3] for e in mine if head[find(e[4])] != e])
    assert sorted(((r["doc_id"], r["n_lines"], r["removed"]) for r in got), key=str) == sorted(want.values(), key=str)
    assert all(r["n_removed"] == len(r["removed"]) for r in got)
    kept = lines.without_lines(docs.filter("doc_id = 52 or doc_id = 55").join(lines.dedup_lines(docs), "doc_id")).select("doc_id", "kept_text").collect()
    assert dict(map(tuple, kept))[52] == "\n \n..."


def test_lines_by_edits_equal_brute_force_on_edit_similarity(spark):
    """Changed words and typos, one to a fifth of the words: every group that edit similarity alone makes is found."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 11))) for _ in range(3000)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + w[i + 1:] or "x"])

    texts = []
    lengths = [1, 2, 3, 5, 10, 20, 40]
    for n_words in lengths * 10:
        base = [rng.choice(vocabulary) for _ in range(n_words)]
        texts.append(" ".join(base))
        for change in (typo, lambda w: rng.choice(vocabulary)):
            w = list(base)
            for k in rng.sample(range(n_words), rng.randrange(1, max(2, n_words // 5 + 1))):
                w[k] = change(w[k])
            texts.append(" ".join(w))
    texts += ["文" * 3 + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))]
    texts += [texts[-1][:30] + "文" + texts[-1][31:]]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs, by_edits=True).collect()}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            most = max(len(a), len(b)) * 20 // 100
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: int(find(i) != i) for i in range(len(texts))}
    assert got == want
    few = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    for n_words in (5, 10, 20, 40):  # three bits of the SimHash lose lines of every length
        mine = [i for i, t in enumerate(texts) if len(t.split()) == n_words]
        assert sum(few[i] for i in mine) < sum(want[i] for i in mine)


def test_every_block_scheme_finds_all_pairs():
    rng = random.Random(1)
    for nodes in (10, 10**7, 10**10, 10**13):
        masks = lines.block_masks(nodes)
        for _ in range(300):
            a = rng.getrandbits(60)
            b = a
            for _ in range(3):
                b ^= 1 << rng.randrange(60)
            assert any(a & m == b & m for m in masks)


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------------------------------------------ near duplicates

def brute_components(rows, width):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=str)


def near_copies(rng, n_groups=6, copies=25):
    rows = []
    for _ in range(n_groups):
        base = words(rng, rng.choice([3, 8, 30, 60, 200]), 5000)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, len(w) // 20, len(w) // 12, len(w) // 8])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
            rows.append(doc(len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = near_copies(rng)
    boiler = " ".join(words(rng, 30, 5000))  # a passage that many unlike documents share
    rows += [doc(1000 + i, boiler + " " + " ".join(words(rng, 60, 5000))) for i in range(40)]
    rows += [doc(2000, None), doc(2001, ""), doc(2002, " \n"), doc(2003, "one"), doc(2004, "ONE"), doc(2005, "one two"), doc(2006, "one two"),
             doc(2007, "a b " * 3000), doc(2008, "a b " * 2000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("node", F.lit("x")).withColumn("kept", F.lit("old"))
    got = minhash.near_duplicates(docs, width=width).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, width)


def test_near_duplicates_in_shares_equal_brute_force(spark, monkeypatch):
    """Many lists, tiles and cells beyond what goes at once: every share is worked on, with the same result."""
    rng = random.Random(3)
    rows = near_copies(rng, n_groups=5, copies=30)
    boiler = " ".join(words(rng, 30, 5000))
    rows += [doc(1000 + i, boiler + " " + " ".join(words(rng, 60, 5000))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    count, real = {}, minhash.staged

    def spy(df, name):
        count[name] = count.get(name, 0) + 1
        return real(df, name)

    monkeypatch.setattr(minhash, "staged", spy)
    want = brute_components(rows, 2)
    for name, value in (("DEALT", 0), ("FEW", 600), ("HELD", 1 << 40), ("TILE", 16), ("BLOCK", 16), ("SIDE", 32)):
        monkeypatch.setattr(minhash, name, value)
    assert sorted(map(tuple, minhash.near_duplicates(docs, width=2).collect()), key=str) == want
    assert count["blockpairs"] > 2 and count["celllinks"] > 1  # the shares and their union; the cells


def test_near_duplicates_with_null_and_repeated_rows(spark):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [doc(5, text), doc(5, text), doc(None, text), doc(9, text + " y"), doc(None, "alone"), doc(None, None), doc(7, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 49, 5, True), (5, 49, 5, True), (None, 49, 5, False), (9, 50, 5, False),
                                                        (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_pairs_reach_python_in_small_batches(spark, monkeypatch):
    seen, real = {}, minhash.staged

    def spy(df, name):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return real(df, name)

    monkeypatch.setattr(minhash, "staged", spy)
    rows = spark.createDataFrame([doc(i, "a b c d e f g h") for i in range(3)], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    minhash.near_duplicates(rows, width=2).collect()
    assert seen["links"] * 2 * minhash.BLOCK <= 2_000 < seen["signatures"] * 2 * minhash.BLOCK
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_near_copies_without_ids_are_linked(spark):
    base = [f"x{i}" for i in range(60)]
    rows = [doc(None, " ".join(base)), doc(None, " ".join(base + ["y"])), doc(5, " ".join(base + ["z"])), doc(None, "quite alone")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"] > 50 and r["doc_id"]) == [(5, 5, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None and r["n_shingles"] > 50] == [(5, False)] * 2


def test_first_rows_judge_texts_not_ids(spark):
    base = [f"x{i}" for i in range(60)]
    copy, other = " ".join(base + ["y"]), " ".join(f"q{i}" for i in range(40))
    rows = [doc(1, " ".join(base)), doc(7, copy), doc(7, other), doc(None, " ".join(base)), doc(None, copy), doc(9, other + " end", "t"),
            doc(3, "twice " * 30), doc(3, "twice " * 30), doc(4, None), doc(4, ""), doc(None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("component", F.lit("c"))
    got = minhash.first_rows(docs.repartition(3), width=5)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] and r["text"]) == [(1, " ".join(base)), (3, "twice " * 30), (7, other)]
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect() if not r["text"]) == sorted(["(4, None)", "(4, '')", "(None, None)"])
    assert minhash.first_rows(docs.filter("false")).count() == 0


def test_group_tasks_equal_brute_force():
    """The in-list comparison names every block pair with a possible link, the block check every link that matters."""
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 1 << 40, 120).astype(np.uint64))
    sets = []
    for k in range(30):
        keep = rng.random(120) > 0.06
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 40, 3).astype(np.uint64)])))
    found = minhash._block_links(list(range(30)), list(range(30)), sets, 30)
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def groups(pairs):
        root[:] = range(30)
        for a, b in pairs:
            root[find(a)] = find(b)
        return [find(x) for x in range(30)]

    true = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    same = lambda g: {(i, j) for i in range(30) for j in range(30) if g[i] == g[j]}
    assert true and same(groups(found)) == same(groups(true)) and set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, true)))
    members = [(k, k % 5, len(s), 11, (s[:32] & np.uint64((1 << 31) - 1)).astype(np.int64).tolist()) for k, s in enumerate(sets)]
    named = minhash._list_block_pairs(members, 32)
    assert all((min(i % 5, j % 5), max(i % 5, j % 5)) in named for i, j in true)


def test_long_lists_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    # One list of 400 members, 30 of them outside the largest component, and a short one.
    rows = [(1, i, 5, 0 if i >= 30 else i + 1) for i in range(400)] + [(2, i, 5, i % 2) for i in range(5)]
    lists = spark.createDataFrame(rows, "value long, node long, score long, label long")
    got = minhash._tiled(lists.join(minhash._mixed(lists), "value")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["value"], r["tile"], r["chunk"]), []).append(r)
    assert max(map(len, groups.values())) <= 4 * 16 and len(groups) > 25
    met = {(v, x["node"], y["node"]) for (v, _, _), g in groups.items() for x in g if x["role"] != 1 for y in g if y["role"] != 0}
    assert met == {(1, i, j) for i in range(30) for j in range(400)} | {(2, i, j) for i in (1, 3) for j in range(5)}
    # The result does not depend on the parts.
    made = near_copies(random.Random(5), 3, 30)
    docs = spark.createDataFrame(made, SCHEMA).repartition(4)
    assert sorted(map(tuple, minhash.near_duplicates(docs, width=2).collect()), key=str) == brute_components(made, 2)


def test_small_components_of_a_group_share_blocks_and_parts(spark):
    """Neither the block pairs nor the members dealt to parts grow with the square of a group of unlinked alike nodes."""
    n = 2000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(50).cast("long").alias("n"))
    judged = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.lit(40).cast("long").alias("inter"), F.lit(60).cast("long").alias("both"))
    grouped = spark.createDataFrame([(2 * i + j, 2 * i) for i in range(n // 2) for j in range(2)], "node long, component long")
    placed = minhash._placed(nodes, judged, grouped)
    blocks = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert sum(blocks) == n and len(blocks) <= 8 and max(blocks) <= 2 * minhash.BLOCK
    # A large component has blocks of its own, long sets make small blocks.
    grouped = spark.createDataFrame([(i, 0) for i in range(1000)], "node long, component long")
    placed = minhash._placed(nodes.withColumn("n", F.lit(5000).cast("long")), judged, grouped).collect()
    assert not {r["block"] for r in placed if r["label"] == 0} & {r["block"] for r in placed if r["label"] != 0}
    assert len({r["block"] for r in placed}) >= 16
    lists = spark.createDataFrame([(1, i, 5, i) for i in range(n)], "value long, node long, score long, label long")
    assert minhash._tiled(lists.join(minhash._mixed(lists), "value")).count() == n


def test_hubs_and_equal_lists_are_not_dealt(spark):
    """A hub has met its list; lists of the same other members are one, those of one component beside the hub are none."""
    rows = [(1, 1, 5, 1), (1, 2, 5, 2), (1, 9, 9, 9), (2, 1, 5, 1), (2, 2, 5, 2), (2, 8, 9, 8),
            (3, 1, 5, 1), (3, 3, 5, 1), (3, 9, 9, 9), (4, 1, 5, 1), (4, 9, 9, 9), (5, 1, 5, 1), (5, 2, 5, 2), (5, 4, 6, 2), (5, 9, 9, 2)]
    lists = spark.createDataFrame(rows, "value long, node long, score long, label long")
    got = {r["value"]: r for r in minhash._mixed(lists).collect()}
    assert set(got) == {1, 5} and (got[1]["hub"], got[1]["lead"]) == (9, 9)
    assert (got[5]["hub"], got[5]["major"], got[5]["tiles"], got[5]["chunks"]) == (9, 2, 1, 1)


def test_block_pairs_share_cells(spark, monkeypatch):
    """Blocks that all meet each other are sent once a cell, not once a pair, and every pair has its two blocks there."""
    monkeypatch.setattr(minhash, "SIDE", 100)
    n = 40
    pairs = {(x, y) for x in range(n) for y in range(x, n)} | {(100, 101)}
    block_pairs = spark.createDataFrame(sorted(pairs), "x long, y long")
    inside = block_pairs.selectExpr("explode(array(x, y)) as block").distinct().selectExpr("block", "10L as n", "explode(sequence(1, 10)) as node")
    cells = {}
    for r in minhash._in_cells(block_pairs, inside).collect():
        cells.setdefault((r["p"], r["q"]), {})[r["block"]] = r["others"]
    found = [(x, y) for held in cells.values() for x, others in held.items() for y in others]
    assert sorted(found) == sorted(pairs) and all(y in held for held in cells.values() for others in held.values() for y in others)
    assert sum(map(len, cells.values())) <= len(pairs) / 2


def test_block_links_between_two_blocks():
    """Only links across the two blocks count, also when the matrix is cut."""
    rng = np.random.default_rng(5)
    base = [np.sort(rng.integers(0, 1 << 40, 200).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[k % 3][rng.random(200) > 0.04], rng.integers(0, 1 << 40, 2).astype(np.uint64)])) for k in range(20)]
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    for width in (4096, 7):
        minhash.WIDTH, before = width, minhash.WIDTH
        try:
            found = minhash._block_links(list(range(20)), list(range(20)), sets, 8)
        finally:
            minhash.WIDTH = before
        assert found and all(i < 8 <= j and alike(i, j) for i, j in found)
        assert {x for p in found for x in p} == {x for i in range(8) for j in range(8, 20) if alike(i, j) for x in (i, j)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(20)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {x: find(x) for x in got} == got and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
