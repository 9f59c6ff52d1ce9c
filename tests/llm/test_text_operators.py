"""Decontamination, quality rules, toxicity, compression classifier, chat format and token shards on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, compression, decontaminate, quality_rules, queries, tokens, toxicity
from tessera.llm.common import held_out

LONG = "lorem ipsum dolor " * 20_000


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def doc(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


# ----------------------------------------------------------------------------------------------------- decontamination

def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for name, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in body or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == w[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def test_decontaminate_equals_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (2, "Short item!"), (10, item), (3, None), (4, "..."), (None, "nothing"), (1, item), (5, "é ß 日本")]
    texts = [item.upper(), "a " * 300 + item, "w0 w1, SHORT\n\nitem w2", None, "", "...", " ".join(f"w{i}" for i in range(7, 20)) + " x",
             " ".join(f"w{i}" for i in range(8, 20)), "x é, ß; 日本 short item", item + " " + item, LONG, "shortitem", "É ß 日本"]
    docs = frame(spark, [doc(i, t) for i, t in enumerate(texts)] + [doc(None, item), doc(3, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench).collect()
    assert len(out) == len(texts) + 2
    named = [(str(i), t) for i, t in items if i is not None]
    for r in out:
        n, hit, found = brute_hits(r["text"], named)
        found = sorted(set(found))
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found)), r["doc_id"]
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        for s in r["spans"]:
            assert r["text"][s["start"]] not in " .,;" and r["text"][s["end"] - 1] not in " .,;"
    # several automata give the same answer as one
    cut = decontaminate.decontaminate(docs, bench, automaton_bytes=40).select("doc_id", "n_hit", "items_sha256", "spans")
    assert sorted(map(str, cut.collect())) == sorted(str(r) for r in decontaminate.decontaminate(docs, bench).select("doc_id", "n_hit", "items_sha256", "spans").collect())


def test_decontaminate_takes_one_python_worker_a_task(spark):
    docs = frame(spark, [doc(1, "a b c"), doc(2, None)])
    bench = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    for size in (10_000, 4):
        plan = decontaminate.decontaminate(docs, bench, automaton_bytes=size)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_decontaminate_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, [doc(1, "a b c")]).withColumn("n_hit", F.lit("old")).withColumn("_runs", F.lit(1)).withColumn("extra", F.lit(2))
    bench = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.decontaminate(docs, bench).first()
    assert (r["n_hit"], r["contaminated"], r["extra"]) == (0, False, 2)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_decontaminate_pieces_hold_each_window_once():
    words = [b"w%d" % i for i in range(57)]
    for n in (0, 1, 12, 13, 14, 25, 57):
        pieces = decontaminate.item_pieces(b" ".join(words[:n]), 13, 10)
        cut = [p.split()[i:i + 13] for p in pieces for i in range(max(1, len(p.split()) - 12))]
        assert cut == ([words[:n][i:i + 13] for i in range(max(1, n - 12))] if n else [])


def test_decontaminate_long_items_and_working_names(spark, monkeypatch):
    """Items of many pieces in several automata equal brute force; columns named like working columns stay."""
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 5)
    monkeypatch.setattr(decontaminate.item_pieces, "__defaults__", (13, 5))
    words = [f"v{i % 37}" for i in range(60)]
    items = [("a", " ".join(words)), ("b", " ".join(words[20:45])), ("c", "v1 v2")]
    texts = [" ".join(words[10:50]), " ".join(words[30:]) + " x " + " ".join(words[:13]), "v1 v2", " ".join(words[:12]), "x y z"]
    docs = (frame(spark, [doc(i, t) for i, t in enumerate(texts)])
            .withColumn("_runs", F.lit(7)).withColumn("_items", F.lit("mine")).withColumn("__runs", F.lit(8)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (10_000, 150):
        out = decontaminate.decontaminate(docs, bench, automaton_bytes=size).collect()
        assert len(out) == len(texts)
        for r in out:
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (lambda n, h, f: (n, h, len(set(f))))(*brute_hits(r["text"], items))
            assert (r["_runs"], r["_items"], r["__runs"]) == (7, "mine", 8)


# ------------------------------------------------------------------------------------------------------- quality rules

def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n\t#|1é\u00a0\u2028", max_size=120))
def test_measures_equal_brute_force(text):
    got = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    want = brute_measures(text)
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want


def test_ledger_policies_and_ablation(spark):
    texts = ["one two three four five six seven eight nine ten eleven", "few words", None, "", "# " * 30, "a b c d e " * 10, LONG,
             "same line here\n" * 6 + "other words in this text are many enough"]
    docs = frame(spark, [doc(i, t) for i, t in enumerate(texts)] + [doc(0, texts[0])]).withColumn("failures", F.lit("old"))
    ledger = quality_rules.ledger(docs)
    rows = {r["doc_id"]: r for r in quality_rules.apply_policy(ledger, "v2").collect()}
    assert rows[0]["kept"] and rows[0]["failures"] == 0
    assert not rows[1]["kept"] and not rows[2]["kept"] and not rows[3]["kept"] and not rows[4]["kept"] and not rows[5]["kept"]
    for r in rows.values():  # each bit is its rule
        for rule in quality_rules.RULES:
            want = eval(rule.fails.replace("AND", "and"), {m: r[m] for m in quality_rules.MEASURES})  # noqa: S307
            assert bool(r["failures"] >> rule.bit & 1) == want
    ablation = {r["rule"]: r for r in quality_rules.ablation(ledger, "v2").collect()}
    failures = [r["failures"] for r in ledger.collect()]
    whole = quality_rules.mask(quality_rules.POLICIES["v2"])
    for rule in quality_rules.RULES:
        a = ablation[rule.name]
        assert a["n_failed"] == sum(f >> rule.bit & 1 for f in failures)
        assert a["n_kept_without"] == sum(f & (whole & ~(1 << rule.bit)) == 0 for f in failures)
    assert quality_rules.apply_policy(quality_rules.ledger(docs.limit(0))).count() == 0


# ------------------------------------------------------------------------------------------------------------ toxicity

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcx", max_size=9))
def test_lexicon_equals_brute_force(word):
    terms, stems = ["abcab", "abc", "cabbage", "bbbbb"], ["cacb", "abca"]
    kind = toxicity.Lexicon(terms, stems).match(word)
    if word in terms:
        want = 1
    elif any(word.startswith(s) for s in stems):
        want = 2
    else:
        want = 3 if any(len(t) >= toxicity.FUZZY_LENGTH and edits(word, t) == 1 for t in terms) else 0
    assert kind == want


def test_context_tells_quotes_from_abuse():
    found = {"scum": 1}
    assert [h["quoted"] for h in toxicity.hits('he said "you scum" to me', found)] == [True]
    assert [h["quoted"] for h in toxicity.hits("you are scum and all that", found)] == [False]
    assert [h["quoted"] for h in toxicity.hits('a "scum b c d e f g h', found)] == [False]


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, 30))
        toxic = i % 5 == 0
        if toxic:
            words.insert(5, ["moronic", "scumbag", "vileness", "vileone"][i // 5 % 4])
        bad = i % 3 == 0
        text = " | ".join(words) if bad else " ".join(words) + "."
        rows.append(doc(i, text))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.withColumn("held", held_out()).join(labels, "doc_id").filter("held").select("predicted", label).collect()
    assert len(rows) > 40
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity_learns_and_scores_everything(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert {"moronic", "scumbag"} <= set(model.terms)
    more = docs.union(frame(spark, [doc(None, None), doc(1000, ""), doc(1001, LONG), doc(1002, "you moronix thing"), doc(1003, "plain words")]))
    scored = toxicity.score(more.withColumn("score", F.lit("old")), model, spans=True)
    assert accuracy(scored, labels, "toxic") > 0.9
    rows = {r["doc_id"]: r for r in scored.filter("doc_id is null or doc_id >= 1000").collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[1000]["predicted"] == 0 and rows[None]["predicted"] == 0
    assert [(h["start"], h["kind"]) for h in rows[1002]["hits"]] == [(4, 3)]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 40)
    for module in (toxicity, compression):
        model = module.fit(docs, labels.limit(0))
        assert {round(r["score"], 6) for r in module.score(docs, model).collect()} == {0.5}
    one = labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(None).cast("int"))
    assert all(r["predicted"] == 1 for r in compression.score(docs, compression.fit(docs, one)).collect())
    assert toxicity.fit(docs, one).terms == []


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = compression.fit(docs, labels), compression.fit(docs, flipped)
    assert a.good == b.good and np.array_equal(a.weights, b.weights)


# -------------------------------------------------------------------------------------------------- compression classes

def test_compression_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = compression.fit(docs, labels)
    more = docs.union(frame(spark, [doc(None, None), doc(2000, ""), doc(2001, LONG)])).withColumn("predicted", F.lit("old"))
    scored = compression.score(more, model)
    assert accuracy(scored, labels, "quality") > 0.9
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert compression.score(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------------------------------------------------- chat format

TEXT = st.text(alphabet="\\#</turn>\n Aé", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "\\n###"]), TEXT), max_size=5), st.integers(1, 7))
def test_format_round_trip(turns, step):
    pieces = list(chat.compile_template()({"role": r, "text": t} for r, t in turns))
    text = "".join(p for p, _ in pieces)
    assert list(chat.read_turns([text])) == turns
    assert list(chat.read_turns([text[i:i + step] for i in range(0, len(text), step)])) == turns
    assert "".join(chat.unescape(p) for p, m in pieces if m) == "".join(t for r, t in turns if r == "assistant")


def test_template_language():
    run = lambda source, **scope: "".join(p for p, _ in chat.generator(chat.fold_nodes(chat.parse(source)))(scope))
    assert run("a{{ 'b' + 'c' | upper }}{% if x == 1 and not y %}yes{% else %}no{% endif %}", x=1, y=0) == "abCyes"
    assert run("{% for i in xs %}<{{ i.n }}>{% endfor %}", xs=[{"n": 1}, {"n": 2}]) == "<1><2>"
    assert chat.fold_nodes(chat.parse("x{{ 'a' + 'b' }}{% if 1 == 2 %}never{% endif %}y")) == [("text", "xaby")]
    for bad in ("{% for x %}{% endfor %}", "{% if x %}", "{{ x.__class__ }}", "{{ x | eval }}", "{% endif %}", "{{ open('f') }}", "{{ }}", "{{ x[0] }}"):
        with pytest.raises(chat.TemplateError):
            run(bad, x={})
    with pytest.raises(chat.TemplateError):
        run("{{ x.real }}", x=1)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (3, None, None, "###"), (3, 0, "assistant", "</turn>\n"),
            (None, 0, "user", "x"), (4, 0, "assistant", LONG), (4, 1, "assistant", "end"), (5, 0, "user", "u"), (5, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_conversations(turns, piece_chars=100)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == conv), key=lambda r: (r[0] is not None, r))
        loss = "".join(x for _, ro, x in mine if ro == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in mine).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = "".join(p for p, _ in chat.compile_template()({"role": ro, "text": x} for _, ro, x in mine))
        assert r["formatted_chars"] == len(text)
    pieces = formatted.filter("conv_id = 4").orderBy("piece").collect()
    assert len(pieces) == 2 and pieces[1]["start"] == len(pieces[0]["text"])
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# ---------------------------------------------------------------------------------------------------------- token shards

def test_piece_encoder_equals_the_library():
    path = queries.tokenizer_path()
    import pyarrow as pa

    fast, plain = tokens.word_encoder(path), tokens.plain_encoder(path)
    odd = ["a<|endoftext|>b C", "<|ENDOFTEXT|> <|endoftext|>", "don't WE'RE I'll X'S 12a3 a_b", "Ωσ Σ İx ŉ ſ naïve", "日本 😀 a\tb\x1cc", "", None,
           "  \n\n ", "l'été 's't. End. a., b", "e\u0301 \u00e9 a\u00a0b", LONG] + [f"{chr(c)}x{chr(c).upper()} {chr(c)}. {chr(c)}" for c in range(1, 0x250)]
    column = pa.array(odd, pa.string())
    for text, a, b in zip(odd, fast(column), plain(column)):
        assert a.tolist() == b.tolist(), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_piece_encoder_on_any_text(texts):
    import pyarrow as pa

    path = queries.tokenizer_path()
    column = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
    assert [x.tolist() for x in tokens.word_encoder(path)(column)] == [x.tolist() for x in tokens.plain_encoder(path)(column)]


def test_new_pieces_are_encoded_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "FRESH_PIECES", 3)
    monkeypatch.setattr(tokens, "MEMORY_PIECES", 12)
    encoder = tokens.PieceIds(queries.tokenizer_path())
    plain = tokens.plain_encoder(queries.tokenizer_path())
    for k in range(4):  # pieces of the memory, new ones, and those that find no room there
        column = pa.array([" ".join(f"word{k * j}a Éte{j}," for j in range(k + 3)), None, "", "word0a\n\nword0a"])
        assert [x.tolist() for x in encoder.encode(column)] == [x.tolist() for x in plain(column)]
    assert 0 < len(encoder.known) <= 12


@pytest.mark.parametrize("codes", ["own", "all equal"])
def test_known_pieces_are_found_by_their_text(monkeypatch, codes):
    import pyarrow as pa

    if codes != "own":
        monkeypatch.setattr(tokens, "_codes", lambda pieces: np.zeros(len(pieces), dtype=np.uint64))
    encoder = tokens.PieceIds(queries.tokenizer_path())
    plain = tokens.plain_encoder(queries.tokenizer_path())
    asked, real = [], encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda pieces: asked.extend(pieces) or real(pieces))
    first = pa.array(["one two,$$$ three!! it's&&& one's ~two~ " + "long" * 40 + "|", "", None])
    second = pa.array(["x", "two three.% one### " + "long" * 40 + " three&&&* it's. ('ve)) d's]] o''re"]).slice(1)
    for column in (first, second, first):
        assert [x.tolist() for x in encoder.encode(column)] == [x.tolist() for x in plain(column)]
    if codes == "own":  # signs at the end are pieces of their own, and no piece is encoded again
        assert {"two", ",$$$", "three", "!!"} <= set(asked) and len(asked) == len(set(asked)) == len(encoder.known)


def test_shards_round_trip(spark, tmp_path):
    texts = ["hello world", "", None, LONG, "hello world", "ünïcode 日本"] + [f"text number {i} of many" for i in range(300)]
    rows = [doc(i * 3 % 1001, t) for i, t in enumerate(texts)] + [doc(None, "no id"), doc(0, "hello world"), doc(0, "another text")]
    docs = frame(spark, rows).repartition(5)
    path = str(tmp_path / "shards")
    tokens.write_tokens(docs, path, queries.encoder, 2, 2, shard_bytes=2000)
    import pyarrow as pa

    plain = tokens.plain_encoder(queries.tokenizer_path())
    want = {}
    for i, t, *_ in rows:
        ids = [*plain(pa.array([t], pa.string()))[0].tolist(), 2]
        want.setdefault(i, []).append(ids)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert ids.tolist() in want[r["doc_id"]]
        at += len(ids)
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    # one document by the offset index alone
    meta = spark.read.parquet(f"{path}/meta").first()
    shards = spark.read.parquet(f"{path}/shards").orderBy("shard").collect()
    assert len(shards) > 3 and [s["before"] for s in shards] == [sum(x["n_ids"] for x in shards[:k]) for k in range(len(shards))]
    image = bytes(shards[-1]["image"])
    ids, counts, *_ = tokens.shard_index(image, bytes(meta["dictionary"]))
    assert tokens.read_document(image, len(ids) - 1, bytes(meta["dictionary"]), 2).tolist() in want[ids[-1]]
    if meta["dictionary"]:
        with pytest.raises(ValueError):
            tokens.shard_index(image, b"another dictionary")


def test_shards_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "empty")
    tokens.write_tokens(frame(spark, []), path, queries.encoder, 2)
    assert tokens.read_tokens(spark, path).count() == 0


def test_stem_counts_equal_plain_counts():
    """Beginnings counted length by length are those of a plain count that stand in enough texts."""
    import random
    from collections import Counter
    from tessera.llm.toxicity import STEM_LENGTHS, count_stems, count_terms

    r = random.Random(5)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(300)] + ["äöüßé", "", "abab"]
    sets = [set(r.sample(words, r.randint(0, 12))) for _ in range(80)] + [set()]
    plain = Counter(s for x in sets for s in {w[:n] for w in x for n in STEM_LENGTHS if len(w) > n})
    for least in (1, 2, 3, 9):
        assert count_stems(sets, least) == {s: k for s, k in plain.items() if k >= least}
    assert count_stems([], 3) == {} and count_terms(sets) == Counter(w for x in sets for w in x if len(w) >= 3)
