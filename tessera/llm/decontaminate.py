"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of every text.

Texts are lower-cased (A-Z) and reduced to their words; a pattern is a window of 13 consecutive item words (or the
whole item, if shorter).  To the automaton a word is two letters, the digits of its number in the benchmark, of two
alphabets (any other word is two letters of neither): matches start and end at word borders, a window takes 26 nodes at
most, and no node has more children than the root of the number of words.  Matches are word positions, mapped back to
character offsets of the original text.

Long items are cut into pieces that overlap by a window less one word, and the pieces are dealt to as many automata as
their bytes ask for.  One automaton at a time passes the driver and lives in a task: several are scanned in jobs of their
own, and what they found is staged in between.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, drop_staged, raw_texts, staged

WINDOW = 13
# A document is contaminated if at least one word in 20 is hit.
SHARE = 20
# Bytes of benchmark words that one automaton takes on average; a larger benchmark is scanned in several automata.
AUTOMATON_BYTES = 2_000_000
# Bytes of rows that a task scans at once.
STEP_BYTES = 1_000_000
# Windows of a piece of an item.
PIECE_WINDOWS = 4096

# Bytes to the words' alphabet: A-Z in lower case; other ASCII except 0-9 and a-z to blanks; the rest unchanged.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_PIECE = T.StructType([T.StructField("item", T.StringType()), T.StructField("piece", T.BinaryType())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_pieces(text: bytes, window: int = WINDOW, windows: int = PIECE_WINDOWS) -> list[bytes]:
    """The item's words in pieces that together hold each of its windows once, and no others."""
    words = words_of(text)
    return [b" ".join(words[lo:lo + windows + window - 1]) for lo in range(0, max(1, len(words) - window + 1), windows)] if words else []


_OTHER = "\0\0"


def automaton(items: list[tuple[str, bytes]], window: int):
    """(automaton, letters of the words): patterns to (number of words, items); None without a pattern.

    Equal windows of several items share one pattern, patterns of the same items one value.
    """
    import ahocorasick

    letters = dict.fromkeys(w for _, text in items for w in words_of(text))
    base = math.isqrt(len(letters)) + 1
    for i, w in enumerate(letters):
        letters[w] = chr(1 + i // base) + chr(1 + base + i % base)
    owners: dict[str, tuple[str, ...]] = {}
    shared: dict[tuple, tuple] = {}
    for name, text in sorted(items):
        words = [letters[w] for w in words_of(text)]
        for i in range(max(1, len(words) - window + 1)) if words else ():
            w = "".join(words[i:i + window])
            had = owners.get(w, ())
            if not had or had[-1] != name:  # names come in order
                grown = (*had, name)
                owners[w] = shared.setdefault(grown, grown)
    found = ahocorasick.Automaton()
    for w, names in owners.items():
        value = (len(w) // 2, names)
        found.add_word(w, shared.setdefault(value, value))
    found.make_automaton()
    return (found, letters) if owners else None


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(machine, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words (start, end) and the items found, from one pass over the text."""
    found, letters = machine
    runs, items = [], set()
    for last, (n, names) in found.iter("".join([letters.get(w, _OTHER) for w in words_of(text)])):
        end = (last + 1) // 2
        runs.append((end - n, end))
        items.update(names)
    return merged(runs), items


def char_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    ends = [m.span() for m in _WORD.finditer(text)]
    cuts, at, chars = {}, 0, 0
    for b in sorted({x for a, z in runs for x in (ends[a][0], ends[z - 1][1])}):
        chars += len(text[at:b].decode("utf-8", "replace"))
        at, cuts[b] = b, chars
    return [{"start": cuts[ends[a][0]], "end": cuts[ends[z - 1][1]]} for a, z in runs]


def _pieces_of(window: int):
    def run(batches):
        for batch in batches:
            for item, body in zip(batch.column("item").to_pylist(), raw_texts(batch, "body")):
                pieces = item_pieces(body, window)
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(pieces), pa.string()), "piece": pa.array(pieces, pa.binary())})
    return run


def _free(name: str, taken: list[str]) -> str:
    """A working column's name that no input column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def _scanned(machine, batch: pa.RecordBatch, text_col: str, runs_col: str, items_col: str):
    """Yield (text, runs, items found) of the rows, with what scans before this one found in them."""
    for text, r0, i0 in zip(raw_texts(batch, text_col), batch.column(runs_col).to_pylist(), batch.column(items_col).to_pylist()):
        r, i = scan(machine, text) if machine and text else ([], set())
        yield text, merged(r + list(zip(r0[::2], r0[1::2]))) if r0 else r, sorted(i | set(i0))


def _scan_columns(items: list[tuple[str, bytes]], window: int, text_col: str, runs_col: str, items_col: str):
    def make():
        machine = automaton(items, window)

        def step(batch: pa.RecordBatch):
            found = list(_scanned(machine, batch, text_col, runs_col, items_col))
            return [[[x for y in runs for x in y] for _, runs, _ in found], [names for _, _, names in found]]
        return step
    return make


def _last_scan(items: list[tuple[str, bytes]], window: int, text_col: str, runs_col: str, items_col: str):
    """The last scan gives the results at once: one Python worker a task instead of one for the scan and one for them."""
    def make():
        machine = automaton(items, window)

        def step(batch: pa.RecordBatch):
            out = [[], [], [], [], [], []]
            for text, runs, names in _scanned(machine, batch, text_col, runs_col, items_col):
                n, hit = len(words_of(text)), sum(z - a for a, z in runs)
                row = (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                       hit > 0 and SHARE * hit >= n, char_spans(text, runs))
                for column, x in zip(out, row):
                    column.append(x)
            return out
        return step
    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
                  drop: tuple[str, ...] = ()) -> DataFrame:
    """Add hit counts, the items found, the verdict and the hit spans (characters) to every row of ``docs``.

    The benchmark's size is measured first: up to ``automaton_bytes`` go into one automaton and one scan.  A larger
    benchmark's pieces are dealt by a hash to as many automata as needed, scanned over the texts one job after the other
    (every text meets every piece).  Null texts have no words and no hits; items without words or without an id are no
    items; repeated items count once.  Columns named in ``drop`` are not returned; of the others only those that are
    named like a result are replaced.
    """
    rows = (benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body"))
            .filter(F.col("item").isNotNull() & F.col("body").isNotNull()).distinct())
    pieces = staged(rows.mapInArrow(_pieces_of(window), _PIECE), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece") + F.octet_length("item"))).first()[0] or 0
    slices = 1 + size // automaton_bytes
    runs_col, items_col = _free("_runs", docs.columns), _free("_items", docs.columns)
    fields = [T.StructField(runs_col, T.ArrayType(T.LongType())), T.StructField(items_col, T.ArrayType(T.StringType()))]
    found = docs.withColumns({runs_col: F.array().cast("array<long>"), items_col: F.array().cast("array<string>")})
    for k in range(slices):
        before = found if k else None
        part = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(slices)) == k).collect()
        args = ([(r["item"], bytes(r["piece"])) for r in part], window, text_col, runs_col, items_col)
        if k == slices - 1:
            found = append_columns(found, _last_scan(*args), FIELDS, drop=(runs_col, items_col, *drop), step_bytes=STEP_BYTES)
        else:
            found = staged(append_columns(found, _scan_columns(*args), fields, step_bytes=STEP_BYTES), "scanned")
            if before is not None:
                drop_staged(before)
    drop_staged(pieces)
    return found
