"""Substring dedup by relative Lempel-Ziv parsing.

A window is ``LENGTH`` consecutive words of one document; a word goes if a window over it also starts earlier (in a document
of a smaller id, or earlier in the same one).  To compare only texts that can share a window, texts are cut into pieces:

1. Pieces.  Every window has a route: the least hash of the runs of ``GRAM`` words in it.  Equal windows have equal routes, so
   a piece, a stretch of windows of one route, must be compared with the pieces of that route alone.  A map task keeps the
   first of equal pieces and answers the others at once, so a passage of a third of all documents leaves a task once.
2. Reference blocks.  All pieces of a route, in the order of (id, start), form its reference block: each piece is factored
   greedily against the indexed pieces before it.  A factor begins where a phrase of ``LENGTH`` words stands in the index and
   goes on as long as the words agree with the indexed place; shorter factors can't hold a window and are passed over word by
   word.  Windows across the end of a factor are checked on their own.  Then the piece's new phrases join the index.
   Phrases are compared as words, in a code that gives every word its own bytes: hashes only route, they never decide.
3. Spans.  The factors are windows that start earlier; their words, merged per document, are the spans to remove.

A sample of the documents, bounded in its results, decides how windows travel, not what is found: its most frequent words get
codes of two bytes (every other word is written out), and routes that very many pieces share (a common phrase with ever other
words around it) are known beforehand; their windows are routed one by one, by a hash of all their words, so that no route
gathers more than equal windows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, arrow_rows, raw_texts, release, staged

LENGTH = 20
GRAM = 4
# Windows of a piece at most: a longer stretch of one route (a repeated word) becomes several pieces.
PIECE_WINDOWS = 64
# Bytes of normalised text that a map step holds in arrays, and words of a part of a very long text.
BATCH_BYTES = 2_000_000
PART_WORDS = 400_000
# One document in SAMPLE is looked at.  Routes with HOT sampled pieces or more are hot, MOST_HOT of them at most; CODES words
# of at most CODED_BYTES bytes get short codes.
SAMPLE, HOT, MOST_HOT = 64, 64, 200_000
CODES, CODED_BYTES = 0xFF00, 40
_NO_ID = (1 << 63) - 1  # a null id stands after every other
# An odd base of the hashes and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------------------------------------------------------- pieces

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Code:
    """Bytes for words: two for a frequent word, the first below 0xFF; else 0xFF, the length in four bytes, and the word."""

    def __init__(self, frequent: list[bytes]):
        self.frequent = pa.array(frequent, pa.binary())
        self.short = pa.array([k.to_bytes(2, "big") for k in range(len(frequent))], pa.binary())

    def __call__(self, words: pa.Array) -> pa.Array:
        of = words.dictionary_encode()
        n = len(of.dictionary)
        head = np.full((n, 5), 0xFF, dtype=np.uint8)
        head[:, 1:] = pc.binary_length(of.dictionary).to_numpy().astype(">u4").view(np.uint8).reshape(n, 4)
        heads = pa.Array.from_buffers(pa.binary(5), n, [None, pa.py_buffer(head.tobytes())]).cast(pa.binary())
        written = pc.binary_join_element_wise(heads, of.dictionary, pa.scalar(b"", pa.binary()))
        codes = pc.coalesce(self.short.take(pc.index_in(of.dictionary, value_set=self.frequent)), written)
        return codes.cast(pa.large_binary()).take(of.indices)


def borders(text: bytes) -> list[int]:
    """Where the words of a coded text begin, and its end."""
    if b"\xff" not in text[::2]:  # no word is written out before the first place where one could stand
        return list(range(0, len(text) + 1, 2))
    out, at = [0], 0
    while at < len(text):
        at += 5 + int.from_bytes(text[at + 1:at + 5], "big") if text[at] == 0xFF else 2
        out.append(at)
    return out


class Words:
    """Coded words of several texts in one buffer; ``text`` is the text of each word and ``at`` its number there."""

    def __init__(self, text: np.ndarray, at: np.ndarray, words: pa.Array, code: Code):
        self.text, self.at = text, at
        coded = code(words)
        cuts = np.frombuffer(coded.buffers()[1], dtype=np.int64)[:len(coded) + 1]
        self.data = coded.buffers()[2].to_pybytes()[:int(cuts[-1])]
        self.starts, self.ends = cuts[:-1], cuts[1:]
        flat = np.frombuffer(self.data, dtype=np.uint8)
        # Prefix sums of bytes times powers of an odd base: the hash of any stretch is a difference, shifted back.
        self._sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(flat)), out=self._sums[1:])
        self._back = _powers(_BACK, len(flat) + 1)

    def hashes(self, at: np.ndarray, words: int) -> np.ndarray:
        """Hash of ``words`` words from each word on."""
        a, b = self.starts[at], self.ends[at + words - 1]
        return _mixed((self._sums[b] - self._sums[a]) * self._back[a])

    def windows(self, length: int) -> np.ndarray:
        """Words at which a window of one text begins."""
        n = len(self.text) - length + 1
        return np.flatnonzero(self.text[:n] == self.text[length - 1:]) if n > 0 else np.zeros(0, dtype=np.int64)

    def slices(self, at: np.ndarray, words: np.ndarray) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + words - 1].tolist())]


def pieces(w: Words, length: int, hot: np.ndarray):
    """(first word, number of windows, route, whether a window stands in it twice) of the pieces.

    Windows of a hot route are pieces of their own.
    """
    at = w.windows(length)
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(bool)
    gram = min(GRAM, length)
    grams = w.hashes(np.arange(len(w.text) - gram + 1), gram)
    # Least hash of the grams of each window, by doubling.
    span, least, width = length - gram + 1, grams, 1
    while width * 2 <= span:
        least, width = np.minimum(least[:len(least) - width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    route, phrase = least[at], w.hashes(at, length)
    head = np.ones(len(at), dtype=bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (route[1:] != route[:-1])
    if len(hot):
        single = hot[np.minimum(np.searchsorted(hot, route), len(hot) - 1)] == route
        head |= single
        head[1:] |= single[:-1]
        route = np.where(single, phrase, route)
    run = np.flatnonzero(head)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    head |= place % PIECE_WINDOWS == 0
    run = np.flatnonzero(head)
    # Equal hashes next to each other in order of hash and place: if a piece has two of them, they are neighbours there.
    order = np.argsort(phrase, kind="stable")
    piece = (np.cumsum(head) - 1)[order]
    twice = np.zeros(len(run), dtype=bool)
    twice[piece[1:][(phrase[order][1:] == phrase[order][:-1]) & (piece[1:] == piece[:-1])]] = True
    return at[run], np.diff(np.append(run, len(at))), route[run], twice


def _parts(batch: pa.RecordBatch, length: int):
    """Yield (row of each word, its number in the text, words): as many texts as BATCH_BYTES hold, at most PART_WORDS words.

    Parts of a longer stretch of words overlap by a window less one word, so each window lies in one part.
    """
    column = batch.column("text")
    sizes = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_BYTES)) + 1).tolist(), len(column)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lists = pc.ascii_split_whitespace(column.slice(a, b - a))
        words, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        real = pc.binary_length(words).to_numpy() > 0
        if not real.all():  # blanks at the ends of a text
            words, ends = words.take(pa.array(np.flatnonzero(real))), np.concatenate([[0], np.cumsum(real)])[ends]
        counts = np.diff(ends)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(text)) - ends[:-1][text]
        for k in range(0, len(text) - length + 1, PART_WORDS - length + 1):
            yield a + text[k:k + PART_WORDS], at[k:k + PART_WORDS], words.slice(k, PART_WORDS)


# ``place`` holds the first word of a piece, whether a window stands in it twice, and the number of its windows.
_PIECE = T.StructType([T.StructField("route", T.LongType()), T.StructField("id", T.LongType()), T.StructField("key", T.LongType()),
                       T.StructField("place", T.LongType()), T.StructField("text", T.BinaryType())])
_TWICE, _SHIFT = 128, 256


def _routed(length: int, frequent: list[bytes], hot: np.ndarray):
    """Pieces of a batch; of equal ones all but the first carry no text and a route by document: their windows start earlier."""
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, code = to_arrow_schema(_PIECE), Code(frequent)
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for part in _parts(batch, length):
                w = Words(*part, code)
                at, windows, route, twice = pieces(w, length, hot)
                if not len(at):
                    continue
                row, start = w.text[at], w.at[at]
                text = pa.array(w.slices(at, windows + length - 1), pa.binary()).dictionary_encode()
                number = text.indices.to_numpy()
                order = np.lexsort((start, keys[row], ids[row], number))
                n, r = number[order], row[order]
                head = np.ones(len(n), dtype=bool)
                head[1:] = n[1:] != n[:-1]
                first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
                # An equal piece of a smaller id or of the same document stands before it; a repeated row is the same piece again.
                f = row[first]
                own = (ids[r] == ids[f]) & (keys[r] == keys[f])
                later = np.zeros(len(at), dtype=bool)
                later[order] = ~head & ((ids[f] < ids[r]) | (own & (start[order] > start[first])))
                again = np.zeros(len(at), dtype=bool)
                again[order] = ~head & own & (start[order] == start[first])
                keep = np.flatnonzero(~again)
                gone = later[keep]
                row, start, windows, route = row[keep], start[keep], windows[keep] + _TWICE * twice[keep], route[keep].astype(np.int64)
                route = np.where(gone, keys[row] ^ start, route)
                shown = text.dictionary.take(pa.array(np.where(gone, 0, number[keep]), mask=gone))
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(ids[row]), pa.array(keys[row]),
                                                  pa.array(start * _SHIFT + windows), shown], schema=schema)
            pa.default_memory_pool().release_unused()
    return run


def _sampled_routes(length: int, frequent: list[bytes]):
    def run(batches):
        code = Code(frequent)
        for batch in batches:
            for part in _parts(batch, length):
                _, _, route, _ = pieces(Words(*part, code), length, np.zeros(0, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(route.astype(np.int64))], names=["route"])
    return run


# --------------------------------------------------------------------------------------------------------------- parsing

class Reference:
    """Indexed pieces of a route: every phrase of ``length`` words with the place where it first stood."""

    def __init__(self, length: int):
        self.length, self.index = length, {}
        self.now, self.own, self.waiting = None, {}, {}

    def turn(self, document: tuple) -> None:
        """Pieces of ``document`` (id, key) come next; phrases of smaller ids and of its own count, not those of equal ids."""
        if document == self.now:
            return
        if self.now is not None:
            for phrase, place in self.own.items():
                self.waiting.setdefault(phrase, place)
            if document[0] != self.now[0]:
                for phrase, place in self.waiting.items():
                    self.index.setdefault(phrase, place)
                self.waiting = {}
        self.now, self.own = document, {}

    def parse(self, text: bytes) -> list[tuple[int, int]]:
        """Factors of at least ``length`` words of the piece, as (first word, end), and of the windows across their ends."""
        at, length = borders(text), self.length
        out, s, n = [], 0, len(at) - 1
        while s + length <= n:
            phrase = text[at[s]:at[s + length]]
            place = self.index.get(phrase) or self.own.get(phrase)
            if place is None:
                self.own[phrase] = (text, at, s)
                s += 1
                continue
            there, its, o = place
            e, o = s + length, o + length
            while e < n and o + 1 < len(its) and there[its[o]:its[o + 1]] == text[at[e]:at[e + 1]]:
                e, o = e + 1, o + 1
            out.append((s, e))
            # Windows across the end of the factor, one by one: a known one begins the next factor.
            s = e - length + 1
        return out


def _factored(length: int):
    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

        def rows():
            for batch in batches:
                # A piece alone on its route, without a window that stands in it twice, has no factor; the ends of a batch may go on.
                route, place = batch.column("route").to_numpy(), batch.column("place").to_numpy()
                near = np.ones(len(route), dtype=bool)
                near[1:-1] = (route[1:-1] == route[:-2]) | (route[1:-1] == route[2:])
                near |= (place % _SHIFT >= _TWICE) | batch.column("text").is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(near))
                yield from zip(*(batch.column(c).to_pylist() for c in ("route", "id", "key", "place", "text")))

        def parsed(block, i, key, place, text):
            block.turn((i, key))
            start = place // _SHIFT
            return [(i, key, start + s, start + e) for s, e in block.parse(text)]

        out = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            block, first, last = None, None, None
            for _, *piece in group:
                i, key, place, text = piece
                if text is None:  # an equal piece stands earlier
                    out.append((i, key, place // _SHIFT, place // _SHIFT + place % _TWICE + length - 1))
                elif first is None:
                    first = last = piece
                elif last[:3] != piece[:3]:  # else the same piece of a repeated row
                    if block is None:
                        block = Reference(length)
                        out += parsed(block, *first)
                    last = piece
                    out += parsed(block, *piece)
            if first is not None and block is None and first[2] % _SHIFT >= _TWICE:
                out += parsed(Reference(length), *first)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


# ----------------------------------------------------------------------------------------------------------------- spans

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ones."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return list(zip(spans[head, 0].tolist(), np.maximum.reduceat(spans[:, 1], np.flatnonzero(head)).tolist()))


def _cut():
    def step(batch: pa.RecordBatch):
        n_words, spans, kept = [], [], []
        starts, ends = (batch.column(c) for c in ("_starts", "_ends"))
        for i, raw in enumerate(raw_texts(batch, "text")):
            words = raw.split()
            found = []
            if starts[i].is_valid:
                found = _merged(np.stack([starts[i].values.to_numpy(), ends[i].values.to_numpy()], axis=1))
                at = [0, *(x for s in found for x in s), len(words)]
                left = [x for a, b in zip(at[::2], at[1::2]) for x in words[a:b]]
            else:
                left = words
            n_words.append(len(words)), spans.append([{"start": a, "end": b} for a, b in found]), kept.append(b" ".join(left).decode())
        pa.default_memory_pool().release_unused()
        return [n_words, spans, kept]
    return step


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``length`` words over it also starts in a document
    of a smaller id, or earlier in the same document; windows are judged on the input.  ``spans`` are the maximal removed runs
    of words, ``kept`` the other words joined by one space.  A null text has no words; a null id counts as greater than every
    other; rows of equal ids but other texts don't judge each other; repeated rows are one document and have equal results.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumn("key", F.xxhash64("text"))
    sample = keyed.filter(F.pmod(F.xxhash64("id", "key"), F.lit(SAMPLE)) == 0).select("text")
    words = sample.select(F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).filter((F.octet_length("word") <= CODED_BYTES) & (F.col("word") != ""))
    # The tops are written first: a collected top sends one list per partition to the driver.
    top = lambda df, n, name: staged(df.groupBy(*df.columns).count().orderBy(F.col("count").desc(), *df.columns).limit(n), name).collect()
    frequent = [r["word"].encode() for r in top(words, CODES, "codes")]
    routes = sample.mapInArrow(_sampled_routes(length, frequent), "route long")
    hot = np.sort(np.array([r["route"] for r in top(routes, MOST_HOT, "hot") if r["count"] >= HOT], dtype=np.int64).astype(np.uint64))
    sent = keyed.select("id", "key", "text").mapInArrow(_routed(length, frequent, hot), _PIECE)
    ordered = sent.repartition("route").sortWithinPartitions("route", "id", "key", "place")
    with arrow_rows(spark, 2000):
        found = staged(ordered.mapInArrow(_factored(length), "id long, key long, start long, end long"), "factors")
    del sent, ordered
    release(spark)
    per_document = (found.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("f"))
                    .select("id", "key", F.col("f.start").alias("_starts"), F.col("f.end").alias("_ends")))
    whole = keyed.join(per_document, ["id", "key"], "left").select(F.col("doc").alias(id_col), "text", "_starts", "_ends")
    cut = append_columns(whole, _cut, [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("kept", T.StringType())],
                         drop=("text", "_starts", "_ends"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(id_col, "n_words", removed.alias("n_removed"), "spans", "kept")
