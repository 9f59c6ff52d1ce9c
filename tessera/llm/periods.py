"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q that is at least ``max(6, 4 * q)`` words long and that no neighbouring
word extends.  Texts of a batch are laid out as one sequence of word numbers, each text between separators of its own.

1. Recompression alternates two steps until one symbol is left.  Block compression replaces a maximal block c c ... c by
   one symbol (c, length); pair compression splits the symbols into left and right ones and replaces every left symbol
   followed by a right one by one symbol for the pair.  The levels are a run-length grammar of the sequence.  Where a
   symbol of a level begins depends on two neighbouring symbols below only, so equal stretches have equal levels inside.
2. The longest common extension of two places climbs the levels while the symbols agree, up to the borders of equal symbols,
   and descends to the first difference: a few steps a level, for all asked pairs of places at once.
3. Candidates stand on a harmonic grid: a run of period p covers four neighbouring multiples of p that hold the same word.
   For each of them the extensions to both sides of (place, place + p) give the exact stretch; a stretch of several
   candidate periods has the smallest of them.

The grid has n ln n places for n words, the grammar O(n) symbols; no suffix array is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, raw_texts

EXPONENT = 4
LEAST = 6
# Bytes of texts that share a grammar, and grid places looked at together.
BATCH_BYTES = 2_000_000
GRID = 1 << 20


# --------------------------------------------------------------------------------------------------------------- grammar

class Level:
    """Symbols of one level; ``width`` is the number of symbols below that each of them stands for (none at the bottom)."""

    def __init__(self, symbols: np.ndarray, width: np.ndarray | None, blocks: bool):
        self.symbols, self.width, self.blocks = symbols, width, blocks

    def mirrored(self) -> "Level":
        return Level(self.symbols[::-1].copy(), None if self.width is None else self.width[::-1].copy(), self.blocks)

    def link(self, below: "Level") -> None:
        """First child of every symbol; for every symbol below its parent and, with blocks, how many of its block are left."""
        ends = np.cumsum(self.width)
        self.child = ends - self.width
        below.parent = np.repeat(np.arange(len(self.width)), self.width)
        below.first = np.zeros(len(below.symbols), dtype=bool)
        below.first[self.child] = True
        below.left = ends[below.parent] - np.arange(len(below.symbols)) if self.blocks else None


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal small numbers."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grammar(words: np.ndarray) -> list[Level]:
    """Levels of the recompression from the words to a single symbol."""
    levels = [Level(words, None, False)]
    turn = 0
    while len(levels[-1].symbols) > 1:
        s = levels[-1].symbols
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(heads) < len(s):  # block compression; a level without blocks would only repeat the one below
            width = np.diff(np.append(heads, len(s)))
            s = _named(s[heads] * (int(width.max()) + 1) + width)
            levels.append(Level(s, width, True))
            if len(s) == 1:
                break
        # Pair compression: of a few random splits the one that joins most pairs.
        best = None
        for salt in range(3 * turn, 3 * turn + 3):
            right = (_mixed(s, salt) >> np.uint64(63)).astype(bool)
            joined = ~right[:-1] & right[1:]
            n = int(joined.sum())
            if best is None or n > best[0]:
                best = (n, joined)
        turn += 1
        if not best[0]:
            continue
        at = np.ones(len(s), dtype=bool)
        at[1:] = ~best[1]
        heads = np.flatnonzero(at)
        width = np.diff(np.append(heads, len(s)))
        second = np.where(width == 2, s[np.minimum(heads + 1, len(s) - 1)] + 1, 0)
        levels.append(Level(_named(s[heads] * (int(s.max()) + 2) + second), width, False))
    return levels


class Extensions:
    """Longest common extensions to the right over the levels of a grammar."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        for below, above in zip(levels, levels[1:]):
            above.link(below)

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from a and b on, a <> b; the sequence ends with a symbol that stands nowhere else."""
        start = a.copy()
        x, y = a.copy(), b.copy()
        stop = np.zeros(len(a), dtype=np.int64)
        going = np.arange(len(a))  # pairs that have met no difference yet
        for k, level in enumerate(self.levels):
            if not len(going):
                break
            s = level.symbols
            if k + 1 == len(self.levels):
                stop[going] = k
                break
            i, j = x[going], y[going]
            differ = np.zeros(len(going), dtype=bool)
            if self.levels[k + 1].blocks:
                differ = s[i] != s[j]
                p, q = level.left[i], level.left[j]
                step = np.where(differ, 0, np.minimum(p, q))
                i, j = i + step, j + step
                differ |= p != q
            else:
                for _ in range(2):
                    up = level.first[i] & level.first[j]
                    unequal = s[i] != s[j]
                    differ |= ~up & unequal
                    step = ~up & ~differ
                    i, j = i + step, j + step
                # After two equal symbols both places begin a symbol above.
            stop[going[differ]] = k
            x[going], y[going] = i, j
            going, i, j = going[~differ], i[~differ], j[~differ]
            x[going], y[going] = level.parent[i], level.parent[j]
        for k in range(len(self.levels) - 1, 0, -1):
            at = np.flatnonzero(stop >= k)
            if not len(at):
                continue
            level, below = self.levels[k], self.levels[k - 1]
            i, j = level.child[x[at]], level.child[y[at]]
            same = below.symbols[i] == below.symbols[j]
            step = np.where(same, np.minimum(below.left[i], below.left[j]) if level.blocks else 1, 0)
            x[at], y[at] = i + step, j + step
        return x - start


class Sequence:
    """Extensions to both sides in one sequence of words."""

    def __init__(self, words: np.ndarray):
        levels = grammar(words)
        self.n = len(words)
        self.right = Extensions(levels)
        self.left = Extensions([level.mirrored() for level in levels])

    def stretches(self, a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximal stretch [start, end) of period p around each place a with an equal word at a + p."""
        forward = self.right.lengths(a, a + p)
        backward = self.left.lengths(self.n - a, self.n - a - p)
        return a - backward, a + p + forward


# ------------------------------------------------------------------------------------------------------------------ runs

def _grid(sizes: np.ndarray, begins: np.ndarray, words: np.ndarray):
    """Yield (place, period): the grid places where a period's word stands at the place and three periods on."""
    tops = np.maximum(sizes // EXPONENT, 0)
    text = np.repeat(np.arange(len(sizes)), tops)
    period = np.arange(int(tops.sum())) - np.repeat(np.cumsum(tops) - tops, tops) + 1
    counts = (sizes[text] - 1) // period - (EXPONENT - 2)
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // GRID)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)]):
        c, p = counts[lo:hi], period[lo:hi]
        p_of = np.repeat(p, c)
        place = np.repeat(begins[text[lo:hi]], c) + (np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)) * p_of
        for step in range(1, EXPONENT):
            same = np.flatnonzero(words[place] == words[place + step * p_of])
            place, p_of = place[same], p_of[same]
        if len(place):
            yield place, p_of


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text (as word numbers from 0) its runs (start, length, period), ordered by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list] = [[] for _ in texts]
    if not len(texts) or not sizes.sum():
        return out
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    words = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    top = 1 + max(int(t.max()) for t in texts if len(t))
    words[np.concatenate([[0], begins + sizes])] = top + np.arange(len(texts) + 1)
    for b, t in zip(begins.tolist(), texts):
        words[b:b + len(t)] = t
    sequence, found = None, []
    for place, period in _grid(sizes, begins, words):
        if sequence is None:  # most batches without candidates need no grammar
            sequence = Sequence(words)
        start, end = sequence.stretches(place, period)
        good = end - start >= np.maximum(LEAST, EXPONENT * period)
        if good.any():
            found.append(np.unique(np.stack([start[good], end[good], period[good]], axis=1), axis=0))
    if not found:
        return out
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period: the smallest period of a stretch comes first
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    text = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows = np.stack([text, rows[:, 0] - begins[text], rows[:, 2], rows[:, 1] - rows[:, 0]], axis=1)
    for t, start, period, length in rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].tolist():
        out[t].append((start, length, period))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that stand in a run after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def periodic_runs(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed`` to every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``collapsed`` is the text without the words that a run holds after its
    first period, joined by one space.  A null text has no words, no runs and an empty ``collapsed``.  Rows are judged one by
    one, so repeated rows have equal results; columns of those three names are replaced; ``drop`` names columns to leave out.
    """
    def make():
        def part(column: pa.Array) -> list[tuple]:
            raw = raw_texts(pa.RecordBatch.from_arrays([column], names=["t"]), "t")
            words = [t.split() for t in raw]
            numbers = pa.array([w for t in words for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            ends = np.cumsum([len(w) for w in words])
            runs = find_runs(np.split(numbers, ends[:-1]))
            out = []
            for w, r in zip(words, runs):
                if r:
                    gone = dropped(len(w), r)
                    w = [x for x, g in zip(w, gone.tolist()) if not g]
                    out.append((len(gone), [{"start": s, "length": n, "period": p} for s, n, p in r], b" ".join(w).decode()))
                else:
                    out.append((len(w), [], b" ".join(w).decode()))
            return out

        def step(batch: pa.RecordBatch):
            column = batch.column(text_col)
            sizes = np.array(pc.fill_null(pc.binary_length(column), 0).to_pylist(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1).tolist(), len(column)]
            rows = [r for a, b in zip(cuts[:-1], cuts[1:]) if b > a for r in part(column.slice(a, b - a))]
            pa.default_memory_pool().release_unused()
            return [list(c) for c in zip(*rows)]
        return step
    return append_columns(docs, make, [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                                       T.StructField("collapsed", T.StringType())], drop=drop)


def strongest(runs: str = "runs"):
    """The run of the greatest length / period, compared exactly; of equal ones the first in start, then period; null without runs."""
    def better(best, r):
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast(_RUN)
    return F.aggregate(F.col(runs), none, better)
