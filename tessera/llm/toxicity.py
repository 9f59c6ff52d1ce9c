"""Toxicity by a lexicon trie and Levenshtein automata, with context windows around every hit.

The lexicon is learned from labelled rows: whole terms, and stems that any ending may follow.  The trie of terms is
intersected with the Levenshtein automaton of one edit (for terms of five letters and more); the product is made
deterministic state by state as texts ask for it, so a word is read once whatever the number of terms.  Hits inside
quotation marks or next to reporting words count apart from plain abuse; a logistic model weighs the counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, fit_rows, give_back, logistic, texts

# Bounds of the fit sample: labelled rows per class and characters per text.
FIT_ROWS, FIT_CHARS = 2000, 20_000
FUZZY_LENGTH = 5
STEM_LENGTHS = range(4, 9)
STEM_LIFT = 6
CONTEXT = 5
# Bounds of a task's memory: words whose match is remembered, bytes of texts at once.
KNOWN_WORDS, STEP_BYTES = 100_000, 4_000_000
THRESHOLD = 0.5

_TOKEN = re.compile(r"[^\W_]+")
_QUOTE = re.compile("[\"“”„«»‘’]")
# Fixed words that report somebody's speech.
_REPORT = frozenset("said says say quoted quote called calls wrote writes word words term slur insult "
                    "sagte sagt schrieb wort dit écrit mot dijo dice palabra".split())

# Per kind of hit: count outside quotations, their density in the text, count inside quotations.
FEATURES = [f"{what}_{kind}" for kind in ("term", "stem", "fuzzy") for what in ("plain", "density", "quoted")]


class Lexicon:
    """Terms (whole words) and stems (any ending) in one trie; state and edges of the automaton are made on demand."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = sorted(terms), sorted(stems)
        self.edges: list[dict[str, int]] = [{}]
        self.term_end: list[bool] = [False]
        self.stem_end: list[bool] = [False]
        self.fuzzy: list[bool] = [False]  # on the way to a term that may be misspelled
        self.fuzzy_end: list[bool] = [False]  # the end of one
        for words, ends in ((self.terms, self.term_end), (self.stems, self.stem_end)):
            for w in words:
                at, path = 0, [0]
                for c in w:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        for flags in (self.term_end, self.stem_end, self.fuzzy, self.fuzzy_end):
                            flags.append(False)
                    at = self.edges[at][c]
                    path.append(at)
                ends[at] = True
                if ends is self.term_end and len(w) >= FUZZY_LENGTH:
                    self.fuzzy_end[at] = True
                    for node in path:
                        self.fuzzy[node] = True
        self.alphabet = {c for e in self.edges for c in e}
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []  # per state: letter to state; letters outside the alphabet share one move
        self.end_kind: list[int] = []  # what a word that ends here is
        self.stem_kind: list[bool] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closure({(0, 0)}))

    def _state(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            exact = any(e == 0 and self.term_end[n] for n, e in states)
            near = any(e == 1 and self.fuzzy_end[n] for n, e in states)
            self.end_kind.append(1 if exact else 3 if near else 0)
            self.stem_kind.append(any(e == 0 and self.stem_end[n] for n, e in states))
        return self.numbers[states]

    def _closure(self, states: set[tuple[int, int]]) -> frozenset:
        """States (trie node, edits); a left-out letter moves on in the trie without reading."""
        out = set(states)
        for node, edits in states:
            if edits == 0 and self.fuzzy[node]:
                out.update((nxt, 1) for nxt in self.edges[node].values() if self.fuzzy[nxt])
        return frozenset(out)

    def _move(self, states: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, edits in states:
            nxt = self.edges[node].get(c)
            if nxt is not None and (edits == 0 or self.fuzzy[nxt]):
                out.add((nxt, edits))
            if edits == 0 and self.fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out.update((x, 1) for d, x in self.edges[node].items() if d != c and self.fuzzy[x])  # another letter
        return self._closure(out)

    def match(self, word: str) -> int:
        """0: no hit, 1: a term, 2: a stem with any ending, 3: a term with one edit."""
        state, dead, moves, stem = self.start, self.dead, self.next, False
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._state(self._move(self.sets[state], c if c in self.alphabet else ""))
                if len(moves[state]) < 5000:
                    moves[state][c] = nxt
            state = nxt
            if state == dead:
                return 2 if stem else 0
            stem = stem or self.stem_kind[state]
        kind = self.end_kind[state]
        return 2 if stem and kind != 1 else kind


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def hits(text: str, found: dict[str, int], context: int = CONTEXT) -> list[dict]:
    """Every hit with its span in the text's lower-case form, its kind, and whether its context quotes it.

    A hit is quoted if a quotation mark stands within ``context`` words before it and another within as many after it,
    or if a reporting word does on either side.
    """
    low = text.lower()
    spans = [m.span() for m in _TOKEN.finditer(low)]
    words = [low[a:b] for a, b in spans]
    out = []
    for k, w in enumerate(words):
        kind = found.get(w, 0)
        if kind:
            i, j = max(0, k - context), min(len(words), k + context + 1)
            before, after = low[spans[i][0]:spans[k][0]], low[spans[k][1]:spans[j - 1][1] + 1]
            quoted = bool(_QUOTE.search(before) and _QUOTE.search(after)) or any(x in _REPORT for x in words[i:j])
            out.append({"start": spans[k][0], "end": spans[k][1], "kind": kind, "quoted": quoted})
    return out


def features(found_hits: list[dict], n_words: int) -> list[float]:
    n = Counter((h["quoted"], h["kind"]) for h in found_hits)
    out = []
    for k in (1, 2, 3):
        plain = n[False, k]
        out += [np.log1p(plain), np.log1p(1000 * plain / max(1, n_words)), np.log1p(n[True, k])]
    return [float(x) for x in out]


def count_terms(sets: list[set[str]]) -> Counter:
    """Texts that hold a whole word, for the words of three letters and more."""
    return Counter(w for words in sets for w in words if len(w) >= 3)


def count_stems(sets: list[set[str]], least: int) -> Counter:
    """Texts with a longer word that begins like this, for the beginnings of STEM_LENGTHS letters.

    A beginning is counted only if its own beginnings stand in ``least`` texts or more: longer ones cannot stand in more.
    So the many beginnings of rare words never fill the driver.
    """
    out: Counter = Counter()
    for n in STEM_LENGTHS:
        shorter = n - 1 if n - 1 in STEM_LENGTHS else 0
        found = Counter(s for words in sets for s in {w[:n] for w in words if len(w) > n and (not shorter or w[:shorter] in out)})
        out.update({s: k for s, k in found.items() if k >= least})
    return out


def unlike(sets: list[set[str]], share: float = 0.5) -> list[set[str]]:
    """The sets without near copies: one goes if it shares over ``share`` of its rare words with one set kept before.

    Copies of a text would lend support to every word in it.  Rare words stand in at most one set in twenty.
    """
    spread = Counter(w for x in sets for w in x)
    most = max(3, len(sets) // 20)
    owners: dict[str, list[int]] = {}
    kept = []
    for x in sets:
        rare = [w for w in x if spread[w] <= most]
        common = Counter(k for w in rare for k in owners.get(w, ()))
        if common and max(common.values()) > share * len(rare):
            continue
        for w in rare:
            owners.setdefault(w, []).append(len(kept))
        kept.append(x)
    return kept


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]]) -> Lexicon:
    """Terms and stems that mark toxic texts beyond chance.

    A whole word needs 19 toxic texts for a clean one, and support that no candidate would reach by chance with
    probability over 0.01 (base rate to the power of the support, times the candidates).  A stem may also begin some
    clean words: it has to be ``STEM_LIFT`` times as frequent in toxic as in clean texts, six standard deviations over
    what the clean texts predict, and seen with several endings.  A stem stands for all terms and stems it begins.
    """
    toxic, clean = unlike(toxic), unlike(clean)
    whole = {w: n for w, n in count_terms(toxic).items() if n >= 3}
    begun = count_stems(toxic, 3)
    clean_words = count_terms([words & whole.keys() for words in clean])
    against = Counter(s for words in clean for s in {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n} if s in begun)
    base = len(toxic) / max(1, len(toxic) + len(clean))
    least = 1 + int(np.ceil(np.log(0.01 / max(1, len(whole) + len(begun))) / np.log(base))) if 0 < base < 1 else 3
    words = {t for t, n in whole.items() if n >= max(3, least) and 19 * clean_words[t] <= n}
    stems = set()
    for t, n in begun.items():
        expected = (against[t] + 1) * len(toxic) / max(1, len(clean))
        if n >= max(3, least) and n >= STEM_LIFT * expected and n - expected >= 6 * np.sqrt(expected + 1):
            stems.add(t)
    # A stem that one whole word accounts for is that word: other endings are hardly seen with it.
    stems -= {s for w in words for k in STEM_LENGTHS if (s := w[:k]) in stems and 2 * whole[w] >= begun[s]}
    stems = {s for s in stems if not any(s[:n] in stems for n in range(min(STEM_LENGTHS), len(s)))}
    return Lexicon([t for t in words if not any(t[:n] in stems for n in STEM_LENGTHS)], list(stems))


class Model:
    """A lexicon and the weights of the hit counts."""

    def __init__(self, terms: list[str], stems: list[str], weights: np.ndarray):
        self.terms, self.stems, self.weights = terms, stems, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> Model:
    """Fit lexicon and weights on a bounded sample of the learning folds, each distinct text once.

    Without toxic or without clean rows no term is learned and the score is the share of label 1 (0.5 without labels).
    """
    sample, y, counts = fit_rows(docs, labels, label, per_class, max_chars, id_col, text_col)
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / total if total else 0.5
    rows = list(dict.fromkeys(zip(sample, y)))
    once: dict[str, str] = {}  # a word is kept once, however many texts hold it
    sets = [[{once.setdefault(w, w) for w in words_of(t)} for t, c in rows if c == k] for k in (0, 1)]
    lexicon = learn_lexicon(sets[1], sets[0])
    del sets, once
    x = []
    for t, _ in rows:
        words = words_of(t)
        x.append(features(hits(t, {w: k for w in set(words) if (k := lexicon.match(w))}), len(words)))
    target = [c for _, c in rows]
    n = Counter(target)
    weight = [(prior if c else 1 - prior) * len(rows) / n[c] for c in target]
    if not (n[0] and n[1]):
        weights = np.zeros(len(FEATURES) + 1)
        weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    else:
        weights = logistic(x, target, weight, ridge=1e-4)
    model = Model(lexicon.terms, lexicon.stems, weights)
    del sample, rows, lexicon, x
    give_back()  # the driver goes on with the other stages
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, spans: bool = False,
          drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``, with ``spans`` also the hits; null and empty texts are scored too."""
    fields = [T.StructField("score", T.DoubleType())]
    if spans:
        hit = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                            T.StructField("kind", T.LongType()), T.StructField("quoted", T.BooleanType())])
        fields.append(T.StructField("hits", T.ArrayType(hit)))

    def make():
        lexicon = Lexicon(model.terms, model.stems)
        known: dict[str, int] = {}

        def step(batch: pa.RecordBatch):
            x, all_hits = [], []
            for t in texts(batch, text_col):
                words = words_of(t)
                distinct = set(words)
                for w in distinct.difference(known):
                    known[w] = lexicon.match(w)
                found = {w: k for w in distinct if (k := known[w])}
                h = hits(t, found) if found else []
                x.append(features(h, len(words)))
                all_hits.append(h)
                if len(known) > KNOWN_WORDS:
                    known.clear()
            out = [pa.array(model.scores(np.array(x).reshape(-1, len(FEATURES))))]
            return [*out, all_hits] if spans else out
        return step

    scored = append_columns(docs, make, fields, drop=drop, step_bytes=STEP_BYTES)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
