"""Toxicity: misspelled and inflected terms found by Levenshtein automata over a lexicon trie, weighed by context.

Learning: words and word beginnings that training rows labelled toxic use far
more often than the others make up the lexicon; a small logistic regression turns
the hits of a text into a probability. Scoring: the automata of all terms are
intersected with the trie of the lexicon and made deterministic as words arrive,
so that one step a character decides whether a word is a term, a term with one
edit, or neither. Each hit is weighed by the words around it: quotation marks,
speech verbs and lexicon-free second-person address separate a quoted term from
abuse. A text is scored as a whole; labels, language, source and id are no inputs.

Defined results: a null or empty text has no hit, and a text without a hit scores
at most 0.49; repeated rows score alike; without labels of both kinds the lexicon
is empty and every text scores the share of toxic labels, at most 0.49; an empty
table gives no rows; further columns are kept by `reject` and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import shared_dir, sized, stored

#: Labelled rows of each kind that the lexicon and the regression are fitted on (a sample by hash), and most terms of the lexicon.
FIT_ROWS = 20_000
MAX_TERMS = 5_000
#: A term occurs in so many toxic training rows at least, and in so many times more of their share than of the others'.
MIN_ROWS, MIN_LIFT = 3, 30.0
STEMS = (4, 5, 6)
#: Shortest term that matches with one edit.
FUZZY_LENGTH = 5
#: Words whose verdict a Python worker remembers.
REMEMBERED = 200_000
#: Words on each side of a hit that make its context.
WINDOW = 8
#: Speech verbs and quotation marks.
SPEECH = frozenset("said says wrote writes quote quoted quotes called calls named termed word term phrase sagte schrieb dit écrit dijo escribió".split())
QUOTES = "\"“”„«»‹›"
TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]")
DEAD = -1
#: Highest score of a text without a hit.
NO_HIT = 0.49


class TrieAutomaton:
    """The intersection of the terms' Levenshtein automata with their trie, made deterministic on demand.

    A state is the set of (trie node, edits so far) that the characters read so
    far can stand for. Stems accept any word that begins with them, without edits.
    """

    def __init__(self, words: list[str], stems: list[str], benign: frozenset[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, int] = {}
        self.stem_end: set[int] = set()
        self.deep: list[int] = [0]
        self.benign = benign
        for term, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.deep.append(0)
                node = self.children[node][c]
                if not stem and len(term) >= FUZZY_LENGTH:
                    self.deep[node] = self.deep[0] = 1  # some term below allows an edit
            if stem:
                self.stem_end.add(node)
            else:
                self.word_end[node] = len(term)
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[float] = []
        self.start = self.state(self.closed({(0, 0)}))

    def closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Add what one deleted character allows."""
        out = set(pairs)
        for node, edits in pairs:
            if not edits and self.deep[node]:
                out.update((x, 1) for x in self.children[node].values() if self.deep[x])
        return frozenset(out)

    def state(self, pairs: frozenset) -> int:
        if not pairs:
            return DEAD
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            best = max((2 - edits for node, edits in pairs if node in self.word_end and (not edits or self.word_end[node] >= FUZZY_LENGTH)), default=0)
            self.found.append(3.0 if any(node in self.stem_end and not edits for node, edits in pairs) else best)
        return self.ids[pairs]

    def move(self, state: int, c: str) -> int:
        nxt = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None and (not edits or self.deep[child]):
                nxt.add((child, edits))
            if not edits and self.deep[node]:
                nxt.add((node, 1))  # c is inserted
                nxt.update((x, 1) for x in self.children[node].values() if self.deep[x])  # c stands for another
        exact = {node for node, edits in nxt if not edits}
        to = self.state(self.closed({(node, edits) for node, edits in nxt if not edits or node not in exact}))
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int:
        """2 for a term or a word that begins with a stem, 1 for a term with one edit, 0 otherwise."""
        state = self.start
        for c in word:
            state = self.moves[state][c] if c in self.moves[state] else self.move(state, c)
            if state == DEAD:
                return 0
            if self.found[state] == 3.0:
                return 2
        got = int(self.found[state])
        return 0 if got == 1 and word in self.benign else got


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    benign: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)


FEATURES = ("hits", "weighed hits", "strongest", "share of words", "quoted hits", "length")


class Scorer:
    """Features of whole texts under a lexicon."""

    def __init__(self, model: Model) -> None:
        self.automaton = TrieAutomaton(model.words, model.stems, model.benign)
        self.seen: dict[str, int] = {}

    def features(self, text: str | None) -> list[float]:
        tokens = TOKEN.findall((text or "").lower())
        seen, match = self.seen, self.automaton.match
        for w in set(tokens).difference(seen):
            seen[w] = match(w)
        grades = {w: seen[w] for w in set(tokens) if seen[w]} if tokens else {}
        if len(seen) > REMEMBERED:
            seen.clear()
        hits = [(k, grades[w]) for k, w in enumerate(tokens) if w in grades] if grades else []
        weighed = strongest = quoted = 0.0
        for k, grade in hits:
            around = tokens[max(0, k - WINDOW) : k], tokens[k + 1 : k + 1 + WINDOW]
            marks = [sum(w in QUOTES for w in side) for side in around]
            cited = 0.6 * (marks[0] > 0 and marks[1] > 0) + 0.3 * any(w in SPEECH for side in around for w in side)
            near = sum(w in grades for side in around for w in side)
            w = (1.0 if grade == 2 else 0.7) * (1 - cited) * (1 + 0.25 * min(near, 4))
            weighed, strongest, quoted = weighed + w, max(strongest, w), quoted + (cited > 0)
        n = len(tokens)
        return [np.log1p(len(hits)), np.log1p(weighed), strongest, np.log1p(1000 * len(hits) / n) if n else 0.0, np.log1p(quoted), np.log1p(n) / 10]


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of rows to learn from: those whose crc32(doc_id as text) mod 5 is not 0.

    Of each kind about FIT_ROWS are taken, by a hash of the id.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, FIT_ROWS / counts.get(True, 1))).otherwise(min(1.0, FIT_ROWS / counts.get(False, 1)))
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", "text").join(sized(chosen, row_bytes=24), "doc_id")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn_terms(rows: DataFrame, positives: int, negatives: int) -> tuple[list[str], list[str]]:
    """Words and stems of the lexicon: of the terms that tell toxic rows, the shortest that explain the others."""
    words = F.filter(F.array_distinct(F.split(folded(F.col("text")), r"[^\p{L}]+")), lambda w: F.char_length(w) >= 3)

    def begun(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [begun(n) for n in STEMS]
    terms = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = ((F.col("a") + 0.5) / (positives + 1)) / ((F.col("b") + 0.5) / (negatives + 1))
    strong = counted.where((F.col("a") >= MIN_ROWS) & (lift >= MIN_LIFT))
    top = [(r["term"], r["a"]) for r in strong.orderBy(F.desc("a"), "term").limit(MAX_TERMS).collect()]  # the bound of the lexicon
    rows_of = dict(top)
    stems_kept: list[str] = []
    for s in sorted((t[:-1] for t in rows_of if t.endswith("*")), key=len):
        if not any(s.startswith(x) for x in stems_kept):
            stems_kept.append(s)
    words_kept = sorted(w for w in rows_of if not w.endswith("*"))
    # A stem that only one of the words accounts for adds nothing but that word.
    own = {s: max((rows_of[w] for w in words_kept if w.startswith(s)), default=0) for s in stems_kept}
    stems_kept = sorted(s for s in stems_kept if own[s] < 0.8 * rows_of[s + "*"])
    return [w for w in words_kept if not any(w.startswith(s) for s in stems_kept)], stems_kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the lexicon and fit the regression on the training rows."""
    shared_dir(docs.sparkSession)
    rows = stored(training_rows(docs, labels), "toxicity-sample")
    counts = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positives, negatives = counts.get(True, 0), counts.get(False, 0)
    if not positives or not negatives:
        share = min(NO_HIT, positives / max(1, positives + negatives))
        return Model(weights=[0.0] * len(FEATURES) + [float(np.log((share + 1e-6) / (1 - share)))], mean=[0.0] * len(FEATURES))
    words, stems = learn_terms(rows, positives, negatives)
    model = Model(words, stems)
    columns = ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for x in frames:
            got = np.array([scorer.features(t) for t in x["text"]], float).reshape(-1, len(FEATURES))
            near = [sorted({w for w in TOKEN.findall((t or "").lower()) if scorer.automaton.match(w) == 1}) if f[0] else [] for t, f in zip(x["text"], got, strict=True)]
            yield pd.DataFrame(got, columns=[f"f{k}" for k in range(len(FEATURES))]).assign(toxic=x["toxic"].to_numpy(), near=near)

    table = rows.select("text", "toxic").mapInPandas(featured, f"{columns}, toxic int, near array<string>").toPandas()  # at most 2 x FIT_ROWS rows in expectation
    # Words one edit away from a term that mark no toxic rows are themselves, not misspellings.
    seen: dict[str, list[int]] = {}
    for near, toxic in zip(table["near"], table["toxic"], strict=True):
        for w in near:
            seen.setdefault(w, [0, 0])[int(toxic)] += 1
    model.benign = frozenset(w for w, (b, a) in seen.items() if b and a <= 3 * b)
    x, y = table[[f"f{k}" for k in range(len(FEATURES))]].to_numpy(), table["toxic"].to_numpy().astype(float)
    hit_by_benign_only = np.array([bool(len(n)) and all(w in model.benign for w in n) for n in table["near"]]) & (y == 0)
    x[hit_by_benign_only, :5] = 0.0
    model.mean, model.weights = regression(x, y)
    return model


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[list[float], list[float]]:
    """Logistic regression by Newton steps with a ridge on all weights but the last, the intercept."""
    mean = x.mean(axis=0)
    a = np.column_stack([x - mean, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean.tolist(), w.tolist()


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the score of each whole text."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        w, mean = np.array(model.weights), np.array(model.mean)
        for x in texts:
            f = np.array([scorer.features(t) for t in x], float).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip((f - mean) @ w[:-1] + w[-1], -30, 30)))
            yield pd.Series(np.where(f[:, 0] > 0, p, np.minimum(p, NO_HIT)))

    return scored(docs[text])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)
    return docs.where(score(docs, model) < 0.5)
