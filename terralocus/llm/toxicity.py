"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, resolves compatibility forms, accents and homoglyphs, and
reads digits and signs that stand in for letters inside words. What is no
letter becomes one space, so a lexicon entry is ` word ` (the whole word) or
` stem` (any word that begins so). One automaton finds entries and exception
phrases; an entry within an exception counts nothing, and of several entries at
one place the heaviest counts. The weights found are summed and divided by the
number of words, and a logistic curve over both gives the score.

Weights are log odds of the entry in labelled documents; exceptions are words
that begin with a stem but stand in clean documents. Label, language, source
and id are never inputs of a score.

Defined results: null, empty and wordless texts get the score of a text without
hits; ids with several labels count as toxic if one label says so, null labels
and labels without a document are ignored; without toxic examples only the
built-in entries with built-in weights are used. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import bucket_of, staged, whole_text

# Labelled rows that a fit uses at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# A learned entry stands in this share of the toxic examples, at least so many, and has these log odds.
SUPPORT_SHARE, SUPPORT, LOG_ODDS = 0.02, 6, 3.0
STEM = range(4, 9)

# Built-in entries, exception phrases, and look-alike signs.
BUILT_IN = ["idiot", "stupid", "moron", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown"]
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "circus clown", "clown fish", "sore loser", "rodeo clown", "pond scum"]
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "ð": "d"})
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

STANDS_IN = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<![\w@$])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?![\w@$])")
NO_LETTER = re.compile(r"[\W\d_]+")
INVISIBLE = re.compile("[­​-‏⁠﻿]+")


def fold(text: str) -> str:
    """Folded words, one space before and after each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        text = text.lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    text = STANDS_IN.sub(lambda m: "".join(DIGITS[c] for c in m.group()), text)
    return f" {NO_LETTER.sub(' ', text).strip()} "


def entries(folded: str) -> set[str]:
    """Entries that a text could give: its words and their stems."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(" " + word[:n] for n in STEM if n <= len(word))
    return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    # of 1, log(1 + weight found), log(1 + weight per hundred words)
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _machine: object = None

    @property
    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), None))
            self._machine.make_automaton()
        return self._machine

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def found(self, folded: str) -> float:
        """Sum of the weights of a folded text."""
        best, spared = {}, []
        if not len(self.machine):
            return 0.0
        for end, (length, weight) in self.machine.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, end)
        return sum(w for start, (w, end) in best.items() if not any(a <= start and end <= b for a, b in spared))

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        weight = self.found(folded)
        return math.log1p(weight), math.log1p(100 * weight / max(folded.count(" ") - 1, 1))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def built_in() -> Model:
    return Model({f" {w} ": 4.0 for w in BUILT_IN}, [f" {p} " for p in EXCEPTIONS])


def examples(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(folded, toxic) of at most `rows` labelled documents outside the held-out part, distinct texts only."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels without a document take no place in the bounded sample
    known = known.filter(bucket_of("doc_id", FOLDS) != HELD_OUT).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id")  # `rows` bounds it

    def run(batches):
        for batch in batches:
            folded = [fold(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), batch.column(1).cast(pa.int64())], ["folded", "toxic"])

    once = texts.groupBy(F.md5("text").alias("key")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"))
    return staged(once.select("text", "toxic").mapInArrow(run, "folded string, toxic bigint"), "toxicity-examples")


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(entry, n): in how many rows of `folded` an entry stands."""
    def run(batches):
        counts = Counter()
        for batch in batches:
            for folded in batch.column(0).to_pylist():
                counts.update(entries(folded) if wanted is None else entries(folded) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

    return rows.select("folded").mapInArrow(run, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Entries, exceptions and curve from labelled documents; everything collected is bounded by `rows`."""
    train = examples(docs, labels, rows)
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    model = built_in()
    if not toxic or not clean:
        return model
    least = max(SUPPORT, math.ceil(SUPPORT_SHARE * toxic))
    bad = {r["entry"]: r["n"] for r in _counted(train.filter("toxic = 1"), None).filter(F.col("n") >= least).collect()}
    good = {r["entry"]: r["n"] for r in _counted(train.filter("toxic = 0"), set(bad) | set(model.weights)).collect()}
    odds = lambda e: math.log((bad.get(e, 0) + 0.5) / (toxic + 1)) - math.log((good.get(e, 0) + 0.5) / (clean + 1))
    learned = {e: odds(e) for e in bad if odds(e) >= LOG_ODDS}
    kept = {e: w for e, w in model.weights.items() if odds(e) > 0 or e not in good}  # labels may speak against a built-in entry
    model = Model({**kept, **learned}, model.exceptions)
    # words of clean documents that a learned stem would hit
    stems = {e for e in learned if not e.endswith(" ")}
    spared = set()
    if stems:
        words = _clean_words(train, stems).collect()
        spared = {r["entry"] for r in words if r["clean"] >= 2 and r["clean"] > r["toxic"]}
    model.exceptions = sorted({*model.exceptions, *spared})
    model.curve = _curve(train, model)
    return model


def _clean_words(train: DataFrame, stems: set[str]) -> DataFrame:
    """(entry, clean, toxic) of the whole words below a stem."""
    def run(batches):
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for folded, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(label > 0)].update(f" {w} " for w in set(folded.split()) if any(" " + w[:n] in stems for n in STEM if n <= len(w)))
        words = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[0][w] for w in words], pa.int64()),
                                          pa.array([counts[1][w] for w in words], pa.int64())], ["entry", "clean", "toxic"])

    found = train.mapInArrow(run, "entry string, clean bigint, toxic bigint")
    return found.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("clean >= 2")


def _curve(train: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic curve over the two features by Newton steps with a small ridge."""
    def run(batches):
        for batch in batches:
            weight = [model.found(t) for t in batch.column(0).to_pylist()]
            words = [max(t.count(" ") - 1, 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(weight, pa.float64()), pa.array(words, pa.int64()), batch.column(1)], ["weight", "words", "toxic"])

    found = train.mapInArrow(run, "weight double, words bigint, toxic bigint").groupBy("weight", "words", "toxic").count()
    table = found.toPandas().sort_values(["weight", "words", "toxic"])
    x = np.stack([np.ones(len(table)), np.log1p(table.weight), np.log1p(100 * table.weight / table.words)], axis=1)
    y, n, beta = (table.toxic.to_numpy() > 0).astype(float), table["count"].to_numpy(np.float64), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (n * (y - p)) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`row` (all columns as a struct) and `score`."""
    packed = docs.select(F.struct("*").alias("row"), whole_text(text).alias("work"))
    out = packed.select("row", F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return packed.mapInArrow(run, out)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    # the text goes to the task beside the row, not within it
    rows = docs.select("doc_id", "text")
    found = scored(rows, fit(docs, labels))
    return found.select(
        F.col("row")["doc_id"].alias("doc_id"), (bucket_of("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") < THRESHOLD).select("row.*")
