"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, drops invisible characters and marks, maps look-alike
letters of other scripts and full-width forms to Latin, and digits and signs that
stand for letters inside a word to those letters; numbers stay numbers, which no
entry matches. Four or more single letters in a row are one spelled-out word. A
word with accents is also looked up without them among the entries that are whole
words. Lexicon entries are whole words or
word beginnings; the most heavily weighted entry at a word counts, and words
inside an exception phrase don't. The sum is normalised by length and turned into
a probability.

Entries and weights are log ratios of rates in labelled toxic and other
documents, from at most ``SAMPLE`` rows a class. Without labels of both
classes the built-in entries and a fixed calibration are used.

Defined cases: null and empty texts match nothing and get the score of a document
without matches; every row of documents gives one row, scored by its text alone,
also where a doc_id is null (then it isn't held out and trains nothing) or on
several rows (each of which trains, as any row); of several labels of one doc_id
the largest counts, null labels and labels without a document none; equal
weights at one word are one hit; texts of any length are read whole; no documents
give no rows; other columns may have any names and are not returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import logistic, remainder, sample
from .shared import Scratch

SAMPLE, ENTRIES, PREFIXES, WORDS_KEPT = 2500, 3000, (4, 5, 6, 7), 1 << 16
BUILT_IN = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "pathetic": 3.0, "worthless": 3.0, "loser": 3.0, "stupid": 3.0, "disgusting": 2.5, "trash": 2.0, "clown": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "idiot proof", "pond scum", "stupid simple")
LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝкмтвнαεορτυικνβ", "aeopcyxijshdqwkmtbhaeoptuiknb")
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
MARKS = re.compile("[\u0300-\u036f\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
LOOKALIKES = re.compile("[" + "".join(map(chr, LOOKALIKE)) + "]")
NUMBERS, NOT_ASCII = re.compile(r"\d+"), re.compile("[^\x00-\x7f]+")
NOT_WORDS = re.compile(r"[\W_]+")
SPELLED = re.compile(r"(?<= )\S(?: \S){3,}(?= )")


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKC", text))
        if LOOKALIKES.search(text):
            text = text.translate(LOOKALIKE)
    if "@" in text or "$" in text:
        text = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    folded = " " + NOT_WORDS.sub(" ", text).strip() + " "
    parts, last = [], 0
    for start, end in words_with(NUMBERS, folded):
        word = folded[start:end]
        inner = "" if word.isdigit() else NUMBERS.sub(" ", word.translate(DIGITS)).strip()
        parts += [folded[last:start], inner + " " if inner else ""]
        last = end + 1
    if parts:
        folded = "".join(parts) + folded[last:]
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), folded)


def words_with(pattern: re.Pattern, folded: str):
    """Bounds of the words, between single spaces, that hold a match."""
    last = 0
    for m in pattern.finditer(folded):
        if m.start() >= last:
            start, last = folded.rfind(" ", 0, m.start()) + 1, folded.find(" ", m.end())
            yield start, last


def bare(word: str) -> str:
    """A folded word without the accents on its letters."""
    return MARKS.sub("", unicodedata.normalize("NFKD", word))


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=lambda: {f" {w} ": v for w, v in BUILT_IN.items()})
    weights: list[float] = field(default_factory=lambda: [1.0, 0.5, 0.5, -4.0])

    def __post_init__(self):
        self._built, self._bare = None, {}

    def __getstate__(self):
        return {"entries": self.entries, "weights": self.weights, "_built": None, "_bare": {}}

    def automaton(self):
        if self._built is None:
            a = ahocorasick.Automaton()
            for term, w in self.entries.items():
                a.add_word(term, (len(term), w))
            for phrase in EXCEPTIONS:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._built = a
        return self._built

    def features(self, text: str | None) -> list[float]:
        folded = fold(text or "")
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton().iter(folded):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if not folded.isascii():  # accents may be put on to disguise a word
            for start, end in words_with(NOT_ASCII, folded):
                word = folded[start:end]
                w = self._bare.get(word)
                if w is None:
                    if len(self._bare) >= WORDS_KEPT:
                        self._bare.clear()
                    w = self._bare[word] = self.entries.get(f" {bare(word)} ", 0.0)
                if w > best.get(start - 1, 0.0):
                    best[start - 1] = w
        hits = outside(best, spared)
        n = max(1, folded.count(" ") - 1)
        total = sum(hits)
        return [total / (1 + np.sqrt(n / 50)), max(hits, default=0.0), total / n * 10]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def outside(best: dict[int, float], spared: list[tuple[int, int]]) -> list[float]:
    """The weights at places that no span [start, end) holds; both are sorted and swept once."""
    if not spared:
        return list(best.values())
    spared, at, reach, out = sorted(spared), 0, -1, []
    for place in sorted(best):
        while at < len(spared) and spared[at][0] <= place:
            reach = max(reach, spared[at][1])
            at += 1
        if reach <= place:
            out.append(best[place])
    return out


def terms(text: str) -> Counter:
    """How often a text has each word and word beginning."""
    out: Counter = Counter()
    for w, n in Counter(fold(text).split()).items():
        if len(w) >= 3:
            out[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out


def _counts(batches):
    held: dict[str, list[int]] = {}

    def rows():
        names = list(held)
        values = np.array(list(held.values()), dtype=np.int64).reshape(-1, 4)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(values[:, i].copy()) for i in range(4))], ["term", "df0", "df1", "tf0", "tf1"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term, n in terms(text or "").items():
                own = held.setdefault(term, [0, 0, 0, 0])
                own[y] += 1
                own[2 + y] += n
            if len(held) > 200_000:
                yield rows()
    yield rows()


def train(docs: DataFrame, labels: DataFrame, *, each: int = SAMPLE) -> Model:
    model = Model()
    rows = Scratch(docs.sparkSession).table(sample(docs, labels, "toxic", folds=3, held=1, each=each).select("text", "label").where("text is not null"))
    size = {r.label: (r.n, r.words) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("words")).collect()}
    if len(size) < 2:
        return model
    (n0, w0), (n1, w1) = size[0], size[1]
    counted = rows.mapInArrow(_counts, "term string, df0 long, df1 long, tf0 long, tf1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df0", "df1", "tf0", "tf1")))
    rate = F.log((F.col("tf1") + 0.5) / (w1 + 1)) - F.log((F.col("tf0") + 0.5) / (w0 + 1))
    # documents, not words, are the independent draws: an entry must be in clearly more toxic documents than its share, or be far denser there
    share = n1 / n0
    surplus = (F.col("df1") - share * F.col("df0")) / F.sqrt(F.col("df1") + share * share * F.col("df0") + 1)
    found = counted.where((F.col("df1") >= 3) & (surplus >= 2.0) & (rate >= 1.2)).select("term", rate.alias("w"), (surplus * rate).alias("rank"))
    for r in found.orderBy(F.desc("rank"), "term").limit(ENTRIES).collect():
        model.entries[r.term] = max(float(r.w), model.entries.get(r.term, 0.0))
    model._built, model._bare = None, {}
    shape = rows.mapInArrow(lambda b: featured(b, model), "x array<double>, label int").collect()
    x, y = np.array([r.x for r in shape]), np.array([r.label for r in shape])
    model.weights = logistic(x, y).tolist()
    return model


def featured(batches, model: Model):
    for batch in batches:
        x = [model.features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            x = np.array([model.features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = body.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
