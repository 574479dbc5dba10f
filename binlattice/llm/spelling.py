"""Spelling variants by an even-partition pigeonhole join.

Words are counted over whole texts. A word of l code points is cut evenly into two
segments; one edit leaves one of them as it is, so the other word, of equal or
one greater length, holds it at the same place or one further. Words are indexed
by both segments, probed with the substrings at those places, and verified
to be exactly one edit apart; pairs that meet in both segments count once.

A bucket that pairs more than ``CROWD`` words is cut again: the part of the word
that may hold the edit is halved, and the key becomes all the rest of it. This
goes on until that part is a single code point, when all that meet are links, so no
bucket is capped and no frequent beginning or ending pairs everything with
everything.

A word's form is its near word of most occurrences (ties: the smallest in code
point order), if that has ``ratio`` times its own; its root is the last of the
forms that follow each other.

Defined cases: null and empty texts have no words; texts of any length are taken
whole, a piece at a time; rows that repeat count as often as they stand there; a
missing doc_id counts as an empty one (which matters with ``altered`` only); no
documents give no rows; other columns may have any names and are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, narrow_join

PIECE, HELD_WORDS, HELD_CHARS, CROWD = 1 << 20, 200_000, 8 << 20, 4096
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
KEY = ["l", "a", "b", "key"]


def pieces(text: str, size: int = PIECE):
    """The text in pieces of about size characters, cut where no word goes on."""
    lo = 0
    while lo < len(text):
        end = BREAK.search(text, lo + size) if lo + size < len(text) else None
        hi = end.start() if end else len(text)
        yield text[lo:hi]
        lo = hi


def misspelt(run: str, salt: int, every: int) -> str:
    """The run, without one code point if its CRC-32, carried on from salt, is divisible by every."""
    h = zlib.crc32(run.encode(), salt)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _tally(least: int, altered: int | None):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def count(batches):
        held, chars = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text.as_py() or ""):
                    for run, n in Counter(runs.findall(piece.encode().lower().decode())).items():
                        word = misspelt(run, salt, altered) if altered else run
                        if len(word) >= least:
                            if word not in held:
                                chars += len(word)
                            held[word] += n
                    if len(held) > HELD_WORDS or chars > HELD_CHARS:
                        yield counted(held)
                        held, chars = Counter(), 0
        if held:
            yield counted(held)

    def counted(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return count


def vocabulary(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, altered: int | None = None) -> DataFrame:
    """(word, n): lower-cased maximal runs of Latin letters of at least so many code points and occurrences.

    altered takes a code point from every so many-th (doc_id, run), by its CRC-32,
    before anything is counted: misspellings that are known. Tasks count before
    they shuffle.
    """
    found = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tally(least_length, altered), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cut(rows: DataFrame, halves: Column) -> DataFrame:
    """Rows (word, n, l, shift) under the keys of both halves."""
    cut = rows.select("word", "n", "l", "shift", F.explode(halves).alias("part")).select("word", "n", "l", "shift", "part.a", "part.b")
    return cut.withColumn("key", F.concat(F.expr("substring(word, 1, a)"), F.expr("substring(word, b + shift + 1)")))


def _halves(a: str, b: str) -> Column:
    return F.expr(f"array(struct({a} AS a, {a} + ({b} - {a}) div 2 AS b), struct({a} + ({b} - {a}) div 2 AS a, {b} AS b))")


def _pairs(rows: DataFrame) -> DataFrame:
    """Verified links of the words that meet under a key: indexed words with others of their length, and with those one longer."""
    own = rows.where("shift = 0").select(*KEY, F.col("word").alias("x"), F.col("n").alias("x_n"))
    probe = rows.select(*KEY, "shift", F.col("word").alias("y"), F.col("n").alias("y_n"))
    meet = own.join(probe.hint("merge"), KEY).where("(shift = 1 OR y > x) AND levenshtein(x, y, 1) = 1")
    return meet.select("x", "x_n", "y", "y_n")


def near_words(vocab: DataFrame, scratch: Scratch, *, crowd: int = CROWD) -> DataFrame:
    """(x, x_n, y, y_n): every pair of words of vocab (word, n; distinct) that one inserted, deleted or replaced code point tells apart, once."""
    sized = vocab.withColumn("size", F.char_length("word")).where("size > 0")
    rows = sized.select("word", "n", F.explode(F.expr("filter(array(struct(size AS l, 0 AS shift), struct(size - 1 AS l, 1 AS shift)), r -> r.l > 0)")).alias("r"))
    rows = _cut(rows.select("word", "n", "r.l", "r.shift"), _halves("0", "l"))
    links = []
    while True:
        own, longer = F.sum(1 - F.col("shift")), F.sum("shift")
        full = rows.where("b - a > 1").groupBy(*KEY).agg(own.alias("own"), longer.alias("longer")).where(F.col("own") * (F.col("own") + F.col("longer")) > crowd)
        full = scratch.table(full.select(*KEY, F.lit("x").alias("full")))
        crowded = bool(full.take(1))
        if not crowded:
            links.append(scratch.table(_pairs(rows)))
            break
        marked = scratch.table(narrow_join(rows, full, KEY, F.octet_length("key") + 16))
        links.append(scratch.table(_pairs(marked.where("full IS NULL").drop("full"))))
        rows = _cut(marked.where("full IS NOT NULL").select("word", "n", "l", "shift", F.col("a").alias("lo"), F.col("b").alias("hi")).withColumn("part", _halves("lo", "hi")), F.col("part"))
    return reduce(DataFrame.union, links).distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form (word, form; no cycles): where the chain of forms ends. Every round doubles the steps taken."""
    steps = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not steps.join(on, "root", "left_semi").take(1):
            return steps
        steps = scratch.table(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def groups(vocab: DataFrame, *, ratio: int = 5, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of vocab (word, n)."""
    scratch = Scratch(vocab.sparkSession)
    vocab = scratch.table(vocab.select("word", "n"))
    links = near_words(vocab, scratch, crowd=crowd)
    both = links.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("n")), F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("x_n").alias("n")))).alias("e"))
    best = both.select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
    led = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    found = scratch.table(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), led["near"].alias("form"), (-led["less"]).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"), scratch)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
