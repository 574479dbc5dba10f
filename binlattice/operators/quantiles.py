"""Exact order statistics of groups of any size, with bounded state.

Values are counted where they lie, and a wanted rank is narrowed down by brackets:
cut points from a sketch divide a bracket, sums of the counts between them say
which part holds the rank, and only that part is kept. A bracket of few distinct
values is sorted. No task holds more than the cuts or a last bracket, however
large a group is and however its values lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import small
from ..sources.workspace import Kept

HELD, CUTS, ACCURACY = 1 << 14, 64, 2000


def at_ranks(values: DataFrame, keys: list[str], wanted: DataFrame, *, held: int = HELD, cuts: int = CUTS) -> DataFrame:
    """(keys, r, v): the value at each wanted rank (keys, r; from 0) of the values (keys, v, n), each of which counts n times.

    Ranks that a group doesn't have give no row; null values don't count.
    """
    kept = Kept(values.sparkSession)
    rows = kept.table(values.where("v IS NOT NULL AND n > 0").groupBy(*keys, "v").agg(F.sum("n").cast("long").alias("n")).withColumn("b", F.lit(0).cast("long")))
    open_ = wanted.select(*keys, "r", F.lit(0).cast("long").alias("b"), F.col("r").cast("long").alias("rest")).distinct()
    on, found = [*keys, "b"], []
    while True:
        sizes = kept.table(rows.groupBy(*on).agg(F.count("*").alias("m")))
        counted = sizes.agg(F.count("*"), F.max("m")).first()
        full = small(sizes.where(F.col("m") > held).select(*on), counted[0])
        some = rows if (counted[1] or 0) <= held else rows.join(full, on, "left_anti")
        running = some.withColumn("to", F.sum("n").over(W.partitionBy(*on).orderBy("v")))  # of few values
        found.append(running.join(open_, on).where("rest >= to - n AND rest < to").select(*keys, "r", "v"))
        if (counted[1] or 0) <= held:
            return reduce(DataFrame.union, found)
        many = rows.join(full, on, "left_semi")
        marks = many.groupBy(*on).agg(F.percentile_approx("v", [k / cuts for k in range(1, cuts)], ACCURACY).alias("marks"))
        marks = small(kept.table(marks), counted[0])
        celled = many.join(marks, on).withColumn("cell", F.size(F.filter("marks", lambda c: c < F.col("v")))).drop("marks")
        sums = celled.groupBy(*on, "cell").agg(F.sum("n").alias("n")).withColumn("to", F.sum("n").over(W.partitionBy(*on).orderBy("cell")))
        placed = sums.join(open_, on).where("rest >= to - n AND rest < to")
        placed = kept.table(placed.select(*on, "cell", "r", (F.col("rest") - F.col("to") + F.col("n")).alias("rest")))
        part = (F.col("b") * cuts + F.col("cell")).alias("b")
        goes_on = placed.select(*on, "cell").distinct()
        rows = kept.table(celled.join(small(goes_on, placed.count()), [*on, "cell"], "left_semi").select(*keys, "v", "n", part))
        open_ = placed.select(*keys, "r", part, "rest")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], *, held: int = HELD) -> DataFrame:
    """(keys, q): the quantiles of value at probs, in their order, interpolated linearly between ranks; keys may be empty."""
    own = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    kept = Kept(df.sparkSession)
    rows = kept.table(rows.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    sizes = rows.groupBy(*own).agg(F.sum("n").alias("size")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))))
    at = F.array(*map(F.lit, map(float, probs)))[F.col("k")] * (F.col("size") - 1)
    places = sizes.select(*own, "k", at.alias("at"))
    ends = places.select(*own, "k", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("r"))
    got = ends.join(at_ranks(rows, own, ends.select(*own, "r"), held=held), [*own, "r"])
    low, high = F.floor("at"), F.ceil("at")
    sides = got.groupBy(*own, "k", "at").agg(F.max(F.when(F.col("r") == low, F.col("v"))).alias("lo"), F.max(F.when(F.col("r") == high, F.col("v"))).alias("hi"))
    q = F.when(low == high, F.col("lo")).otherwise((high - F.col("at")) * F.col("lo") + (F.col("at") - low) * F.col("hi"))
    listed = sides.select(*own, F.struct("k", q.alias("q")).alias("e")).groupBy(*own).agg(F.sort_array(F.collect_list("e")).alias("e"))
    return listed.select(*keys, F.transform("e", lambda e: e["q"]).alias("q"))
