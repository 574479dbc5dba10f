"""Table-level routines: diagonals, weighted summaries, distributions, runs with gaps, isolated bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ratio


def diagonal(cells: DataFrame, k: int = 0) -> DataFrame:
    """Cells (i, j, value) of one diagonal."""
    return cells.where(F.col("j") - F.col("i") == k)


def set_diagonal(cells: DataFrame, value: float | None, k: int = 0) -> DataFrame:
    """Cells with the value of one diagonal replaced."""
    return cells.withColumn("value", F.when(F.col("j") - F.col("i") == k, F.lit(value).cast("double")).otherwise(F.col("value")))


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null, NaN nor infinite."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def weighted_means(df: DataFrame, keys: list[str], weight: str, values: list[str], mode: str = "mean") -> DataFrame:
    """Weighted mean, population deviation ("std") or exp of the deviation of logarithms ("logstd") by keys.

    The weight is summed. Null values leave both sums of their own mean.
    """
    if mode not in ("mean", "std", "logstd"):
        raise ValueError(f"no such mode: {mode}")
    x = {v: F.log(v) if mode == "logstd" else F.col(v).cast("double") for v in values}
    w = {v: F.when(x[v].isNotNull(), F.col(weight)) for v in values}
    means = df.groupBy(*keys).agg(F.sum(weight).alias(weight), *(ratio(F.sum(w[v] * x[v]), F.sum(w[v])).alias(v) for v in values))
    if mode == "mean":
        return means
    near = df.join(means.select(*keys, *(F.col(v).alias(f"_m_{v}") for v in values)), keys)
    spread = {v: F.sqrt(ratio(F.sum(w[v] * (x[v] - F.col(f"_m_{v}")) ** 2), F.sum(w[v]))) for v in values}
    return near.groupBy(*keys).agg(F.sum(weight).alias(weight), *((F.exp(s) if mode == "logstd" else s).alias(v) for v, s in spread.items()))


def ecdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, share): the share of a group's values at or below each distinct one. Values are counted first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(group)
    return counted.select(group, value, (F.sum("_n").over(w.orderBy(value)) / F.sum("_n").over(w)).alias("share"))


def diag_counts(cells: DataFrame, value: str = "ind") -> DataFrame:
    """How often each value occurs at each distance of cells (dist, value)."""
    return cells.where(F.col(value).isNotNull()).groupBy("dist", value).agg(F.count("*").alias("n"))


def above_mean(df: DataFrame, value: str, group: str) -> DataFrame:
    """Adds high: 1 where a value is over its group's mean, 0 where not, null where missing."""
    mean = df.groupBy(group).agg(F.avg(value).alias("_mean"))
    return df.join(mean, group).withColumn("high", (F.col(value) > F.col("_mean")).cast("int")).drop("_mean")


def normalized(x: Column) -> Column:
    """A ratio a / b as (a - b) / (a + b)."""
    return ratio(x - 1, x + 1)


def unnormalized(y: Column) -> Column:
    """The ratio a / b of (a - b) / (a + b)."""
    return ratio(1 + y, 1 - y)


def fill_gaps(runs: DataFrame, region: str, length: int | None = None, *, signed_tail: bool = False) -> DataFrame:
    """Runs (region, start, length, value) with null runs between them, from 0 and up to a length if given.

    signed_tail always gives a region's last null run, of length 0 or less where its runs reach or pass the length.
    """
    w = W.partitionBy(region).orderBy("start", "length")
    end = F.col("start") + F.col("length")
    own = runs.select(region, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("value"))
    before = own.withColumn("_from", F.coalesce(F.lag(end).over(w), F.lit(0)))
    gaps = before.select(region, F.col("_from").alias("start"), (F.col("start") - F.col("_from")).alias("length"))
    gaps = gaps.where("length > 0")
    if length is not None:
        last = own.groupBy(region).agg(F.max(end).alias("start"))
        tail = last.withColumn("length", F.lit(length).cast("long") - F.col("start"))
        gaps = gaps.unionByName(tail if signed_tail else tail.where("length > 0"))
    return own.unionByName(gaps, allowMissingColumns=True)


def drop_gaps(runs: DataFrame) -> DataFrame:
    return runs.where("value is not null")


def align_runs(a: DataFrame, b: DataFrame, region: str, length: int) -> DataFrame:
    """Two sets of runs cut at the starts of both: region, start, length, value1, value2."""
    side = lambda df, k: fill_gaps(df, region, length).where("length > 0").select(region, "start", "length", F.struct("value").alias(f"_{k}"))
    both = side(a, 1).unionByName(side(b, 2), allowMissingColumns=True)
    cuts = both.groupBy(region, "start").agg(F.max("_1").alias("_1"), F.max("_2").alias("_2"), F.max(F.col("start") + F.col("length")).alias("_end"))
    w = W.partitionBy(region).orderBy("start")
    value = lambda k: F.last(f"_{k}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))["value"]
    return cuts.select(region, "start", (F.coalesce(F.lead("start").over(w), F.col("_end")) - F.col("start")).alias("length"), value(1).alias("value1"), value(2).alias("value2"))


def simplify_runs(runs: DataFrame, region: str, length: int | None = None) -> DataFrame:
    """Adjacent runs of (nearly) equal values as one; null runs and runs of length zero go."""
    w = W.partitionBy(region).orderBy("start")
    rows = fill_gaps(runs, region, length).where("length > 0")
    last = F.lag("value").over(w)
    near = F.abs(last - F.col("value")) <= 1e-8 + 1e-5 * F.abs("value")
    same = F.coalesce(near, last.isNull() & F.col("value").isNull()) & F.lag("start").over(w).isNotNull()
    numbered = rows.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w))
    merged = numbered.groupBy(region, "_run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min_by("value", "start").alias("value"))
    return drop_gaps(merged.drop("_run"))


def singletons(bins: DataFrame, region: str, order: str, good: str) -> DataFrame:
    """Adds kind: good, bad, and good_single or bad_single where both neighbours are of the other kind."""
    w = W.partitionBy(region).orderBy(order)
    back, ahead = F.lag(good).over(w), F.lead(good).over(w)
    single = F.coalesce((back == ahead) & (back != F.col(good)), F.lit(False))
    name = F.when(F.col(good), "good").otherwise("bad")
    return bins.withColumn("kind", F.when(single, F.concat(name, F.lit("_single"))).otherwise(name))


def repair_singletons(cells: DataFrame, n: int) -> DataFrame:
    """Fills the rows and columns of isolated bad bins from their neighbours along the diagonal, for display.

    Cells are (region, i, j, value, kind1, kind2) with 0 <= i <= j < n, dense,
    values of bad bins null; along the first row and the last column the
    neighbours lie along the edge. Two passes; the three central diagonals
    come back null.
    """
    bad = F.lit("bad")
    hole = ((F.col("kind1") == "bad_single") | (F.col("kind2") == "bad_single")) & (F.col("kind1") != bad) & (F.col("kind2") != bad)
    rows = cells.withColumn("_hole", hole & (F.col("j") > F.col("i")))
    rows = rows.withColumn("value", F.when(hole & (F.col("i") == F.col("j")), 0.0).otherwise(F.col("value")))
    top, side = F.col("i") == 0, F.col("j") == n - 1
    di, dj = F.when(top, 0).otherwise(1), F.when(~top & side, 0).otherwise(1)
    for _ in range(2):
        want = rows.where("_hole and value is null").select("region", "i", "j", F.explode(F.array(F.lit(-1), F.lit(1))).alias("s"), di.alias("di"), dj.alias("dj"))
        want = want.select("region", "i", "j", (F.col("i") + F.col("s") * F.col("di")).alias("_i"), (F.col("j") + F.col("s") * F.col("dj")).alias("_j"))
        have = rows.select("region", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_v")).where("_v is not null")
        means = want.join(have, ["region", "_i", "_j"]).groupBy("region", "i", "j").agg(F.avg("_v").alias("_mean"))
        rows = rows.join(means, ["region", "i", "j"], "left").withColumn("value", F.coalesce("value", "_mean")).drop("_mean")
    return rows.select("region", "i", "j", F.when(F.col("j") - F.col("i") > 1, F.col("value")).alias("value"))


def sampled_deviation(df: DataFrame, value: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Population deviation of n values, those of the least hash of key and seed."""
    picked = df.select(key, value).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return picked.agg(F.stddev_pop(value).alias("sd"))
