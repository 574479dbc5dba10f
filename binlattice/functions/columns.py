"""Column-level array operators: filling, scores, run lengths, coarse grids, moving means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ratio


def fill_nainf(c: str, value: float = 0.0) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(value)).otherwise(x)


def distance_to_mask(df: DataFrame, mask: str, region: str, order: str) -> DataFrame:
    """Adds dist_left, dist_right, their least and their greatest: steps to the nearest true, an edge counting as one just outside."""
    w = W.partitionBy(region).orderBy(order)
    at = F.row_number().over(w)
    rows = df.withColumn("_i", at).withColumn("_n", F.count("*").over(W.partitionBy(region)))
    here = F.when(F.col(mask), F.col("_i"))
    left = F.col("_i") - F.coalesce(F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    right = F.coalesce(F.first(here, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("_n") + 1) - F.col("_i")
    out = rows.withColumn("dist_left", left.cast("long")).withColumn("dist_right", right.cast("long"))
    return out.withColumn("dist_min", F.least("dist_left", "dist_right")).withColumn("dist_max", F.greatest("dist_left", "dist_right")).drop("_i", "_n")


def scores(df: DataFrame, value: str, group: str) -> DataFrame:
    """Adds z, mad and madz scores of a value within its group (population deviation; 0.67449 for madz)."""
    mid = df.groupBy(group).agg(F.median(value).alias("_med"), F.avg(value).alias("_avg"), F.stddev_pop(value).alias("_sd"))
    near = df.join(mid, group)
    mad = near.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("mad"))
    out = near.join(mad, group)
    dev = F.col(value) - F.col("_med")
    return out.withColumn("z", ratio(F.col(value) - F.col("_avg"), "_sd")).withColumn("by_mad", ratio(dev, "mad")).withColumn("madz", ratio(dev * 0.67449, "mad")).drop("_med", "_avg", "_sd")


def comedian(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    mid = df.groupBy(group).agg(F.median(x).alias("_x"), F.median(y).alias("_y"))
    return df.join(mid, group).groupBy(group).agg(F.median((F.col(x) - F.col("_x")) * (F.col(y) - F.col("_y"))).alias("comed"))


def run_lengths(df: DataFrame, value: str, region: str, order: str) -> DataFrame:
    """Runs of equal values (null equals null): region, start, length, value."""
    w = W.partitionBy(region).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(region, "_run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.first(value).alias("value")).drop("_run")


def run_decode(runs: DataFrame, region: str) -> DataFrame:
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    return runs.select(region, at.alias("at"), "value")


def coarsen(cells: DataFrame, k: int, reduction=F.sum) -> DataFrame:
    """Blocks of k by k cells (i, j, value) reduced to one; the reducer is any aggregate."""
    return cells.groupBy(F.floor(F.col("i") / k).alias("i"), F.floor(F.col("j") / k).alias("j")).agg(reduction("value").alias("value"))


def interpolate_nulls(df: DataFrame, value: str, region: str, order: str) -> DataFrame:
    """Fills inner nulls linearly by order, outer ones with the nearest value."""
    back, ahead = W.partitionBy(region).orderBy(order).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(region).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    rows = df.withColumn("_a", F.last(at, ignorenulls=True).over(back)).withColumn("_b", F.first(at, ignorenulls=True).over(ahead))
    line = F.col("_a.y") + ratio((F.col(order) - F.col("_a.x")) * (F.col("_b.y") - F.col("_a.y")), F.col("_b.x") - F.col("_a.x"))
    return rows.withColumn("filled", F.coalesce(F.col(value), line, "_a.y", "_b.y")).drop("_a", "_b")


def box_smooth(df: DataFrame, value: str, region: str, order: str, half: int) -> DataFrame:
    """Mean of 2 half + 1 neighbours, edges extended with the outermost values."""
    w = W.partitionBy(region).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    i, n = F.row_number().over(w), F.count("*").over(W.partitionBy(region))
    rows = df.withColumn("_l", F.greatest(F.lit(half + 1) - i, F.lit(0))).withColumn("_r", F.greatest(i + half - n, F.lit(0)))
    total = F.sum(value).over(w.rowsBetween(-half, half)) + F.col("_l") * F.first(value).over(whole) + F.col("_r") * F.last(value).over(whole)
    return rows.withColumn("smooth", total / (2 * half + 1)).drop("_l", "_r")


def gauss_smooth(df: DataFrame, value: str, region: str, order: str, sigma: float) -> DataFrame:
    """Gaussian mean over neighbours within four sigma that have a value."""
    reach = int(4 * sigma + 0.5)
    a = df.select(region, order, F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias("_o"))
    b = df.select(region, F.col(order).alias("_o"), F.col(value).alias("_v")).where("_v is not null")
    w = F.exp(-((F.col("_o") - F.col(order)) ** 2) / (2 * sigma * sigma))
    return a.join(b, [region, "_o"]).groupBy(region, order).agg(ratio(F.sum(w * F.col("_v")), F.sum(w)).alias("smooth"))


def gauss_rows(value: str, w, sigma: float) -> Column:
    """Gaussian mean over the rows of a window, by their order, within four sigma; rows that aren't there or are null don't count."""
    reach = int(4 * sigma + 0.5)
    near = [(F.lag(value, d).over(w) if d >= 0 else F.lead(value, -d).over(w), math.exp(-d * d / (2 * sigma * sigma))) for d in range(-reach, reach + 1)]
    total = sum((F.coalesce(x * k, F.lit(0.0)) for x, k in near), F.lit(0.0))
    return ratio(total, sum((F.when(x.isNotNull(), k).otherwise(0.0) for x, k in near), F.lit(0.0)))


def asymmetry(cells: DataFrame, by: str | None = None) -> DataFrame:
    """Cells (i, j, value) whose mirror differs, in one matrix or in one for each value of by."""
    keys = [by] if by else []
    other = cells.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("mirror"))
    both = cells.join(other, [*keys, "i", "j"], "full")
    tolerance = 1e-7 * cells.agg(F.coalesce(F.stddev_pop("value"), F.lit(0.0))).first()[0] + 1e-5
    return both.where(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("mirror", F.lit(0.0))) >= tolerance)
