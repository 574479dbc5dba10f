"""Operators over a band along the diagonal: insulation, boundaries, directionality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.columns import distance_to_mask
from ..plans.joins import annotate, assign_supports, small
from ..schema import ContactMap, ratio
from . import quantiles
from .peaks import prominences


def band_pairs(bins: DataFrame, reach: int) -> DataFrame:
    """Ordered pairs of bins of one region at most reach apart, joined on buckets of reach + 1 bins."""
    width = reach + 1
    a = bins.select("region", F.col("bin_id").alias("i"), F.col("weight").alias("wi")).withColumn("b", F.explode(F.array(F.floor(F.col("i") / width), F.floor(F.col("i") / width) + 1)))
    b = bins.select("region", F.col("bin_id").alias("j"), F.col("weight").alias("wj"), F.floor(F.col("bin_id") / width).alias("b"))
    return a.join(b, ["region", "b"]).where(f"j >= i and j - i <= {reach}").drop("b")


def band_cells(cmap: ContactMap, bins: DataFrame, reach: int, weighted: bool = True) -> DataFrame:
    """All cells of the band, zeros included: region, i, j, count, value (null where a bin is bad)."""
    px = cmap.pixels.where(F.col("bin2_id") - F.col("bin1_id") <= reach).select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count")
    cells = band_pairs(bins, reach).join(px, ["i", "j"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return cells.withColumn("value", F.col("count") * F.col("wi") * F.col("wj") if weighted else F.col("count").cast("double"))


def diamond_sizes(bins: DataFrame, window: int, ignore_diags: int, weighted: bool = True) -> DataFrame:
    """Adds n_valid: pairs of good bins in each bin's diamond, at least ignore_diags apart.

    Good bins to the left times good bins to the right, less the pairs too near
    each other; all are sums over neighbours in one sort by region.
    """
    w = W.partitionBy("region").orderBy("bin_id")
    good = F.col("weight").isNotNull().cast("long") if weighted else F.lit(1).cast("long")
    rows = bins.withColumn("_g", good)
    near = range(min(ignore_diags, 2 * window - 1))
    rows = rows.select("*", *((F.col("_g") * F.coalesce(F.lead("_g", s).over(w), F.lit(0))).alias(f"_g{s}") for s in near))
    total = lambda c, lo, hi: F.coalesce(F.sum(c).over(w.rowsBetween(lo, hi)), F.lit(0))
    n = total("_g", 1 - window, 0) * total("_g", 0, window - 1)
    for s in near:
        n = n - total(f"_g{s}", -min(s, window - 1), min(0, window - 1 - s))
    return rows.withColumn("n_valid", n).drop("_g", *(f"_g{s}" for s in near))


def insulation(cmap: ContactMap, view: DataFrame, window: int, *, ignore_diags: int = 2, weighted: bool = True, norm_by_median: bool = True) -> DataFrame:
    """log2 mean of the diamond of window bins at every bin, over the region's median.

    Null where nothing is valid or the sum is zero. Every stored pixel adds to
    the diamonds it lies in, at most window of them; absent ones only count.
    """
    bins = assign_supports(cmap.bins, view).where("region is not null")
    near = cmap.pixels.where((F.col("bin2_id") - F.col("bin1_id") <= 2 * (window - 1)) & (F.col("bin2_id") - F.col("bin1_id") >= ignore_diags))
    px = annotate(near, bins, ("region", "weight"), rows=cmap.n_bins()).where("region1 = region2")
    value = F.col("count") * F.col("weight1") * F.col("weight2") if weighted else F.col("count").cast("double")
    at = F.sequence(F.greatest("bin1_id", F.col("bin2_id") - (window - 1)), F.least("bin2_id", F.col("bin1_id") + (window - 1)))
    per = px.withColumn("value", value).where("value is not null").select(F.explode(at).alias("bin_id"), "count", "value").groupBy("bin_id").agg(F.sum("count").alias("sum_counts"), F.sum("value").alias("sum_balanced"))
    out = diamond_sizes(bins, window, ignore_diags, weighted).join(per, "bin_id", "left")
    out = out.withColumns({c: F.when(F.col("n_valid") > 0, F.coalesce(c, F.lit(0).cast(t))) for c, t in (("sum_counts", "long"), ("sum_balanced", "double"))})
    out = out.withColumn("score", ratio("sum_balanced", "n_valid"))
    if norm_by_median:
        median = quantiles.exact_quantiles(out, ["region"], "score", [0.5]).select("region", F.col("q")[0].alias("_m"))
        out = out.join(F.broadcast(median), "region", "left").withColumn("score", ratio("score", "_m")).drop("_m")
    bad = F.col("weight").isNull() if weighted else F.lit(False)
    return out.select("bin_id", "chrom", "start", "end", "region", bad.alias("is_bad_bin"), F.when(F.col("score") > 0, F.log2("score")).alias("log2_score"), "n_valid", "sum_counts", "sum_balanced")


def boundaries(scores: DataFrame, *, min_frac_valid: float = 0.66) -> DataFrame:
    """Adds boundary_strength: prominence of -log2 score among bins with enough valid pixels, by region."""
    top = scores.agg(F.max("n_valid")).first()[0] or 0
    ok = scores.where((F.col("n_valid") >= min_frac_valid * top) & F.col("log2_score").isNotNull()).select("region", "bin_id", "log2_score")

    found = prominences(ok.select("region", "bin_id", (-F.col("log2_score")).alias("v"))).where("prominence > 0")
    found = found.select("bin_id", F.col("prominence").alias("boundary_strength"))
    return scores.join(found, "bin_id", "left")


def call_boundaries(scores: DataFrame, threshold: float | str = "Li") -> DataFrame:
    """Adds is_boundary; Li and Otsu thresholds come from all strengths, a number is used as is."""
    if threshold in ("Li", "Otsu"):
        v = scores.where("boundary_strength is not null").select("boundary_strength").toPandas()["boundary_strength"].to_numpy(float)  # fewer than bins
        threshold = {"Li": arrays.li_threshold, "Otsu": arrays.otsu_threshold}[threshold](v) if len(v) else float("inf")
    return scores.withColumn("is_boundary", F.coalesce(F.col("boundary_strength") >= threshold, F.lit(False)))


def insulation_table(
    cmap: ContactMap, view: DataFrame, windows: list[int], *, ignore_diags: int = 2, threshold: float | str = "Li", weighted: bool = True, min_frac_valid: float = 0.66, min_dist_bad_bin: int = 0, append_raw: bool = False
) -> DataFrame:
    """Scores, strengths and boundaries of several windows (in bp, multiples of the bin size) side by side.

    Bins nearer to a bad bin or the region's edge than min_dist_bad_bin have no
    score and no boundary. Raw sums of the diamonds are added if asked for.
    """
    where = assign_supports(cmap.bins, view).where("region is not null")
    where = where.withColumn("is_bad_bin", F.col("weight").isNull() if weighted else F.lit(False))
    out = distance_to_mask(where, "is_bad_bin", "region", "bin_id").withColumnRenamed("dist_min", "dist_bad_bin")
    out = out.select("bin_id", "chrom", "start", "end", "region", "is_bad_bin", "dist_bad_bin")
    far = out.where(F.col("dist_bad_bin") >= min_dist_bad_bin).select("bin_id", F.lit(True).alias("_far"))
    for w in windows:
        if w % cmap.binsize:
            raise ValueError(f"window {w} is not a multiple of the bin size {cmap.binsize}")
        own = insulation(cmap, view, w // cmap.binsize, ignore_diags=ignore_diags, weighted=weighted)
        if min_dist_bad_bin:
            own = own.join(far, "bin_id", "left").withColumn("log2_score", F.when(F.col("_far"), F.col("log2_score"))).drop("_far")
        own = call_boundaries(boundaries(own, min_frac_valid=min_frac_valid), threshold)
        names = {"log2_score": f"log2_insulation_score_{w}", "n_valid": f"n_valid_pixels_{w}", "boundary_strength": f"boundary_strength_{w}", "is_boundary": f"is_boundary_{w}"}
        if append_raw:
            names |= {"sum_counts": f"sum_counts_{w}", "sum_balanced": f"sum_balanced_{w}"}
        out = out.join(own.select("bin_id", *(F.col(a).alias(b) for a, b in names.items())), "bin_id")
    return out


def near_bad(bins: DataFrame, k: int) -> DataFrame:
    """Adds bad_bin_masked: within k - 1 bins of a bad bin, or among the k - 1 first or last of the chromosome."""
    w = W.partitionBy("chrom").orderBy("bin_id")
    i, n = F.row_number().over(w), F.count("*").over(W.partitionBy("chrom"))
    bad: Column = F.max(F.col("weight").isNull().cast("int")).over(w.rowsBetween(1 - k, k - 1)) == 1
    return bins.withColumn("bad_bin_masked", bad | (i < k) | (i > n - k + 1))


def directionality(cmap: ContactMap, window: int, *, ignore_diags: int = 2, min_dist_bad_bin: int = 2) -> DataFrame:
    """Upstream a and downstream b of each bin within the window: (b - a) / (a + b), and the signed chi square."""
    px = cmap.pixels.where((F.col("bin2_id") - F.col("bin1_id") >= ignore_diags) & (F.col("bin2_id") - F.col("bin1_id") < window))
    side = cmap.bins.where("weight is not null").select("bin_id", "chrom", "weight")
    for k in "12":
        px = px.join(small(side.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("chrom").alias(f"c{k}"), F.col("weight").alias(f"w{k}")), cmap.n_bins()), f"bin{k}_id")
    v = F.col("count") * F.col("w1") * F.col("w2")
    ends = px.where("c1 = c2").select(F.explode(F.array(F.struct(F.col("bin1_id").alias("bin_id"), F.lit(0.0).alias("a"), v.alias("b")), F.struct(F.col("bin2_id").alias("bin_id"), v.alias("a"), F.lit(0.0).alias("b")))).alias("x"))
    sums = ends.groupBy("x.bin_id").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    e = (F.col("a") + F.col("b")) / 2
    chi = F.signum(F.col("b") - F.col("a")) * ratio((F.col("a") - e) ** 2 + (F.col("b") - e) ** 2, e)
    out = near_bad(cmap.bins, min_dist_bad_bin).join(sums, "bin_id", "left")
    masked = lambda c: F.when(~F.col("bad_bin_masked"), c)
    return out.select("bin_id", "chrom", "start", "end", "bad_bin_masked", masked(ratio(F.col("b") - F.col("a"), F.col("a") + F.col("b"))).alias("directionality_ratio"), masked(chi).alias("directionality_index"))
