"""Snippets around features, and their pile-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import assign_supports, assign_view, small
from ..schema import ContactMap, ratio, require
from . import quantiles

REDUCERS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop}


def expand_align(features: DataFrame, flank: int, binsize: int, sides: tuple[str, ...] = ("",)) -> DataFrame:
    """Adds lo and hi bins (in the chromosome) of a window of flank bp around each centre, or the feature's own bins."""
    for k in sides:
        s, e = F.col(f"start{k}"), F.col(f"end{k}")
        if flank is None:
            lo, hi = F.floor(s / binsize), F.ceil(e / binsize)
        else:
            centre = F.floor((s + e) / 2 / binsize)
            lo, hi = centre - flank // binsize, centre + flank // binsize + 1
        features = features.withColumn(f"lo{k}", lo).withColumn(f"hi{k}", hi)
    return features


def aligned_windows(loci: DataFrame, binsize: int, flank: int = 0, region_start: int = 0) -> DataFrame:
    """Adds lo, hi (bins, end exclusive), start_bp and end_bp of bin-aligned windows around loci (chrom, left, right)."""
    if flank % binsize:
        raise ValueError("the flank is no multiple of the bin size")
    require(loci.where("left > right").limit(1), "left after right")
    at = lambda c: ((F.col(c) - region_start) / binsize).cast("long")
    out = loci.withColumn("lo", at("left") - flank // binsize).withColumn("hi", at("right") + flank // binsize + 1)
    return out.withColumn("start_bp", F.col("lo") * binsize).withColumn("end_bp", F.col("hi") * binsize)


def snippets(cmap: ContactMap, features: DataFrame, view: DataFrame, *, flank: int | None, min_diag: int | None = 2, expected: DataFrame | None = None, only_expected: bool = False, value: Callable[[], Column] | None = None) -> DataFrame:
    """Long form (snip_id, i, j, value) for BED (chrom, start, end) or BEDPE (chrom1, ...) features with snip_id.

    Balanced values, zero for absent pixels; null for bad bins and for j - i
    below min_diag; a window that leaves its region is null altogether. With an
    expected, observed over expected, or the expected itself. value may make
    another one from count (null if absent), wx, wy and, with an expected, e.
    """
    made = value
    two = "chrom1" in features.columns
    sides = ("1", "2") if two else ("",)
    for k in sides:
        require(features.where(f"start{k} > end{k}").limit(1), "start after end")
    aligned = expand_align(assign_view(features, view, "snip_id"), flank, cmap.binsize, sides)
    edges = assign_supports(cmap.bins, view).where("region is not null")
    spans = edges.groupBy("region").agg(F.min("bin_id").alias("rlo"), F.max("bin_id").alias("rhi"), F.min(F.col("bin_id") - F.floor(F.col("start") / cmap.binsize)).alias("base"))
    rows = aligned.join(F.broadcast(spans), "region", "left")
    a, b = ("1", "2") if two else ("", "")
    di = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"hi{a}") - F.col(f"lo{a}") - 1))
    dj = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"hi{b}") - F.col(f"lo{b}") - 1))
    inside = lambda k: (F.col("base") + F.col(f"lo{k}") >= F.col("rlo")) & (F.col("base") + F.col(f"hi{k}") - 1 <= F.col("rhi"))
    rows = rows.withColumn("ok", F.coalesce(inside(a) & inside(b), F.lit(False)))
    cells = rows.withColumn("i", di).withColumn("j", dj).select("snip_id", "region", "i", "j", "ok", F.when(F.col("ok"), F.col("base") + F.col(f"lo{a}") + F.col("i")).alias("x"), F.when(F.col("ok"), F.col("base") + F.col(f"lo{b}") + F.col("j")).alias("y"))
    w = cmap.bins.select("bin_id", "weight")
    cells = cells.join(small(w.select(F.col("bin_id").alias("x"), F.col("weight").alias("wx")), cmap.n_bins()), "x", "left")
    cells = cells.join(small(w.select(F.col("bin_id").alias("y"), F.col("weight").alias("wy")), cmap.n_bins()), "y", "left")
    px = cmap.pixels.select(F.col("bin1_id").alias("p"), F.col("bin2_id").alias("q"), "count")
    cells = cells.withColumn("p", F.least("x", "y")).withColumn("q", F.greatest("x", "y")).join(px, ["p", "q"], "left")
    value = F.coalesce("count", F.lit(0)) * F.col("wx") * F.col("wy")
    if expected is not None:
        lookup = expected.select(F.col("region1").alias("region"), F.col("dist").alias("d"), F.col("balanced_avg").alias("e"))
        cells = cells.withColumn("d", F.col("q") - F.col("p")).join(small(lookup, cmap.n_bins()), ["region", "d"], "left")
        value = F.col("e") if only_expected else ratio(value, "e")
    if made:
        value = made()
    if min_diag is not None:
        value = F.when(F.col("y") - F.col("x") >= min_diag, value)
    out = cells.select("snip_id", "i", "j", F.when(F.col("ok"), value).alias("value"))
    if two:
        return out
    mirror = out.select("snip_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("m"))
    return out.join(mirror, ["snip_id", "i", "j"]).select("snip_id", "i", "j", F.greatest("value", "m").alias("value"))


def pileup(stack: DataFrame, reducer: str = "mean") -> DataFrame:
    """The stack reduced over snippets; nulls don't count. Medians are exact, with bounded state however many snippets there are."""
    if reducer == "median":
        middle = quantiles.exact_quantiles(stack, ["i", "j"], "value", [0.5]).select("i", "j", F.col("q")[0].alias("value"))
        return stack.select("i", "j").distinct().join(middle, ["i", "j"], "left")
    return stack.groupBy("i", "j").agg(REDUCERS[reducer]("value").alias("value"))
