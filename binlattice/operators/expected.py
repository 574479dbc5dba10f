"""Contact frequency against distance, and by blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.columns import gauss_rows
from ..plans.joins import annotate, assign_supports, view_pairs
from ..schema import ContactMap, ratio

REGIONS = ["region1", "region2"]


def region_bins(cmap: ContactMap, view: DataFrame) -> DataFrame:
    return assign_supports(cmap.bins, view).where("region is not null")


def diag_table(bins: DataFrame, pairs: DataFrame, weighted: bool = True) -> DataFrame:
    """n_total and n_valid at each distance of each region pair, from the bins alone.

    Each region is a 0/1 vector of its bins; the numbers of pairs at all
    distances are its correlation with the other's, by FFT in one group a pair.
    """
    ok = F.col("weight").isNotNull() if weighted else F.lit(True)
    vectors = bins.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("bin_id", ok.cast("int").alias("ok")))).alias("v"))
    a, b = (vectors.select(F.col("region").alias(f"region{k}"), F.col("v").alias(f"v{k}")) for k in "12")

    def count(frames):
        for frame in frames:
            for r in frame.itertuples():
                v1, v2 = (np.array([(x["bin_id"], x["ok"]) for x in v], dtype=np.int64) for v in (r.v1, r.v2))
                dist, total, valid = arrays.pair_distances(v1, v2, r.region1 == r.region2)
                yield pd.DataFrame({"region1": r.region1, "region2": r.region2, "dist": dist, "n_total": total, "n_valid": valid})

    return pairs.join(a, "region1").join(b, "region2").mapInPandas(count, "region1 string, region2 string, dist long, n_total long, n_valid long")


def regional_pixels(cmap: ContactMap, view: DataFrame, weighted: bool) -> DataFrame:
    """Pixels with regions and balanced value; with weights, pixels of bad bins go."""
    px = annotate(cmap.pixels, region_bins(cmap, view), ("chrom", "region", "region_idx", "weight"), rows=cmap.n_bins())
    px = px.withColumn("dist", F.col("bin2_id") - F.col("bin1_id")).withColumn("balanced", F.col("count") * F.col("weight1") * F.col("weight2"))
    return px.where("weight1 is not null and weight2 is not null") if weighted else px


def expected_cis(
    cmap: ContactMap, view: DataFrame, *, intra_only: bool = True, weighted: bool = True, ignore_diags: int = 2, smooth: bool = False, aggregate_smoothed: bool = False, smooth_sigma: float = 0.1, transforms: dict[str, Callable[[], Column]] | None = None
) -> DataFrame:
    """Per region (pair) and distance: n_total, n_valid, sums and averages.

    count_avg divides by n_total, balanced_avg by n_valid; distances below
    ignore_diags have counts of pairs but no sums. transforms name further
    columns of pixels to sum and average over n_valid, made from count, balanced,
    weight1, weight2 and dist. Smoothed averages are added by region, and over
    all regions too, if asked for.
    """
    transforms = transforms or {}
    bins = region_bins(cmap, view)
    pairs = view_pairs(view, "cis")
    if intra_only:
        pairs = pairs.where("region1 = region2")
    table = diag_table(bins, pairs, weighted)
    px = regional_pixels(cmap, view, weighted).where("chrom1 = chrom2")
    px = px.select(F.col("region1"), F.col("region2"), "dist", "count", "balanced", *(make().alias(name) for name, make in transforms.items()))
    values = (["count", "balanced"] if weighted else ["count"]) + list(transforms)
    sums = px.groupBy(*REGIONS, "dist").agg(*(F.sum(v).alias(f"{v}_sum") for v in values))
    out = table.join(sums, [*REGIONS, "dist"], "left")
    for v in values:
        out = out.withColumn(f"{v}_sum", F.when(F.col("dist") >= ignore_diags, F.coalesce(F.col(f"{v}_sum"), F.lit(0)).cast("double")))
    out = out.withColumn("count_avg", ratio("count_sum", "n_total")).withColumn("dist_bp", F.col("dist") * cmap.binsize)
    for v in (["balanced"] if weighted else []) + list(transforms):
        out = out.withColumn(f"{v}_avg", ratio(f"{v}_sum", "n_valid"))
    value = "balanced_sum" if weighted else "count_sum"
    if smooth or aggregate_smoothed:
        out = smooth_cvd(out, True, value, smooth_sigma)
    return smooth_cvd(out, False, value, smooth_sigma) if aggregate_smoothed else out


def block_table(bins: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_total and n_valid of region rectangles from bin counts."""
    n = bins.groupBy("region").agg(F.count("*").alias("n"), F.count("weight").alias("g"))
    a, b = (n.select(F.col("region").alias(f"region{k}"), F.col("n").alias(f"n{k}"), F.col("g").alias(f"g{k}")) for k in "12")
    return pairs.join(a, "region1").join(b, "region2").select(*REGIONS, (F.col("n1") * F.col("n2")).alias("n_total"), (F.col("g1") * F.col("g2")).alias("n_valid"))


def block_sums(cmap: ContactMap, view: DataFrame) -> DataFrame:
    """Sums over all pairs of different regions, same chromosome included."""
    table = block_table(region_bins(cmap, view), view_pairs(view, "blocks"))
    px = regional_pixels(cmap, view, True).where("region1 <> region2")
    sums = px.groupBy(*REGIONS).agg(F.sum("count").alias("count_sum"), F.sum("balanced").alias("balanced_sum"))
    return table.join(sums, REGIONS, "left").withColumn("count_sum", F.coalesce("count_sum", F.lit(0)).cast("double")).withColumn("balanced_sum", F.coalesce("balanced_sum", F.lit(0.0)))


def expected_trans(cmap: ContactMap, view: DataFrame) -> DataFrame:
    """Block sums between chromosomes; both averages divide by n_valid."""
    out = block_sums(cmap, view).join(view_pairs(view, "trans"), REGIONS)
    return out.withColumn("count_avg", ratio("count_sum", "n_valid")).withColumn("balanced_avg", ratio("balanced_sum", "n_valid"))


def expected_full(cmap: ContactMap, view: DataFrame, ignore_diags: int = 2) -> DataFrame:
    """Cis by distance and trans with distance -1 in one table, from one pass over the pixels."""
    bins = region_bins(cmap, view)
    far = F.lit(-1).cast("long")
    table = diag_table(bins, view_pairs(view, "cis")).select(*REGIONS, "dist", "n_valid")
    table = table.unionByName(block_table(bins, view_pairs(view, "trans")).select(*REGIONS, far.alias("dist"), "n_valid"))
    px = regional_pixels(cmap, view, True).withColumn("dist", F.when(F.col("chrom1") == F.col("chrom2"), F.col("dist")).otherwise(far))
    sums = px.groupBy(*REGIONS, "dist").agg(F.sum("count").alias("count_sum"), F.sum("balanced").alias("balanced_sum"))
    out = table.join(sums, [*REGIONS, "dist"], "left")
    counted = (F.col("dist") < 0) | (F.col("dist") >= ignore_diags)
    for v in ("count_sum", "balanced_sum"):
        out = out.withColumn(v, F.when(counted, F.coalesce(v, F.lit(0)).cast("double")))
    return out.withColumn("balanced_avg", ratio("balanced_sum", "n_valid"))


def rolled_up(expected: DataFrame, view: DataFrame) -> DataFrame:
    """A full expected with its additive columns summed by chromosome pair and distance, then divided again."""
    chrom = view.select(F.col("name"), "chrom")
    for k in "12":
        expected = expected.join(F.broadcast(chrom.select(F.col("name").alias(f"region{k}"), F.col("chrom").alias(f"chrom{k}"))), f"region{k}")
    sums = expected.groupBy("chrom1", "chrom2", "dist").agg(*(F.sum(c).alias(c) for c in ("n_valid", "count_sum", "balanced_sum")))
    return sums.withColumn("balanced_avg", ratio("balanced_sum", "n_valid"))


def obs_over_exp(cmap: ContactMap, view: DataFrame, expected: DataFrame) -> DataFrame:
    """Balanced pixels over a full expected; pixels between chromosomes look distance -1 up."""
    px = regional_pixels(cmap, view, True).withColumn("dist", F.when(F.col("chrom1") == F.col("chrom2"), F.col("dist")).otherwise(-1))
    lookup = expected.select(*REGIONS, "dist", F.col("balanced_avg").alias("e"))
    return px.join(lookup, [*REGIONS, "dist"], "left").select("bin1_id", "bin2_id", ratio("balanced", "e").alias("oe"))


def diagsum_from_cells(cells: DataFrame, ignore_diags: int = 2, by: str | None = None) -> DataFrame:
    """Per distance of a dense square matrix (i, j, value), or of one for each value of by: valid cells and their sum; empty rows and columns are invalid."""
    keys = [by] if by else []
    bad = cells.groupBy(*keys, "i").agg(F.count("value").alias("n")).where("n = 0").select(*keys, "i")
    upper = cells.where("j >= i").join(bad, [*keys, "i"], "left_anti").join(bad.withColumnRenamed("i", "j"), [*keys, "j"], "left_anti")
    out = upper.groupBy(*keys, (F.col("j") - F.col("i")).alias("dist")).agg(F.count("*").alias("n_valid"), F.sum("value").alias("s"))
    return out.withColumn("sum", F.when(F.col("dist") >= ignore_diags, F.coalesce("s", F.lit(0.0)))).drop("s")


def smooth_cvd(expected: DataFrame, by_region: bool, value: str = "balanced_sum", sigma: float = 0.1) -> DataFrame:
    """Adds the log-smoothed average, by region pair or over all regions together."""
    keys = REGIONS if by_region else []
    name = "balanced_avg_smoothed" if by_region else "balanced_avg_smoothed_agg"
    summed = expected.groupBy(*keys, "dist").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("v"), F.sum("n_valid").alias("n"))
    kind = ", ".join([f"{k} string" for k in keys] + ["dist long", f"{name} double"])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf.dist > 0) & (pdf.n > 0)].sort_values("dist")
        v, n = (arrays.log_smooth(pdf.dist.to_numpy(float), pdf[c].to_numpy(float), sigma) for c in ("v", "n"))
        return pdf[[*keys, "dist"]].assign(**{name: v / n})

    return expected.join(summed.groupBy(*keys).applyInPandas(smooth, kind), [*keys, "dist"], "left")


def log_smooth_exact(expected: DataFrame, value: str, sigma: float = 0.1) -> DataFrame:
    """The Gaussian in log10 distance over all neighbours within five sigma, as a self-join by bucket of log distance."""
    width = 5 * sigma
    rows = expected.where("dist > 0").select("region1", "dist", F.log10("dist").alias("x"), F.col(value).alias("v"))
    left = rows.withColumn("b", F.explode(F.array(*(F.floor(F.col("x") / width) + k for k in (-1, 0, 1)))))
    right = rows.select("region1", F.col("x").alias("x2"), F.col("v").alias("v2"), F.floor(F.col("x") / width).alias("b"))
    near = left.join(right, ["region1", "b"]).where((F.col("x2") >= F.col("x") - width) & (F.col("x2") < F.col("x") + width))
    w = F.exp(-((F.col("x2") - F.col("x")) ** 2) / (2 * sigma * sigma))
    return near.groupBy("region1", "dist").agg(ratio(F.sum(w * F.col("v2")), F.sum(w)).alias("smoothed"))


def logbin(expected: DataFrame, value: str = "balanced_sum", per_decade: int = 10, min_nvalid: int = 200, min_count: int = 50) -> DataFrame:
    """Sums by logarithmic distance bin and region: mean distance, average, bounds; thin bins are dropped."""
    edges = arrays.persistent_log_bins(10, per_decade)
    bin_id = F.size(F.filter(F.array(*map(F.lit, map(int, edges))), lambda e: e <= F.col("dist"))) - 1
    binned = expected.withColumn("dist_bin_id", bin_id).where("dist_bin_id >= 0")
    out = binned.groupBy(*REGIONS, "dist_bin_id").agg(
        F.sum("n_valid").alias("n_valid"), F.sum("count_sum").alias("count_sum"), F.sum(value).alias(value), F.sum(F.col("dist") * F.col("n_valid")).alias("_d")
    )
    edge = F.array(*map(F.lit, map(int, edges)))
    out = out.withColumn("dist_avg", ratio("_d", "n_valid")).withColumn("balanced_avg", ratio(value, "n_valid")).drop("_d")
    out = out.withColumn("dist_bin_start", edge[F.col("dist_bin_id")].cast("long")).withColumn("dist_bin_end", (edge[F.col("dist_bin_id") + 1] - 1).cast("long"))
    return out.where((F.col("n_valid") > min_nvalid) & (F.col("balanced_avg") > 0) & (F.col("count_sum") > min_count))


def _drawn_slopes(binned: DataFrame, keys: list[str], sigma: float | None, smooth: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    rows = binned.withColumn("_x", F.log("dist_avg")).withColumn("_y", F.log("balanced_avg"))
    w = W.partitionBy(*keys).orderBy("dist_bin_id")  # a row a distance bin
    if smooth:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("dist_bin_id")
            return pdf.assign(**{c: smooth(pdf[c].to_numpy(float)) for c in ("_x", "_y")})

        grouped = rows if keys else rows.withColumn("_all", F.lit(0))
        rows = grouped.groupBy(*keys or ["_all"]).applyInPandas(run, grouped.schema)
    elif sigma:
        rows = rows.withColumns({c: gauss_rows(c, w, sigma) for c in ("_x", "_y")})
    nxt = lambda c: F.lead(c).over(w)
    return rows.select(
        *keys, "dist_bin_id", F.least("n_valid", nxt("n_valid")).alias("n_valid"), F.sqrt(F.col("dist_avg") * nxt("dist_avg")).alias("dist_avg"),
        ratio(nxt("_y") - F.col("_y"), nxt("_x") - F.col("_x")).alias("slope"), nxt("dist_bin_id").alias("_next"),
    ).where("_next is not null and slope is not null").drop("_next")


def slopes(binned: DataFrame, sigma: float | None = 2.0, *, smooth: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Log-log slope between consecutive kept distance bins of a region pair, at the geometric mean distance.

    Before, the logarithms of average and distance are smoothed over the region
    pair's bins, in their order, by a Gaussian of sigma bins (None: not at all), or by smooth.
    """
    return _drawn_slopes(binned, REGIONS, sigma, smooth)


def combined_slopes(combined: DataFrame, by_region: DataFrame | None = None, sigma: float | None = 1.3, *, smooth: Callable[[np.ndarray], np.ndarray] | None = None, spread: str = "std", minmax_drop_bins: int = 2) -> DataFrame:
    """Slopes of the curve of all regions together (the result of combine_binned), smoothed likewise.

    With slopes by region, low_err and high_err are the slope less and plus their weighted standard
    deviation, or their extremes without the last bins of each region (minmax).
    """
    out = _drawn_slopes(combined, [], sigma, smooth)
    if by_region is None:
        return out
    if spread == "minmax":
        spans = _extremes(by_region.withColumn("balanced_avg", F.col("slope")), minmax_drop_bins)
        return out.join(spans.select("dist_bin_id", F.col("low").alias("low_err"), F.col("high").alias("high_err")), "dist_bin_id", "left")
    w, v = F.col("n_valid"), F.col("slope")
    mean = by_region.groupBy("dist_bin_id").agg(ratio(F.sum(w * v), F.sum(w)).alias("_m"))
    var = by_region.join(mean, "dist_bin_id").groupBy("dist_bin_id").agg(F.sqrt(ratio(F.sum(w * (v - F.col("_m")) ** 2), F.sum(w))).alias("_s"))
    out = out.join(var, "dist_bin_id", "left")
    return out.select("dist_bin_id", "n_valid", "dist_avg", "slope", (v - F.col("_s")).alias("low_err"), (v + F.col("_s")).alias("high_err"))


def combine_binned(binned: DataFrame, minmax_drop_bins: int = 2, spread: str | Callable[[Column, Column], Column] = "logstd", value: str = "balanced_avg") -> DataFrame:
    """n_valid-weighted mean over regions by distance bin, with spread, and extremes without the last bins of each region.

    spread is logstd, std, or an aggregate made from the value and the weight
    columns; value may be slope. The result names the value balanced_avg.
    """
    binned = binned.withColumn("balanced_avg", F.col(value))
    w, v = F.col("n_valid"), F.col("balanced_avg")
    if spread != "logstd":
        made = F.sqrt(F.greatest(ratio(F.sum(w * v * v), F.sum(w)) - ratio(F.sum(w * v), F.sum(w)) ** 2, F.lit(0.0))).alias("std") if spread == "std" else spread(v, w).alias("spread")
        means = binned.groupBy("dist_bin_id").agg(F.sum("n_valid").alias("n_valid"), ratio(F.sum(w * F.col("dist_avg")), F.sum(w)).alias("dist_avg"), ratio(F.sum(w * v), F.sum(w)).alias("balanced_avg"), made)
        return means.join(_extremes(binned, minmax_drop_bins), "dist_bin_id", "left")
    mean = binned.groupBy("dist_bin_id").agg(F.sum("n_valid").alias("n_valid"), ratio(F.sum(w * F.col("dist_avg")), F.sum(w)).alias("dist_avg"), ratio(F.sum(w * v), F.sum(w)).alias("balanced_avg"), ratio(F.sum(w * F.log(v)), F.sum(w)).alias("_m"))
    logstd = binned.join(mean.select("dist_bin_id", "_m"), "dist_bin_id").groupBy("dist_bin_id").agg(F.exp(F.sqrt(F.greatest(ratio(F.sum(w * (F.log(v) - F.col("_m")) ** 2), F.sum(w)), F.lit(0.0)))).alias("logstd"))
    return mean.drop("_m").join(logstd, "dist_bin_id").join(_extremes(binned, minmax_drop_bins), "dist_bin_id", "left")


def _extremes(binned: DataFrame, drop: int) -> DataFrame:
    last = F.row_number().over(W.partitionBy(*REGIONS).orderBy(F.desc("dist_bin_id")))
    return binned.withColumn("_k", last).where(F.col("_k") > drop).groupBy("dist_bin_id").agg(F.min("balanced_avg").alias("low"), F.max("balanced_avg").alias("high"))


def interpolate_expected(expected: DataFrame, binned: DataFrame, columns: tuple[str, ...] = ("balanced_avg",), *, kind: str = "quadratic", by_region: bool | str = True, extrapolate_small_s: bool = False) -> DataFrame:
    """An expected whose columns come from a binned one, interpolated in log-log at the bins' middles and carried on.

    By region; or, if by_region is False or names a region, from one curve for
    all. Null below the first bin, unless asked for, and where a curve has too
    few bins for the kind (linear or quadratic).
    """
    curve, least = arrays.INTERPOLATORS[kind]
    keys = [*REGIONS, "dist"]

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("dist_bin_id")
        out = left[keys].assign(**{c: np.nan for c in columns})
        if len(right) >= least:
            ok = (left.dist >= (1 if extrapolate_small_s else right.dist_bin_start.min())).to_numpy()
            x, at = np.log((right.dist_bin_start + right.dist_bin_end).to_numpy(float) / 2), np.log(left.dist[ok].to_numpy(float))
            for c in columns:
                with np.errstate(divide="ignore", invalid="ignore"):
                    out.loc[ok, c] = np.exp(curve(at, x, np.log(right[c].to_numpy(float))))
        return out

    need = ["dist_bin_id", "dist_bin_start", "dist_bin_end", *columns]
    schema = "region1 string, region2 string, dist long, " + ", ".join(f"{c} double" for c in columns)
    if by_region is True and set(REGIONS) <= set(binned.columns):
        filled = expected.select(keys).groupBy(*REGIONS).cogroup(binned.select(*REGIONS, *need).groupBy(*REGIONS)).applyInPandas(fill, schema)
    else:
        if isinstance(by_region, str):
            binned = binned.where(F.col("region1") == by_region)
        one = binned.select(need).toPandas()  # a row a distance bin
        if one.dist_bin_id.duplicated().any():
            raise ValueError("a combined expected has one row for each distance bin")
        filled = expected.select(keys).groupBy(*REGIONS).applyInPandas(lambda left: fill(left, one), schema)
    return expected.drop(*columns).join(filled, keys, "left")
