"""Track digitizing, saddles, and eigenvector compartments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..plans.joins import annotate, assign_supports, small
from ..schema import ContactMap, ratio
from ..sources.workspace import Kept
from . import eigen, quantiles
from .expected import diag_table
from .matrix import knight_ruiz


def bin_edges(track: DataFrame, n_bins: int, *, vrange: tuple[float, float] | None = None, qrange: tuple[float, float] | None = None) -> list[float]:
    """n_bins + 1 edges: evenly spaced values, or exact quantiles at evenly spaced ranks."""
    if (vrange is None) == (qrange is None):
        raise ValueError("give one of vrange and qrange")
    if vrange:
        return np.linspace(*vrange, n_bins + 1).tolist()
    q = np.linspace(*qrange, n_bins + 1).tolist()
    return list(quantiles.exact_quantiles(track, [], "value", q).first()[0])


def digitized(value: Column, edges: list[float]) -> Column:
    """-1 for null, else the number of edges at or below: 0 low, 1..n, n + 1 high, the maximum included."""
    return F.when(value.isNull(), F.lit(-1)).otherwise(sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)))


def digitize(track: DataFrame, n_bins: int, *, vrange=None, qrange=None) -> DataFrame:
    return track.withColumn("cls", digitized(F.col("value"), bin_edges(track, n_bins, vrange=vrange, qrange=qrange)))


def region_cells(cmap: ContactMap, bins: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs of bins of one region, zeros included: region, i, j, dist, value and columns of either bin."""
    a, b = (bins.select("region", F.col("bin_id").alias(k), *(F.col(c).alias(c + k) for c in ["weight", *columns])) for k in "ij")
    px = cmap.pixels.select(F.col("bin1_id").alias("lo"), F.col("bin2_id").alias("hi"), "count")
    cells = a.join(b, "region").withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).join(px, ["lo", "hi"], "left")
    value = F.coalesce("count", F.lit(0)) * F.col("weighti") * F.col("weightj")
    return cells.withColumn("dist", F.col("hi") - F.col("lo")).withColumn("value", value).drop("lo", "hi")


def _completed(sums: DataFrame, n_bins: int, trim: bool) -> DataFrame:
    """S and C with their transposes added."""
    turned = F.array(F.struct("ci", "cj"), F.struct(F.col("cj").alias("ci"), F.col("ci").alias("cj")))
    both = sums.select(F.explode(turned).alias("x"), "s", "c")
    out = both.groupBy("x.ci", "x.cj").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return out.where(f"ci between 1 and {n_bins} and cj between 1 and {n_bins}") if trim else out


def saddle_cis(cmap: ContactMap, track: DataFrame, view: DataFrame, expected: DataFrame, n_bins: int, *, min_diag: int = 3, max_diag: int = -1, trim_outliers: bool = False) -> DataFrame:
    """Sum s and number c of observed over expected by class pair; zeros count, both triangles do.

    Absent pixels add to c alone, so only stored ones are read: c comes from
    the classes' indicator vectors, correlated at the distances that count.
    """
    bins = assign_supports(cmap.bins, view).where("region is not null and weight is not null").join(track.select("bin_id", "cls"), "bin_id").where("cls >= 0")
    reach = F.col("dist") >= min_diag if max_diag < 0 else F.col("dist").between(min_diag, max_diag)
    lookup = expected.where(reach & (F.col("balanced_avg") != 0)).select(F.col("region1").alias("region"), "dist", F.col("balanced_avg").alias("e"))

    def count(own: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if own.empty or at.empty:
            return pd.DataFrame({"ci": [], "cj": [], "c": []})
        classes = np.sort(own.cls.unique())
        pairs = arrays.class_pairs(own.bin_id.to_numpy(), np.searchsorted(classes, own.cls), at.dist.to_numpy())
        ci, cj = np.nonzero(pairs)
        return pd.DataFrame({"ci": classes[ci], "cj": classes[cj], "c": pairs[ci, cj]})

    counted = bins.select("region", "bin_id", "cls").groupBy("region").cogroup(lookup.groupBy("region")).applyInPandas(count, "ci int, cj int, c long")
    px = annotate(cmap.pixels, bins, ("region", "cls", "weight"), rows=cmap.n_bins()).where("region1 = region2").withColumn("dist", F.col("bin2_id") - F.col("bin1_id"))
    oe = px.join(small(lookup.withColumnRenamed("region", "region1"), cmap.n_bins()), ["region1", "dist"]).withColumn("oe", ratio(F.col("count") * F.col("weight1") * F.col("weight2"), "e"))
    pair = lambda x, y: F.struct(F.col(f"cls{x}").alias("ci"), F.col(f"cls{y}").alias("cj"))
    sides = F.when(F.col("dist") == 0, F.array(pair(1, 2))).otherwise(F.array(pair(1, 2), pair(2, 1)))
    sums = oe.select(F.explode(sides).alias("x"), "oe").groupBy("x.ci", "x.cj").agg(F.sum("oe").alias("s"))
    sizes = counted.groupBy("ci", "cj").agg(F.sum("c").alias("c"))
    return _completed(sizes.join(sums, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("s", F.lit(0.0)).alias("s"), "c"), n_bins, trim_outliers)


def saddle_trans(cmap: ContactMap, track: DataFrame, expected: DataFrame, n_bins: int, *, trim_outliers: bool = False) -> DataFrame:
    """The same between chromosomes. Absent pixels are zeros, so their number comes from class sizes and only stored pixels are summed."""
    bins = cmap.bins.join(track.select("bin_id", "cls"), "bin_id").where("cls >= 0 and weight is not null")
    e = expected.where("balanced_avg <> 0").select(F.col("region1").alias("chrom1"), F.col("region2").alias("chrom2"), F.col("balanced_avg").alias("e"))
    n = bins.groupBy("chrom", "cls").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("chrom").alias(f"chrom{k}"), F.col("cls").alias(c), F.col("n").alias(f"n{k}")) for k, c in (("1", "ci"), ("2", "cj")))
    sizes = e.join(a, "chrom1").join(b, "chrom2").groupBy("ci", "cj").agg(F.sum(F.col("n1") * F.col("n2")).alias("c"))
    px = annotate(cmap.pixels, bins, ("chrom", "cls", "weight"), rows=cmap.n_bins()).where("chrom1 <> chrom2").join(F.broadcast(e), ["chrom1", "chrom2"])
    sums = px.groupBy(F.col("cls1").alias("ci"), F.col("cls2").alias("cj")).agg(F.sum(ratio(F.col("count") * F.col("weight1") * F.col("weight2"), "e")).alias("s"))
    return _completed(sizes.join(sums, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("s", F.lit(0.0)).alias("s"), "c"), n_bins, trim_outliers)


def saddle_strength(saddle: DataFrame, n_bins: int) -> DataFrame:
    """For extents k = 1..n-1 of a trimmed saddle: mean of both like corners over mean of both unlike ones; extent 0 is 0."""
    inner = saddle.where(f"ci between 1 and {n_bins} and cj between 1 and {n_bins}")
    rows = inner.withColumn("extent", F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1))))
    low = lambda c: F.col(c) <= F.col("extent")
    high = lambda c: F.col(c) > n_bins - F.col("extent")
    like, unlike = (low("ci") & low("cj")), (low("ci") & high("cj"))
    like2, unlike2 = (high("ci") & high("cj")), (high("ci") & low("cj"))
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    intra = ratio(total(like, "s") + total(like2, "s"), total(like, "c") + total(like2, "c"))
    inter = ratio(total(unlike, "s") + total(unlike2, "s"), total(unlike, "c") + total(unlike2, "c"))
    out = rows.groupBy("extent").agg(ratio(intra, inter).alias("strength"))
    return out.union(saddle.sparkSession.range(1).select(F.lit(0).alias("extent"), F.lit(0.0).alias("strength")))


def cis_operator(cmap: ContactMap, view: DataFrame, *, ignore_diags: int = 2, clip_percentile: float = 99.9) -> tuple[DataFrame, DataFrame]:
    """Entries (key, i, j, s) and members (key, bin_id) of observed over expected less one, by region.

    Members have contacts in their region. Expected is the mean of a logarithmic
    distance bin over all pairs of members; absent pixels are zeros, so only stored ones
    and the ignored diagonals, which are ones, are entries. They are clipped at a
    percentile of all cells, absent ones included.
    """
    bins = assign_supports(cmap.bins, view).where("region is not null").select("bin_id", "region", "weight")
    kept = Kept(cmap.bins.sparkSession)
    px = annotate(cmap.pixels, bins, ("region", "weight"), rows=cmap.n_bins()).where("region1 = region2 and weight1 is not null and weight2 is not null and count > 0")
    px = kept.table(px.select(F.col("region1").alias("key"), F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), (F.col("count") * F.col("weight1") * F.col("weight2")).alias("value")))
    members = kept.table(px.select("key", F.explode(F.array("i", "j")).alias("bin_id")).distinct())
    own = bins.select(F.col("region").alias("key"), "bin_id").join(members.select("bin_id", F.lit(1.0).alias("weight")), "bin_id", "left")
    pairs = view.select(F.col("name").alias("region1"), F.col("name").alias("region2"))
    counts = diag_table(own.withColumnRenamed("key", "region"), pairs).select(F.col("region1").alias("key"), "dist", "n_valid")
    widest = bins.groupBy("region").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 2
    edges = F.array(*map(F.lit, arrays.log_bins(1, max(widest, 2), 1.03).tolist()))
    which = F.size(F.filter(edges, lambda e: e <= F.col("dist")))
    steps = F.array(*map(F.lit, range(ignore_diags))).cast("array<long>")
    near = members.select("key", F.col("bin_id").alias("i"), F.explode(F.transform(steps, lambda d: F.col("bin_id") + d)).alias("j"))
    near = near.join(members.withColumnRenamed("bin_id", "j"), ["key", "j"], "left_semi").select("key", "i", "j", F.lit(1.0).alias("value"))
    cells = px.where(F.col("j") - F.col("i") >= ignore_diags).unionByName(near).withColumn("dist", F.col("j") - F.col("i")).withColumn("db", which)
    pairs_in = counts.withColumn("db", which).groupBy("key", "db").agg(F.sum("n_valid").alias("n"))
    mean = kept.table(cells.groupBy("key", "db").agg(F.sum("value").alias("sum")).join(pairs_in, ["key", "db"]).select("key", "db", ratio("sum", "n").alias("m")))
    oe = cells.join(small(mean), ["key", "db"]).select("key", "i", "j", F.when(F.col("dist") < ignore_diags, 1.0).when(F.col("m") == 0, F.col("value")).otherwise(F.col("value") / F.col("m")).alias("s"))
    if not clip_percentile:
        return oe, members
    oe = kept.table(oe)
    sizes = members.groupBy("key").agg((F.count("*") * F.count("*")).alias("cells"))
    top = clipped_at(oe.select("key", F.col("s").alias("v"), F.when(F.col("i") == F.col("j"), 1).otherwise(2).alias("n")), sizes, clip_percentile)
    return oe.join(F.broadcast(top), "key").select("key", "i", "j", F.least("s", "top").alias("s")), members


def clipped_at(values: DataFrame, sizes: DataFrame, percentile: float) -> DataFrame:
    """(key, top): a percentile over so many cells a key (key, cells), of which those not among the values (key, v, n) are zero and the values aren't below it."""
    stored = values.groupBy("key").agg(F.sum("n").alias("stored"))
    at = sizes.join(stored, "key").select("key", (F.lit(percentile / 100) * (F.col("cells") - 1)).alias("at"), (F.col("cells") - F.col("stored")).alias("zeros"))
    ends = at.select("key", "at", "zeros", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("end")).withColumn("r", F.col("end") - F.col("zeros")).distinct()
    found = quantiles.at_ranks(values, ["key"], ends.where("r >= 0").select("key", "r"))
    value = ends.join(found, ["key", "r"], "left").select("key", "at", "end", F.coalesce("v", F.lit(0.0)).alias("v"))
    low, high = (F.max(F.when(F.col("end") == f("at"), F.col("v"))) for f in (F.floor, F.ceil))
    return value.groupBy("key", "at").agg(low.alias("low"), high.alias("high")).select("key", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("top"))


def phased(vectors: DataFrame, track: DataFrame, sort: str | None = None) -> DataFrame:
    """Vectors (key, bin_id, k, eigval, value) turned to agree with a track (bin_id, value), by Spearman's or the named metric, and ordered by it if one is named."""
    if sort not in (None, "spearmanr", "pearsonr", "var_explained", "MAD_explained"):
        raise ValueError(f"no such metric: {sort}")
    of = ["key", "k"]
    both = vectors.join(track.select("bin_id", F.col("value").alias("y")), "bin_id").where("value is not null and y is not null and not isnan(y)").select(*of, F.col("value").alias("x"), "y")
    if sort == "MAD_explained":
        middle = both.groupBy(*of).agg(F.median("x").alias("mx"), F.median("y").alias("my"))  # as many values as bins
        off = both.join(F.broadcast(middle), of).select(*of, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
        scored = off.groupBy(*of).agg((F.median(F.col("x") * F.col("y")) * F.median(F.abs("x"))).alias("r"), F.count("*").alias("n"))
    else:
        if sort in (None, "spearmanr"):
            middle = lambda c: F.rank().over(W.partitionBy(*of).orderBy(c)) + (F.count("*").over(W.partitionBy(*of, c)) - 1) / 2
            both = both.select(*of, middle("x").alias("x"), middle("y").alias("y"))
        r = F.corr("x", "y")
        scored = both.groupBy(*of).agg((F.abs(r) * r * F.var_pop("x") if sort == "var_explained" else r).alias("r"), F.count("*").alias("n"))
    r = F.when(F.col("n") >= 3, F.nanvl(F.coalesce("r", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    scored = vectors.select(*of).distinct().join(scored, of, "left").select(*of, F.coalesce(r, F.lit(0.0)).alias("r"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.abs("r")), "k")).cast("int") if sort else F.col("k")
    scored = scored.select(*of, F.when(F.col("r") < 0, -1.0).otherwise(1.0).alias("sign"), place.alias("place"))
    return vectors.join(F.broadcast(scored), of).select("key", "bin_id", F.col("place").alias("k"), "eigval", (F.col("value") * F.col("sign")).alias("value"))


def solved(entries: DataFrame, members: DataFrame, bins: DataFrame, n: int, weighted: bool = False, phasing: DataFrame | None = None, sort: str | None = None) -> DataFrame:
    """(key, bin_id, k, eigval, value) for all bins (key, bin_id): null where a bin isn't a member or a key has too few."""
    spark = bins.sparkSession
    values, vectors = eigen.leading(entries, members, n)
    rows = [(key, k + 1, float(x)) for key, xs in values.items() if len(xs) == n for k, x in enumerate(xs)]
    table = F.broadcast(spark.createDataFrame(rows, "key string, k int, eigval double"))
    long = vectors.select("key", "bin_id", F.posexplode("v").alias("k", "value")).withColumn("k", F.col("k") + 1).join(table, ["key", "k"])
    largest = long.groupBy("key", "k").agg(F.max(F.struct(F.abs("value").alias("size"), (-F.col("bin_id")).alias("b"), F.signum("value").alias("sign"))).alias("top"))
    size = F.sqrt(F.abs("eigval")) if weighted else F.lit(1.0)
    long = long.join(F.broadcast(largest), ["key", "k"]).select("key", "bin_id", "k", "eigval", (F.col("value") * F.col("top.sign") * size).alias("value"))
    if phasing is not None:
        long = phased(long, phasing, sort)
    found = long.select("key", "k", "eigval").distinct()
    every = bins.select("key", "bin_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).join(F.broadcast(found), ["key", "k"], "left")
    return every.join(long.select("key", "bin_id", "k", "value"), ["key", "bin_id", "k"], "left").select("key", "bin_id", "k", "eigval", "value")


def eigs_cis(cmap: ContactMap, view: DataFrame, n_eigs: int = 3, *, phasing: DataFrame | None = None, ignore_diags: int = 2, clip_percentile: float = 99.9, sort: str | None = None) -> DataFrame:
    """Long form (region, bin_id, k, eigval, value): leading eigenvectors of observed over expected less one, scaled by the root of the eigenvalue.

    Regions are solved together by block Lanczos over the stored pixels; no task
    holds a region's matrix. Regions of too few bins have nulls.
    """
    operator = cis_operator(cmap, view, ignore_diags=ignore_diags, clip_percentile=clip_percentile)
    return eigs_of(operator, cmap, view, n_eigs, phasing=phasing, ignore_diags=ignore_diags, sort=sort)


def eigs_of(operator: tuple[DataFrame, DataFrame], cmap: ContactMap, view: DataFrame, n_eigs: int = 3, *, phasing: DataFrame | None = None, ignore_diags: int = 2, sort: str | None = None) -> DataFrame:
    """``eigs_cis`` of an operator (entries and members) that is there already."""
    entries, members = operator
    bins = assign_supports(cmap.bins, view).where("region is not null").select(F.col("region").alias("key"), "bin_id")
    enough = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(ignore_diags + 3, n_eigs)).select("key")
    entries, members = (df.join(F.broadcast(enough), "key", "left_semi") for df in (entries, members))
    return solved(entries, members, bins, n_eigs, True, phasing, sort).withColumnRenamed("key", "region")


def trans_operator(cmap: ContactMap, *, perc_top: float = 99.95, perc_bottom: float = 1.0, seed: int = 0, max_products: int = 100) -> tuple[DataFrame, DataFrame]:
    """Entries and members, under one key, of the balanced map between chromosomes over its mean, less one.

    Trans values are clipped at a percentile of all trans cells, and bins of low
    marginal go. A cell within a chromosome stands for a random trans cell of its
    row or column, drawn by a hash; only draws that meet a stored pixel make
    entries. The map is balanced with them, twice, drawing from the balanced one
    the second time.
    """
    kept = Kept(cmap.bins.sparkSession)
    px = annotate(cmap.pixels, cmap.bins, rows=cmap.n_bins()).where("chrom1 <> chrom2 and weight1 is not null and weight2 is not null and count > 0")
    px = kept.table(px.select(F.lit("all").alias("key"), F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), (F.col("count") * F.col("weight1") * F.col("weight2")).alias("v")))
    n = cmap.bins.groupBy("chrom").agg(F.count("*").alias("n"))
    sizes = n.agg(F.lit("all").alias("key"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("cells"))
    top = clipped_at(px.select("key", "v", F.lit(2).alias("n")), sizes, perc_top)
    px = px.join(F.broadcast(top), "key").select("i", "j", F.least("v", "top").alias("v"))
    margin = kept.table(px.select(F.explode(F.array("i", "j")).alias("bin_id"), "v").groupBy("bin_id").agg(F.sum("v").alias("m")))
    low = quantiles.exact_quantiles(margin.where("m > 0"), [], "m", [perc_bottom / 100])
    good = margin.join(F.broadcast(low)).where((F.col("m") > 0) & (F.col("m") >= F.col("q")[0])).select("bin_id").join(cmap.bins.select("bin_id", "chrom"), "bin_id")
    own = good.groupBy("chrom").agg(F.min("bin_id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a chromosome
    own = own.select("chrom", "n", before.alias("base"), F.sum("n").over(W.partitionBy()).alias("total"))
    place = F.row_number().over(W.partitionBy("chrom").orderBy("bin_id")) - 1
    good = kept.table(good.withColumn("place", place).join(F.broadcast(own), "chrom").select("bin_id", "chrom", "n", "base", "total", (F.col("base") + F.col("place")).cast("long").alias("pos")))
    rows = good.count()
    for k in "ij":
        px = px.join(small(good.select(F.col("bin_id").alias(k)), rows), k, "left_semi")
    px = kept.table(px)
    width = 256  # bins a bucket, so that a chromosome's pairs are spread over tasks
    a = good.select("chrom", F.col("bin_id").alias("i"), F.col("pos").alias("pi"), "n", "base", "total")
    b = good.select("chrom", F.col("bin_id").alias("j"), F.col("pos").alias("pj"), F.floor(F.col("pos") / width).alias("b"))
    a = a.withColumn("b", F.explode(F.sequence(F.floor(F.col("pi") / width), F.floor((F.col("base") + F.col("n") - 1) / width))))
    cells = a.join(b, ["chrom", "b"]).where("pj >= pi and total > n")
    h = F.xxhash64("pi", "pj", F.lit(seed))
    drawn = F.pmod(F.shiftrightunsigned(h, 1), F.col("total") - F.col("n"))
    cells = cells.select("i", "j", F.when(F.pmod(h, F.lit(2)) == 0, F.col("i")).otherwise(F.col("j")).alias("own"), F.when(drawn >= F.col("base"), drawn + F.col("n")).otherwise(drawn).alias("pos"))
    partner = small(good.select("pos", F.col("bin_id").alias("far")), rows)
    cells = cells.join(partner, "pos").select("i", "j", F.least("own", "far").alias("x"), F.greatest("own", "far").alias("y"))
    draws = kept.table(cells.join(px.select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("v")), ["x", "y"]).select("i", "j", "x", "y", "v"))

    def scaled(df: DataFrame, weight: DataFrame, first: str, second: str) -> DataFrame:
        for k in (first, second):
            df = df.join(small(weight.select(F.col("bin_id").alias(k), F.col("weight").alias(f"w{k}")), rows), k).withColumn("v", F.col("v") * F.col(f"w{k}")).drop(f"w{k}")
        return df

    for _ in range(2):
        whole = kept.table(px.select("i", "j", "v").union(draws.select("i", "j", "v")))
        as_map = ContactMap(good.select("bin_id"), whole.select(F.col("i").alias("bin1_id"), F.col("j").alias("bin2_id"), F.col("v").alias("count")), cmap.binsize, {}, rows)
        weight, _ = knight_ruiz(as_map, max_products=max_products)
        weight = kept.table(weight.where("weight is not null"))
        px = kept.table(scaled(px, weight, "i", "j"))
        last, draws = draws.select("i", "j", "v"), kept.table(scaled(draws, weight, "x", "y"))
    whole = px.select("i", "j", "v").union(scaled(last, weight, "i", "j").select("i", "j", "v"))
    members = weight.select(F.lit("all").alias("key"), "bin_id")
    mean = whole.agg((F.sum(F.col("v") * F.when(F.col("i") == F.col("j"), 1).otherwise(2)) / F.lit(float(max(1, weight.count())) ** 2)).alias("mean"))
    return whole.join(F.broadcast(mean)).select(F.lit("all").alias("key"), "i", "j", (F.col("v") / F.col("mean")).alias("s")), members


def eigs_trans(cmap: ContactMap, n_eigs: int = 3, *, phasing: DataFrame | None = None, perc_top: float = 99.95, perc_bottom: float = 1.0, sort: str | None = None, seed: int = 0) -> DataFrame:
    """Long form (bin_id, k, eigval, value) of unit eigenvectors from contacts between chromosomes; no task holds the map."""
    entries, members = trans_operator(cmap, perc_top=perc_top, perc_bottom=perc_bottom, seed=seed)
    return solved(entries, members, cmap.bins.select(F.lit("all").alias("key"), "bin_id"), n_eigs, False, phasing, sort).drop("key")


def indicator(kind: str, a: Column, b: Column, which=None) -> Column:
    """1, 0 or null for a pair of bin types, by scheme; null types are invalid."""
    t, valid = F.lit(which), a.isNotNull() & b.isNotNull()
    one, none = (a == t) & (b == t), (a != t) & (b != t)
    rule = {
        "any_mixed": F.when(a == b, 1).otherwise(0),
        "segments": F.when(a == b, 1).otherwise(0),
        "type_mixed": F.when(one, 1).when(a != b, 0),
        "type_other": F.when(one, 1).when((a == t) | (b == t), 0),
        "type_nontype": F.when(one, 1).when(none, 0),
        "type_rest": F.when(one, 1).otherwise(0),
    }[kind]
    return F.when(valid, rule)


def contrast_by_diag(cells: DataFrame, *, normalized: bool = False) -> DataFrame:
    """Per distance of cells (dist, value, ind): means of both sets and their ratio, or (a - b) / (a + b); counts n1, n2."""
    a, b = F.avg(F.when(F.col("ind") == 1, F.col("value"))), F.avg(F.when(F.col("ind") == 0, F.col("value")))
    out = cells.groupBy("dist").agg(F.count(F.when((F.col("ind") == 1) & F.col("value").isNotNull(), 1)).alias("n1"), F.count(F.when((F.col("ind") == 0) & F.col("value").isNotNull(), 1)).alias("n2"), a.alias("a"), b.alias("b"))
    value = ratio(F.col("a") - F.col("b"), F.col("a") + F.col("b")) if normalized else ratio("a", "b")
    return out.select("dist", "n1", "n2", value.alias("contrast"))


def contrast(by_diag: DataFrame, ignore_diags: int = 1) -> DataFrame:
    """Mean over distances weighted by sqrt(n1 n2)."""
    w = F.when(F.col("contrast").isNotNull(), F.sqrt(F.col("n1") * F.col("n2")))
    return by_diag.where(F.col("dist") >= ignore_diags).agg(ratio(F.sum(w * F.col("contrast")), F.sum(w)).alias("contrast"))


def oe_by_log_distance(cells: DataFrame, edges: list[int]) -> DataFrame:
    """Cells (region, i, j, dist, value) over the mean of their logarithmic distance bin; a mean of 0 changes nothing."""
    which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("dist")))
    binned = cells.where("value is not null").withColumn("db", which)
    mean = binned.groupBy("region", "db").agg(F.avg("value").alias("m"))
    return binned.join(F.broadcast(mean), ["region", "db"]).select("region", "i", "j", (F.col("value") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m"))).alias("oe"))
