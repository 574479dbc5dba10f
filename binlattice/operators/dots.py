"""Enriched pixels ("dots"): local adjustment of expected, false discovery by lambda-bin, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.clustering import inserted
from ..plans.joins import annotate, assign_supports, small
from ..schema import ContactMap
from ..sources.workspace import Kept


def lambda_edges(n: int = 40) -> list[float]:
    """Inner edges 1, 2^(1/3), 2^(2/3), ...; the outer intervals are open."""
    return [2 ** (k / 3) for k in range(n)]


def corners(kernel: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, column, weight) whose look-ups in a summed-area table add up to the kernel: its differences in both directions, few for shapes made of rectangles."""
    d = np.zeros((kernel.shape[0] + 1, kernel.shape[1] + 1))
    d[:-1, :-1] += kernel
    d[1:, :-1] -= kernel
    d[:-1, 1:] -= kernel
    d[1:, 1:] += kernel
    return [(int(y), int(x), float(d[y, x])) for y, x in zip(*np.nonzero(d), strict=True)]


def summed(a: np.ndarray) -> np.ndarray:
    """Summed-area table, with a row and a column of zeros before it."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=out[1:, 1:])
    return out


def convolved(table: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The convolution with a kernel at all places where it fits, from the summed-area table."""
    turned = kernel[::-1, ::-1]
    side = len(kernel)
    h, w = table.shape[0] - side, table.shape[1] - side
    out = np.zeros((h, w))
    for y, x, weight in corners(turned):  # the kernel's cell (y, x) lies over the table's differences there
        out += weight * table[y : y + h, x : x + w]
    return out


def tile_scores(counts: np.ndarray, wi: np.ndarray, wj: np.ndarray, e: np.ndarray, kernels: dict[str, np.ndarray], max_nans: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which inner cells of a tile keep their scores, and la_exp by kernel.

    The tile has a border as wide as the kernels' half-width. wi, wj are weights of rows and columns,
    NaN where bad, and e is expected by cell, NaN where there is none.
    """
    side = len(next(iter(kernels.values())))
    half = side // 2
    value = counts * wi[:, None] * wj[None, :]
    valid = ~(np.isnan(value) | np.isnan(e))
    o, x = np.where(valid, value, 0.0), np.where(valid, e, 0.0)
    inner = (slice(half, len(wi) - half), slice(half, len(wj) - half))
    keep = side * side - np.rint(convolved(summed(valid), np.ones((side, side)))) < max_nans
    la = np.nan_to_num(e[inner] / (wi[inner[0], None] * wj[None, inner[1]]))
    tables = [summed(t) for t in (o, x, o != 0, x != 0)]
    out = {}
    for name, kernel in kernels.items():
        under, some, seen = (convolved(t, k) for t, k in zip(tables[1:], (kernel, kernel != 0, kernel != 0), strict=True))
        over = np.where(np.rint(some) > 0, convolved(tables[0], kernel), 0.0)
        known = np.rint(seen) > 0
        keep &= known & (under != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[name] = la * over / under
    return keep, out


def scores(cmap: ContactMap, view: DataFrame, expected: DataFrame, kernels: dict[str, np.ndarray], *, band: int, max_nans: int = 1, tile: int = 256) -> DataFrame:
    """(bin1_id, bin2_id, region, count, kernel, la_exp) of all pixels of the band, zeros included.

    la_exp = expected / (w1 w2) * (kernel over observed) / (kernel over expected).
    A tile of the band gets its stored pixels, with a border as wide as the
    kernels' half-width, the weights of its rows and columns and the expected
    values, so little more than the band is shuffled, once. There, summed-area
    tables give every kernel as a few look-ups. A pixel stays if fewer than
    max_nans cells under the kernels are invalid, for all kernels.
    """
    half = arrays.check_kernels(kernels, 0)
    reach = band + 2 * half
    bins = assign_supports(cmap.bins, view).where("region is not null").select("region", "bin_id", "weight")
    sides = lambda c: F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile))
    touches = f"(tj - ti + 1) * {tile} > 1 and (tj - ti) * {tile} - {tile - 1} < {band}"
    near = F.sequence(F.lit(0).cast("long"), F.lit((band + tile - 1) // tile + 1).cast("long"))
    rows = bins.withColumn("ti", F.explode(sides("bin_id"))).withColumn("tj", F.explode(F.transform(near, lambda k: F.col("ti") + k)))
    columns = bins.withColumn("tj", F.explode(sides("bin_id"))).withColumn("ti", F.explode(F.transform(near, lambda k: F.col("tj") - k)))
    number = lambda c: F.col(c).cast("double")
    part = lambda df, kind, a, b, x: df.where(touches).select("region", "ti", "tj", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), x.alias("x"))
    none = F.lit(0).cast("long")
    px = annotate(cmap.pixels.where(F.col("bin2_id") - F.col("bin1_id") <= reach), bins, ("region",), rows=cmap.n_bins()).where("region1 = region2").withColumnRenamed("region1", "region")
    px = px.withColumn("ti", F.explode(sides("bin1_id"))).withColumn("tj", F.explode(sides("bin2_id")))
    extent = bins.groupBy("region").agg(F.floor(F.min("bin_id") / tile).alias("lo"), F.floor(F.max("bin_id") / tile).alias("hi"))
    all_tiles = extent.withColumn("ti", F.explode(F.sequence("lo", "hi"))).withColumn("tj", F.explode(F.sequence(F.col("ti"), F.least("hi", F.col("ti") + near[F.size(near) - 1]))))
    lookup = expected.where(F.col("dist") <= reach).select(F.col("region1").alias("region"), "dist", F.col("balanced_avg").alias("e"))
    if "region2" in expected.columns:
        lookup = expected.where((F.col("dist") <= reach) & (F.col("region1") == F.col("region2"))).select(F.col("region1").alias("region"), "dist", F.col("balanced_avg").alias("e"))
    e_rows = all_tiles.join(small(lookup, cmap.n_bins()), "region")
    every = part(px, 0, F.col("bin1_id"), F.col("bin2_id"), number("count"))
    every = every.union(part(rows, 1, F.col("bin_id"), none, number("weight"))).union(part(columns, 2, F.col("bin_id"), none, number("weight"))).union(part(e_rows, 3, F.col("dist"), none, number("e")))
    kind = cmap.pixels.schema["count"].dataType.simpleString()
    made = pa.float64() if kind in ("double", "float") else pa.int64()

    def score(t: pa.Table) -> pa.Table:
        region, ti, tj = (t[c][0].as_py() for c in ("region", "ti", "tj"))
        which, a, b, x = (t[c].to_numpy() for c in ("kind", "a", "b", "x"))
        r0, c0, wide = ti * tile - half, tj * tile - half, tile + 2 * half
        counts, wi, wj = np.zeros((wide, wide)), np.full(wide, np.nan), np.full(wide, np.nan)
        here = np.zeros((2, wide), dtype=bool)
        m = which == 0
        counts[a[m] - r0, b[m] - c0] = x[m]
        for k, w, first in ((1, wi, r0), (2, wj, c0)):
            m = which == k
            w[a[m] - first], here[k - 1][a[m] - first] = x[m], True
        by_dist = np.full(reach + 1, np.nan)
        m = which == 3
        by_dist[a[m]] = x[m]
        dist = c0 - r0 + np.arange(wide)[None, :] - np.arange(wide)[:, None]
        e = np.where((dist >= 0) & (dist <= reach), by_dist[np.clip(dist, 0, reach)], np.nan)
        keep, found = tile_scores(counts, wi, wj, e, kernels, max_nans)
        inner = slice(half, half + tile)
        d = dist[inner, inner]
        keep &= (d > 0) & (d < band) & here[0][inner, None] & here[1][None, inner]
        i, j = np.nonzero(keep)
        n = counts[inner, inner][i, j]
        return pa.table({
            "bin1_id": pa.array(np.tile(i + r0 + half, len(kernels))), "bin2_id": pa.array(np.tile(j + c0 + half, len(kernels))), "region": pa.array([region] * (len(i) * len(kernels)), pa.string()),
            "count": pa.array(np.tile(n, len(kernels)), made, safe=False) if made == pa.float64() else pa.array(np.tile(n.astype(np.int64), len(kernels))),
            "kernel": pa.array(np.repeat(list(kernels), len(i)), pa.string()), "la_exp": pa.array(np.concatenate([la[i, j] for la in found.values()])),
        })

    schema = f"bin1_id long, bin2_id long, region string, count {'double' if made == pa.float64() else 'long'}, kernel string, la_exp double"
    return every.groupBy("region", "ti", "tj").applyInArrow(score, schema).withColumn("count", F.col("count").cast(kind))


def with_lambda_bin(scored: DataFrame, edges: list[float]) -> DataFrame:
    """Adds lbin: the number of edges below la_exp, so that bin k is (edge k-1, edge k]."""
    return scored.withColumn("lbin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("la_exp"))))


def histogram(scored: DataFrame, edges: list[float]) -> DataFrame:
    return with_lambda_bin(scored, edges).groupBy("kernel", "lbin", "count").agg(F.count("*").alias("n"))


def thresholds(hist: DataFrame, edges: list[float], fdr: float, *, open_bin: bool = False) -> DataFrame:
    """(kernel, lbin, count, threshold, qval): Benjamini-Hochberg by lambda-bin over the counts seen in any bin of the kernel.

    The survival function of the Poisson law at each upper edge is computed for
    the pairs of bin and count that occur, where they lie. The bin beyond the last edge has no upper one,
    so no count can be significant there: with open_bin, its threshold is over its largest count and its q-values are 1;
    without, pixels in it are a ValueError.
    """
    over = hist.agg(F.max("lbin")).first()[0]
    if not open_bin and over is not None and over >= len(edges):
        raise ValueError("the open lambda-bin isn't empty: more bins are needed")

    def survival(batches):
        for batch in batches:
            lbin, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            out = np.full(len(lbin), np.nan)
            for b in np.unique(lbin[lbin < len(edges)]):
                out[lbin == b] = arrays.poisson_sf_at(edges[b], count[lbin == b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, from_pandas=True)], ["lbin", "count", "sf"])

    met = hist.select("kernel", "count").distinct().join(hist.select("kernel", "lbin").distinct(), "kernel").select(F.col("lbin").cast("int").alias("lbin"), F.col("count").cast("long").alias("count")).distinct()
    sf = met.mapInArrow(survival, "lbin int, count long, sf double")
    grid = hist.select("kernel", "count").distinct().join(hist.select("kernel", "lbin").distinct(), "kernel")
    rows = grid.join(hist, ["kernel", "lbin", "count"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(sf, ["lbin", "count"])
    w = W.partitionBy("kernel", "lbin").orderBy("count")
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("rcs", F.sum("n").over(down)).withColumn("u", F.sum("n").over(W.partitionBy("kernel", "lbin")) * F.col("sf"))
    rows = rows.withColumn("best", F.max(fdr * F.col("rcs") - F.col("u")).over(up)).withColumn("qval", F.least(F.min(F.col("u") / F.nullif(F.col("rcs").cast("double"), F.lit(0.0))).over(up), F.lit(1.0)))
    whole = W.partitionBy("kernel", "lbin")
    limit = F.coalesce(F.min(F.when(F.col("best") >= 0, F.col("count"))).over(whole), F.max("count").over(whole) + 1)
    return rows.select("kernel", "lbin", "count", limit.alias("threshold"), "qval")


def extracted(scored: DataFrame, limits: DataFrame, edges: list[float], n_kernels: int) -> DataFrame:
    """Pixels at or over the threshold of their lambda-bin for every kernel: (bin1_id, bin2_id, kernel, count, la_exp, qval)."""
    hit = with_lambda_bin(scored, edges).join(limits, ["kernel", "lbin", "count"]).where(F.col("count") >= F.col("threshold"))
    every = F.count("*").over(W.partitionBy("bin1_id", "bin2_id"))
    return hit.withColumn("_n", every).where(F.col("_n") == n_kernels).select("bin1_id", "bin2_id", "region", "kernel", "count", "la_exp", "qval")


TILINGS = ((0, 0), (1, 1), (1, 0), (0, 1))  # in halves of a tile: every place is well inside one of these


def feature_tiles(points: DataFrame, radius_bins: float, tile: int, branching: int = 50) -> tuple[DataFrame, DataFrame]:
    """Clusters (region, label, n, x, y, square) of points (region, bin1_id, bin2_id), and the points with their label.

    Each tile of a region's plane grows a clustering-feature tree of its own. The
    clusters of a tile, as features, are then inserted into trees of tilings
    moved by half a tile, so that clusters at a border meet. A cluster is moved on only
    if it lies within four radii of a border of the tiling before: what is
    inside has met its neighbours. Points and features go in by place, so the result
    doesn't depend on partitions; it does on the order and on the tiling, as
    with any such tree.
    """
    kept = Kept(points.sparkSession)
    first = points.select("region", "bin1_id", "bin2_id").distinct()
    coordinate = lambda c: F.col(c).cast("double")
    square = coordinate("bin1_id") ** 2 + coordinate("bin2_id") ** 2
    place = F.struct("bin1_id", "bin2_id")
    features = first.select("region", place.alias("label"), F.lit(1.0).alias("n"), coordinate("bin1_id").alias("x"), coordinate("bin2_id").alias("y"), square.alias("square"))
    label = features.schema["label"].dataType.simpleString()
    members = None
    for turn, (right, down) in enumerate(TILINGS):
        cx, cy = F.col("x") / F.col("n"), F.col("y") / F.col("n")
        shift = lambda c, half: (c + half * tile / 2) / tile
        placed = features.withColumn("tx", F.floor(shift(cx, right))).withColumn("ty", F.floor(shift(cy, down)))
        if turn:  # only what lies at a border of the tiling before, or within reach of it, can still join others
            old = TILINGS[turn - 1]
            edge = lambda c, half: F.abs(shift(c, half) - F.round(shift(c, half))) * tile <= 4 * radius_bins
            moves = edge(cx, old[0]) | edge(cy, old[1]) | (edge(cx, TILINGS[0][0]) | edge(cy, TILINGS[0][1]))
            placed, rest = placed.where(moves), placed.where(~moves).drop("tx", "ty")
            if not placed.take(1):
                continue

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(a=[v["bin1_id"] for v in pdf.label], b=[v["bin2_id"] for v in pdf.label]).sort_values(["a", "b"])
            of, tree = inserted(pdf.n.to_numpy(), pdf[["x", "y"]].to_numpy(), pdf.square.to_numpy(), radius_bins, branching)
            n, total, squares = tree.clusters()
            head = np.full(tree.count, len(pdf))
            np.minimum.at(head, of, np.arange(len(pdf)))
            heads = pdf.label.to_numpy()[head]
            return pd.DataFrame({"region": pdf.region.to_numpy(), "old": pdf.label.to_numpy(), "label": heads[of], "n": n[of], "x": total[of, 0], "y": total[of, 1], "square": squares[of]})

        met = kept.table(placed.groupBy("region", "tx", "ty").applyInPandas(grow, f"region string, old {label}, label {label}, n double, x double, y double, square double"))
        made = met.dropDuplicates(["region", "label"]).select(*features.columns)
        step = met.select("region", "old", F.col("label").alias("new"))
        if turn:
            features = kept.table(rest.unionByName(made))
            members = kept.table(members.join(step.withColumnRenamed("old", "label"), ["region", "label"], "left").select("region", "bin1_id", "bin2_id", F.coalesce("new", "label").alias("label")))
        else:
            features = made
            members = kept.table(step.select("region", F.col("old.bin1_id").alias("bin1_id"), F.col("old.bin2_id").alias("bin2_id"), F.col("new").alias("label")))
    return features, members


def clusters(points: DataFrame, radius_bins: float, *, tile: int = 4096, branching: int = 50) -> DataFrame:
    """Points (region, bin1_id, bin2_id) with c_label, c_size and the centroid c_bin1, c_bin2 of their cluster.

    Clusters come from clustering-feature trees; a point then takes the cluster of the nearest centroid
    within two radii, or keeps its own, so a centroid is that of the tree and a size
    that of the points after it. Labels number a region's clusters by place.
    """
    features, members = feature_tiles(points, radius_bins, tile, branching)
    centre = features.select("region", "label", (F.col("x") / F.col("n")).alias("c_bin1"), (F.col("y") / F.col("n")).alias("c_bin2"))
    cell = 2 * radius_bins
    around = F.array(*map(F.lit, (-1, 0, 1)))
    at = centre.withColumn("gx", F.explode(F.transform(around, lambda k: F.floor(F.col("c_bin1") / cell) + k))).withColumn("gy", F.explode(F.transform(around, lambda k: F.floor(F.col("c_bin2") / cell) + k)))
    here = members.select("region", "bin1_id", "bin2_id", F.floor(F.col("bin1_id") / cell).alias("gx"), F.floor(F.col("bin2_id") / cell).alias("gy"))
    near = here.join(at, ["region", "gx", "gy"]).drop("gx", "gy")
    own = members.join(centre, ["region", "label"])
    away = (F.col("bin1_id") - F.col("c_bin1")) ** 2 + (F.col("bin2_id") - F.col("c_bin2")) ** 2
    best = near.unionByName(own).groupBy("region", "bin1_id", "bin2_id").agg(F.min(F.struct(F.round(away, 9).alias("d"), "c_bin1", "c_bin2", "label")).alias("c"))
    number = F.dense_rank().over(W.partitionBy("region").orderBy("c.c_bin1", "c.c_bin2", "c.label")) - 1
    size = F.count("*").over(W.partitionBy("region", "c.label"))
    return best.select("region", "bin1_id", "bin2_id", number.cast("long").alias("c_label"), size.alias("c_size"), F.col("c.c_bin1").alias("c_bin1"), F.col("c.c_bin2").alias("c_bin2"))


def clustered(pixels: DataFrame, radius_bins: float, *, tile: int = 4096) -> DataFrame:
    """Wide dots (one row a pixel) with cluster label, size and centroid, then the row of the largest count of each cluster."""
    rows = pixels.join(clusters(pixels, radius_bins, tile=tile), ["region", "bin1_id", "bin2_id"])
    first = F.row_number().over(W.partitionBy("region", "c_label").orderBy(F.desc("count"), "bin1_id", "bin2_id"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def enriched(dots: DataFrame) -> DataFrame:
    """Keeps dots that stand out from all four recommended neighbourhoods, and lone pixels only if very significant."""
    need = [f"la_{k}" for k in ("donut", "vertical", "horizontal", "lowleft")]
    if missing := set(need) - set(dots.columns):
        raise ValueError(f"the enrichment filter needs all four kernels; missing {sorted(missing)}")
    # fixed values: factors over each neighbourhood, over either of the first two, and the sum of q-values of lone pixels
    factors, either, lone = {"lowleft": 1.75, "donut": 1.75, "vertical": 1.5, "horizontal": 1.5}, 2.0, 0.02
    over = lambda k, f: F.col("count") > f * F.col(f"la_{k}")
    strong = over("lowleft", either) | over("donut", either)
    for k, f in factors.items():
        strong = strong & over(k, f)
    total = sum(F.col(f"q_{k}") for k in ("donut", "vertical", "horizontal", "lowleft"))
    return dots.where(strong & ((F.col("c_size") > 1) | (total <= lone)))


def dots(cmap: ContactMap, view: DataFrame, expected: DataFrame, kernels: dict[str, np.ndarray], *, band: int, max_nans: int = 1, n_lambda_bins: int = 40, fdr: float = 0.1, radius_bins: float | None = 2.0, open_bin: bool = False) -> DataFrame:
    """One row a dot, with la_<kernel> and q_<kernel>; clustered and, with the four recommended kernels, filtered.

    There are at least n_lambda_bins edges, and as many more as the largest la_exp needs; with open_bin, exactly so many.
    """
    scored = Kept(cmap.bins.sparkSession).table(scores(cmap, view, expected, kernels, band=band, max_nans=max_nans))
    edges = lambda_edges(n_lambda_bins)
    if not open_bin:
        top = scored.agg(F.max("la_exp")).first()[0] or 0.0
        while edges[-1] < top < np.inf:
            edges = lambda_edges(len(edges) + 1)
    limits = thresholds(histogram(scored, edges), edges, fdr, open_bin=open_bin)
    hit = extracted(scored, limits, edges, len(kernels))
    pick = lambda k, c: F.max(F.when(F.col("kernel") == k, F.col(c)))
    wide = hit.groupBy("region", "bin1_id", "bin2_id", "count").agg(*(pick(k, "la_exp").alias(f"la_{k}") for k in kernels), *(pick(k, "qval").alias(f"q_{k}") for k in kernels))
    if not radius_bins:
        return wide
    out = clustered(wide, radius_bins)
    return enriched(out) if {"donut", "vertical", "horizontal", "lowleft"} <= set(kernels) else out
