"""Per-region routines on signals and blocks that need a scan: extrema, resampling, adaptive grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..schema import ratio
from ..sources.workspace import Kept


def extrema(df: DataFrame, value: str, region: str, order: str, delta: float) -> DataFrame:
    """(region, at, kind): alternating minima and maxima of each region that differ by more than delta."""

    def find(t: pa.Table) -> pa.Table:  # typed, also where a region has no extremum
        t = t.sort_by("at")
        low, high = arrays.peakdet(t["value"].to_numpy(), delta)
        at, n = t["at"].to_numpy(), len(low) + len(high)
        return pa.table({"region": pa.array([t["region"][0].as_py()] * n, pa.string()), "at": np.concatenate([at[low], at[high]]), "kind": pa.array(["min"] * len(low) + ["max"] * len(high), pa.string())})

    return _signal(df, value, region, order).groupBy("region").applyInArrow(find, "region string, at long, kind string")


def swept_prominence(df: DataFrame, value: str, region: str, order: str, steps: int = 100, least_pairs: int = 5) -> DataFrame:
    """(region, at, low, high): the largest threshold at which each place is a minimum, and a maximum."""

    def find(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("at")
        low, high = arrays.prominence_sweep(t.value.to_numpy(dtype=float), steps, least_pairs)
        return pd.DataFrame({"region": t.region, "at": t["at"], "low": low, "high": high})

    return _signal(df, value, region, order).groupBy("region").applyInPandas(find, "region string, at long, low double, high double")


def _signal(df: DataFrame, value: str, region: str, order: str) -> DataFrame:
    return df.select(F.col(region).cast("string").alias("region"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))


def _blocks(t: pd.DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    shape = int(t.i.max()) + 1, int(t.j.max()) + 1
    out = tuple(np.full(shape, np.nan) for _ in columns)
    for a, c in zip(out, columns, strict=True):
        a[t.i, t.j] = t[c]
    return out


def _cells(region: str, a: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(a.shape)
    return pd.DataFrame({"region": region, "i": i.ravel(), "j": j.ravel(), "value": a.ravel()})


CELLS = "region string, i long, j long, value double"


def zoomed(cells: DataFrame, shape: tuple[int, int], *, same_sum: bool = False, zoom_function=None) -> DataFrame:
    """Each region's block of cells (region, i, j, value; all of them) resampled to a shape.

    Interpolation and block means are linear along each axis, so a cell adds to the
    few new ones that its row's and column's weights name; a null makes them null. A zoom_function
    of its own needs the block as an array, in one task a region.
    """
    if zoom_function:

        def run(t: pd.DataFrame) -> pd.DataFrame:
            return _cells(t.region.iloc[0], arrays.zoom(_blocks(t, "value")[0], shape, same_sum, zoom_function))

        return cells.select("region", "i", "j", "value").groupBy("region").applyInPandas(run, CELLS)
    spark = cells.sparkSession
    sizes = cells.groupBy("region").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("columns"))
    known = sizes.select("rows", "columns").distinct().collect()  # of regions, distinct sizes
    made = [{(int(r[k]), m) for r in known} for k, m in enumerate(shape)]
    tables = [F.broadcast(spark.createDataFrame(pd.concat([arrays.zoom_weights(n, m).assign(size=n) for n, m in sorted(own)]), "to long, at long, f double, size long")) if own else None for own in made]
    if not known:
        return cells.select("region", "i", "j", "value").where("false")
    rows = cells.select("region", "i", "j", F.coalesce("value", F.lit(float("nan"))).alias("value")).join(F.broadcast(sizes), "region")
    scale = F.col("rows") * F.col("columns") / float(shape[0] * shape[1]) if same_sum else F.lit(1.0)
    rows = rows.withColumn("value", F.col("value") * scale)
    x, y = (t.select(F.col("to").alias(f"t{k}"), F.col("at").alias(k), F.col("f").alias(f"f{k}"), F.col("size").alias(n)) for t, k, n in zip(tables, "ij", ("rows", "columns"), strict=True))
    met = rows.join(x, ["i", "rows"]).join(y, ["j", "columns"])
    return met.groupBy("region", F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.sum(F.col("fi") * F.col("fj") * F.col("value")).alias("value"))


def adaptively_coarse(cells: DataFrame, cutoff: int = 5, max_levels: int = 8, min_shape: int = 8) -> DataFrame:
    """Each region's square block of cells (region, i, j, value, count), thin places pooled; null cells stay null.

    Every level of a pyramid sums quartets of cells, their counts and how many are valid; on the
    way back, a quartet with a cell of fewer counts than cutoff shares the mean of the wider
    block. Levels are aggregates and joins, a quarter of the rows each.
    """
    kept = Kept(cells.sparkSession)
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    base = cells.select("region", "i", "j", F.when(valid, F.col("value")).otherwise(0.0).alias("v"), F.when(valid, F.coalesce("count", F.lit(0))).otherwise(0).alias("c"), valid.cast("int").alias("ok"))
    size = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.max("i"), F.max("j")) + 1.0)))
    depth = F.greatest(F.lit(0), F.least(F.lit(max_levels), F.ceil(size - F.log2(F.lit(float(min_shape))))))
    levels = base.groupBy("region").agg(depth.cast("int").alias("depth"))
    most = levels.agg(F.max("depth")).first()[0] or 0
    pyramid = [kept.table(base.join(F.broadcast(levels), "region"))]
    up = [F.floor(F.col(k) / 2).alias(k) for k in "ij"]
    for k in range(most):
        thin = F.min(F.when(F.col("ok") > 0, F.col("c"))).alias("thin")  # of the cells below
        sums = pyramid[-1].where(F.col("depth") > k).groupBy("region", *up, "depth").agg(F.sum("v").alias("v"), F.sum("c").alias("c"), F.sum("ok").alias("ok"), thin)
        pyramid.append(kept.table(sums.select("region", "i", "j", "v", "c", "ok", "depth", "thin")))
    above = None
    for k in range(most, -1, -1):
        own = pyramid[k].select("region", "i", "j", "v", "ok", "depth", *(["thin"] if k else []))
        if above is not None:
            wide = above.select("region", F.col("i").alias("pi"), F.col("j").alias("pj"), ratio("u", "ok").alias("mean"), F.col("thin").alias("least"))
            own = own.withColumn("pi", F.floor(F.col("i") / 2)).withColumn("pj", F.floor(F.col("j") / 2)).join(wide, ["region", "pi", "pj"], "left").drop("pi", "pj")
            u = F.when(F.col("depth") <= k, F.col("v")).when(F.col("ok") == 0, 0.0).when(F.col("least") < cutoff, F.col("mean") * F.col("ok")).otherwise(F.col("v"))
        else:
            u = F.col("v")
        above = own.withColumn("u", u)
    return above.select("region", "i", "j", F.when(F.col("ok") == 1, F.col("u")).alias("value"))


def filled_gaps(cells: DataFrame, *, pad_zeros: bool = True) -> DataFrame:
    """Each region's block of cells (region, i, j, value) with masked rows and columns interpolated."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return _cells(t.region.iloc[0], arrays.interp_nan_2d(_blocks(t, "value")[0], pad_zeros))

    return cells.select("region", "i", "j", "value").groupBy("region").applyInPandas(run, CELLS)
