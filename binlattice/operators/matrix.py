"""Linear algebra over pixels: products, balancing, marginal filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..plans.joins import BROADCAST_ROWS, small
from ..schema import ContactMap
from ..sources.workspace import Kept
from . import quantiles


def matvec(pixels: DataFrame, x: DataFrame, rows: int | None = None) -> DataFrame:
    """y = A x for the symmetric matrix of upper-triangle pixels; x has (bin_id, x), the result (bin_id, y)."""
    a, b = (small(x.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("x").alias(f"x{k}")), rows) for k in "12")
    px = pixels.join(a, "bin1_id").join(b, "bin2_id")
    up = F.struct(F.col("bin1_id").alias("bin_id"), (F.col("count") * F.col("x2")).alias("v"))
    down = F.struct(F.col("bin2_id").alias("bin_id"), F.when(F.col("bin1_id") != F.col("bin2_id"), F.col("count") * F.col("x1")).otherwise(0.0).alias("v"))
    return px.select(F.explode(F.array(up, down)).alias("t")).groupBy("t.bin_id").agg(F.sum("t.v").alias("y"))


def ice_step(pixels: DataFrame, bias: DataFrame, damping: float = 0.8, rows: int | None = None) -> DataFrame:
    """One round of iterative correction: bias (bin_id, x) divided by its damped relative marginal."""
    y = matvec(pixels, bias, rows).join(bias, "bin_id").withColumn("s", F.col("x") * F.col("y"))
    mean = y.where("s <> 0").agg(F.avg("s").alias("m"))
    rel = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s") / F.col("m"))
    step = y.crossJoin(F.broadcast(mean)).select("bin_id", "x", rel.alias("s"))
    return step.select("bin_id", (F.col("x") / (1 + damping * (F.col("s") - 1))).alias("x"), "s")


def balance(cmap: ContactMap, *, ignore_diags: int = 2, max_iter: int = 200, tol: float = 1e-5) -> tuple[DataFrame, bool]:
    """Weights by iterative correction, each round a written table in place of the last; bins without contacts get null. Also whether it converged."""
    kept = Kept(cmap.bins.sparkSession)
    px = cmap.pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags)
    bias = kept.table(cmap.bins.select("bin_id", F.lit(1.0).alias("x")))
    done = False
    for _ in range(max_iter):
        last, bias = bias, kept.table(ice_step(px, bias.select("bin_id", "x"), rows=cmap.n_bins()))
        kept.drop(last)
        if done := (bias.where("s <> 1").agg(F.var_pop("s")).first()[0] or 0.0) < tol:
            break
    return cmap.bins.select("bin_id").join(bias.select("bin_id", F.col("x").alias("weight")), "bin_id", "left"), done


def knight_ruiz(cmap: ContactMap, *, ignore_diags: int = 0, tol: float = 1e-6, max_products: int = 300) -> tuple[DataFrame, float]:
    """(bin_id, weight) that make all marginals 1, by Newton's method with conjugate gradients, and the residual.

    Products with the matrix are distributed; the vectors, one number a bin, stay
    on the driver, so there may be at most as many bins as are broadcast. Bins
    without contacts have no weight.
    """
    if cmap.n_bins() > BROADCAST_ROWS:
        raise ValueError(f"{cmap.n_bins()} bins are too many to keep their vectors on the driver")
    spark = cmap.bins.sparkSession
    px = cmap.pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags).persist()
    ids = np.sort(px.select(F.explode(F.array("bin1_id", "bin2_id")).alias("b")).distinct().toPandas()["b"].to_numpy())

    def product(v: np.ndarray) -> np.ndarray:
        got = matvec(px, spark.createDataFrame(pd.DataFrame({"bin_id": ids, "x": v})), len(ids)).toPandas()
        out = np.zeros(len(ids))
        out[np.searchsorted(ids, got["bin_id"])] = got["y"]
        return out

    x, residual = arrays.newton_scaling(product, len(ids), tol, max_products)
    px.unpersist()
    found = spark.createDataFrame(pd.DataFrame({"bin_id": ids, "weight": x}), "bin_id long, weight double")
    return cmap.bins.select("bin_id").join(found, "bin_id", "left"), residual


def balance_rectangle(cells: DataFrame, *, max_iter: int = 1000, tol: float = 1e-5) -> DataFrame:
    """Cells (region, i, j, value, converged) of each region's rectangle, iteratively corrected: rows, then columns, divided by their relative sums.

    Rows and columns have a factor each, from products of the cells with the other
    side's; only factors and their spread by region are kept between rounds. A
    region is done when both spreads are below tol.
    """
    kept = Kept(cells.sparkSession)
    base = kept.table(cells.select("region", "i", "j", F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v")))
    sides = {k: kept.table(base.select("region", k, F.lit(1.0).alias("f")).distinct()) for k in "ij"}
    done: dict[str, bool] = {}
    for _ in range(max_iter):
        spread: dict[str, float] = {}
        for own, other in ("ij", "ji"):
            sums = base.join(sides[other], ["region", other]).groupBy("region", own).agg(F.sum(F.col("v") * F.col("f")).alias("y"))
            own_sums = sums.join(sides[own], ["region", own]).withColumn("s", F.col("y") * F.col("f"))
            mean = own_sums.where("s <> 0").groupBy("region").agg(F.avg("s").alias("m"))
            step = F.when((F.col("s") == 0) | F.col("m").isNull(), 1.0).otherwise(F.col("s") / F.col("m"))
            new = kept.table(own_sums.join(F.broadcast(mean), "region", "left").select("region", own, (F.col("f") / step).alias("f"), F.when(F.col("s") != 0, step).alias("step")))
            for r in new.groupBy("region").agg(F.var_pop("step").alias("v")).collect():  # a row a region
                spread[r.region] = max(spread.get(r.region, 0.0), r.v or 0.0)
            kept.drop(sides[own])
            sides[own] = new
        done = {r: v < tol for r, v in spread.items()}
        if all(done.values()):
            break
    out = base
    for k in "ij":
        out = out.join(sides[k].select("region", k, F.col("f").alias(f"f{k}")), ["region", k])
    state = cells.sparkSession.createDataFrame(list(done.items()) or [("", False)], "region string, converged boolean")
    return out.join(F.broadcast(state), "region").select("region", "i", "j", (F.col("v") * F.col("fi") * F.col("fj")).alias("value"), "converged")


def trimmed_trans(cells: DataFrame, perc_top: float, perc_bottom: float) -> DataFrame:
    """Symmetric cells (i, j, value): values clipped at a percentile, bins of low marginal dropped."""
    top = quantiles.exact_quantiles(cells, [], "value", [perc_top / 100]).select(F.col("q")[0].alias("top"))
    margin = cells.groupBy("i").agg(F.sum("value").alias("m")).where("m > 0")
    low = quantiles.exact_quantiles(margin, [], "m", [perc_bottom / 100]).select(F.col("q")[0].alias("low"))
    weak = margin.crossJoin(F.broadcast(low)).where("m < low").select("i")
    kept = cells.join(small(weak), "i", "left_anti").join(small(weak.withColumnRenamed("i", "j")), "j", "left_anti")
    return kept.crossJoin(F.broadcast(top)).select("i", "j", F.least("value", "top").alias("value"))
