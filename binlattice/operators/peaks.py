"""Prominence of the maxima of signals of any length, cut into chunks.

A monotone stack finds the nearest higher value of every place within a chunk, and
the lowest value on the way. Where none is in the chunk, the maxima of the region's
chunks name the one that holds it, their minima give the way between, and
that chunk answers for the rest. No task holds more than a chunk and one row a chunk
of its region.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Kept

CHUNK = 1 << 14


def lowest_to_higher(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the lowest value since the last higher one, itself included, and whether there is one before it."""
    low, found, stack = v.copy(), np.zeros(len(v), dtype=bool), []
    for i, x in enumerate(v.tolist()):
        while stack and stack[-1][0] <= x:
            low[i] = min(low[i], stack.pop()[1])
        found[i] = bool(stack)
        stack.append((x, low[i]))
    return low, found


def _within(chunk: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """The peaks of a chunk: value, lowest value on either side as far as known, and the chunks to ask for the rest (null: none higher)."""
    chunk = chunk.sort_values("bin_id")
    v, sums = chunk.v.to_numpy(), sums.sort_values("chunk")
    c = int(np.searchsorted(sums.chunk, chunk.chunk.iloc[0]))
    top, low = sums.top.to_numpy(), sums.low.to_numpy()
    before = sums["last"].iloc[c - 1] if c else np.nan
    after = sums["first"].iloc[c + 1] if c + 1 < len(sums) else np.nan
    left, right = np.r_[before, v[:-1]], np.r_[v[1:], after]
    peaks = np.flatnonzero((v > left) & (v > right))
    lows = v[(v < left) & (v < right)]
    sides = []
    for back in (False, True):
        way, found = lowest_to_higher(v[::-1] if back else v)
        way, found = (way[::-1], found[::-1]) if back else (way, found)
        m, ask, known = way[peaks], np.full(len(peaks), -1), found[peaks]
        for k in np.flatnonzero(~known):
            x = v[peaks[k]]
            at = np.flatnonzero(top[c + 1 :] > x) + c + 1 if back else np.flatnonzero(top[:c] > x)
            if len(at):
                goal = at[0] if back else at[-1]
                between = low[c + 1 : goal] if back else low[goal + 1 : c]
                m[k] = min(m[k], between.min()) if len(between) else m[k]
                ask[k] = sums.chunk.iloc[goal]
        sides.append((m, ask, known))
    (ml, al, kl), (mr, ar, kr) = sides
    lowest = lows.min() if len(lows) else np.inf  # the last row is of the chunk itself: its lowest local minimum, and its lowest value
    with_last = lambda a, x: np.append(a, x)
    return pd.DataFrame({
        "region": [chunk.region.iloc[0]] * (len(peaks) + 1), "bin_id": with_last(chunk.bin_id.to_numpy()[peaks], -1), "x": with_last(v[peaks], lowest),
        "left": with_last(ml, v.min()), "ask_left": with_last(al, -1), "has_left": with_last(kl, False).astype(bool),
        "right": with_last(mr, 0.0), "ask_right": with_last(ar, -1), "has_right": with_last(kr, False).astype(bool),
    })


def _answers(chunk: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each question (bin_id, x, side), the lowest value between the nearest higher one and the chunk's edge."""
    if chunk.empty or asked.empty:
        return pd.DataFrame({"region": pd.Series([], dtype=object), "bin_id": pd.Series([], dtype="int64"), "side": pd.Series([], dtype=object), "m": pd.Series([], dtype=float)})
    v = chunk.sort_values("bin_id").v.to_numpy()
    facing = {"left": np.fmin.accumulate(v[::-1])[::-1], "right": np.fmin.accumulate(v)}
    runs = {"left": np.maximum.accumulate(v[::-1])[::-1], "right": np.maximum.accumulate(v)}
    m = []
    for x, side in zip(asked.x, asked.side):
        if side == "left":
            at = int(np.flatnonzero(runs[side] > x)[-1])
            m.append(facing[side][at + 1] if at + 1 < len(v) else np.inf)
        else:
            at = int(np.flatnonzero(runs[side] > x)[0])
            m.append(facing[side][at - 1] if at else np.inf)
    return pd.DataFrame({"region": asked.region.tolist(), "bin_id": asked.bin_id.to_numpy(), "side": asked.side.tolist(), "m": m})


def prominences(signal: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(region, bin_id, prominence) of the strict local maxima of signals (region, bin_id, v; no nulls).

    A side ends at the next higher value, and its lowest value counts; the higher of both counts. Of
    maxima that no side ends, the first of a region is measured from the lowest local minimum, or
    the lowest value where there is none, and the others have a prominence of 0.
    """
    kept = Kept(signal.sparkSession)
    rows = kept.table(signal.select("region", "bin_id", F.col("v").cast("double").alias("v"), F.floor(F.col("bin_id") / chunk).alias("chunk")))
    sums = kept.table(rows.groupBy("region", "chunk").agg(F.min_by("v", "bin_id").alias("first"), F.max_by("v", "bin_id").alias("last"), F.max("v").alias("top"), F.min("v").alias("low")))
    to = sums.select("region", F.col("chunk").alias("to")).join(sums, "region")  # a region's chunks, for each of them
    kind = "region string, bin_id long, x double, left double, ask_left long, has_left boolean, right double, ask_right long, has_right boolean"
    found = rows.groupBy("region", "chunk").cogroup(to.groupBy("region", "to")).applyInPandas(_within, kind)
    found = kept.table(found)
    asked = [found.where(f"bin_id >= 0 and ask_{s} >= 0").select("region", F.col(f"ask_{s}").alias("chunk"), "bin_id", "x", F.lit(s).alias("side")) for s in ("left", "right")]
    told = rows.groupBy("region", "chunk").cogroup(asked[0].union(asked[1]).groupBy("region", "chunk")).applyInPandas(_answers, "region string, bin_id long, side string, m double")
    answers = told.groupBy("region", "bin_id").agg(*(F.min(F.when(F.col("side") == s, F.col("m"))).alias(f"m_{s}") for s in ("left", "right")))
    peaks = found.where("bin_id >= 0").join(answers, ["region", "bin_id"], "left")
    side = lambda s: F.when(F.col(f"has_{s}") | (F.col(f"ask_{s}") >= 0), F.col("x") - F.least(s, F.coalesce(f"m_{s}", F.lit(float("inf")))))
    peaks = peaks.select("region", "bin_id", "x", F.least(side("left"), side("right")).alias("p"))
    whole = found.where("bin_id < 0").groupBy("region").agg(F.min("x").alias("lows"), F.min("left").alias("all"))
    first = peaks.where("p is null").groupBy("region").agg(F.min("bin_id").alias("bin_id"), F.lit(True).alias("first"))
    base = F.when(F.col("lows") < float("inf"), F.col("lows")).otherwise(F.col("all"))
    open_ = F.when(F.col("first"), F.col("x") - base).otherwise(0.0)
    return peaks.join(whole, "region").join(first, ["region", "bin_id"], "left").select("region", "bin_id", F.coalesce("p", open_).alias("prominence"))
