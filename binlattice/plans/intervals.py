"""Overlaps of two tables of intervals through dyadic cells: an equality join whose candidates are, but for cell edges, the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dominant
from ..sources.workspace import Kept
from .joins import BROADCAST_ROWS, small

LEAF, CELL, SALTS = 1024, 4096, 64


def _cover(top: int) -> Column:
    """The fewest dyadic cells (level k, cell c) that make up leaves a to b: at most two a level, none of them shared."""
    lo, hi = "-shiftright(-a, k)", "shiftright(b, k)"
    cell = lambda odd, c: f"if({lo} < {hi} and ({odd} & 1) = 1, struct(k, {c} as c), null)"
    both = f"array({cell(f'({lo})', lo)}, {cell(hi, f'{hi} - 1')})"
    return F.expr(f"filter(flatten(transform(sequence(0, {top}), k -> {both})), x -> x is not null)")


def _path(top: int) -> Column:
    """The cells above leaf a, one a level."""
    return F.expr(f"transform(sequence(0, {top}), k -> struct(k, shiftright(a, k) as c))")


def _placed(df: DataFrame, name: str, start: Column, end: Column, leaf: int) -> DataFrame:
    own = df.select("chrom", F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), start.cast("long").alias(f"{name}s"), end.cast("long").alias(f"{name}e"))
    a = F.floor(F.col(f"{name}s") / leaf)
    return own.where(f"chrom is not null and {name}s is not null and {name}e is not null").withColumn("a", a).withColumn("b", F.greatest(F.ceil(F.col(f"{name}e") / leaf), a + 1))


def overlapping(features: DataFrame, regions: DataFrame, *, leaf: int = LEAF) -> DataFrame:
    """All pairs of a feature and a region (chrom, start, end and any other columns) that overlap, as structs f and r.

    They overlap if feature.end > region.start and feature.start < region.end. A
    region's null start or end is open; features with a null chromosome, start or
    end meet nothing; repeated rows give repeated pairs; either table may be empty.

    Of two overlapping intervals, one holds the other's start. An interval is cut
    into dyadic cells, at most two a level, and a start lies below one cell a
    level, so each pair meets in exactly one cell. Levels reach as far as the
    longest interval does. Unlike a table of bins, a cell holds no candidates
    that don't overlap (but within a leaf), however regions are nested or
    stacked, and a long interval takes few rows. A cell with very many of either side is a
    skewed key, which adaptive execution splits; regions of a counted size are broadcast.
    """
    seen = features.agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.max(F.col("end") - F.col("start")).alias("longest")).first()
    lo, hi, longest = (int(x or 0) for x in seen)
    f = _placed(features, "f", F.col("start"), F.col("end"), leaf)
    r = _placed(regions, "r", F.coalesce("start", F.lit(lo - 1)), F.coalesce("end", F.lit(hi + 1)), leaf)
    n, widest = r.agg(F.count("*"), F.max(F.col("b") - F.col("a"))).first()
    tops = (longest // leaf + 2).bit_length(), int(widest or 1).bit_length()

    def side(df: DataFrame, cells: Column, rows: int | None = None) -> DataFrame:
        out = df.withColumn("cell", F.explode(cells)).select("chrom", "cell.k", "cell.c", *(x for x in df.columns if x not in ("chrom", "a", "b")))
        return F.broadcast(out) if rows is not None and rows <= BROADCAST_ROWS else out

    on, both = ["chrom", "k", "c"], ("f", "r")
    within = side(f, _path(tops[1])).join(side(r, _cover(tops[1]), n * 2 * (tops[1] + 1)), on).where("rs <= fs and fs < re and fe > rs")
    after = side(f, _cover(tops[0])).join(side(r, _path(tops[0]), n * (tops[0] + 1)), on).where("fs < rs and rs < fe and fs < re")
    return within.select(*both).unionAll(after.select(*both))


def overlap_sums(features: DataFrame, regions: DataFrame, *, cell: int = CELL) -> DataFrame:
    """Features with n, how many regions they overlap, and shared, how many places they share with them; no pair is made.

    Overlaps and open ends are as in ``overlapping``, but intervals that end before
    they start meet nothing. Starts and ends are counted by place and added up within cells and over
    cells; a feature then takes the difference of the sums at its two ends, so work
    is by rows however many intervals lie over each other.
    """
    seen = features.agg(F.min("start"), F.max("end")).first()
    lo, hi = (int(x or 0) for x in seen)
    r = regions.select("chrom", F.coalesce("start", F.lit(lo - 1)).cast("long").alias("s"), F.coalesce("end", F.lit(hi + 1)).cast("long").alias("e")).where("chrom is not null and s <= e")
    at = lambda pos, s, e, z, want: F.struct(pos.cast("long").alias("pos"), s.cast("long").alias("s"), e.cast("long").alias("e"), z.cast("long").alias("z"), F.lit(want).alias("want"))
    no, one = F.lit(0), F.lit(1)
    marks = r.select("chrom", F.explode(F.array(at(F.col("s"), one, no, F.col("s") == F.col("e"), False), at(F.col("e"), no, one, no, False))).alias("m"))
    asked = features.where("chrom is not null and start <= end").select("chrom", F.explode(F.array(*(at(F.col(c), no, no, no, True) for c in ("start", "end")))).alias("m"))
    places = marks.union(asked).groupBy("chrom", "m.pos").agg(*(F.sum(f"m.{c}").alias(c) for c in "sez"), F.max("m.want").alias("want"))
    kept = Kept(features.sparkSession)
    places = kept.table(places.withColumn("c", F.floor(F.col("pos") / cell)).withColumn("p", F.col("pos") - F.col("c") * cell).withColumn("open", F.col("s") - F.col("e")))
    cells = places.groupBy("chrom", "c").agg(F.sum("s").alias("s0"), F.sum("e").alias("e0"), F.sum("open").alias("open0"), F.sum(F.col("open") * F.col("p")).alias("m0"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    w = W.partitionBy("chrom").orderBy("c")  # a row a cell
    far = F.col("c") * cell * before("open0", w) - before(F.col("open0") * F.col("c") * cell + F.col("m0"), w)
    cells = kept.table(cells.select("chrom", "c", before("s0", w).alias("s0"), before("e0", w).alias("e0"), before("open0", w).alias("open0"), far.alias("far")))
    w = W.partitionBy("chrom", "c").orderBy("p")  # a row a place
    inside = F.col("p") * before("open", w) - before(F.col("open") * F.col("p"), w)
    sums = places.select("*", before("s", w).alias("sb"), (before("e", w) + F.col("e")).alias("eu"), inside.alias("in")).where("want").join(small(cells), ["chrom", "c"])
    sums = sums.select("chrom", "pos", (F.col("s0") + F.col("sb")).alias("sb"), (F.col("e0") + F.col("eu")).alias("eu"), "z", (F.col("far") + F.col("p") * F.col("open0") + F.col("in")).alias("depth"))
    sums = kept.table(sums)
    a = sums.select("chrom", F.col("pos").alias("start"), F.col("eu").alias("_eu"), F.col("z").alias("_z"), F.col("depth").alias("_d0"))
    b = sums.select("chrom", F.col("pos").alias("end"), F.col("sb").alias("_sb"), F.col("depth").alias("_d1"))
    n = F.col("_sb") - F.col("_eu") + F.when(F.col("start") == F.col("end"), F.col("_z")).otherwise(0)
    met = features.join(a, ["chrom", "start"], "left").join(b, ["chrom", "end"], "left")
    some = F.col("start") <= F.col("end")
    return met.select(*features.columns, F.coalesce(F.when(some, n), F.lit(0)).alias("n"), F.coalesce(F.when(some, F.col("_d1") - F.col("_d0")), F.lit(0)).alias("shared"))


def _largest(fs: np.ndarray, fe: np.ndarray, rs: np.ndarray, re: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For each feature the region of largest overlap, of equal ones that of the largest turn; -1 where there is none.

    A region of largest overlap holds the feature, or lies in it, or reaches farthest into it from the left or the right.
    """
    order = lambda *keys: np.argsort(np.lexsort(keys))
    found = [
        (order(turn), rs, -re, fs, -fe),
        (order(turn, re - rs), -rs, re, -fs, fe),
        (order(turn, re), rs, np.zeros_like(rs), fs, np.zeros_like(fs)),
        (order(turn, -rs), -re, np.zeros_like(re), -fe, np.zeros_like(fe)),
    ]
    best, most, first = np.full(len(fs), -1), np.zeros(len(fs), dtype=np.int64), np.zeros(len(fs), dtype=np.int64)
    for rank, x, y, qx, qy in found:
        got = dominant(x, y, rank, qx, qy)
        of = np.argsort(rank)[np.maximum(got, 0)]
        overlap = np.where(got >= 0, np.minimum(fe, re[of]) - np.maximum(fs, rs[of]), 0)
        over = (overlap > most) | ((overlap == most) & (overlap > 0) & (turn[of] > first))
        best, most, first = np.where(over, of, best), np.where(over, overlap, most), np.where(over, turn[of], first)
    return best


def _last(fs: np.ndarray, fe: np.ndarray, rs: np.ndarray, re: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For each feature the overlapping region of the largest turn; -1 where there is none."""
    rank = np.argsort(np.argsort(turn, kind="stable"))
    got = dominant(rs, -re, rank, fe - 1, -(fs + 1))
    return np.where(got >= 0, np.argsort(rank)[np.maximum(got, 0)], -1)


def best_met(features: DataFrame, view: DataFrame, kind: str, *, leaf: int = LEAF) -> DataFrame:
    """Features with _r (overlap, turn, region_idx, name): their overlapping region that is "largest", of equal ones the first in view order, or "last" in it.

    Distinct intervals of both sides meet in dyadic cells, as in ``overlapping``, but
    a cell gives one region a feature and makes no pairs. Intervals of one or
    two leaves stay on the lowest level. Above it, one side has a start below a cell and is dealt to
    some salts, and the other covers the cell, in few copies.
    """
    seen = features.agg(F.min("start"), F.max("end")).first()
    lo, hi = (int(x or 0) for x in seen)
    first = F.min if kind == "largest" else F.max
    named = F.min_by if kind == "largest" else F.max_by
    f = features.select("chrom", "start", "end").distinct()
    own = view.select("chrom", F.coalesce("start", F.lit(lo - 1)).cast("long").alias("start"), F.coalesce("end", F.lit(hi + 1)).cast("long").alias("end"), F.col("region_idx").cast("long").alias("region_idx"), "name")
    r = own.groupBy("chrom", "start", "end").agg(first("region_idx").alias("region_idx"), named("name", "region_idx").alias("name"))

    def placed(df: DataFrame) -> DataFrame:
        a = F.floor(F.col("start") / leaf).cast("long")
        return df.where("chrom is not null and start is not null and end is not null").withColumn("a", a).withColumn("b", F.greatest(F.ceil(F.col("end") / leaf).cast("long"), a + 1))

    f, r = placed(f), placed(r)
    widest = [int(df.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 1) for df in (f, r)]
    f_top, r_top = (0 if n <= 2 else n.bit_length() for n in widest)

    def cells(df: DataFrame, top: int, other: int, side: int) -> DataFrame:
        # side 0 (regions) covers cells of kind 0 and has a start in those of kind 1, side 1 (features) the other way round; the lowest level has one kind
        n_salts = f"if(x.k = 0, 1L, least(shiftleft(1L, x.k), {SALTS}L))"
        item = lambda kind, salt: f"struct(x.k as k, x.c as c, if(x.k = 0, 0, {kind}) as kind, {salt} as salt)"
        low = "transform(sequence(a, b - 1), c -> struct(0 as k, c as c, 0 as kind, 0L as salt))"
        high = F.expr(f"flatten(transform(_cells, x -> transform(sequence(0L, {n_salts} - 1), s -> {item(side, 's')})))")
        path = F.expr(f"transform(_starts, x -> {item(1 - side, f'pmod(a, {n_salts})')})")
        df = df.withColumn("_starts", _path(other)).withColumn("_cells", _cover(top))
        cover = F.when(F.col("b") - F.col("a") <= 2, F.expr(low)).otherwise(high) if top else F.expr(low)
        df = df.withColumn("cell", F.explode(F.array_union(cover, path))).drop("_starts", "_cells")
        return df.select("chrom", "cell.*", *(c for c in df.columns if c not in ("chrom", "a", "b", "cell")))

    pick = _largest if kind == "largest" else _last
    on = ["chrom", "k", "c", "kind", "salt"]
    name = view.schema["name"].dataType

    def met(ft: pa.Table, rt: pa.Table) -> pa.Table:
        fs, fe, rs, re, idx = (t[c].to_numpy() for t, c in ((ft, "start"), (ft, "end"), (rt, "start"), (rt, "end"), (rt, "region_idx")))
        of = pick(fs, fe, rs, re, -idx if kind == "largest" else idx) if len(rs) and len(fs) else np.full(len(fs), -1)
        hit = np.flatnonzero(of >= 0)
        of = of[hit]
        own, r = ft.take(pa.array(hit)), rt.take(pa.array(of, pa.int64()))
        overlap = np.minimum(fe[hit], re[of]) - np.maximum(fs[hit], rs[of])
        return pa.table({"chrom": own["chrom"], "start": own["start"], "end": own["end"], "overlap": pa.array(overlap, pa.int64()), "region_idx": r["region_idx"], "name": r["name"]})

    sides = cells(f.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long")), f_top, r_top, 1), cells(r, r_top, f_top, 0)
    hits = sides[0].groupBy(*on).cogroup(sides[1].groupBy(*on)).applyInArrow(met, f"chrom string, start long, end long, overlap long, region_idx long, name {name.simpleString()}")
    order = F.struct("overlap", -F.col("region_idx"), "name") if kind == "largest" else F.struct("region_idx", "name", "overlap")
    best = hits.groupBy("chrom", "start", "end").agg(F.max_by(F.struct("overlap", "region_idx", "name"), order).alias("_r"))
    return features.join(best, ["chrom", "start", "end"], "left").select(*features.columns, "_r")
