"""Annotation and interval joins. Every one has an equality key but view_pairs, whose result is all pairs of a view's regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
VIEW_ROWS = 1_000


ROWS_A_TASK = 1 << 19


def tasks_for(rows: int) -> int:
    """Into how many tasks so many counted rows are dealt: at least a few, and none with more than a bounded share."""
    return max(8, -(-rows // ROWS_A_TASK))


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table of so many rows at most, counted if not known, if that is within the limit; as it is beyond."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def annotate(pixels: DataFrame, bins: DataFrame, columns: tuple[str, ...] = ("chrom", "weight"), rows: int | None = None) -> DataFrame:
    """Pixels with the bin columns of either end, suffixed 1 and 2; rows bounds the number of bins, if it is known."""
    side = small(bins.select("bin_id", *columns), rows)
    for k in "12":
        named = side.select(F.col("bin_id").alias(f"bin{k}_id"), *(F.col(c).alias(c + k) for c in columns))
        pixels = pixels.join(named, f"bin{k}_id")
    return pixels


def with_regions(df: DataFrame, view: DataFrame, chosen) -> DataFrame:
    """Adds _r, which chosen makes of the list of regions of a row's chromosome; for short views, so that nothing is shuffled but them."""
    region = F.struct("region_idx", "name", F.col("start").alias("s"), F.col("end").alias("e"))
    listed = view.groupBy("chrom").agg(F.collect_list(region).alias("_regions"))
    return df.join(F.broadcast(listed), "chrom", "left").withColumn("_r", chosen(F.col("_regions"))).drop("_regions")


def is_short(view: DataFrame) -> bool:
    """Whether a view's regions may be listed by chromosome and sent along; longer ones go through the interval join."""
    return view.limit(VIEW_ROWS + 1).count() <= VIEW_ROWS


def _overlapped(features: DataFrame, view: DataFrame, kind: str) -> DataFrame:
    """Features and the region they take of those they overlap, as _r; neither a list of regions nor a pair is made."""
    from .intervals import best_met

    return best_met(features, view.select("chrom", "start", "end", "name", "region_idx"), kind)


def assign_supports(bins: DataFrame, view: DataFrame) -> DataFrame:
    """Bins with the region they overlap; of several regions, the last in view order."""
    if not is_short(view):
        hit = _overlapped(bins, view, "last")
        return hit.select(*bins.columns, F.col("_r.name").alias("region"), F.col("_r.region_idx").cast(view.schema["region_idx"].dataType).alias("region_idx"))
    inside = lambda r: r["s"].isNull() | ((F.col("end") > r["s"]) & (r["e"].isNull() | (F.col("start") < r["e"])))
    hit = with_regions(bins, view, lambda regions: F.array_max(F.filter(regions, inside)))
    return hit.select(*bins.columns, F.col("_r.name").alias("region"), F.col("_r.region_idx").alias("region_idx"))


def assign_regions(features: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """Features (key, chrom, start, end) with the region of largest overlap, or null; of equal overlaps, the first in view order."""
    if not is_short(view):
        return _overlapped(features, view, "largest").select(*features.columns, F.col("_r.name").alias("region"))
    overlap = lambda r: F.least(F.col("end"), r["e"]) - F.greatest(F.col("start"), r["s"])
    ranked = lambda r: F.struct(overlap(r).alias("overlap"), (-r["region_idx"]).alias("turn"), r["name"].alias("name"))
    hit = with_regions(features, view, lambda regions: F.array_max(F.filter(F.transform(regions, ranked), lambda x: x["overlap"] > 0)))
    return hit.select(*features.columns, F.col("_r.name").alias("region"))


def assign_regions_paired(features: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """2-D features: region1 and region2 for either side, and region where they agree."""
    for k in "12":
        side = features.select(key, *(F.col(c + k).alias(c) for c in ("chrom", "start", "end")))
        features = features.join(assign_regions(side, view, key).select(key, F.col("region").alias(f"region{k}")), key, "left")
    return features.withColumn("region", F.when(F.col("region1") == F.col("region2"), F.col("region1")))


def assign_view(features: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """Either of the above, by the columns there are."""
    return assign_regions_paired(features, view, key) if "chrom1" in features.columns else assign_regions(features, view, key)


def view_pairs(view: DataFrame, kind: str = "cis") -> DataFrame:
    """Pairs of regions in view order: cis (same chromosome, with itself), blocks (different regions) or trans."""
    a, b = (view.select(*(F.col(c).alias(c + k) for c in ("name", "chrom", "region_idx"))) for k in "12")
    on = {"cis": "chrom1 = chrom2 and region_idx1 <= region_idx2", "blocks": "region_idx1 < region_idx2", "trans": "chrom1 <> chrom2 and region_idx1 < region_idx2"}[kind]
    return a.join(F.broadcast(b), F.expr(on)).select(F.col("name1").alias("region1"), F.col("name2").alias("region2"))


def align_track(bins: DataFrame, track: DataFrame, value: str = "value", mask_bad: bool = True) -> DataFrame:
    """Bins with a track's value; bad bins get null if asked to."""
    joined = bins.join(track.select("chrom", "start", F.col(value).alias("value")), ["chrom", "start"], "left")
    return joined.withColumn("value", F.when(F.col("weight").isNotNull(), F.col("value"))) if mask_bad else joined


def largest_first(df: DataFrame, by: str, partition: str, tie: str) -> DataFrame:
    """The row of each partition with the largest value; ties by the least tie column."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(partition).orderBy(F.desc(by), tie))).where("_k = 1").drop("_k")
