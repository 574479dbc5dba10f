"""Maps with regions reordered, flipped and joined into new chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import assign_supports, small
from ..schema import ContactMap, require


def rearrange_bins(bins: DataFrame, view: DataFrame) -> DataFrame:
    """Bins of a view (chrom, start, end, name, region_idx[, new_chrom, strand]) with new_id, new_chrom, new_start, new_end.

    Regions of strand - run backwards. New coordinates add up the lengths within
    each new chromosome; bins outside the view aren't in the result.
    """
    if "new_chrom" not in view.columns:
        view = view.withColumn("new_chrom", F.col("chrom"))
    if "strand" not in view.columns:
        view = view.withColumn("strand", F.lit("+"))
    own = W.orderBy("region_idx")
    jumps = view.withColumn("turn", (~F.col("new_chrom").eqNullSafe(F.lag("new_chrom").over(own))).cast("int")).groupBy("new_chrom").agg(F.sum("turn").alias("turns"))
    require(jumps.where("turns > 1").limit(1), "a new chromosome's regions must follow each other")
    hit = assign_supports(bins, view).where("region is not null")
    hit = hit.join(F.broadcast(view.select(F.col("name").alias("region"), "new_chrom", "strand")), "region")
    place = F.when(F.col("strand") == "-", -F.col("bin_id")).otherwise(F.col("bin_id"))
    sizes = hit.groupBy("region_idx", "new_chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("region_idx", before("n", own).alias("id0"), before("bp", W.partitionBy("new_chrom").orderBy("region_idx")).alias("bp0"))
    w = W.partitionBy("region_idx").orderBy("place")
    rows = hit.withColumn("place", place).join(F.broadcast(bases), "region_idx")
    end = F.col("bp0") + F.sum(F.col("end") - F.col("start")).over(w)
    new_id = F.col("id0") + F.row_number().over(w) - 1
    return rows.select("bin_id", new_id.alias("new_id"), "new_chrom", (end - (F.col("end") - F.col("start"))).alias("new_start"), end.alias("new_end"), "weight")


def rearrange_pixels(pixels: DataFrame, mapping: DataFrame, rows: int | None = None) -> DataFrame:
    """Pixels whose ends both stay, with new ids, upper triangle again; counts keep their type."""
    for k in "12":
        pixels = pixels.join(small(mapping.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("new_id").alias(f"n{k}")), rows), f"bin{k}_id")
    return pixels.select(F.least("n1", "n2").alias("bin1_id"), F.greatest("n1", "n2").alias("bin2_id"), "count")


def rearrange(cmap: ContactMap, view: DataFrame) -> ContactMap:
    bins = rearrange_bins(cmap.bins, view)
    order = bins.groupBy("new_chrom").agg(F.min("new_id").alias("at")).select("new_chrom", (F.row_number().over(W.orderBy("at")) - 1).alias("chrom_idx"))
    named = bins.join(F.broadcast(order), "new_chrom")
    out = named.select(F.col("new_id").alias("bin_id"), F.col("new_chrom").alias("chrom"), "chrom_idx", F.col("new_start").alias("start"), F.col("new_end").alias("end"), "weight")
    return ContactMap(out, rearrange_pixels(cmap.pixels, bins, cmap.n_bins()), cmap.binsize, cmap.meta)
