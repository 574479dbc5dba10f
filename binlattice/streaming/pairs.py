"""Streams of point pairs binned into pixel counts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_stream(pairs: DataFrame, binsize: int, *, time: str | None = None, window: str = "1 hour", delay: str = "10 minutes", tasks: int | None = None) -> DataFrame:
    """Counts by (chrom1, bin1, chrom2, bin2) of a stream (chrom1, pos1, chrom2, pos2); with a time column, a map for each window.

    Counts are additive, so update mode keeps totals and append mode closes
    windows behind the watermark. Of a batch whose rows are known, the pairs may be dealt to so many tasks first.
    """
    end = lambda k: F.struct(F.col(f"chrom{k}").alias("chrom"), F.floor(F.col(f"pos{k}") / binsize).alias("bin"))
    keys = [F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b")]
    if time:
        pairs = pairs.withWatermark(time, delay)
        keys.append(F.window(time, window).alias("w"))
    if tasks:
        pairs = pairs.select(*keys).repartition(tasks, "a", "b")
        keys = ["a", "b", *(["w"] if time else [])]
    counted = pairs.groupBy(*keys).agg(F.count("*").alias("count"))
    own = [F.col("w.start").alias("window_start")] if time else []
    return counted.select(*own, F.col("a.chrom").alias("chrom1"), F.col("a.bin").alias("bin1"), F.col("b.chrom").alias("chrom2"), F.col("b.bin").alias("bin2"), "count")
