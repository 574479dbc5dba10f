"""Maps derived from event and order tables, and maps kept as Parquet."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import small, tasks_for
from ..schema import ContactMap

EPOCH_US, HOUR_US = 1704067200000000, 3600000000
BINS_SUMMED, PAIRS_AT_ONCE = 2048, 1 << 16  # of the second, as many as stay in a core's cache
_derived: dict[tuple[str, str, str], ContactMap] = {}


def pixels_of(members: DataFrame, group: str, bin_: str, *, once: bool = False, bins: int | None = None) -> DataFrame:
    """Contacts of all unordered pairs of a group's members, counted by their bins; once: a bin counts once a group.

    Members are counted by bin first, so a group of very many members costs the
    square of its bins at most, not of its members. Groups are dealt to as many tasks as the counted
    members ask for, so a task's pairs don't grow with the table. Where all members lie in a few bins
    (numbered from 0 to bins), a task sums its pairs by cell and no pair is a row.
    """
    named = members.select(F.col(group).alias("g"), F.col(bin_).alias("b"))
    found = named.agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high")).first()
    tasks = tasks_for(found.n)
    counted = named.repartition(tasks, "g").distinct().withColumn("n", F.lit(1).cast("long")) if once else named.groupBy("g", "b").agg(F.count("*").alias("n")).repartition(tasks, "g")
    if bins and bins <= BINS_SUMMED and found.low is not None and 0 <= found.low and found.high < bins:
        parts = max(tasks_for(tasks * bins * (bins + 1) // 2), 2 * members.sparkSession.sparkContext.defaultParallelism)
        cells = _cells_summed(counted.where("g is not null and b is not null"), bins).repartition(parts, "bin1_id", "bin2_id")
        return cells.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))
    a, b = (counted.select("g", F.col("b").alias(f"bin{k}_id"), F.col("n").alias(f"n{k}")) for k in "12")
    both = a.join(b, "g").where("bin1_id <= bin2_id and (bin1_id < bin2_id or n1 > 1)")
    pairs = F.when(F.col("bin1_id") == F.col("bin2_id"), F.expr("n1 * (n1 - 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
    return both.groupBy("bin1_id", "bin2_id").agg(F.sum(pairs).alias("count"))


def _cells_summed(counted: DataFrame, bins: int) -> DataFrame:
    """(bin1_id, bin2_id, count) of the pairs of rows (g, b, n; a bin once a group, a group in one task), summed by task."""

    def run(batches):
        sums = np.zeros(bins * bins, np.int64)

        def add(rows: pa.Table, starts: np.ndarray) -> None:
            b, n = (rows.column(c).to_numpy() for c in "bn")
            np.add.at(sums, b * (bins + 1), n * (n - 1) // 2)
            sizes = np.diff(np.append(starts, len(b)))
            later = np.repeat(starts + sizes, sizes) - np.arange(len(b)) - 1  # rows of the group after each
            before = np.cumsum(later) - later
            cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, later.sum() + 1, PAIRS_AT_ONCE)), [0, len(b)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first = np.repeat(np.arange(lo, hi), later[lo:hi])
                second = first + 1 + np.arange(len(first)) - np.repeat(before[lo:hi] - before[lo], later[lo:hi])
                np.add.at(sums, b[first] * bins + b[second], n[first] * n[second])

        held = None  # a batch's last group may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held else rows).combine_chunks()
            g = rows.column("g")
            starts = np.append(0, np.flatnonzero(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy()) + 1)
            add(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held:
            add(held, np.zeros(1, np.int64))
        cells = np.flatnonzero(sums)
        for lo in range(0, len(cells), 1 << 16):
            at = cells[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at // bins), pa.array(at % bins), pa.array(sums[at])], ["bin1_id", "bin2_id", "count"])

    return counted.sortWithinPartitions("g", "b").mapInArrow(run, "bin1_id long, bin2_id long, count long")


def fixed_bins(spark: SparkSession, n: int, per_chrom: int, binsize: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("bin_id"), F.concat(F.lit("c"), (F.floor(i / per_chrom) + 1).cast("string")).alias("chrom"), F.floor(i / per_chrom).cast("int").alias("chrom_idx"),
        (i % per_chrom * binsize).alias("start"), ((i % per_chrom + 1) * binsize).alias("end"),
    )


def weighted(bins: DataFrame, pixels: DataFrame, bad) -> DataFrame:
    """Bins with weight 100 / sqrt(coverage), null for bad and empty bins."""
    ends = pixels.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count").groupBy("bin_id").agg(F.sum("count").alias("cov"))
    return bins.join(ends, "bin_id", "left").withColumn("weight", F.when(~bad & (F.col("cov") > 0), 100.0 / F.sqrt(F.col("cov").cast("double")))).drop("cov")


def _kept(spark: SparkSession, kind: str, sf_dir: str, make) -> ContactMap:
    """Derived once a session and folder: a map is read many times by one query. ``forget`` releases them."""
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _derived:
        m = make()
        m.pixels = m.pixels.persist()
        rows = m.n_bins()
        bins = weighted(m.bins, m.pixels, m.meta.pop("bad"))
        m.bins = (bins.coalesce(tasks_for(rows)) if rows <= BINS_SUMMED else bins).persist()
        _derived[key] = m
    return _derived[key]


def forget() -> None:
    """Releases the maps that the session keeps."""
    for m in _derived.values():
        m.pixels.unpersist()
        m.bins.unpersist()
    _derived.clear()


def hour_map(spark: SparkSession, sf_dir: str) -> ContactMap:
    """720 hour bins on four chromosomes; contacts are pairs of events of a user."""

    def make() -> ContactMap:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.floor((us - EPOCH_US) / HOUR_US).alias("b"))
        return ContactMap(fixed_bins(spark, 720, 180, 3600), pixels_of(events, "user_id", "b", bins=720), 3600, {"bad": F.col("bin_id") % 37 == 5})

    return _kept(spark, "hour", sf_dir, make)


def part_map(spark: SparkSession, sf_dir: str) -> ContactMap:
    """Sparse map of parts that were ordered together; ten chromosomes."""

    def make() -> ContactMap:
        n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") - 1).alias("b"))
        first = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_partkey")).first()[0]
        rows = rows.withColumn("b", F.col("b") + 1 - first)
        return ContactMap(fixed_bins(spark, n, max(1, n // 10), 1000), pixels_of(rows, "l_orderkey", "b", once=True), 1000, {"bad": F.col("bin_id") % 41 == 3})

    return _kept(spark, "part", sf_dir, make)


def half_view(spark: SparkSession, chroms: int = 4, half: int = 90 * 3600) -> DataFrame:
    """Both halves of each chromosome, named c1_p, c1_q, ..."""
    i = F.col("id")
    chrom = F.concat(F.lit("c"), (F.floor(i / 2) + 1).cast("string"))
    return spark.range(2 * chroms).select(
        chrom.alias("chrom"), (i % 2 * half).alias("start"), ((i % 2 + 1) * half).alias("end"), F.concat(chrom, F.when(i % 2 == 0, "_p").otherwise("_q")).alias("name"), i.cast("int").alias("region_idx")
    )


def halves(bins: DataFrame) -> DataFrame:
    """Two regions a chromosome, cut in the middle of its bins and named like it with _p and _q."""
    sizes = bins.groupBy("chrom", "chrom_idx").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.sort_array(F.collect_list("start")).alias("starts"))  # one row a chromosome
    middle = F.element_at("starts", (F.floor(F.size("starts") / 2) + 1).cast("int"))
    side = lambda name, start, end, k: F.struct(start.alias("start"), end.alias("end"), F.concat("chrom", F.lit(name)).alias("name"), (F.col("chrom_idx") * 2 + k).cast("int").alias("region_idx"))
    both = F.explode(F.array(side("_p", F.col("s"), middle, 0), side("_q", middle, F.col("e"), 1)))
    return sizes.select("chrom", both.alias("r")).select("chrom", "r.*")


def chrom_view(bins: DataFrame) -> DataFrame:
    """One region a chromosome, named like it."""
    return bins.groupBy("chrom", "chrom_idx").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end", F.col("chrom").alias("name"), F.col("chrom_idx").alias("region_idx"))


def view_from_track(track: DataFrame) -> DataFrame:
    return track.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("name", F.col("chrom"))


def write_map(cmap: ContactMap, path: str) -> None:
    """Bins, pixels sorted by (bin1, bin2) so that row groups prune on bin1, and a sidecar of attributes."""
    cmap.bins.write.mode("errorifexists").parquet(f"{path}/bins")
    cmap.pixels.repartitionByRange("bin1_id", "bin2_id").sortWithinPartitions("bin1_id", "bin2_id").write.parquet(f"{path}/pixels")
    spark = cmap.bins.sparkSession
    spark.createDataFrame([(json.dumps(cmap.meta | {"binsize": cmap.binsize}),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def read_map(spark: SparkSession, path: str) -> ContactMap:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return ContactMap(spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/pixels"), meta.pop("binsize"), meta)


def coarser(cmap: ContactMap, factor: int) -> ContactMap:
    """The map in bins factor times as wide, counted from each chromosome's start; weights are not carried over."""
    own = F.floor((F.col("start") / cmap.binsize) / factor)
    named = cmap.bins.withColumn("k", own)
    wide = named.groupBy("chrom_idx", "chrom", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("bin_id").alias("first"))
    sizes = wide.groupBy("chrom_idx").agg(F.count("*").alias("n"))
    base = sizes.select("chrom_idx", F.coalesce(F.sum("n").over(W.orderBy("chrom_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a chromosome
    bins = wide.join(F.broadcast(base), "chrom_idx").select((F.col("base") + F.col("k")).alias("bin_id"), "chrom", "chrom_idx", "start", "end", F.lit(None).cast("double").alias("weight"))
    ids = named.join(F.broadcast(base), "chrom_idx").select("bin_id", (F.col("base") + F.col("k")).alias("wide"))
    px = cmap.pixels
    for k in "12":
        px = px.join(small(ids.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("wide").alias(f"w{k}")), cmap.n_bins()), f"bin{k}_id")
    px = px.groupBy(F.col("w1").alias("bin1_id"), F.col("w2").alias("bin2_id")).agg(F.sum("count").alias("count"))
    return ContactMap(bins, px, cmap.binsize * factor, cmap.meta)


def range_query(pixels: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Stored pixels with i0 <= bin1 < i1 and j0 <= bin2 < j1; both reach the scan."""
    return pixels.where((F.col("bin1_id") >= i0) & (F.col("bin1_id") < i1) & (F.col("bin2_id") >= j0) & (F.col("bin2_id") < j1))


def bins_in(bins: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return bins.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
