"""Additive profiles by bin, filters by coverage, sampling, and scaling of point pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..plans.joins import annotate, small
from ..schema import ContactMap
from ..sources.workspace import Kept


def coverage(cmap: ContactMap, *, weighted: bool = False, ignore_diags: int = 0) -> DataFrame:
    """Cis and total marginal of every bin; each pixel counts at both ends, on the diagonal twice.

    Balanced: pixels of bad bins add nothing and bad bins are null.
    """
    px = annotate(cmap.pixels, cmap.bins, rows=cmap.n_bins()).where(F.abs(F.col("bin2_id") - F.col("bin1_id")) >= ignore_diags)
    zero = F.lit(0.0)
    v = F.col("count") * F.coalesce("weight1", zero) * F.coalesce("weight2", zero) if weighted else F.col("count")
    ends = px.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), v.alias("v"), (F.col("chrom1") == F.col("chrom2")).alias("cis"))
    sums = ends.groupBy("bin_id").agg(F.sum(F.when(F.col("cis"), F.col("v"))).alias("cov_cis"), F.sum("v").alias("cov_tot"))
    out = cmap.bins.join(sums, "bin_id", "left")
    for c in ("cov_cis", "cov_tot"):
        full = F.coalesce(c, F.lit(0.0 if weighted else 0))
        out = out.withColumn(c, F.when(F.col("weight").isNotNull(), full) if weighted else full)
    return out


def cis_total_ratio(cmap: ContactMap, threshold: float = 0.5) -> DataFrame:
    """(bin_id, good): whether over threshold of a bin's contacts are on its own chromosome."""
    share = F.col("cov_cis") / F.nullif(F.col("cov_tot").cast("double"), F.lit(0.0))
    return coverage(cmap).select("bin_id", F.coalesce(share > threshold, F.lit(False)).alias("good"))


def bin_mask(cmap: ContactMap, filters: list) -> DataFrame:
    """All of several bin filters together."""
    out = cmap.bins.select("bin_id", F.lit(True).alias("good"))
    for f in filters:
        out = out.join(f(cmap).withColumnRenamed("good", "_g"), "bin_id").select("bin_id", (F.col("good") & F.col("_g")).alias("good"))
    return out


def filtered(cmap: ContactMap, mask: DataFrame) -> ContactMap:
    """The map with only pixels whose ends both pass; all bins stay."""
    ok = mask.where("good").select("bin_id")
    px = cmap.pixels
    for k in "12":
        px = px.join(small(ok.withColumnRenamed("bin_id", f"bin{k}_id"), cmap.n_bins()), f"bin{k}_id", "left_semi")
    return ContactMap(cmap.bins, px.select("bin1_id", "bin2_id", "count"), cmap.binsize, cmap.meta)


def virtual4c(cmap: ContactMap, chrom: str, start: int, end: int, *, weighted: bool = True) -> DataFrame:
    """Every bin's mean over stored pixels to a viewpoint; null inside it and where nothing is stored."""
    px = annotate(cmap.pixels, cmap.bins, ("chrom", "start", "end", "weight"), rows=cmap.n_bins())
    v = F.col("count") * F.col("weight1") * F.col("weight2") if weighted else F.col("count").cast("double")
    inside = lambda k: (F.col(f"chrom{k}") == chrom) & (F.col(f"start{k}") < end) & (F.col(f"end{k}") > start)
    met = px.where(inside(1) != inside(2)).select(F.when(inside(1), F.col("bin2_id")).otherwise(F.col("bin1_id")).alias("bin_id"), v.alias("v"))
    return cmap.bins.select("bin_id", "chrom", "start", "end").join(met.groupBy("bin_id").agg(F.avg("v").alias("value")), "bin_id", "left")


def cross_score(cmap: ContactMap, edges: list[int]) -> DataFrame:
    """Cis marginals by bin, distance bin and side: down at a pixel's first bin, up at its second, both together."""
    px = annotate(cmap.pixels, cmap.bins, rows=cmap.n_bins()).where("chrom1 = chrom2")
    bp = (F.col("bin2_id") - F.col("bin1_id")) * cmap.binsize
    which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= bp))
    rows = px.where(which < len(edges)).select(which.alias("dist_bin"), F.explode(F.array(F.struct(F.col("bin1_id").alias("bin_id"), F.lit("down").alias("dir")), F.struct(F.col("bin2_id").alias("bin_id"), F.lit("up").alias("dir")))).alias("x"), "count")
    sides = rows.groupBy("x.bin_id", "dist_bin", "x.dir").agg(F.sum("count").alias("score"))
    both = sides.groupBy("bin_id", "dist_bin").agg(F.sum("score").alias("score")).withColumn("dir", F.lit("both"))
    return sides.unionByName(both)


def pair_scaling(pairs: DataFrame, edges: list[int], length: int) -> DataFrame:
    """Pairs (pos1, pos2) by distance bin, with the bin's area of possible pairs on a chromosome of that length."""
    n = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.abs(F.col("pos2") - F.col("pos1"))))
    arr = F.array(*map(F.lit, edges))
    area = lambda c: 0.5 * F.greatest(F.lit(length) - c, F.lit(0)).cast("double") ** 2
    counted = pairs.select(n.alias("b")).where((F.col("b") > 0) & (F.col("b") < len(edges))).groupBy("b").agg(F.count("*").alias("n_pairs"))
    lo, hi = arr[F.col("b") - 1], arr[F.col("b")]
    return counted.select(lo.alias("dist_lo"), hi.alias("dist_hi"), "n_pairs", (area(lo) - area(hi)).alias("area"))


def region_scaling(pairs: DataFrame, region1: tuple[int, int], region2: tuple[int, int], edges: list[int]) -> DataFrame:
    """Pairs (pos1 in region1, pos2 in region2) by distance bin, empty bins too, with the area of possible pairs.

    The points of a rectangle at a distance of x or more are those of four
    triangles, two added and two taken away.
    """
    (s1, e1), (s2, e2) = sorted([region1, region2])
    half = lambda u: max(u, 0) ** 2 / 2
    beyond = [half(e2 - s1 - x) - half(s2 - s1 - x) - half(e2 - e1 - x) + half(s2 - e1 - x) for x in edges]
    table = [(k + 1, lo, hi, float(a - b)) for k, (lo, hi, a, b) in enumerate(zip(edges, edges[1:], beyond, beyond[1:], strict=False))]
    bins = pairs.sparkSession.createDataFrame(table, "b int, dist_lo long, dist_hi long, area double")
    inside = pairs.where(F.col("pos1").between(region1[0], region1[1] - 1) & F.col("pos2").between(region2[0], region2[1] - 1))
    which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("pos2") - F.col("pos1")))
    counted = inside.select(which.alias("b")).groupBy("b").agg(F.count("*").alias("n_pairs"))
    return bins.join(counted, "b", "left").select("dist_lo", "dist_hi", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "area")


HASH_RANGE, CHUNK, SPLITS, FEW = 1 << 60, 4096, 1 << 12, 10_000


def contact_hash(seed: int = 0):
    """A number in [0, HASH_RANGE) for the k-th contact of a pixel."""
    return lambda k: F.xxhash64("bin1_id", "bin2_id", k, F.lit(seed)).bitwiseAND(HASH_RANGE - 1)


def sample_approx(pixels: DataFrame, frac: float, seed: int = 0, *, key=None) -> DataFrame:
    """Binomial thinning of every pixel: contacts whose hash lies below the share of its range stay.

    The draw depends on the pixel, the contact's number and the seed, not on
    partitions; key may be another hash of a contact's number.
    """
    if not 0 <= frac <= 1:
        raise ValueError("a fraction is between 0 and 1")
    key, cut = key or contact_hash(seed), F.lit(round(frac * HASH_RANGE))
    inside = lambda c: F.sequence(c * CHUNK + 1, F.least((c + 1) * CHUNK, "count"))
    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / CHUNK)), F.lit(0).cast("long"), lambda n, c: n + F.size(F.filter(inside(c), lambda k: key(k) < cut)))
    return pixels.where("count > 0").select("bin1_id", "bin2_id", drawn.alias("count")).where("count > 0")


BLOCK_PIXELS, MOST_BLOCKS = 1 << 18, 1 << 20


def sample_split(pixels: DataFrame, count: int, seed: int = 0, *, block_pixels: int = BLOCK_PIXELS) -> DataFrame:
    """Exactly count contacts without replacement, by a tree of draws: over blocks of pixels, then over each block's pixels.

    Blocks are dealt by a hash of the pixel, and each draws by its own seed from its
    pixels in order, so the sample depends on pixels and seed alone, not on
    partitions or retries. A row is never made for a contact: one number a block
    reaches the driver, and work and shuffle are by pixels.
    """
    spark = pixels.sparkSession
    px = pixels.where("count > 0").select("bin1_id", "bin2_id", F.col("count").cast("long").alias("count"))
    rows, total = px.agg(F.count("*"), F.sum("count")).first()
    if not 0 <= count <= (total or 0):
        raise ValueError("more contacts asked for than there are")
    blocks = min(MOST_BLOCKS, max(1, -(-rows // block_pixels)))
    px = px.withColumn("block", F.pmod(F.xxhash64("bin1_id", "bin2_id"), F.lit(blocks)).cast("int"))
    sums = sorted((r.block, r.n) for r in px.groupBy("block").agg(F.sum("count").alias("n")).collect())
    share = draws.split(np.random.default_rng([seed, 0]), np.array([n for _, n in sums], dtype=np.int64), count)
    wanted = spark.createDataFrame([(b, int(k)) for (b, _), k in zip(sums, share, strict=True) if k], "block int, k long")

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bin1_id", "ascending"), ("bin2_id", "ascending")])
        got = draws.split(np.random.default_rng([seed, 1, t["block"][0].as_py()]), t["count"].to_numpy(), t["k"][0].as_py())
        keep = np.flatnonzero(got)
        return pa.table({"bin1_id": t["bin1_id"].take(keep), "bin2_id": t["bin2_id"].take(keep), "count": pa.array(got[keep])})

    return px.join(small(wanted, len(sums)), "block").groupBy("block").applyInArrow(draw, "bin1_id long, bin2_id long, count long")


def sample_exact(pixels: DataFrame, count: int, seed: int = 0, *, key=None) -> DataFrame:
    """Exactly count contacts without replacement: those of the least hash, so that other engines can draw the same; ties by pixel and number.

    ``sample_split`` is the way to draw where no hash of each contact is asked for.

    Hashes spread evenly, so two bounds on either side of the share asked for hold the last one but for a chance in 10^9. One
    pass over the contacts counts those below both by pixel and keeps those between; only these are sorted. Where the
    bounds miss, histograms of the hash narrow the last one down instead.
    """
    kept = Kept(pixels.sparkSession)
    px = kept.table(pixels.where("count > 0").select("bin1_id", "bin2_id", F.col("count").cast("long").alias("count")))  # a row a pixel
    total = px.agg(F.sum("count")).first()[0] or 0
    if count >= total:
        return px
    if count <= 0:
        return px.where("false")
    share, off = count / total, 6 * math.sqrt(count * (1 - count / total)) / total + 20 / total
    lo, hi = (min(HASH_RANGE, max(0, round((share + s * off) * HASH_RANGE))) for s in (-1, 1))
    dealt = px.repartition(max(1, min(-(-total // CONTACTS_A_TASK), 10_000)), "bin1_id", "bin2_id") if total > CONTACTS_A_TASK else px  # few rows of pixels are much work
    drawn = _contacts(dealt, key or contact_hash(seed)).where(F.col("h") < hi)
    between = F.col("h") >= lo
    met = kept.table(drawn.groupBy("bin1_id", "bin2_id", F.when(between, F.col("h")).alias("h"), F.when(between, F.col("k")).alias("k")).agg(F.count("*").alias("count")))
    below, inside = met.agg(F.sum(F.when(F.col("h").isNull(), F.col("count"))), F.count("h")).first()
    left = count - (below or 0)
    if 0 <= left <= inside:
        sure, last = met.where("h is null"), met.where("h is not null").orderBy("h", "bin1_id", "bin2_id", "k").limit(left)
        return sure.unionByName(last).groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))
    return _narrowed(px, count, key or contact_hash(seed))


CONTACTS_A_TASK = 1 << 22


def _contacts(pixels: DataFrame, key) -> DataFrame:
    """A row a contact (bin1_id, bin2_id, k, h), by its number and hash."""
    return pixels.select("bin1_id", "bin2_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long"))).alias("k")).withColumn("h", key(F.col("k")))


def _narrowed(pixels: DataFrame, count: int, key) -> DataFrame:
    """The contacts of the least hash, whatever its spread: histograms narrow the last one down until few contacts share its interval."""
    contacts = _contacts(pixels, key)
    lo, width, left, size = 0, HASH_RANGE, count, None
    while (size is None or size > FEW) and width > 1 and left > 0:
        step = max(1, width // SPLITS)
        hist = {r.s: r.n for r in contacts.where((F.col("h") >= lo) & (F.col("h") < lo + width)).groupBy(F.floor((F.col("h") - lo) / step).alias("s")).agg(F.count("*").alias("n")).collect()}  # about SPLITS rows
        at = None
        for s in sorted(hist):
            at = s
            if hist[s] >= left:
                break
            left -= hist[s]
        if at is None or hist[at] < left:
            left = 0  # there are no more contacts than asked for
            lo += width
            break
        lo, width, size = lo + at * step, step, hist[at]
    sure = contacts.where(F.col("h") < lo)
    last = contacts.where((F.col("h") >= lo) & (F.col("h") < lo + width)).orderBy("h", "bin1_id", "bin2_id", "k").limit(left)
    return sure.unionByName(last).groupBy("bin1_id", "bin2_id").agg(F.count("*").alias("count"))


def sample(cmap: ContactMap, *, count: int | None = None, cis_count: int | None = None, frac: float | None = None, exact: bool = False, seed: int = 0) -> ContactMap:
    """A map with a share or a number of the contacts; one target must be given."""
    if sum(x is not None for x in (count, cis_count, frac)) != 1:
        raise ValueError("give one of count, cis_count and frac")
    total = cmap.pixels.agg(F.sum("count")).first()[0] or 0
    if cis_count is not None:
        frac = cis_count / annotate(cmap.pixels, cmap.bins, rows=cmap.n_bins()).where("chrom1 = chrom2").agg(F.sum("count")).first()[0]
    elif count is not None:
        frac = count / total
    if frac > 1:
        raise ValueError("more contacts asked for than there are")
    px = sample_split(cmap.pixels, count if count is not None else round(frac * total), seed) if exact else sample_approx(cmap.pixels, frac, seed)
    return ContactMap(cmap.bins if exact else cmap.bins.withColumn("weight", F.lit(None).cast("double")), px, cmap.binsize, cmap.meta)
