"""The contact map and its validators.

Bins are ``bin_id, chrom, chrom_idx, start, end, weight``; pixels are
``bin1_id <= bin2_id, count``. A null weight marks a bad bin. Missing values are
NULL everywhere, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIVISIVE = ("KR", "VC", "VC_SQRT")
SORT_BUCKET = 1 << 20


@dataclass
class ContactMap:
    bins: DataFrame
    pixels: DataFrame
    binsize: int
    meta: dict = field(default_factory=dict)
    _rows: int | None = field(default=None, repr=False, compare=False)

    def n_bins(self) -> int:
        """How many bins there are, counted once: the bound of what is broadcast by bin or distance."""
        if self._rows is None:
            self._rows = self.bins.count()
        return self._rows

    def chromsizes(self) -> DataFrame:
        return self.bins.groupBy("chrom", "chrom_idx").agg(F.max("end").alias("length"))


def ratio(a, b) -> Column:
    """a / b, null where b is zero or null."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(a).cast("double") / F.nullif(c(b).cast("double"), F.lit(0.0))


def require(problems: DataFrame, what: str) -> None:
    """Raises ValueError if a table of violations has a row."""
    if first := problems.take(1):
        raise ValueError(f"{what}: {first[0].asDict()}")


def is_balanced(cmap: ContactMap, name: str = "weight") -> bool:
    """Whether the weight column exists; reserved, potentially divisive names are refused."""
    if not isinstance(name, str):
        raise TypeError("a weight name is a string")
    if name in DIVISIVE:
        raise KeyError(f"{name} may be divisive; weights here are multiplicative")
    return name in cmap.bins.columns


def view_problems(view: DataFrame, chromsizes: DataFrame) -> DataFrame:
    """Regions that are inverted, outside their chromosome, overlapping or share a name."""
    own = W.partitionBy("chrom").orderBy("start", "end")
    checked = view.join(F.broadcast(chromsizes.select("chrom", "length")), "chrom", "left").select(
        "chrom", "start", "end", "name", "length", F.count("*").over(W.partitionBy("name")).alias("named"), F.lag("end").over(own).alias("before")
    )
    why = (
        F.when(F.col("length").isNull(), "unknown chromosome")
        .when((F.col("start") < 0) | (F.col("end") > F.col("length")), "out of bounds")
        .when(F.col("start") >= F.col("end"), "inverted")
        .when(F.col("named") > 1, "repeated name")
        .when(F.col("before") > F.col("start"), "overlap")
    )
    return checked.withColumn("problem", why).where("problem is not null").select("chrom", "start", "end", "name", "problem")


def track_problems(track: DataFrame, value: str = "value") -> DataFrame:
    """Intervals of a track that are inverted or overlap their predecessor."""
    before = F.lag("end").over(W.partitionBy("chrom").orderBy("start", "end"))
    why = F.when(F.col("start") >= F.col("end"), "inverted").when(before > F.col("start"), "overlap")
    return track.select("chrom", "start", "end", why.alias("problem")).where("problem is not null")


def expected_problems(expected: DataFrame, keys: list[str]) -> DataFrame:
    """Key rows of an expected table that are null or repeated."""
    nulls = F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0
    counted = expected.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("problem", F.when(nulls, "null key").when(F.col("n") > 1, "repeated key")).where("problem is not null").select(*keys, "problem")


def expected_fits_view(expected: DataFrame, diag_table: DataFrame) -> DataFrame:
    """Region pairs whose number of distances isn't what their bins give (compatibility of cis expected)."""
    have = expected.groupBy("region1", "region2").agg(F.countDistinct("dist").alias("n_have"))
    need = diag_table.groupBy("region1", "region2").agg(F.countDistinct("dist").alias("n_need"))
    return need.join(have, ["region1", "region2"], "full").where(~F.col("n_need").eqNullSafe(F.col("n_have")))


def uncatalogued(expected: DataFrame, view: DataFrame) -> DataFrame:
    """View names that an expected table lacks."""
    names = expected.select(F.col("region1").alias("name")).union(expected.select("region2"))
    return view.select("name").join(names, "name", "left_anti")


def is_sorted(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows that come before their predecessor in the stated order column (none: sorted).

    Rows are compared within buckets of the order column, and each bucket's
    first with the last of the one before, so no task sees all of them.
    """
    key = F.struct(*by)
    rows = df.withColumn("_b", F.floor(F.col(order) / SORT_BUCKET))
    ends = rows.groupBy("_b").agg(F.max_by(key, order).alias("_end"))
    last = F.lag("_end").over(W.orderBy("_b"))  # one row a bucket
    inside = F.lag(key).over(W.partitionBy("_b").orderBy(order))
    compared = rows.withColumn("_in", inside).join(ends.select("_b", last.alias("_last")), "_b").withColumn("_before", F.coalesce("_in", "_last"))
    return compared.where(F.col("_before") > key).select(df.columns)


def expected_fits_trans(expected: DataFrame, blocks: DataFrame) -> DataFrame:
    """Region pairs of a trans expected that are missing, repeated or have another number of valid pairs than their blocks."""
    have = expected.groupBy("region1", "region2").agg(F.count("*").alias("rows"), F.max("n_valid").alias("n_have"))
    both = blocks.select("region1", "region2", F.col("n_valid").alias("n_need")).join(have, ["region1", "region2"], "full")
    return both.where(~F.col("n_need").eqNullSafe(F.col("n_have")) | (F.col("rows") > 1))
