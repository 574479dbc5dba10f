"""Tables in the folder that all executors share, size-checked joins and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import shared_dir

BROADCAST_BYTES = 32 << 20


class Scratch:
    """Written tables of one query: they cut lineage, outlive executors, and go with the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/binlattice-{uuid.uuid4().hex}"
        self.count = 0
        path = self._path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def table(self, df: DataFrame, *by: str) -> DataFrame:
        """Writes df, with a folder for each value of the columns ``by``, and reads it back."""
        self.count += 1
        name = f"{self.root}/{self.count}"
        df.write.partitionBy(*by).option("compression", "zstd").parquet(name)
        kept = self.spark.read.schema(df.schema).parquet(name)
        kept._binlattice_path = name
        return kept

    def run(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Writes df in so many sorted buckets by the hash of key; joins of such runs by it need no shuffle."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        name = f"run_{path.rsplit('-', 1)[1].replace('/', '_')}"
        df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
        kept = self.spark.table(name)
        kept._binlattice_path, kept._binlattice_run = path, name
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            if name := getattr(df, "_binlattice_run", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self._path(df._binlattice_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def places(prefix: str = "") -> list[Column]:
    """row and tag, which tell rows of one doc_id apart, and rows without one.

    row is the doc_id, or a hash of the text where that is null; tag is another
    hash of the text. Rows equal in both hold the same text, so they may share
    whatever is found out about it.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(own))
    return [row.alias(f"{prefix}row"), F.xxhash64(F.lit(7), own).bitwiseAND(0x7FFFFFFF).cast("int").alias(f"{prefix}tag")]


def narrow_join(big: DataFrame, small: DataFrame, key: str | list[str], payload: str | Column, how: str = "left", *, limit: int | None = None) -> DataFrame:
    """Joins the documents with marks, one row a key.

    payload is the column of marks, or their size in bytes. The marks are broadcast
    if their measured size is within limit (BROADCAST_BYTES by default); beyond
    it, both sides are shuffled by the key.
    """
    size = small.agg(F.sum((F.length(payload) if isinstance(payload, str) else payload) + 64)).first()[0] or 0
    side = F.broadcast(small) if size <= (BROADCAST_BYTES if limit is None else limit) else small.hint("merge")
    return big.join(side, key, how)


def by_key(batches):
    """The columns of whole groups of rows that come sorted by their first column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        key = held.column(0).to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield held.slice(0, end).combine_chunks()
            held = held.slice(end)
    if held is not None:
        yield held.combine_chunks()


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of the columns begins with, in either case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def without(docs: DataFrame, scratch: Scratch, gone: DataFrame) -> DataFrame:
    """The documents but the rows in gone (row, tag of ``places``, distinct), columns as they were, whatever their names."""
    own = free_prefix(docs.columns)
    listed = scratch.table(gone.select(F.col("row").alias(f"{own}row"), F.col("tag").alias(f"{own}tag"), F.lit("x").alias(f"{own}mark")))
    return narrow_join(docs.select("*", *places(own)), listed, [f"{own}row", f"{own}tag"], f"{own}mark", "left_anti").select(docs.columns)


def components(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) for every row of nodes (id): the same root for ids that edges (a, b) connect.

    Every round maps each id to its least neighbour by a hashed order, with one
    jump, and contracts the edges by it: paths shrink geometrically in
    expectation and stars at once. Rounds are written tables, so a lost
    executor repeats one round at most.
    """
    labels = nodes.select("id", F.col("id").alias("root"))
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    live = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    while live.take(1):
        ends = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        step = scratch.table(ends.groupBy("a").agg(F.min(order("b")).alias("low")).select("a", F.least("low", order("a"))["v"].alias("to")))
        jump = scratch.table(step.join(step.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to")))
        left, right = (jump.select(F.col("a").alias(x), F.col("to").alias("n" + x)) for x in "ab")
        after = scratch.table(live.join(left, "a").join(right, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        labels = scratch.table(labels.join(jump.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        scratch.drop(live, step)
        live = after
    return labels
