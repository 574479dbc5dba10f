"""A stored map that grows with a stream of point pairs: sorted runs of counts, merged level by level, behind a list of live runs.

A folder holds ``log/<batch>.json``, one small file a batch that lists the live
runs and the sums so far, and the runs themselves: pixels (chrom1, bin1, chrom2,
bin2, count) and marginals (chrom, bin, cis, total). A batch counts only what it
brings and writes it as a run of level 0; full levels are merged into one run of
the next, so a row is rewritten once a level and not once a batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import tasks_for
from .pairs import pixel_stream

PIXEL = ["chrom1", "bin1", "chrom2", "bin2"]
BIN = ["chrom", "bin"]
RUNS_A_LEVEL = 4
KEPT_STATES = 2


@dataclass
class State:
    """What one batch left: its number, who numbers batches, the live runs as (level, folder), and the sums over all pairs so far."""

    batch: int = -1
    writer: str = ""
    runs: list = field(default_factory=list)
    contacts: int = 0
    cis: int = 0

    def levels(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for level, folder in self.runs:
            out.setdefault(level, []).append(folder)
        return out


class StoredMap:
    """The map in a folder that the driver and all executors share. One query writes it; any number may read."""

    def __init__(self, spark: SparkSession, path: str, binsize: int):
        self.spark, self.path, self.binsize = spark, path.rstrip("/"), binsize
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _batches(self) -> list[int]:
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self) -> State:
        """The state after the last batch that was finished."""
        done = self._batches()
        if not done:
            return State()
        file = self._fs.open(self._at(f"{self.path}/log/{done[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return State(**json.loads(text))

    def _commit(self, state: State) -> None:
        """The list appears whole or not at all: it is written aside and renamed, which is where a batch takes effect."""
        name = f"{self.path}/log/{state.batch:012d}.json"
        aside = self._at(f"{self.path}/aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(json.dumps(state.__dict__).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at(f"{self.path}/log"))
        if not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise RuntimeError(f"batch {state.batch} of {self.path} was finished by another writer")

    def _write(self, pixels: DataFrame, tasks: int) -> str:
        """One run: its pixels in the order of their bins, and their marginals from what was written. A stream's session doesn't adapt its partitions, so tasks are counted."""
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        pixels.repartitionByRange(tasks, *PIXEL).sortWithinPartitions(*PIXEL).write.parquet(f"{folder}/pixels")
        marginals(self._read(folder, "pixels")).write.parquet(f"{folder}/marginals")
        return folder

    def _read(self, folder: str, what: str) -> DataFrame:
        return self.spark.read.schema(PIXEL_SCHEMA if what == "pixels" else MARGINAL_SCHEMA).parquet(f"{folder}/{what}")

    def _summed(self, folders: list[str], what: str) -> DataFrame:
        keys, values = (PIXEL, ["count"]) if what == "pixels" else (BIN, ["cis", "total"])
        if not folders:
            return self.spark.createDataFrame([], PIXEL_SCHEMA if what == "pixels" else MARGINAL_SCHEMA)
        rows = self.spark.read.schema(PIXEL_SCHEMA if what == "pixels" else MARGINAL_SCHEMA).parquet(*(f"{x}/{what}" for x in folders))
        return rows.repartition(tasks_for(rows.count()), *keys).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))

    def merge(self, pairs: DataFrame, batch: int, writer: str = "") -> State:
        """Adds a batch of pairs (chrom1, pos1, chrom2, pos2). A batch that is already in is skipped, so replays change nothing.

        Batches are numbered by one writer, a query's checkpoint; another one's numbers
        mean other pairs, so it gets a ValueError and no batch is skipped by mistake.
        Runs that an attempt without an end left behind are in no list and are not
        read. Pairs with a null in any of the four columns are left out.
        """
        before = self.state()
        if before.batch >= 0 and before.writer != writer:
            raise ValueError(f"{self.path} follows {before.writer or 'batches by hand'}, not {writer or 'batches by hand'}")
        if batch <= before.batch:
            return before
        known = pairs.dropna(subset=["chrom1", "pos1", "chrom2", "pos2"])
        tasks = tasks_for(known.count())
        new = self._write(pixel_stream(known, self.binsize, tasks=tasks), tasks)
        sums = self._read(new, "pixels").agg(F.sum("count"), F.sum(F.when(F.col("chrom1") == F.col("chrom2"), F.col("count")))).first()
        after = State(batch, writer, [*before.runs, [0, new]], before.contacts + (sums[0] or 0), before.cis + (sums[1] or 0))
        while full := [k for k, folders in after.levels().items() if len(folders) >= RUNS_A_LEVEL]:
            level = min(full)
            folders = after.levels()[level]
            merged = self._write(self._summed(folders, "pixels"), tasks_for(self.spark.read.schema(PIXEL_SCHEMA).parquet(*(f"{x}/pixels" for x in folders)).count()))
            after.runs = [r for r in after.runs if r[0] != level] + [[level + 1, merged]]
        self._commit(after)
        self._clean(after)
        return after

    def _clean(self, now: State) -> None:
        """Deletes lists but the last two, and runs that neither of those names; readers of the list before still find theirs."""
        batches = self._batches()
        live = {folder for _, folder in now.runs}
        for b in batches[-KEPT_STATES:-1]:
            file = self._fs.open(self._at(f"{self.path}/log/{b:012d}.json"))
            try:
                live |= {f for _, f in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))["runs"]}
            finally:
                file.close()
        names = {folder.rsplit("/", 1)[1] for folder in live}
        for s in self._fs.listStatus(self._at(self.path)):
            name = s.getPath().getName()
            if name.startswith("run-") and name not in names:
                self._fs.delete(s.getPath(), True)
        for b in batches[:-KEPT_STATES]:
            self._fs.delete(self._at(f"{self.path}/log/{b:012d}.json"), False)

    def pixels(self) -> DataFrame:
        """All counts so far. Runs overlap in their keys, so they are added up; there are few of them."""
        return self._summed([f for _, f in self.state().runs], "pixels")

    def marginals(self) -> DataFrame:
        """Coverage by bin (cis and total), kept beside the counts: no pixel is read for it."""
        return self._summed([f for _, f in self.state().runs], "marginals")

    def follow(self, pairs: DataFrame, checkpoint: str, **trigger):
        """Starts the query that merges a stream of pairs; the checkpoint folder says which batches it made."""
        return pairs.writeStream.foreachBatch(lambda df, batch: self.merge(df, batch, checkpoint) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


PIXEL_SCHEMA = "chrom1 string, bin1 long, chrom2 string, bin2 long, count long"
MARGINAL_SCHEMA = "chrom string, bin long, cis long, total long"


def marginals(pixels: DataFrame) -> DataFrame:
    """Contacts at each bin; one within a bin counts at both its ends."""
    ends = F.array(F.struct(F.col("chrom1").alias("chrom"), F.col("bin1").alias("bin")), F.struct(F.col("chrom2").alias("chrom"), F.col("bin2").alias("bin")))
    cis = F.when(F.col("chrom1") == F.col("chrom2"), F.col("count")).otherwise(0)
    rows = pixels.select(F.explode(ends).alias("e"), cis.alias("cis"), F.col("count").alias("total"))
    return rows.groupBy("e.chrom", "e.bin").agg(F.sum("cis").alias("cis"), F.sum("total").alias("total"))
