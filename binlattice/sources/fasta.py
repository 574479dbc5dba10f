"""A splittable source of sequences: byte ranges of FASTA files, stitched to tiles of records.

Each task reads the lines that begin in its byte range and hands on pieces of records
of bounded length; what record a range begins in, and how far, follows from one row a
range. Tiles have a fixed length and place, so a chromosome is never one string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT, PIECE, TILE = 64 << 20, 1 << 16, 1 << 16


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int


def files(path: str) -> list[tuple[str, int]]:
    """Files under a path of any file system that Arrow opens, with their sizes."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    info = fs.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if x.type == pafs.FileType.File]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(f"{path.rstrip('/')}{x.path[len(inner.rstrip('/')):]}", x.size) for x in sorted(found, key=lambda x: x.path)]


def lines_of(path: str, start: int, end: int, buffer: int = 1 << 20) -> Iterator[tuple[bool, bytes]]:
    """(whether a line begins, text) of the lines that begin in [start, end), without their ends; long lines come in parts."""
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        at = max(start - 1, 0)
        f.seek(at)
        held, skipping, begins = b"", start > 0, True  # the byte before says whether a line begins at start
        while True:
            block = f.read(buffer)
            held += block
            cut = 0
            while (stop := held.find(b"\n", cut)) >= 0:
                if begins and not skipping and at + cut >= end:
                    return
                if not skipping:
                    yield begins, held[cut:stop].rstrip(b"\r")
                skipping, begins, cut = False, True, stop + 1
            if begins and not skipping and at + cut >= end:
                return
            if cut < len(held) and (not block or len(held) - cut > buffer // 2):  # the rest of the file, or a part of a long line
                if not skipping:
                    yield begins, held[cut:].rstrip(b"\r")
                begins, cut = False, len(held)
            at, held = at + cut, held[cut:]
            if not block:
                return


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.piece = options["path"], int(options.get("split", SPLIT)), int(options.get("piece", PIECE))
        self.buffer = int(options.get("buffer", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        return [Range(p, n, lo, min(lo + self.split, size)) for p, size in files(self.path) for n, lo in enumerate(range(0, size, self.split))] or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        """(file, range, record, name, at, seq): records of a range are numbered from 1, 0 is the one it begins in; at counts its letters in the range."""
        if not partition.path:
            return
        record, name, at, held, size = 0, None, 0, [], 0

        def row():
            return partition.path, partition.number, record, name, at, b"".join(held).decode("ascii")

        header = False
        for begins, line in lines_of(partition.path, partition.start, partition.end, self.buffer):
            header = line.startswith(b">") if begins else header
            if header and not begins:
                continue  # the rest of a header of very many letters
            if header:
                if held or record == 0 or at == 0:
                    yield row()
                words = line[1:].split()
                record, name, at, held, size = record + 1, words[0].decode() if words else "", 0, [], 0
                continue
            letters = b"".join(line.split())
            for lo in range(0, len(letters), self.piece):
                part = letters[lo : lo + self.piece]
                if size + len(part) > self.piece:
                    yield row()
                    at, held, size = at + size, [], 0
                held.append(part)
                size += len(part)
        yield row()


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "file string, range int, record int, name string, at long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def read_pieces(spark: SparkSession, path: str, *, split: int = SPLIT, piece: int = PIECE, buffer: int = 1 << 20) -> DataFrame:
    """(chrom, start, seq): pieces of the records, in no order."""
    spark.dataSource.register(Fasta)
    pieces = spark.read.format("fasta_pieces").options(split=split, piece=piece, buffer=buffer).load(path)
    sized = pieces.groupBy("file", "range", "record").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("n"))
    ends = sized.groupBy("file", "range").agg(F.max("record").alias("records"), F.max_by("name", "record").alias("name"), F.max_by("n", "record").alias("tail"), F.max(F.when(F.col("record") == 0, F.col("n")).otherwise(0)).alias("before"))
    w = W.partitionBy("file").orderBy("range")  # a row a range
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    opens = F.when(F.col("records") > 0, F.struct("name", "tail"))
    ends = ends.withColumn("from", F.last(opens, ignorenulls=True).over(earlier)).withColumn("era", F.coalesce(F.count(opens).over(earlier), F.lit(0)))
    passed = F.sum("before").over(W.partitionBy("file", "era").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("file", "range", F.col("from.name").alias("from"), (F.coalesce("from.tail", F.lit(0)) + F.coalesce(passed, F.lit(0))).alias("offset"))
    placed = pieces.where("seq <> ''").join(F.broadcast(carried), ["file", "range"])
    inside = F.col("record") == 0
    return placed.select(F.when(inside, F.col("from")).otherwise(F.col("name")).alias("chrom"), (F.col("at") + F.when(inside, F.col("offset")).otherwise(0)).alias("start"), "seq").where("chrom is not null")


def tiles_of(pieces: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, start, seq): tiles of a fixed length, but for the last of a record, from pieces (chrom, start, seq)."""
    first, last = F.floor(F.col("start") / tile), F.floor((F.col("start") + F.length("seq") - 1) / tile)
    cut = pieces.where("seq <> ''").withColumn("k", F.explode(F.sequence(first, last)))
    lo = F.greatest("start", F.col("k") * tile)
    hi = F.least(F.col("start") + F.length("seq"), (F.col("k") + 1) * tile)
    part = F.struct(lo.alias("at"), F.substring("seq", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["part"]), "")  # a tile's letters at most
    return cut.groupBy("chrom", "k").agg(whole.alias("seq")).select("chrom", (F.col("k") * tile).alias("start"), "seq")


def read_tiles(spark: SparkSession, path: str, *, tile: int = TILE, split: int = SPLIT, piece: int = PIECE) -> DataFrame:
    """(chrom, start, seq): the records of FASTA files as tiles. Letters before a first header belong to nothing."""
    return tiles_of(read_pieces(spark, path, split=split, piece=piece), tile)
