"""Genome tables: fixed bins, restriction fragments, GC content, gene coverage; text readers and writers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import require, view_problems
from .fasta import TILE, read_tiles

# Recognition sites of common restriction enzymes, the cut marked by ^
SITES = {"BglII": "A^GATCT", "DpnII": "^GATC", "EcoRI": "G^AATTC", "HindIII": "A^AGCTT", "MboI": "^GATC", "NcoI": "C^CATGG"}


def site_of(enzyme: str) -> tuple[str, int]:
    """Letters and cut of an enzyme's name, or of a site with its cut marked by ^."""
    marked = SITES.get(enzyme, enzyme)
    if not re.fullmatch("[ACGT]*\\^[ACGT]*", marked) or len(marked) < 2:
        raise ValueError(f"neither a known enzyme nor a site like A^AGCTT: {enzyme}")
    return marked.replace("^", ""), marked.index("^")


def binnify(chromsizes: DataFrame, binsize: int) -> DataFrame:
    """Fixed-size bins of (chrom, length); the last one of a chromosome may be short."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / binsize) - 1))
    rows = chromsizes.where("length > 0").select("chrom", "length", k.alias("k"))
    return rows.select("chrom", (F.col("k") * binsize).alias("start"), F.least((F.col("k") + 1) * binsize, "length").alias("end"))


def tiled(sequences: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles (chrom, start, seq) of short whole sequences (chrom, seq); long ones are read as tiles by ``fasta.read_tiles``."""
    if "start" in sequences.columns:
        return sequences
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / tile).cast("int")))
    rows = sequences.where("seq <> ''").withColumn("k", k)
    return rows.select("chrom", (F.col("k") * tile).cast("long").alias("start"), F.substring("seq", F.col("k") * tile + 1, F.lit(tile)).alias("seq"))


def overlaps_itself(site: str) -> bool:
    return any(site[k:] == site[:-k] for k in range(1, len(site)))


def apart(t: pd.DataFrame, width: int) -> pd.DataFrame:
    """Places at least width apart, taken from the left."""
    kept, end = [], -1
    for x in np.sort(t["at"].to_numpy()).tolist():
        if x >= end:
            kept.append(x)
            end = x + width
    return pd.DataFrame({"chrom": [t.chrom.iloc[0]] * len(kept), "at": kept})


def digest(sequences: DataFrame, site: str, cut: int, *, tile: int = TILE) -> DataFrame:
    """Fragments (chrom, start, end) of sequences or tiles: cuts lie cut letters into each occurrence of a site.

    A tile is searched together with the first letters of the next one, so no
    occurrence is missed at a border. Of occurrences that overlap, which few sites
    allow, the first counts.
    """
    rows = tiled(sequences, tile).withColumn("seq", F.upper("seq"))
    reach = len(site) - 1
    heads = rows.select("chrom", (F.col("start") - tile).alias("start"), F.substring("seq", 1, reach).alias("head")) if reach else None
    if reach:
        rows = rows.join(heads, ["chrom", "start"], "left").withColumn("seq", F.concat("seq", F.coalesce("head", F.lit("")))).withColumn("own", F.length("seq") - F.length(F.coalesce("head", F.lit(""))))
    else:
        rows = rows.withColumn("own", F.length("seq"))
    parts = F.split("seq", f"(?={site})")  # every part but perhaps the first begins where the site does
    places = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), lambda s, p: F.struct((s["n"] + F.length(p)).alias("n"), F.when((s["n"] > 0) | F.col("seq").startswith(site), F.concat(s["at"], F.array(s["n"]))).otherwise(s["at"]).alias("at")), lambda s: s["at"])
    found = rows.select("chrom", "start", "own", F.explode(places).alias("p")).where("p < own").select("chrom", (F.col("start") + F.col("p")).alias("at"))
    if overlaps_itself(site):
        found = found.groupBy("chrom").applyInPandas(lambda t: apart(t, len(site)), "chrom string, at long")  # places only
    lengths = rows.groupBy("chrom").agg(F.max(F.col("start") + F.col("own")).alias("end"))
    ends = found.select("chrom", (F.col("at") + cut).alias("end")).union(lengths).distinct()
    before = F.lag("end").over(W.partitionBy("chrom").orderBy("end"))
    return ends.select("chrom", F.coalesce(before, F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("end > start")


def gc(bins: DataFrame, sequences: DataFrame, mapped_only: bool = True, *, tile: int = TILE) -> DataFrame:
    """Share of G and C letters in each bin of the sequences' chromosomes; unmapped (not ACGT) letters leave the denominator, or the bin if asked.

    Bins meet the tiles they touch, and the letters counted there are added up.
    """
    rows = tiled(sequences, tile).select("chrom", F.col("start").alias("s"), F.upper("seq").alias("seq"), F.floor(F.col("start") / tile).alias("k"))
    touched = bins.where("end > start").select("chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("k"))
    lo = F.greatest("start", "s")
    part = F.substring("seq", (lo - F.col("s") + 1).cast("int"), F.greatest(F.least(F.col("end"), F.col("s") + tile) - lo, F.lit(0)).cast("int"))
    count = lambda letters: F.length("part") - F.length(F.translate("part", letters, ""))
    met = touched.join(rows, ["chrom", "k"]).select("chrom", "start", "end", part.alias("part"))
    sums = met.groupBy("chrom", "start", "end").agg(F.sum(count("GC")).alias("gc"), F.sum(count("ACGT") if mapped_only else F.length("part")).alias("n"))
    known = bins.join(rows.select("chrom").distinct(), "chrom", "left_semi").select("chrom", "start", "end")
    return known.join(sums, ["chrom", "start", "end"], "left").select("chrom", "start", "end", (F.col("gc") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).alias("gc"))


def gene_coverage(bins: DataFrame, genes: DataFrame, binsize: int) -> DataFrame:
    """Gene base pairs in each bin; genes are joined by the bins they touch."""
    k = F.explode(F.sequence(F.floor(F.col("gs") / binsize), F.floor((F.col("ge") - 1) / binsize)))
    touched = genes.select("chrom", F.col("start").alias("gs"), F.col("end").alias("ge")).where("ge > gs").withColumn("k", k).withColumn("start", F.col("k") * binsize)
    met = bins.join(touched.drop("k"), ["chrom", "start"], "left")
    inside = F.when(F.col("ge").isNotNull(), F.least("end", "ge") - F.greatest("start", "gs"))
    return met.groupBy("chrom", "start", "end").agg(F.coalesce(F.sum(F.greatest(inside, F.lit(0))), F.lit(0)).alias("covered"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, seq) tiles of the records of FASTA files, read by byte ranges."""
    return read_tiles(spark, path)


def path_and_column(text: str) -> tuple[str, int | str | None]:
    """PATH, or PATH::NAME, or PATH::NUMBER with columns counted from 1; the column comes back from 0."""
    path, _, column = text.partition("::")
    if column.isdigit() and int(column) < 1:
        raise ValueError("columns count from 1")
    return path, (int(column) - 1 if column.isdigit() else column) if column else None


def has_header(lines: list[str]) -> bool:
    """Whether the first row is of names: no number in it, in a column where all further rows have one."""
    def number(x: str) -> bool:
        return re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan", x.strip()) is not None

    rows = [x.split("\t") for x in lines]
    if len(rows) < 2:
        return False
    return any(not number(x) and all(len(r) > k and number(r[k]) for r in rows[1:]) for k, x in enumerate(rows[0]))


def read_track(spark: SparkSession, text: str) -> DataFrame:
    """(chrom, start, end, value) of a tab-separated file, header or not; value is the column after ::, or the fourth."""
    path, column = path_and_column(text)
    first = [r.value for r in spark.read.text(path).where("value not like '#%' and value <> ''").limit(11).collect()]
    rows = spark.read.csv(path, sep="\t", header=has_header(first), comment="#", nullValue="nan")
    names = rows.columns
    value = names[column if isinstance(column, int) else 3] if column is None or isinstance(column, int) else column
    if value not in names:
        raise ValueError(f"no column {value} in {path}")
    kinds = (names[0], "chrom", "string"), (names[1], "start", "long"), (names[2], "end", "long"), (value, "value", "double")
    return rows.select(*(F.col(f"`{n}`").cast(t).alias(a) for n, a, t in kinds))


def read_table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated, typed; nan and blanks are null."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, nullValue="nan", mode="FAILFAST")


def read_expected(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    """Cis expected table; names with dots become underscores. Any failure is a ValueError."""
    try:
        raw = spark.read.csv(path, sep="\t", header=True, nullValue="nan")
        raw = raw.toDF(*(c.replace(".", "_") for c in raw.columns))
        keys = [c for c in ("region1", "region2") if c in raw.columns]
        if len(keys) < 2 or "n_valid" not in raw.columns or (missing := [v for v in values if v not in raw.columns]):
            raise ValueError(f"columns missing: {locals().get('missing', 'region1, region2 or n_valid')}")
        longs = [c for c in ("dist", "n_valid") if c in raw.columns]
        return raw.select(*keys, *(F.col(c).cast("double").cast("long").alias(c) for c in longs), *(F.col(v).cast("double").alias(v) for v in values))
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"not an expected table: {path}") from e


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Numbers the rows of one text file as they come in it: by split, then by place in the split."""
    placed = rows.select("*", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    counts = placed.groupBy("_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a split
    return placed.join(F.broadcast(counts.select("_at", "_first", before.alias("_before"))), "_at").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_at", "_id", "_first", "_before")


def read_view(spark: SparkSession, path: str, chromsizes: DataFrame | None = None) -> DataFrame:
    """BED with three or four columns; without names, chrom:start-end. Checked against chromosome lengths (chrom, length), if given."""
    rows = in_file_order(spark.read.csv(path, sep="\t", comment="#"), "region_idx")
    name = F.col("_c3") if "_c3" in rows.columns else F.concat("_c0", F.lit(":"), "_c1", F.lit("-"), "_c2")
    view = rows.select(F.col("_c0").alias("chrom"), F.col("_c1").cast("long").alias("start"), F.col("_c2").cast("long").alias("end"), name.alias("name"), F.col("region_idx").cast("int"))
    if chromsizes is not None:
        require(view_problems(view, chromsizes), f"view {path}")
    return view


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """BED or BEDPE by the number of columns, with snip_id in file order."""
    rows = in_file_order(spark.read.csv(path, sep="\t", comment="#"), "snip_id")
    names = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"] if "_c5" in rows.columns else ["chrom", "start", "end"]
    typed = [F.col(f"_c{i}").cast("string" if "chrom" in n else "long").alias(n) for i, n in enumerate(names)]
    return rows.select(*typed, "snip_id")


def write_table(df: DataFrame, path: str, na: str = "nan") -> None:
    df.write.csv(path, sep="\t", header=True, nullValue=na)


def write_bedgraph(df: DataFrame, path: str, value: str) -> None:
    df.where(F.col(value).isNotNull()).select("chrom", "start", "end", value).write.csv(path, sep="\t")


def dense_rows(cells: DataFrame, row: str = "i", col: str = "j", value: str = "value", by: str | None = None) -> DataFrame:
    """A dense block, or one for each value of by, as text: one line a row, cells by tabs."""
    listed = F.array_sort(F.collect_list(F.struct(col, value)))
    return cells.groupBy(*([by] if by else []), row).agg(F.concat_ws("\t", F.transform(listed, lambda x: F.coalesce(x[value].cast("string"), F.lit("nan")))).alias("line"))


def dense_text(cells: DataFrame, bins: DataFrame, assembly: str, digits: int = 8, by: str | None = None) -> DataFrame:
    """(row, line) of a dense block with headers, or of one for each value of by: row 0 names the columns, the others their bin and its cells.

    A bin's name is number|assembly|chrom:first-last, counted from 1.
    """
    keys = [by] if by else []
    name = F.concat(F.col("bin_id").cast("string"), F.lit(f"|{assembly}|"), "chrom", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
    named = bins.select(*keys, "bin_id", name.alias("name"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bin_id", "name"))), lambda x: x["name"])
    corner = F.concat(F.count("*").cast("string"), F.lit("x"), F.count("*").cast("string"))
    blocks = named.groupBy(*keys).agg(F.concat_ws("\t", corner, listed).alias("line"), F.min("bin_id").alias("first"))
    head = blocks.select(*keys, F.lit(0).cast("long").alias("row"), "line")
    shown = cells.select(*keys, "i", "j", F.when(F.col("value").isNotNull(), F.format_string(f"%.{digits}f", F.col("value").cast("double"))).alias("value"))
    rows = dense_rows(shown, by=by).join(named.withColumnRenamed("bin_id", "i"), [*keys, "i"])
    first = blocks.select(*keys, "first")
    rows = rows.join(F.broadcast(first), keys) if keys else rows.crossJoin(F.broadcast(first))
    return head.union(rows.select(*keys, (F.col("i") - F.col("first") + 1).alias("row"), F.concat_ws("\t", "name", "line")))
