"""Command line: one subcommand an operator, over a map folder written by sources.maps.write_map."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays
from .operators import bands, compartments, dots, expected, profiles, rearrange, snip
from .plans.joins import align_track, view_pairs
from .schema import ContactMap, expected_fits_trans, expected_fits_view, expected_problems, require
from .sources import genome, maps
from .sources.bigwig import write_bigwig
from .sources.workspace import Kept


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="binlattice", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **extra):
        s = sub.add_parser(name)
        s.add_argument("map")
        s.add_argument("-o", "--output", required=True)
        s.add_argument("--view", help="BED file of regions")
        for flag, kind in extra.items():
            s.add_argument(f"--{flag.replace('_', '-')}", **kind)

    number = {"type": int}
    add("expected-cis", smooth={"action": "store_true"}, aggregate_smoothed={"action": "store_true"}, ignore_diags={"type": int, "default": 2})
    add("expected-trans")
    add("logbin-expected", bins_per_decade={"type": int, "default": 10}, table={"choices": ["binned", "slopes", "combined", "combined-slopes"], "default": "binned"}, spread={"choices": ["logstd", "std"], "default": "logstd"}, spread_slopes={"choices": ["std", "minmax"], "default": "std"}, min_nvalid={"type": int, "default": 200}, min_count={"type": int, "default": 50}, expected={"help": "table of cis expected, instead of the map's own"})
    add("insulation", window={"type": int, "nargs": "+", "required": True}, threshold={"default": "0"}, ignore_diags={"type": int, "default": 2}, min_frac_valid_pixels={"type": float, "default": 0.66}, min_dist_bad_bin={"type": int, "default": 0}, append_raw_scores={"action": "store_true"}, window_pixels={"action": "store_true", "help": "windows are in bins"}, bedgraph={"action": "store_true", "help": "also one track a window, beside the output"}, bigwig={"action": "store_true", "help": "also as bigWig, beside the output"})
    add("directionality", window_bins={"type": int, "default": 10})
    add("coverage", ignore_diags={"type": int, "default": 0}, raw={"action": "store_true"}, store={"action": "store_true", "help": "the output is the map with the marginals as bin columns"}, bigwig={"action": "store_true", "help": "also as bigWig, beside the output"})
    add("virtual4c", viewpoint={"required": True, "help": "chrom:start-end"}, bigwig={"action": "store_true", "help": "also as bigWig, beside the output"})
    add("pileup", features={"required": True}, ignore_diags={"type": int, "help": "by default as many as the map's balancing did, or 2"}, flank={"type": int, "default": 100_000}, aggregate={"default": "mean", "choices": sorted(snip.REDUCERS)}, by_expected={"action": "store_true"}, expected={"help": "table of cis expected to divide by"}, stack={"help": "folder for the snippets themselves, as Parquet"})
    phased = {"bigwig": {"action": "store_true", "help": "also the first eigenvector as bigWig, beside the output"}, "n_eigs": {"type": int, "default": 3}, "phasing_track": {"help": "FILE or FILE::COLUMN of chrom, start, end, value"}, "sort_metric": {"choices": ["spearmanr", "pearsonr", "var_explained", "MAD_explained"]}}
    add("eigs-cis", clip_percentile={"type": float, "default": 99.9}, **phased)
    add("eigs-trans", **phased)
    add("saddle", track={"required": True, "help": "FILE or FILE::COLUMN of chrom, start, end, value"}, n_bins={"type": int, "default": 50}, strength={"action": "store_true"}, contact_type={"choices": ["cis", "trans"], "default": "cis"}, expected={"help": "table of expected values"}, qrange={"type": float, "nargs": 2}, vrange={"type": float, "nargs": 2}, min_dist={"type": int, "default": 3, "help": "in bins"}, max_dist={"type": int, "default": -1, "help": "in bins"}, trim_outliers={"action": "store_true"}, bundle={"help": "folder for sums, counts, edges and the digitized track, as Parquet"})
    add("dots", max_distance={"type": int, "default": 2_000_000}, fdr={"type": float, "default": 0.02}, n_lambda_bins={"type": int, "default": 45}, radius={"type": float, "default": 39_000}, expected={"help": "table of cis expected"})
    add("random-sample", count=number, cis_count=number, frac={"type": float}, exact={"action": "store_true"}, seed={"type": int, "default": 0})
    add("rearrange")
    add("coarsen", factor={"type": int, "nargs": "+", "required": True, "help": "one map a factor goes into the output folder"})
    g = sub.add_parser("genome").add_subparsers(dest="what", required=True)
    for name, inputs in (("binnify", ["chromsizes", "binsize"]), ("digest", ["fasta", "enzyme"]), ("gc", ["bins", "fasta"]), ("genecov", ["bins", "genes"])):
        s = g.add_parser(name)
        for x in inputs:
            s.add_argument(x, **number if x == "binsize" else {})
        s.add_argument("-o", "--output", required=True)
        if name == "gc":
            s.add_argument("--all-letters", action="store_true")
    return p


def region(text: str) -> tuple[str, int, int]:
    chrom, _, span = text.rpartition(":")
    start, end = span.replace(",", "").split("-")
    return chrom, int(start), int(end)


def track_of(spark: SparkSession, m: ContactMap, text: str | None) -> DataFrame | None:
    """The values of a track file at the bins of a map; bad bins have none."""
    return align_track(m.bins, genome.read_track(spark, text)).select("bin_id", "value") if text else None


def cis_expected(spark: SparkSession, m: ContactMap, view: DataFrame, path: str | None) -> DataFrame:
    """A cis expected from a file, checked against map and view, or computed."""
    if not path:
        return expected.expected_cis(m, view)
    e = genome.read_expected(spark, path, ["balanced_avg"])
    pairs = view_pairs(view, "cis").where("region1 = region2")
    require(expected_problems(e, ["region1", "region2", "dist"]), f"expected {path}")
    require(expected_fits_view(e.where("region1 = region2"), expected.diag_table(expected.region_bins(m, view), pairs)), f"expected {path} does not fit the view")
    return e.where("region1 = region2")


def trans_expected(spark: SparkSession, m: ContactMap, view: DataFrame, path: str | None) -> DataFrame:
    """A trans expected from a file, checked against map and view, or computed."""
    if not path:
        return expected.expected_trans(m, view)
    e = genome.read_expected(spark, path, ["balanced_avg"])
    require(expected_fits_trans(e, expected.block_table(expected.region_bins(m, view), view_pairs(view, "trans"))), f"expected {path} does not fit the view")
    return e


def run_genome(spark: SparkSession, a: argparse.Namespace) -> None:
    bed = "chrom string, start long, end long"
    if a.what == "binnify":
        out = genome.binnify(genome.read_table(spark, a.chromsizes, "chrom string, length long", header=False), a.binsize)
    elif a.what == "digest":
        out = genome.digest(genome.read_fasta(spark, a.fasta), *genome.site_of(a.enzyme))
    elif a.what == "gc":
        out = genome.gc(genome.read_table(spark, a.bins, bed), genome.read_fasta(spark, a.fasta), not a.all_letters)
    else:
        bins = genome.read_table(spark, a.bins, bed)
        size = bins.select(F.max(F.col("end") - F.col("start"))).first()[0]
        out = genome.gene_coverage(bins, genome.read_table(spark, a.genes, bed, header=False), size)
    genome.write_table(out, a.output)


def write_tracks(a: argparse.Namespace, m: ContactMap, out: DataFrame) -> None:
    """One bigWig file a track, named after the output."""
    if a.command == "insulation":
        tracks = {c.removeprefix("log2_insulation_score_"): (out, c) for c in out.columns if c.startswith("log2_insulation_score_")}
    elif a.command == "coverage":
        tracks = {"cis": (out, "cov_cis"), "tot": (out, "cov_tot")}
    elif a.command == "virtual4c":
        tracks = {"": (out, "value")}
    else:
        first = out.where("k = 1").select("bin_id", "value").join(m.bins.select("bin_id", "chrom", "start", "end"), "bin_id")
        tracks = {a.command.removeprefix("eigs-"): (first, "value")}
    for name, (rows, column) in tracks.items():
        write_bigwig(rows, m.chromsizes(), ".".join(x for x in (a.output.rstrip("/"), name, "bw") if x), column)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "genome":
        return run_genome(spark, a)
    if a.command == "eigs-trans" and a.view:
        raise ValueError("eigs-trans takes no view")
    m = maps.read_map(spark, a.map)
    view = genome.read_view(spark, a.view, m.chromsizes()) if a.view else maps.chrom_view(m.bins)
    out = None
    if a.command == "expected-cis":
        out = expected.expected_cis(m, view, ignore_diags=a.ignore_diags, smooth=a.smooth, aggregate_smoothed=a.aggregate_smoothed)
    elif a.command == "expected-trans":
        out = expected.expected_trans(m, view)
    elif a.command == "logbin-expected":
        e = genome.read_expected(spark, a.expected, ["count_sum", "balanced_sum"]) if a.expected else expected.expected_cis(m, view)
        out = expected.logbin(e, per_decade=a.bins_per_decade, min_nvalid=a.min_nvalid, min_count=a.min_count)
        if a.table == "slopes":
            out = expected.slopes(out)
        elif a.table == "combined":
            out = expected.combine_binned(out, spread=a.spread)
        elif a.table == "combined-slopes":
            out = expected.combined_slopes(expected.combine_binned(out), expected.slopes(out), spread=a.spread_slopes)
    elif a.command == "insulation":
        windows = [w * m.binsize for w in a.window] if a.window_pixels else a.window
        more = {"min_frac_valid": a.min_frac_valid_pixels, "min_dist_bad_bin": a.min_dist_bad_bin, "append_raw": a.append_raw_scores}
        out = bands.insulation_table(m, view, windows, ignore_diags=a.ignore_diags, **more, threshold=a.threshold if a.threshold in ("Li", "Otsu") else float(a.threshold))
        for w in windows if a.bedgraph else ():
            genome.write_bedgraph(out, f"{a.output}.{w}.bedgraph", f"log2_insulation_score_{w}")
    elif a.command == "directionality":
        out = bands.directionality(m, a.window_bins)
    elif a.command == "coverage":
        out = profiles.coverage(m, weighted=not a.raw, ignore_diags=a.ignore_diags)
        if a.bigwig:
            out = Kept(spark).table(out)
        if a.store:  # the marginals count each contact at both ends; the total within chromosomes is of raw contacts only
            kind = "raw" if a.raw else "weight"
            stored = out.withColumnsRenamed({"cov_cis": f"cov_cis_{kind}", "cov_tot": f"cov_tot_{kind}"})
            total = {"cis": int(out.agg(F.sum("cov_cis")).first()[0] or 0) // 2} if a.raw else {}
            maps.write_map(ContactMap(stored, m.pixels, m.binsize, m.meta | total), a.output)
            if a.bigwig:
                write_tracks(a, m, out)
            return
    elif a.command == "virtual4c":
        out = profiles.virtual4c(m, *region(a.viewpoint))
    elif a.command == "pileup":
        e = cis_expected(spark, m, view, a.expected) if a.by_expected or a.expected else None
        diags = m.meta.get("ignore_diags", 2) if a.ignore_diags is None else a.ignore_diags
        stack = snip.snippets(m, genome.read_features(spark, a.features), view, flank=a.flank, min_diag=diags, expected=e)
        if a.stack:
            stack.write.parquet(a.stack)
            stack = spark.read.parquet(a.stack)
        out = snip.pileup(stack, a.aggregate)
    elif a.command == "eigs-cis":
        out = compartments.eigs_cis(m, view, a.n_eigs, phasing=track_of(spark, m, a.phasing_track), clip_percentile=a.clip_percentile, sort=a.sort_metric)
    elif a.command == "eigs-trans":
        out = compartments.eigs_trans(m, a.n_eigs, phasing=track_of(spark, m, a.phasing_track), sort=a.sort_metric)
    elif a.command == "saddle":
        track = track_of(spark, m, a.track)
        edges = compartments.bin_edges(track, a.n_bins, vrange=a.vrange, qrange=None if a.vrange else a.qrange or (0.0, 1.0))
        classes = track.withColumn("cls", compartments.digitized(F.col("value"), edges))
        if a.contact_type == "trans":
            out = compartments.saddle_trans(m, classes, trans_expected(spark, m, view, a.expected), a.n_bins, trim_outliers=a.trim_outliers)
        else:
            out = compartments.saddle_cis(m, classes, view, cis_expected(spark, m, view, a.expected), a.n_bins, min_diag=a.min_dist, max_diag=a.max_dist, trim_outliers=a.trim_outliers)
        if a.bundle:
            out.write.parquet(f"{a.bundle}/saddle")
            classes.write.parquet(f"{a.bundle}/track")
            spark.createDataFrame(list(enumerate(edges)), "n int, edge double").write.parquet(f"{a.bundle}/edges")
            out = spark.read.parquet(f"{a.bundle}/saddle")
        out = compartments.saddle_strength(out, a.n_bins) if a.strength else out
    elif a.command == "dots":
        out = dots.dots(m, view, cis_expected(spark, m, view, a.expected), arrays.recommend_kernels(m.binsize), band=a.max_distance // m.binsize, fdr=a.fdr, n_lambda_bins=a.n_lambda_bins, radius_bins=a.radius / m.binsize)
    elif a.command == "random-sample":
        maps.write_map(profiles.sample(m, count=a.count, cis_count=a.cis_count, frac=a.frac, exact=a.exact, seed=a.seed), a.output)
    elif a.command == "rearrange":
        maps.write_map(rearrange.rearrange(m, view), a.output)
    elif a.command == "coarsen":
        for k in a.factor:
            maps.write_map(maps.coarser(m, k), f"{a.output}/{m.binsize * k}")
    if getattr(a, "bigwig", False):
        out = Kept(spark).table(out)
        write_tracks(a, m, out)
    if out is not None:
        genome.write_table(out, a.output)


def main(args: list[str] | None = None) -> None:
    run(SparkSession.builder.getOrCreate(), parser().parse_args(args))


if __name__ == "__main__":
    main()
