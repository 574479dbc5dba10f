"""Commands that no other test runs, over one small map, and small operators without a query."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binlattice import cli
from binlattice.functions import arrays
from binlattice.operators import bands, compartments, expected, profiles, snip
from binlattice.schema import ContactMap, uncatalogued
from binlattice.sources import bigwig, maps

BIN = 20000


@pytest.fixture(scope="module")
def contacts(spark, tmp_path_factory):
    """A map of two chromosomes with one bright spot, its folder and its contacts."""
    rng = np.random.default_rng(12)
    sizes = (40, 26)
    n = sum(sizes)
    chrom = np.repeat(["c1", "c2"], sizes)
    start = np.concatenate([np.arange(k) for k in sizes]) * BIN
    i, j = np.triu_indices(n)
    mean = np.where(chrom[i] == chrom[j], 60.0 / (1 + j - i), 1.0)
    count = rng.poisson(mean)
    count[(abs(i - 10) <= 1) & (abs(j - 24) <= 1)] += 40
    rows = [(k, str(chrom[k]), int(chrom[k] == "c2"), int(start[k]), int(start[k]) + BIN, None if k == 33 else 1.0) for k in range(n)]
    bins = spark.createDataFrame(rows, "bin_id long, chrom string, chrom_idx int, start long, end long, weight double").coalesce(1)
    keep = count > 0
    px = spark.createDataFrame(pd.DataFrame({"bin1_id": i[keep], "bin2_id": j[keep], "count": count[keep]})).coalesce(1)
    folder = str(tmp_path_factory.mktemp("maps") / "m")
    m = ContactMap(bins, px, BIN, {"ignore_diags": 3})
    maps.write_map(m, folder)
    return maps.read_map(spark, folder), folder, dict(zip(zip(i[keep].tolist(), j[keep].tolist()), count[keep].tolist()))


def command(spark, *args):
    cli.run(spark, cli.parser().parse_args([str(a) for a in args]))


def table(spark, path):
    return spark.read.csv(str(path), sep="\t", header=True, inferSchema=True, nullValue="nan").toPandas()


def test_dots_command_finds_the_spot(spark, contacts, tmp_path):
    command(spark, "dots", contacts[1], "-o", tmp_path / "dots", "--max-distance", 20 * BIN, "--fdr", 0.1, "--radius", 2 * BIN)
    got = table(spark, tmp_path / "dots").sort_values("count").iloc[-1]  # others may be false discoveries
    assert 9 <= got.bin1_id <= 11 and 23 <= got.bin2_id <= 25 and got.c_size >= 4
    assert abs(got.c_bin1 - 10) < 1 and abs(got.c_bin2 - 24) < 1


def test_eigenvector_commands(spark, contacts, tmp_path):
    m, folder, _ = contacts
    command(spark, "eigs-cis", folder, "-o", tmp_path / "cis", "--n-eigs", 2)
    got = table(spark, tmp_path / "cis")
    assert len(got) == 2 * 66 and got.value.isna().sum() == 2 and set(got.region) == {"c1", "c2"}
    command(spark, "eigs-trans", folder, "-o", tmp_path / "trans", "--n-eigs", 1)
    got = table(spark, tmp_path / "trans")
    assert len(got) == 66 and (got.value.dropna() ** 2).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        command(spark, "eigs-trans", folder, "-o", tmp_path / "no", "--view", "v")


def test_sampling_virtual4c_and_rearranging_commands(spark, contacts, tmp_path):
    m, folder, counts = contacts
    total = sum(counts.values())
    command(spark, "random-sample", folder, "-o", tmp_path / "half", "--frac", 0.5, "--exact")
    assert maps.read_map(spark, str(tmp_path / "half")).pixels.agg(F.sum("count")).first()[0] == round(total / 2)
    command(spark, "random-sample", folder, "-o", tmp_path / "some", "--count", 500)
    assert 350 < maps.read_map(spark, str(tmp_path / "some")).pixels.agg(F.sum("count")).first()[0] < 650
    command(spark, "virtual4c", folder, "-o", tmp_path / "v4c", "--viewpoint", f"c1:{5 * BIN}-{6 * BIN}")
    got = table(spark, tmp_path / "v4c").sort_values("bin_id").value
    assert len(got) == 66 and np.isnan(got.iloc[5]) and got.iloc[7] == counts[5, 7] and got.iloc[2] == counts[2, 5]
    view = tmp_path / "view.bed"
    view.write_text(f"c2\t0\t{26 * BIN}\tc2\nc1\t0\t{40 * BIN}\tc1\n")
    command(spark, "rearrange", folder, "-o", tmp_path / "turned", "--view", view)
    turned = maps.read_map(spark, str(tmp_path / "turned"))
    assert turned.bins.orderBy("bin_id").first().chrom == "c2" and turned.pixels.agg(F.sum("count")).first()[0] == total


def test_logbin_command_reads_an_expected(spark, contacts, tmp_path):
    folder = contacts[1]
    command(spark, "expected-cis", folder, "-o", tmp_path / "e")
    for kind in ("slopes", "combined-slopes"):
        for more in ((), ("--expected", tmp_path / "e")):
            command(spark, "logbin-expected", folder, "-o", tmp_path / f"{kind}{len(more)}", "--table", kind, "--min-nvalid", 5, "--min-count", 1, *more)
        a, b = (table(spark, tmp_path / f"{kind}{k}").sort_values("dist_bin_id").reset_index(drop=True) for k in (0, 2))
        keys = [c for c in ("region1", "dist_bin_id") if c in a]
        a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
        assert len(a) > 5 and list(a) == list(b)
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-6)


def test_pileups_ignore_as_many_diagonals_as_the_map(spark, contacts, tmp_path):
    features = tmp_path / "f.bed"
    features.write_text(f"c1\t{20 * BIN}\t{21 * BIN}\n")
    for name, args, nearest in (("own", (), 3), ("one", ("--ignore-diags", 1), 1)):
        command(spark, "pileup", contacts[1], "-o", tmp_path / name, "--features", features, "--flank", 4 * BIN, *args)
        got = table(spark, tmp_path / name)
        assert abs(got.i - got.j)[got.value.notna()].min() == nearest


def test_slopes_are_smoothed_like_this(spark):
    rng = np.random.default_rng(2)
    n = 30
    pdf = pd.DataFrame({"region1": "r", "region2": "r", "dist_bin_id": np.arange(n) + (np.arange(n) > 12), "n_valid": rng.integers(1, 99, n), "dist_avg": 2.0 ** np.arange(n), "balanced_avg": np.exp(rng.standard_normal(n))})

    def smooth(x, sigma):
        w = np.exp(-((np.arange(n)[:, None] - np.arange(n)) ** 2) / (2 * sigma**2)) * (abs(np.arange(n)[:, None] - np.arange(n)) <= int(4 * sigma + 0.5))
        return w @ x / w.sum(axis=1)

    for sigma, made in ((2.0, expected.slopes), (1.3, lambda df: expected.combined_slopes(df.drop("region1", "region2")))):
        got = made(spark.createDataFrame(pdf)).toPandas().sort_values("dist_bin_id")
        x, y = (smooth(np.log(pdf[c].to_numpy()), sigma) for c in ("dist_avg", "balanced_avg"))
        assert got.slope.to_numpy() == pytest.approx(np.diff(y) / np.diff(x)) and got.n_valid.tolist() == np.minimum(pdf.n_valid[1:].to_numpy(), pdf.n_valid[:-1].to_numpy()).tolist()
    twice = expected.slopes(spark.createDataFrame(pdf), smooth=lambda v: 2 * v).toPandas().sort_values("dist_bin_id").slope
    assert twice.to_numpy() == pytest.approx(np.diff(np.log(pdf.balanced_avg)) / np.diff(np.log(pdf.dist_avg)))


def test_combined_spread_may_be_made(spark, contacts):
    m = contacts[0]
    binned = expected.logbin(expected.expected_cis(m, maps.chrom_view(m.bins)), min_nvalid=5, min_count=1)
    got = expected.combine_binned(binned, spread=lambda v, w: F.max(v) - F.min(v)).toPandas()
    want = binned.toPandas().groupby("dist_bin_id").balanced_avg.agg(lambda v: v.max() - v.min())
    assert got.set_index("dist_bin_id").spread.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy())


def test_thresholds_of_equal_strengths(spark):
    assert arrays.li_threshold(np.array([1.0, 1.0])) == 1 and arrays.otsu_threshold(np.array([0.5])) == 0.5
    for values in ((0.3,), (0.3, 0.3), ()):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None])], "bin_id long, boundary_strength double")
        for how in ("Li", "Otsu"):
            assert [r.is_boundary for r in bands.call_boundaries(rows, how).orderBy("bin_id").collect()] == [True] * len(values) + [False]


def test_small_operators(spark, contacts):
    m = contacts[0]
    view = maps.view_from_track(m.bins.where("start > 0")).orderBy("chrom").collect()
    assert [(r.chrom, r.start, r.end, r["name"]) for r in view] == [("c1", BIN, 40 * BIN, "c1"), ("c2", BIN, 26 * BIN, "c2")]
    assert [r.bin_id for r in maps.bins_in(m.bins, "c2", 10, BIN + 1).orderBy("bin_id").collect()] == [40, 41]
    names = [(r["name"], r.start, r.end) for r in maps.halves(m.bins).orderBy("region_idx").collect()]
    assert names == [("c1_p", 0, 20 * BIN), ("c1_q", 20 * BIN, 40 * BIN), ("c2_p", 0, 13 * BIN), ("c2_q", 13 * BIN, 26 * BIN)]


def test_snippets_of_the_expected_alone(spark, contacts):
    m = contacts[0]
    view = maps.chrom_view(m.bins)
    e = expected.expected_cis(m, view)
    by_dist = {r.dist: r.balanced_avg for r in e.where("region1 = 'c1'").collect()}
    features = spark.createDataFrame([(1, "c1", 20 * BIN, 21 * BIN)], "snip_id long, chrom string, start long, end long")
    got = snip.snippets(m, features, view, flank=2 * BIN, expected=e, only_expected=True).collect()
    assert len(got) == 25
    for r in got:
        assert r.value == (pytest.approx(by_dist[abs(r.i - r.j)]) if abs(r.i - r.j) >= 2 else None)


def test_saddles_may_be_trimmed(spark, contacts):
    m = contacts[0]
    view = maps.chrom_view(m.bins)
    track = m.bins.select("bin_id", F.when(F.col("weight").isNotNull(), F.col("bin_id") % 6).cast("int").alias("cls"))
    whole, trimmed = (compartments.saddle_cis(m, track, view, expected.expected_cis(m, view), 4, trim_outliers=t).toPandas() for t in (False, True))
    assert set(whole.ci) == set(range(6)) and set(trimmed.ci) == set(trimmed.cj) == {1, 2, 3, 4}
    inner = whole[whole.ci.between(1, 4) & whole.cj.between(1, 4)].sort_values(["ci", "cj"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(inner, trimmed.sort_values(["ci", "cj"]).reset_index(drop=True))


def test_uncatalogued_regions(spark, contacts):
    m = contacts[0]
    e = spark.createDataFrame([("c1", "c1"), ("c1", "c3")], "region1 string, region2 string")
    assert [r["name"] for r in uncatalogued(e, maps.chrom_view(m.bins)).collect()] == ["c2"]
    assert profiles.coverage(m).count() == 66


def test_tracks_as_bigwig(spark, contacts, tmp_path):
    """Each command's files hold the finite values of its table."""
    m, folder, _ = contacts
    shown = lambda t, c: sorted((r.chrom, r.start, r.end, float(np.float32(getattr(r, c)))) for r in t.itertuples() if np.isfinite(getattr(r, c)))
    held = lambda name: sorted(tuple(r) for r in bigwig.read_bigwig(spark, f"{tmp_path}/{name}.bw").collect())
    command(spark, "insulation", folder, "-o", tmp_path / "ins", "--window", 3 * BIN, "--bigwig")
    want = shown(table(spark, tmp_path / "ins"), f"log2_insulation_score_{3 * BIN}")
    assert held(f"ins.{3 * BIN}") == want and len(want) > 40
    command(spark, "coverage", folder, "-o", tmp_path / "cov", "--raw", "--bigwig")
    got = table(spark, tmp_path / "cov")
    assert held("cov.cis") == shown(got, "cov_cis") and held("cov.tot") == shown(got, "cov_tot")
    command(spark, "virtual4c", folder, "-o", tmp_path / "v4c", "--viewpoint", f"c1:{5 * BIN}-{8 * BIN}", "--bigwig")
    assert held("v4c") == shown(table(spark, tmp_path / "v4c"), "value")
    command(spark, "eigs-cis", folder, "-o", tmp_path / "eig", "--n-eigs", 1, "--bigwig")
    got = table(spark, tmp_path / "eig")
    bins = m.bins.select("bin_id", "chrom", "start", "end").toPandas()
    assert held("eig.cis") == shown(got[["bin_id", "value"]].merge(bins, on="bin_id"), "value")
