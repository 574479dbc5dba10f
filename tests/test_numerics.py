"""Routines against plain versions, and commands over a small map on disk."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_maps import dense_map, tiny

from binlattice import cli
from binlattice.functions import arrays
from binlattice.operators import expected, matrix, profiles, signals, snip
from binlattice.schema import expected_fits_trans, is_sorted
from binlattice.sources import genome, maps


def test_kernels_cell_by_cell():
    w, p = 3, 1
    for y in range(-w, w + 1):
        for x in range(-w, w + 1):
            ring = max(abs(x), abs(y)) > p
            want = {
                "donut": ring and x != 0 and y != 0,
                "vertical": ring and abs(x) <= 1,
                "horizontal": ring and abs(y) <= 1,
                "lowleft": ring and x > 0 and y < 0,
                "upright": ring and x < 0 and y > 0,
            }
            for kind, on in want.items():
                assert arrays.kernel(w, p, kind)[y + w, x + w] == on, (kind, y, x)
    assert {k: v.shape[0] for k, v in arrays.recommend_kernels(10000).items()} == dict.fromkeys(("donut", "vertical", "horizontal", "lowleft"), 11)


def test_lower_left_reads_towards_the_diagonal():
    """A convolution with the kernel sums cells of later rows and earlier columns."""
    k = arrays.kernel(2, 1, "lowleft")
    a = np.arange(49.0).reshape(7, 7)
    got = sum(k[dy, dx] * a[3 - (dy - 2), 3 - (dx - 2)] for dy in range(5) for dx in range(5))
    assert got == sum(a[3 + i, 3 - j] for i in (1, 2) for j in (1, 2) if max(i, j) > 1)


def test_quadratic_interpolation():
    rng = np.random.default_rng(3)
    for n in (3, 4, 9):
        x = np.sort(rng.uniform(0, 10, n))
        at = np.linspace(-3, 13, 40)
        f = lambda z: 2 - 3 * z + 0.5 * z * z
        assert np.allclose(arrays.interpolate_quadratic(at, x, f(x)), f(at))
        y = rng.normal(size=n)
        assert np.allclose(arrays.interpolate_quadratic(x, x, y), y)
        inner = ((x[1:] + x[:-1]) / 2)[1:-1]  # one parabola between knots: second differences are constant there
        for lo, hi in zip([x[0], *inner], [*inner, x[-1]], strict=True):
            v = arrays.interpolate_quadratic(np.linspace(lo, hi - 1e-9, 6), x, y)
            assert np.allclose(np.diff(v, 3), 0, atol=1e-6)


@pytest.mark.parametrize("by_region", [True, False, "r"])
def test_interpolate_expected(spark, by_region):
    rows = [("r", "r", d, float(d), 1) for d in range(0, 40)]
    e = spark.createDataFrame(rows, "region1 string, region2 string, dist long, balanced_avg double, n_valid long")
    bins = [(k, lo, hi, 100.0 / ((lo + hi) / 2) ** 1.5, 5.0) for k, (lo, hi) in enumerate([(2, 3), (4, 7), (8, 15), (16, 31)])]
    binned = spark.createDataFrame([("r", "r", *b) for b in bins], "region1 string, region2 string, dist_bin_id int, dist_bin_start long, dist_bin_end long, balanced_avg double, other double")
    got = {r.dist: r for r in expected.interpolate_expected(e, binned if by_region is not False else binned.drop("region1", "region2"), ("balanced_avg", "other"), by_region=by_region).collect()}
    assert len(got) == 40 and got[1].balanced_avg is None and got[0].balanced_avg is None
    for d in range(2, 40):
        assert got[d].balanced_avg == pytest.approx(100.0 / d**1.5) and got[d].other == pytest.approx(5.0)
    small = expected.interpolate_expected(e, binned, kind="linear", extrapolate_small_s=True).where("dist = 1").first()
    assert small.balanced_avg == pytest.approx(100.0)


def test_expected_transforms_and_smoothing(spark):
    m, full = dense_map(spark)
    view = maps.chrom_view(m.bins)
    got = {r.dist: r for r in expected.expected_cis(m, view, smooth=True, aggregate_smoothed=True, transforms={"twice": lambda: F.col("balanced") * 2}).collect()}
    assert got[3].twice_avg == pytest.approx(2 * got[3].balanced_avg)
    assert got[3].balanced_avg_smoothed == pytest.approx(got[3].balanced_avg_smoothed_agg)


def coarse_by_hand(a, c, cutoff, min_shape):
    """The definition, cell by cell, on a grid of a power of two."""
    ok = np.isfinite(a).astype(float)
    levels = [(np.where(ok > 0, a, 0), np.where(ok > 0, c, 0), ok)]
    while len(levels[-1][0]) > min_shape:
        levels.append(tuple(np.array([[x[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].sum() for j in range(len(x) // 2)] for i in range(len(x) // 2)]) for x in levels[-1]))
    up = levels[-1][0]
    for (v, n, k), (_, _, wide) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        out = v.copy()
        for i in range(len(v)):
            for j in range(len(v)):
                four = [(x, y) for x in (i // 2 * 2, i // 2 * 2 + 1) for y in (j // 2 * 2, j // 2 * 2 + 1) if k[x, y]]
                if four and min(n[p] for p in four) < cutoff:
                    out[i, j] = up[i // 2, j // 2] / wide[i // 2, j // 2] * k[i, j]
                if not k[i, j]:
                    out[i, j] = 0
        up = out
    return np.where(ok > 0, up, np.nan)


def test_adaptive_coarsegrain():
    rng = np.random.default_rng(5)
    c = rng.poisson(3, (16, 16)).astype(float)
    a = c * rng.uniform(0.5, 2, (16, 16))
    a[rng.random((16, 16)) < 0.15] = np.nan
    a[:, 4] = np.nan
    for cutoff, least in ((3, 2), (5, 4), (1, 8)):
        assert np.allclose(arrays.adaptive_coarsegrain(a, c, cutoff, 9, least), coarse_by_hand(a, c, cutoff, least), equal_nan=True)
    odd = arrays.adaptive_coarsegrain(a[:11, :11], c[:11, :11], 3, 9, 2)
    assert odd.shape == (11, 11) and (np.isnan(odd) == np.isnan(a[:11, :11])).all()


def test_zoom():
    a = np.random.default_rng(2).normal(size=(7, 5))
    up = arrays.zoom(a, (13, 9))
    assert np.allclose(up[::2, ::2], a) and np.allclose(up[1::2, ::2], (a[1:] + a[:-1]) / 2)
    fine = arrays.zoom(a, (8, 6))
    assert np.allclose(arrays.zoom(a, (4, 3)), fine.reshape(4, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(arrays.zoom(a, (14, 5), same_sum=True), arrays.zoom(a, (14, 5)) / 2)
    assert arrays.zoom(a, (4, 3), zoom_function=lambda x, fine: np.ones(fine)).tolist() == np.ones((4, 3)).tolist()


def test_masked_rows_and_columns_are_interpolated():
    y, x = np.mgrid[:8, :8]
    a = (2.0 * y + 3 * x + 1).copy()
    b = a.copy()
    b[3], b[:, 5] = np.nan, np.nan
    assert np.allclose(arrays.interp_nan_2d(b), a)
    edge = a.copy()
    edge[0] = np.nan
    with pytest.raises(ValueError):
        arrays.interp_nan_2d(edge, pad_zeros=False)
    b[1, 1] = np.nan  # neither in a masked row nor in a masked column
    with pytest.raises(ValueError):
        arrays.interp_nan_2d(b)


def test_prominence_with_gaps_and_reach():
    v = np.array([1, 3, np.nan, 2, 5, 1, 4, 0, 6, 2.0])
    assert arrays.prominence(v).tolist() == [0, 1, 0, 0, 5 - 0, 0, 3, 0, 6, 0]
    assert arrays.prominence(v, 2)[4] == 3 and arrays.prominence(np.array([np.nan, 1.0])).tolist() == [0, 0]


def test_poisson_tail():
    for lam in (0.5, 3.0, 900.0):
        k = np.array([0, 1, 5, 40, 850, 900, 1000, 10**7])
        top = arrays.poisson_sf(lam, 1000)
        got = arrays.poisson_sf_at(lam, k)
        assert np.allclose(got[:-1], top[k[:-1]], atol=1e-9) and got[-1] == 0


def test_newton_scaling_and_distributed_balancing(spark):
    rng = np.random.default_rng(1)
    a = np.triu(rng.uniform(0, 5, (40, 40)) * (rng.random((40, 40)) < 0.6))
    np.fill_diagonal(a, 1 + a.diagonal())
    full = a + np.triu(a, 1).T
    x, residual = arrays.newton_scaling(lambda v: full @ v, 40, 1e-9)
    assert residual < 1e-9 and np.allclose(x * (full @ x), 1)
    m, _ = dense_map(spark, 10, bad=())
    w, residual = matrix.knight_ruiz(m)
    x = np.array([r.weight for r in w.orderBy("bin_id").collect()])
    d = np.zeros((10, 10))
    for r in m.pixels.collect():
        d[r.bin1_id, r.bin2_id] = d[r.bin2_id, r.bin1_id] = r["count"]
    assert residual < 1e-6 and np.allclose(x * (d @ x), 1, atol=1e-5)


def test_rectangles_are_balanced(spark):
    a = np.random.default_rng(4).uniform(1, 2, (4, 6))
    cells = spark.createDataFrame([("r", i, j, float(a[i, j])) for i in range(4) for j in range(6)], "region string, i long, j long, value double")
    out = matrix.balance_rectangle(cells).toPandas()
    b = out.pivot(index="i", columns="j", values="value").to_numpy()
    assert out.converged.all() and np.ptp(b.sum(axis=1)) < 0.05 and np.ptp(b.sum(axis=0)) < 0.05


def test_exact_samples_narrow_down(spark, monkeypatch):
    m, _ = dense_map(spark, 20)
    every = m.pixels.select("bin1_id", "bin2_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("k")).withColumn("h", profiles.contact_hash()(F.col("k"))).toPandas()
    order = every.sort_values(["h", "bin1_id", "bin2_id", "k"])
    monkeypatch.setattr(profiles, "FEW", 3)
    for n in (0, 1, 57, len(order), len(order) + 9):
        want = order.head(n).groupby(["bin1_id", "bin2_id"]).size().to_dict()
        assert {(r.bin1_id, r.bin2_id): r["count"] for r in profiles.sample_exact(m.pixels, n).collect()} == want
    monkeypatch.setattr(profiles, "CHUNK", 2)
    cut = round(0.3 * profiles.HASH_RANGE)
    want = every[every.h < cut].groupby(["bin1_id", "bin2_id"]).size().to_dict()
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in profiles.sample_approx(m.pixels, 0.3).collect()} == want


def test_exact_samples_take_one_pass_unless_hashes_are_uneven(spark, monkeypatch):
    m, _ = dense_map(spark, 30)
    total = m.pixels.agg(F.sum("count")).first()[0]
    made = []
    narrowed = profiles._narrowed
    monkeypatch.setattr(profiles, "_narrowed", lambda *a: made.append(1) or narrowed(*a))
    monkeypatch.setattr(profiles, "CONTACTS_A_TASK", 50)
    for key, passes in ((None, 0), (lambda k: F.xxhash64("bin1_id", "bin2_id", k).bitwiseAND(1023), 1)):
        made.clear()
        own = key or profiles.contact_hash()
        every = m.pixels.select("bin1_id", "bin2_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("k")).withColumn("h", own(F.col("k"))).toPandas()
        want = every.sort_values(["h", "bin1_id", "bin2_id", "k"]).head(total // 2).groupby(["bin1_id", "bin2_id"]).size().to_dict()
        assert {(r.bin1_id, r.bin2_id): r["count"] for r in profiles.sample_exact(m.pixels, total // 2, key=key).collect()} == want
        assert len(made) == passes


def test_pairs_of_a_group_are_counted_by_bin(spark):
    rows = [("u", b) for b in (1, 1, 1, 2, 5)] + [("v", 7)]
    got = {(r.bin1_id, r.bin2_id): r["count"] for r in maps.pixels_of(spark.createDataFrame(rows, "g string, b long"), "g", "b").collect()}
    assert got == {(1, 1): 3, (1, 2): 3, (1, 5): 3, (2, 5): 1}


def test_sortedness_over_buckets(spark, monkeypatch):
    from binlattice import schema

    monkeypatch.setattr(schema, "SORT_BUCKET", 2)
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 3), (4, 9)], "n long, v int")
    assert is_sorted(df, ["v"], "n").count() == 0
    assert [r.n for r in is_sorted(df.replace(3, 0, "v"), ["v"], "n").collect()] == [2]


def test_snippets_of_another_value(spark):
    m, _ = dense_map(spark)
    f = spark.createDataFrame([(0, "chr1", 5, 6)], "snip_id long, chrom string, start long, end long")
    got = snip.snippets(m, f, maps.chrom_view(m.bins), flank=1, min_diag=None, value=lambda: F.coalesce(F.col("count"), F.lit(0)).cast("double")).collect()
    want = {(r.bin1_id, r.bin2_id): r["count"] for r in m.pixels.collect()}
    assert {(r.i, r.j): r.value for r in got} == {(i, j): float(want.get((min(4 + i, 4 + j), max(4 + i, 4 + j)), 0)) for i in range(3) for j in range(3)}


def test_filled_gaps(spark):
    y, x = np.mgrid[:6, :6]
    a = (y + x + 1.0).copy()
    a[2], a[:, 2] = np.nan, np.nan
    cells = spark.createDataFrame(pd.DataFrame({"region": "r", "i": y.ravel(), "j": x.ravel(), "value": a.ravel()}))
    got = signals.filled_gaps(cells).toPandas()
    assert np.allclose(got.value, got.i + got.j + 1)


def write(path, text):
    path.write_text(text)
    return str(path)


def run(spark, *args):
    cli.run(spark, cli.parser().parse_args([*map(str, args)]))


def test_views_are_checked_and_numbered_in_file_order(spark, tmp_path):
    m, _ = dense_map(spark, 12)
    good = write(tmp_path / "v.bed", "".join(f"chr1\t{k}\t{k + 1}\tr{k}\n" for k in range(12)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        view = genome.read_view(spark, good, m.chromsizes()).orderBy("region_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.name, r.region_idx) for r in view] == [(f"r{k}", k) for k in range(12)]
    with pytest.raises(ValueError, match="out of bounds"):
        genome.read_view(spark, write(tmp_path / "w.bed", "chr1\t0\t99\tr\n"), m.chromsizes())


def test_commands_over_a_map(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 24
    px = [(i, j, int(rng.integers(1, 9))) for i in range(n) for j in range(i, n) if rng.random() < 0.8]
    m = tiny(spark, [None if i == 5 else 0.5 for i in range(n)], px, ["chr1"] * 14 + ["chrX"] * 10)
    bins = m.bins.withColumn("start", F.when(F.col("chrom") == "chrX", F.col("start") - 14).otherwise(F.col("start"))).withColumn("end", F.col("start") + 1)
    d = str(tmp_path / "m")
    maps.write_map(type(m)(bins, m.pixels, 1, {}), d)
    track = write(tmp_path / "t.bedgraph", "".join(f"{c}\t{k}\t{k + 1}\t{(k * 7) % 5}.5\n" for c, top in (("chr1", 14), ("chrX", 10)) for k in range(top)))
    out = lambda name: str(tmp_path / name)
    read = lambda name: spark.read.csv(out(name), sep="\t", header=True)
    run(spark, "expected-cis", d, "-o", out("cis"))
    run(spark, "expected-trans", d, "-o", out("trans"))
    assert read("cis").count() == 24 and read("trans").count() == 1
    for kind, e in (("cis", "cis"), ("trans", "trans")):
        run(spark, "saddle", d, "-o", out(f"s_{kind}"), "--track", track, "--n-bins", 3, "--contact-type", kind, "--vrange", 0, 5, "--expected", out(e), "--bundle", out(f"b_{kind}"))
        run(spark, "saddle", d, "-o", out(f"c_{kind}"), "--track", track, "--n-bins", 3, "--contact-type", kind, "--vrange", 0, 5)
        assert sorted(map(str, read(f"s_{kind}").select("ci", "cj", "c").collect())) == sorted(map(str, read(f"c_{kind}").select("ci", "cj", "c").collect()))
        assert spark.read.parquet(out(f"b_{kind}/edges")).count() == 4
    with pytest.raises(ValueError, match="fit"):
        short = write(tmp_path / "short.tsv", "region1\tregion2\tdist\tn_valid\tbalanced_avg\nchr1\tchr1\t3\t5\t1.0\n")
        run(spark, "saddle", d, "-o", out("no"), "--track", track, "--n-bins", 3, "--expected", short)
    features = write(tmp_path / "f.bed", "chr1\t6\t7\nchr1\t9\t10\n")
    run(spark, "pileup", d, "-o", out("pile"), "--features", features, "--flank", 2, "--expected", out("cis"), "--stack", out("stack"))
    assert read("pile").count() == 25 and spark.read.parquet(out("stack")).select("snip_id").distinct().count() == 2
    run(spark, "coverage", d, "-o", out("covered"), "--store")
    stored = maps.read_map(spark, out("covered"))
    assert "cov_tot_weight" in stored.bins.columns and "cis" not in stored.meta
    run(spark, "coverage", d, "-o", out("counted"), "--store", "--raw")
    stored = maps.read_map(spark, out("counted"))
    assert "cov_tot_raw" in stored.bins.columns and stored.meta["cis"] == sum(k for i, j, k in px if (i < 14) == (j < 14))
    run(spark, "coarsen", d, "-o", out("levels"), "--factor", 2, 4)
    two, four = (maps.read_map(spark, out(f"levels/{k}")) for k in (2, 4))
    assert two.bins.count() == 12 and four.bins.count() == 7 and four.binsize == 4
    total = m.pixels.agg(F.sum("count")).first()[0]
    assert two.pixels.agg(F.sum("count")).first()[0] == four.pixels.agg(F.sum("count")).first()[0] == total
    run(spark, "insulation", d, "-o", out("ins"), "--window", 3, "--bedgraph", "--threshold", "Li")
    assert spark.read.csv(out("ins.3.bedgraph"), sep="\t").count() > 0 and read("ins").count() == 24
    json.dumps(stored.meta)


def test_trans_expected_must_fit(spark):
    need = spark.createDataFrame([("a", "b", 6), ("a", "c", 4)], "region1 string, region2 string, n_valid long")
    assert expected_fits_trans(need, need).count() == 0
    assert expected_fits_trans(need.where("region2 = 'b'"), need).count() == 1
    assert expected_fits_trans(need.union(need.limit(1)), need).count() == 1
