"""Operators that work in parts, against dense versions on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binlattice.functions import arrays, clustering, draws
from binlattice.operators import compartments, dots, eigen, peaks, profiles, quantiles, signals
from binlattice.schema import ContactMap
from binlattice.sources import maps


def small_map(spark, seed=0, chroms=(14, 11), density=0.8, bad=(3,)):
    """Bins of some chromosomes with random contacts; returns the map and its dense balanced matrix (NaN in bad bins)."""
    rng = np.random.default_rng(seed)
    n = sum(chroms)
    chrom = np.repeat([f"c{k}" for k in range(len(chroms))], chroms)
    start = np.concatenate([np.arange(k) for k in chroms]) * 10
    weight = rng.uniform(0.5, 1.5, n)
    weight[list(bad)] = np.nan
    counts = np.triu(rng.poisson(4, (n, n)) + 1) * (np.triu(rng.random((n, n))) < density)
    counts[:, n - 1] = counts[n - 1] = 0
    rows = [(i, str(chrom[i]), int(chrom[i][1:]), int(start[i]), int(start[i]) + 10, None if np.isnan(weight[i]) else float(weight[i])) for i in range(n)]
    bins = spark.createDataFrame(rows, "bin_id long, chrom string, chrom_idx int, start long, end long, weight double").coalesce(1)
    i, j = np.nonzero(np.triu(counts))
    px = spark.createDataFrame(pd.DataFrame({"bin1_id": i, "bin2_id": j, "count": counts[i, j]})).coalesce(2)
    dense = counts + np.triu(counts, 1).T
    return ContactMap(bins, px, 10), dense * weight[:, None] * weight[None, :], chrom


@pytest.mark.parametrize("held", [1, 7, 1 << 14])
def test_quantiles_are_exact(spark, held):
    rng = np.random.default_rng(4)
    groups = {"a": rng.lognormal(0, 30, 300), "b": rng.integers(0, 3, 200).astype(float), "c": np.array([5.0]), "d": np.r_[np.zeros(150), rng.normal(0, 1e-300, 150), 1e300]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r.g: r.q for r in quantiles.exact_quantiles(df, ["g"], "x", probs, held=held).collect()}
    assert set(got) == set("abcd")
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, probs), rel=1e-12, abs=1e-310)


def test_quantiles_of_weighted_values(spark):
    values = spark.createDataFrame([("a", float(v), v + 1) for v in range(50)], "g string, v double, n long")
    flat = np.repeat(np.arange(50), np.arange(50) + 1)
    wanted = spark.createDataFrame([("a", r) for r in (0, 1, 2, 3, 700, len(flat) - 1, len(flat))], "g string, r long")
    assert {r.r: r.v for r in quantiles.at_ranks(values, ["g"], wanted, held=4, cuts=4).collect()} == {r: flat[r] for r in (0, 1, 2, 3, 700, len(flat) - 1)}
    assert quantiles.exact_quantiles(values.where("v < 0"), [], "v", [0.5]).collect() == []


def iterate(m, n, block, basis, steps=200, tol=1e-9):
    """The iteration of eigen.leading on a dense matrix."""
    v, w, s = np.zeros((len(m), 0)), np.random.default_rng(1).uniform(-1, 1, (len(m), block)), eigen.Small(len(m))
    for _ in range(steps):
        width = v.shape[1]
        left, right = np.hstack([v, w, np.ones((len(m), 1))]), np.hstack([v[:, width - block :] if width else np.zeros((len(m), block)), w])
        s.step(left.T @ right, width, block, n, tol, width + block <= basis)
        if s.done:
            return s.values, v @ s.mix
        v = np.hstack([v @ s.turn, (w - v @ s.take) @ s.scale])
        w = m @ v[:, -block:]


@pytest.mark.parametrize(("size", "block", "basis"), [(150, 8, 500), (150, 8, 40), (9, 8, 40), (3, 4, 16), (60, 4, 16)])
def test_lanczos_steps(size, block, basis):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    a = a + a.T
    want = np.linalg.eigvalsh(a)
    want = want[np.argsort(-np.abs(want))][:3]
    values, vectors = iterate(a, 3, block, basis)
    assert values == pytest.approx(want, rel=1e-9)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-6 and np.linalg.norm(vectors, axis=0) == pytest.approx(1)
    low = rng.standard_normal((size, 1))
    values, vectors = iterate(low @ low.T, 1, block, basis)  # the space runs out at once
    assert values[0] == pytest.approx(float((low**2).sum())) and np.abs(vectors[:, 0]) == pytest.approx(np.abs(low[:, 0]) / np.linalg.norm(low))


def test_cis_eigenvectors_are_those_of_the_dense_matrix(spark):
    m, dense, chrom = small_map(spark)
    view = maps.chrom_view(m.bins)
    got = compartments.eigs_cis(m, view, 2, clip_percentile=90.0, phasing=m.bins.select("bin_id", (F.col("bin_id") % 5).alias("value"))).toPandas()
    for c in ("c0", "c1"):
        at = np.flatnonzero(chrom == c)
        values, vectors = arrays.cis_eig(dense[np.ix_(at, at)], 2, 2, 90.0)
        values, vectors = arrays.phase(values, vectors, (at % 5).astype(float))
        for k in (1, 2):
            mine = got[(got.region == c) & (got.k == k)].sort_values("bin_id")
            assert mine.eigval.dropna().unique() == pytest.approx([values[k - 1]], rel=1e-9) and mine.bin_id.tolist() == at.tolist()
            assert mine.value.to_numpy() == pytest.approx(vectors[k - 1], abs=1e-7, nan_ok=True)


def test_phasing_metrics(spark):
    rng = np.random.default_rng(8)
    n = 12
    x, y = rng.standard_normal((2, n)).round(1), rng.standard_normal(n).round(1)
    rows = [("r", i, k + 1, float(k), None if i == 2 else float(x[k, i])) for k in range(2) for i in range(n)]
    long = spark.createDataFrame(rows, "key string, bin_id long, k int, eigval double, value double")
    track = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "bin_id long, value double")
    holed = np.where(np.arange(n) == 2, np.nan, x)
    for sort in (None, "spearmanr", "pearsonr", "var_explained", "MAD_explained"):
        values, vectors = arrays.phase(np.array([0.0, 1.0]), holed, y, sort)
        got = compartments.phased(long, track, sort).toPandas().sort_values(["k", "bin_id"])
        assert got.value.to_numpy().reshape(2, n) == pytest.approx(vectors, nan_ok=True) and got.eigval.to_numpy().reshape(2, n)[:, 0].tolist() == values.tolist()


def test_trans_operator_is_balanced(spark):
    m, dense, chrom = small_map(spark, 2, density=1.0)
    entries, members = compartments.trans_operator(m, perc_bottom=0.0)
    e, ids = entries.toPandas(), np.sort(members.toPandas().bin_id.to_numpy())
    assert 3 not in ids and len(chrom) - 1 not in ids and len(ids) == len(chrom) - 2
    at = pd.Series(range(len(ids)), index=ids)
    a = np.zeros((len(ids),) * 2)
    a[at[e.i], at[e.j]] = a[at[e.j], at[e.i]] = e.s
    assert a.mean() == pytest.approx(1) and a.sum(axis=1) == pytest.approx(len(ids), rel=1e-4)
    raw = dense[np.ix_(ids, ids)]
    cis = chrom[ids][:, None] == chrom[ids][None, :]
    clip = np.percentile(np.nan_to_num(dense)[chrom[:, None] != chrom[None, :]], 99.95)
    scale = a / np.minimum(raw, clip)  # of trans cells: one factor a row and column
    row = scale[np.ix_(chrom[ids] == "c0", chrom[ids] == "c1")]
    assert row == pytest.approx(row[:, :1] @ row[:1] / row[0, 0]) and (a[cis] > 0).all()


def test_rank_deficient_and_tiny_regions(spark):
    entries = spark.createDataFrame([("a", 0, 0, 3.0), ("a", 1, 1, 3.0), ("b", 5, 5, 1.0)], "key string, i long, j long, s double")
    members = spark.createDataFrame([("a", 0), ("a", 1), ("b", 5)], "key string, bin_id long")
    values, vectors = eigen.leading(entries, members, 2)
    assert values["a"] == pytest.approx([3, 1]) and len(values["b"]) <= 1 and vectors.count() == 3


def test_summed_areas_give_convolutions():
    rng = np.random.default_rng(3)
    a = rng.random((20, 17))
    kernels = [rng.integers(0, 4, (5, 5)), *arrays.recommend_kernels(10000).values()]
    for k in kernels:
        w = len(k)
        want = [[(a[i : i + w, j : j + w] * k[::-1, ::-1]).sum() for j in range(17 - w + 1)] for i in range(20 - w + 1)]
        assert dots.convolved(dots.summed(a), k) == pytest.approx(np.array(want))
    assert len(dots.corners(kernels[1])) <= 36 and len(dots.corners(kernels[2])) <= 8


def scores_by_hand(m, dense, chrom, e, kernels, band, max_nans):
    """Cell by cell: (bin1, bin2, kernel) to la_exp."""
    counts = {(r.bin1_id, r.bin2_id): r["count"] for r in m.pixels.collect()}
    w = {r.bin_id: r.weight for r in m.bins.collect()}
    half, out = len(next(iter(kernels.values()))) // 2, {}
    n = len(chrom)
    def cell(i, j):
        if not (0 <= i <= j < n) or chrom[i] != chrom[j] or j - i > band + 2 * half or w[i] is None or w[j] is None or e.get((chrom[i], j - i)) is None:
            return None
        return counts.get((i, j), 0) * w[i] * w[j], e[chrom[i], j - i]
    for i in range(n):
        for j in range(i + 1, n):
            if chrom[i] != chrom[j] or j - i >= band:
                continue
            met = {(dy, dx): cell(i - dy, j - dx) for dy in range(-half, half + 1) for dx in range(-half, half + 1)}
            if sum(c is None for c in met.values()) >= max_nans:
                continue
            found = {}
            for name, k in kernels.items():
                o, x = (sum(c[v] * k[dy + half, dx + half] for (dy, dx), c in met.items() if c) for v in (0, 1))
                la = e[chrom[i], j - i] / (w[i] * w[j]) if w[i] and w[j] and e.get((chrom[i], j - i)) is not None else 0.0
                found[name] = la * o / x if x else None
            if all(v is not None for v in found.values()):
                out |= {(i, j, name): (v, counts.get((i, j), 0)) for name, v in found.items()}
    return out


@pytest.mark.parametrize(("tile", "max_nans"), [(4, 1), (7, 2), (64, 1)])
def test_dot_scores_in_tiles(spark, tile, max_nans):
    m, dense, chrom = small_map(spark, 5, chroms=(22, 15), density=0.7, bad=(9,))
    view = maps.chrom_view(m.bins)
    rng = np.random.default_rng(6)
    e = {(c, d): float(rng.uniform(1, 3)) for c in ("c0", "c1") for d in range(2, 22)}
    table = spark.createDataFrame([(c, c, d, v) for (c, d), v in e.items()], "region1 string, region2 string, dist long, balanced_avg double")
    kernels = {"k": np.array([[1, 2, 0], [0, 0, 3], [1, 0, 1]]), "l": np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]])}
    got = dots.scores(m, view, table, kernels, band=8, max_nans=max_nans, tile=tile).collect()
    want = scores_by_hand(m, dense, chrom, e, kernels, 8, max_nans)
    assert len(got) == len(want) > 50
    for r in got:
        assert (r.la_exp, r["count"]) == pytest.approx(want[r.bin1_id, r.bin2_id, r.kernel]) and r.region == chrom[r.bin1_id]


@pytest.mark.parametrize("branching", [2, 3, 50])
def test_feature_trees(branching):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (9, 1), (3, 12), (1e6, 1e6))])[rng.permutation(160)]
    of, tree = clustering.inserted(np.ones(160), points, (points**2).sum(axis=1), 1.0, branching)
    n, total, square = tree.clusters()
    assert n.tolist() == np.bincount(of).tolist() and n.sum() == 160
    for c in range(tree.count):
        own = points[of == c]
        assert total[c] / n[c] == pytest.approx(own.mean(axis=0)) and ((own - own.mean(axis=0)) ** 2).sum(axis=1).mean() <= 1 + 1e-6
    depths, rest = set(), [(tree.root, 0)]
    while rest:
        node, d = rest.pop()
        assert node.used <= branching
        depths |= {d} if node.leaf else set()
        rest += [] if node.leaf else [(x, d + 1) for x in node.below]
    assert len(depths) == 1 and (branching > 3 or max(depths) > 0)
    if branching == 50:
        assert tree.count == 4
        again, merged = clustering.inserted(n, total, square, 1.0, branching)  # merged trees keep what is apart
        assert merged.count == 4 and sorted(merged.clusters()[0]) == [40] * 4


@pytest.mark.parametrize("tile", [16, 4096])
def test_clusters_meet_over_borders(spark, tile):
    centres = [(8, 24), (16, 16), (16, 40), (32, 48), (40, 56), (23, 32), (5, 100)]
    rows = [(x + dx, y + dy) for x, y in centres for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    df = spark.createDataFrame([("r", *p) for p in rows] + [("s", 1, 2)], "region string, bin1_id long, bin2_id long").repartition(3)
    got = dots.clusters(df, 2.0, tile=tile).toPandas()
    assert len(got) == len(rows) + 1
    r = got[got.region == "r"]
    assert sorted(r[["c_bin1", "c_bin2"]].drop_duplicates().itertuples(index=False, name=None)) == sorted((float(x), float(y)) for x, y in centres)
    assert set(r.c_size) == {9} and sorted(r.c_label.unique()) == list(range(len(centres))) and (abs(r.bin1_id - r.c_bin1) <= 1).all()
    assert got[got.region == "s"][["c_label", "c_size", "c_bin1", "c_bin2"]].to_numpy().tolist() == [[0, 1, 1.0, 2.0]]


def wide_dots(spark, rows):
    names = ("donut", "vertical", "horizontal", "lowleft")
    kind = "region string, bin1_id long, bin2_id long, count long, c_size long, " + ", ".join([f"la_{k} double" for k in names] + [f"q_{k} double" for k in names])
    return spark.createDataFrame([("r", i, i + 9, n, size, *la, *q) for i, (n, size, la, q) in enumerate(rows)], kind)


def test_bin_beyond_the_last_edge(spark):
    hist = spark.createDataFrame([("k", 0, 1, 50), ("k", 0, 9, 2), ("k", 2, 9, 3), ("k", 2, 700, 1)], "kernel string, lbin int, count long, n long")
    with pytest.raises(ValueError, match="open"):
        dots.thresholds(hist, [1.0, 2.0], 0.1).collect()
    got = {(r.lbin, r["count"]): (r.threshold, r.qval) for r in dots.thresholds(hist, [1.0, 2.0], 0.1, open_bin=True).collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, c): (701, 1.0) for c in (1, 9, 700)}
    assert got[0, 9][0] == 9 and got[0, 9][1] < 1e-4
    assert {k: v for k, v in got.items() if k[0] == 0} == {(r.lbin, r["count"]): (r.threshold, r.qval) for r in dots.thresholds(hist.where("lbin = 0").union(hist.where("lbin = 2").selectExpr("kernel", "1", "count", "n")), [1.0, 2.0], 0.1).where("lbin = 0").collect()}


def test_dots_add_edges_for_large_expected_values(spark):
    n = 24
    bins = spark.createDataFrame([(i, "c", 0, i * 10, i * 10 + 10, 1.0) for i in range(n)], "bin_id long, chrom string, chrom_idx int, start long, end long, weight double")
    px = spark.createDataFrame([(i, j, 900 if (i, j) == (6, 14) else 100) for i in range(n) for j in range(i, n)], "bin1_id long, bin2_id long, count long")
    m = ContactMap(bins, px, 10)
    view = maps.chrom_view(bins)
    expected = spark.createDataFrame([("c", k, 100.0) for k in range(n)], "region1 string, dist long, balanced_avg double")
    kernels = {"donut": arrays.kernel(3, 1, "donut")}
    call = lambda **k: sorted((r.bin1_id, r.bin2_id) for r in dots.dots(m, view, expected, kernels, band=12, n_lambda_bins=12, radius_bins=None, **k).collect())
    assert (6, 14) in call() and call(open_bin=True) == []


def test_enriched_dots_by_hand(spark):
    low = (0.001,) * 4
    rows = [
        (21, 2, (10.0, 10.0, 10.0, 10.0), (0.1,) * 4),  # over twice two of them, and 1.75 and 1.5 times all
        (20, 2, (10.0, 10.0, 10.0, 10.0), low),  # not over twice the donut or lower left
        (21, 2, (13.0, 10.0, 10.0, 10.0), low),  # not 1.75 times the donut
        (21, 2, (10.0, 14.5, 10.0, 10.0), low),  # not 1.5 times the vertical
        (21, 1, (10.0, 10.0, 10.0, 10.0), (0.005,) * 4),  # alone, q-values add up to 0.02
        (21, 1, (10.0, 10.0, 10.0, 10.0), (0.006,) * 4),
    ]
    assert sorted(r.bin1_id for r in dots.enriched(wide_dots(spark, rows)).collect()) == [0, 4]
    with pytest.raises(ValueError):
        dots.enriched(wide_dots(spark, rows).drop("la_donut"))


def test_a_cluster_keeps_its_largest_count(spark):
    df = spark.createDataFrame([("r", 5, 9, 3), ("r", 5, 10, 7), ("r", 6, 10, 7), ("r", 90, 99, 1)], "region string, bin1_id long, bin2_id long, count long")
    got = sorted((r.bin1_id, r.bin2_id, r.c_size) for r in dots.clustered(df, 2.0).collect())
    assert got == [(5, 10, 3), (90, 99, 1)]


@pytest.mark.parametrize(("counts", "draws_"), [([3, 0, 5, 2], 4), ([400, 900, 0, 1700], 1200), ([400, 900, 0, 1700], 2600)])
def test_draws_are_multivariate_hypergeometric(counts, draws_):
    rng, counts = np.random.default_rng(11), np.array(counts)
    got = np.array([draws.split(rng, counts, draws_) for _ in range(4000)])
    total = counts.sum()
    assert (got.sum(axis=1) == draws_).all() and (got <= counts).all() and (got >= 0).all()
    p = counts / total
    var = draws_ * p * (1 - p) * (total - draws_) / (total - 1)
    assert np.abs(got.mean(axis=0) - draws_ * p).max() < 5 * np.sqrt(var.max() / 4000)
    ok = var > 0
    assert got.var(axis=0)[ok] / var[ok] == pytest.approx(1, abs=0.12)
    cov = np.cov(got[:, 0], got[:, 3])[0, 1]
    assert cov == pytest.approx(-draws_ * p[0] * p[3] * (total - draws_) / (total - 1), rel=0.25)


def test_draws_from_very_large_counts():
    counts = np.array([10**15, 3 * 10**15, 5], dtype=np.int64)
    got = draws.split(np.random.default_rng(1), counts, 10**15)
    assert got.sum() == 10**15 and got[0] == pytest.approx(10**15 / 4, rel=1e-6)
    assert draws.split(np.random.default_rng(1), counts, int(counts.sum())).tolist() == counts.tolist()
    with pytest.raises(ValueError):
        draws.split(np.random.default_rng(1), counts, int(counts.sum()) + 1)


def test_samples_by_a_tree_of_draws(spark):
    m, _, _ = small_map(spark, 9, density=1.0)
    px = m.pixels.withColumn("count", F.col("count") * 1_000_000)
    total = px.agg(F.sum("count")).first()[0]
    have = {(r.bin1_id, r.bin2_id): r["count"] for r in px.collect()}
    got = {(r.bin1_id, r.bin2_id): r["count"] for r in profiles.sample_split(px, total // 3, 5, block_pixels=20).collect()}
    assert sum(got.values()) == total // 3 and all(0 < k <= have[p] for p, k in got.items())
    off = [(got.get(p, 0) - n / 3) / np.sqrt(n * 2 / 9) for p, n in have.items()]
    assert 0.8 < np.std(off) < 1.2 and abs(np.mean(off)) < 0.3
    again = profiles.sample_split(px.repartition(7), total // 3, 5, block_pixels=20)
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in again.collect()} == got
    assert profiles.sample_split(px, 0).collect() == []
    with pytest.raises(ValueError):
        profiles.sample_split(px, total + 1)


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_prominences_of_signals_cut_anywhere(spark, chunk):
    rng = np.random.default_rng(10)
    signals = {"walk": np.cumsum(rng.standard_normal(90)), "ties": rng.integers(0, 4, 80).astype(float), "flat": np.zeros(5), "hill": np.r_[0.0, 5, 1], "one": np.ones(1), "tops": np.tile([0.0, 7, 1, 7], 5)}
    rows = [(g, 3 + 2 * i, float(x)) for g, v in signals.items() for i, x in enumerate(v)]
    got = peaks.prominences(spark.createDataFrame(rows, "region string, bin_id long, v double"), chunk=chunk).where("prominence > 0").collect()
    want = {(g, 3 + 2 * i): x for g, v in signals.items() for i, x in enumerate(arrays.prominence(v)) if x > 0}
    assert {(r.region, r.bin_id): r.prominence for r in got} == pytest.approx(want) and len(want) > 20


def block(spark, arrays_by_region, name="value"):
    rows = [(g, i, j, None if np.isnan(a[i, j]) else float(a[i, j]), int(abs(np.nan_to_num(a[i, j])) * 3) % 9) for g, a in arrays_by_region.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "region string, i long, j long, value double, count long")


def dense_of(df, shapes):
    out = {g: np.full(s, np.nan) for g, s in shapes.items()}
    for r in df.collect():
        out[r.region][r.i, r.j] = np.nan if r.value is None else r.value
    return out


@pytest.mark.parametrize(("levels", "least"), [(8, 2), (1, 2), (8, 8)])
def test_pyramids_are_those_of_the_dense_block(spark, levels, least):
    rng = np.random.default_rng(13)
    a = {"r": rng.uniform(0, 3, (11, 11)), "s": rng.uniform(0, 3, (4, 4)), "t": rng.uniform(0, 3, (1, 1))}
    a["r"][4] = a["r"][:, 4] = np.nan
    cells = block(spark, a)
    got = dense_of(signals.adaptively_coarse(cells, 4, levels, least), {g: x.shape for g, x in a.items()})
    for g, x in a.items():
        counts = (np.abs(np.nan_to_num(x)) * 3).astype(int) % 9
        assert got[g] == pytest.approx(arrays.adaptive_coarsegrain(x, counts, 4, levels, least), nan_ok=True)


def test_zooms_are_those_of_the_dense_block(spark):
    rng = np.random.default_rng(14)
    a = {"r": rng.uniform(0, 3, (11, 8)), "s": rng.uniform(0, 3, (4, 5))}
    for shape, same in (((5, 5), False), ((13, 3), True)):
        got = dense_of(signals.zoomed(block(spark, a), shape, same_sum=same), dict.fromkeys(a, shape))
        for g, x in a.items():
            assert got[g] == pytest.approx(arrays.zoom(x, shape, same))
