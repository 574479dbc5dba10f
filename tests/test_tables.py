"""Table routines, readers and the genome commands against known answers and dense numpy versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binlattice import cli
from binlattice.functions import arrays, tables
from binlattice.operators import bands, profiles, signals, snip
from binlattice.sources import genome

CELL = "region string, i long, j long, value double"


def dense(spark, a):
    return spark.createDataFrame([("r", int(i), int(j), None if np.isnan(a[i, j]) else float(a[i, j])) for i, j in np.ndindex(a.shape)], CELL)


def test_diagonals(spark):
    a = np.arange(16.0).reshape(4, 4)
    assert sorted(r.value for r in tables.diagonal(dense(spark, a), 1).collect()) == np.diag(a, 1).tolist()
    got = {(r.i, r.j): r.value for r in tables.set_diagonal(dense(spark, a), None, -1).collect()}
    assert all(got[i, j] == (None if j - i == -1 else a[i, j]) for i, j in got)


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.x for r in tables.finite(df, "x").collect()] == [1.0]


@pytest.mark.parametrize("mode", ["mean", "std", "logstd"])
def test_weighted_means(spark, mode):
    rng = np.random.default_rng(1)
    g, w, x = rng.integers(0, 3, 50), rng.integers(1, 9, 50), rng.random(50) + 0.5
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, w, x, strict=True)] + [(0, 5, None)], "g int, w long, x double")
    for r in tables.weighted_means(df, ["g"], "w", ["x"], mode).collect():
        v, u = (np.log(x) if mode == "logstd" else x)[g == r.g], w[g == r.g]
        mean = np.average(v, weights=u)
        sd = np.sqrt(np.average((v - mean) ** 2, weights=u))
        assert r.x == pytest.approx({"mean": mean, "std": sd, "logstd": np.exp(sd)}[mode]) and r.w == u.sum() + 5 * (r.g == 0)
    with pytest.raises(ValueError):
        tables.weighted_means(df, ["g"], "w", ["x"], "other")


def test_ecdf(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0, None)], "g string, x double")
    assert {r.x: r.share for r in tables.ecdf(df, "x", "g").collect()} == {1.0: 0.25, 2.0: 0.75, 4.0: 1.0}


def test_contrast_forms(spark):
    x, y = spark.range(1).select(tables.normalized(F.lit(3.0)).alias("x"), tables.unnormalized(F.lit(0.5)).alias("y")).first()
    assert (x, y) == (0.5, 3.0)


RUNS = "region string, start long, length long, value double"


def laid(rows, n):
    out = [None] * n
    for r in rows:
        out[r.start : r.start + r.length] = [r.value] * r.length
    return out


def test_runs(spark):
    a = spark.createDataFrame([("r", 2, 3, 1.0), ("r", 5, 2, 1.0), ("r", 7, 0, 9.0), ("r", 9, 1, None), ("r", 10, 2, 2.0)], RUNS)
    b = spark.createDataFrame([("r", 0, 6, 7.0), ("r", 8, 3, 8.0)], RUNS)
    filled = sorted((r.start, r.length, r.value) for r in tables.fill_gaps(a, "region", 15).where("length > 0").collect())
    assert filled == [(0, 2, None), (2, 3, 1.0), (5, 2, 1.0), (7, 2, None), (9, 1, None), (10, 2, 2.0), (12, 3, None)]
    assert sorted((r.start, r.length, r.value) for r in tables.simplify_runs(a, "region", 15).collect()) == [(2, 5, 1.0), (10, 2, 2.0)]
    both = tables.align_runs(a, b, "region", 15).orderBy("start").collect()
    assert sum(r.length for r in both) == 15 and [r.start for r in both] == sorted({0, 2, 5, 6, 7, 8, 9, 10, 11, 12})
    for k, df in ((1, a), (2, b)):
        want, at = laid(df.collect(), 15), 0
        for r in both:
            assert set(want[r.start : r.start + r.length]) == {r[f"value{k}"]} and r.start == at
            at += r.length
    assert tables.simplify_runs(a.where("start < 0"), "region", 15).count() == 0


def test_singletons(spark):
    good = [True, False, True, True, False, False, True, False, True, True]
    bins = spark.createDataFrame([("r", i, g) for i, g in enumerate(good)], "region string, bin_id long, good boolean")
    kinds = [r.kind for r in tables.singletons(bins, "region", "bin_id", "good").orderBy("bin_id").collect()]
    assert kinds == ["good", "bad_single", "good", "good", "bad", "bad", "good_single", "bad_single", "good", "good"]
    n, kinds = 10, np.array(kinds)
    a = np.add.outer(np.arange(10.0), 2 * np.arange(10.0))
    bad = np.array([k.startswith("bad") for k in kinds])
    a[bad] = a[:, bad] = np.nan
    cells = spark.createDataFrame([("r", i, j, None if np.isnan(a[i, j]) else float(a[i, j]), str(kinds[i]), str(kinds[j])) for i in range(n) for j in range(i, n)], CELL + ", kind1 string, kind2 string")
    got = {(r.i, r.j): r.value for r in tables.repair_singletons(cells, n).collect()}
    assert got[0, 0] is None and got[2, 3] is None and got[4, 8] is None and got[0, 5] is None
    assert got[1, 3] == pytest.approx(np.nanmean([a[0, 2], a[2, 4]])) and got[0, 7] == pytest.approx(np.nanmean([a[0, 6], a[0, 8]]))
    assert got[1, 9] == pytest.approx(np.nanmean([a[0, 9], a[2, 9]])) and got[2, 8] == a[2, 8]


def test_sampled_deviation(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"))
    one = [tables.sampled_deviation(df.repartition(k), "x", "id", 1000, 7).first().sd for k in (1, 5)]
    assert one[0] == one[1] == pytest.approx(np.std(np.arange(100)), rel=0.1)


def test_runs_that_reach_or_pass_the_length(spark):
    runs = spark.createDataFrame([("under", 2, 3, 1.0), ("at", 10, 5, 1.0), ("past", 14, 4, 1.0)], RUNS)
    tail = lambda **k: sorted((r.region, r.start, r.length) for r in tables.fill_gaps(runs, "region", 15, **k).where("value is null and start > 0").collect())
    assert tail() == [("under", 5, 10)]
    assert tail(signed_tail=True) == [("at", 15, 0), ("past", 18, -3), ("under", 5, 10)]


def test_aligned_windows(spark):
    loci = spark.createDataFrame([("c", 105, 260)], "chrom string, left long, right long")
    r = snip.aligned_windows(loci, 50, 100).first()
    assert (r.lo, r.hi, r.start_bp, r.end_bp) == (0, 8, 0, 400)
    for bad in (lambda: snip.aligned_windows(loci, 50, 70), lambda: snip.aligned_windows(loci.selectExpr("chrom", "right as left", "left as right"), 50)):
        with pytest.raises(ValueError):
            bad()


def test_extrema(spark):
    v = [0.0, 5.0, 1.0, 4.0, 3.5, 9.0, 2.0, None, 3.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)], "region string, at long, value double")
    got = {(r["at"], r.kind) for r in signals.extrema(df, "value", "region", "at", 2.0).collect()}
    assert {(1, "max"), (2, "min"), (5, "max")} <= got and (4, "min") not in got
    swept = {r["at"]: r for r in signals.swept_prominence(df, "value", "region", "at", 50, 1).collect()}
    assert swept[2].low == pytest.approx(4.0, rel=0.1) and swept[0].high is None
    assert signals.swept_prominence(df.where("at = 0"), "value", "region", "at").first().low is None


def test_extrema_of_flat_signals_and_behind_nulls(spark):
    rows = [("flat", i, 1.0) for i in range(5)] + [("none", i, None) for i in range(3)] + [("late", i, x) for i, x in enumerate([None, 0.0, 5.0, 1.0, 4.0])]
    df = spark.createDataFrame(rows, "region string, at long, value double")
    got = lambda df: sorted((r.region, r["at"], r.kind) for r in signals.extrema(df, "value", "region", "at", 2.0).collect())
    assert got(df) == [("late", 2, "max"), ("late", 3, "min")]
    assert got(df.where("region <> 'late'")) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=3, max_size=60))
def test_sweep_keeps_the_largest_threshold(values):
    v = np.array(values)
    low, _ = arrays.prominence_sweep(v, 20, 1)
    known = np.unique(v)
    if len(known) < 2:
        assert np.isnan(low).all()
        return
    steps = np.geomspace(np.diff(known).min(), known[-1] - known[0], 20)
    called = [set(arrays.peakdet(v, s)[0].tolist()) for s in steps]
    for i in range(len(v)):
        at = [s for s, c in zip(steps, called, strict=True) if i in c]
        assert np.isnan(low[i]) if not at else low[i] == max(at)


def test_blocks(spark):
    a = np.random.default_rng(3).integers(0, 9, (8, 8)).astype(float)
    got = signals.zoomed(dense(spark, a), (4, 4)).collect()
    assert len(got) == 16 and sum(r.value for r in got) * 4 == pytest.approx(a.sum())
    cells = dense(spark, a).withColumn("count", F.lit(100))
    assert {(r.i, r.j): r.value for r in signals.adaptively_coarse(cells).collect()} == {(i, j): a[i, j] for i, j in np.ndindex(8, 8)}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_class_pairs(n):
    rng = np.random.default_rng(n)
    at = np.sort(rng.choice(2 * n, n, replace=False)) + 100
    cls, dists = rng.integers(0, 4, n), np.array([d for d in range(3 * n) if d % 3 != 1])
    want = np.zeros((cls.max() + 1,) * 2, dtype=int)
    for i, j in np.ndindex(n, n):
        want[cls[i], cls[j]] += abs(at[i] - at[j]) % 3 != 1
    assert (arrays.class_pairs(at, cls, dists) == want).all()


@pytest.mark.parametrize(("window", "ignore"), [(1, 0), (1, 2), (2, 4), (3, 2), (4, 0), (3, 9)])
def test_diamond_sizes(spark, window, ignore):
    good = [True, True, False, True, True, True, True, False, True, True, True]
    region = ["a"] * 6 + ["b"] * 5
    bins = spark.createDataFrame([(i, r, 1.0 if g else None) for i, (r, g) in enumerate(zip(region, good, strict=True))], "bin_id long, region string, weight double")
    for weighted in (True, False):
        ok = good if weighted else [True] * len(good)
        for r in bands.diamond_sizes(bins, window, ignore, weighted).collect():
            p = r.bin_id
            pairs = [(i, j) for i in range(p - window + 1, p + 1) for j in range(p, p + window) if 0 <= i and j < 11 and region[i] == region[p] == region[j]]
            assert r.n_valid == sum(ok[i] and ok[j] and j - i >= ignore for i, j in pairs)


@pytest.mark.parametrize("metric", [None, "spearmanr", "pearsonr", "var_explained", "MAD_explained"])
def test_phase(metric):
    t = np.sin(np.arange(60) / 5)
    t[3] = np.nan
    weak, strong = np.cos(np.arange(60) * 1.7) + 0.3 * np.nan_to_num(t), -2 * np.nan_to_num(t)
    values, vectors = arrays.phase(np.array([5.0, 4.0]), np.array([weak, strong]), t, metric)
    assert values.tolist() == ([4.0, 5.0] if metric else [5.0, 4.0])
    assert np.nansum(vectors[0 if metric else 1] * t) > 0
    with pytest.raises(ValueError):
        arrays.phase(values, vectors, t, "other")


@pytest.mark.parametrize(("one", "two"), [((0, 40), (0, 40)), ((0, 30), (10, 60)), ((0, 20), (35, 50)), ((10, 60), (0, 30))])
def test_region_scaling(spark, one, two):
    edges = [0, 3, 8, 20, 70]
    pairs = spark.createDataFrame([(p, q) for p in range(0, 60, 3) for q in range(1, 60, 4)], "pos1 long, pos2 long")
    (s1, e1), (s2, e2) = sorted([one, two])
    fine = (np.arange(600) + 0.5) / 10
    p, q = fine[(fine >= s1) & (fine < e1)], fine[(fine >= s2) & (fine < e2)]
    gap = q[None, :] - p[:, None]
    for r in profiles.region_scaling(pairs, one, two, edges).collect():
        assert r.n_pairs == sum(one[0] <= a < one[1] and two[0] <= b < two[1] and r.dist_lo <= b - a < r.dist_hi for a in range(0, 60, 3) for b in range(1, 60, 4))
        assert r.area == pytest.approx(((gap >= r.dist_lo) & (gap < r.dist_hi)).sum() / 100, abs=6)


def test_dense_text(spark):
    bins = spark.createDataFrame([(4, "c", 0, 10), (5, "c", 10, 15)], "bin_id long, chrom string, start long, end long")
    cells = spark.createDataFrame([(4, 4, 1.0), (4, 5, None), (5, 4, None), (5, 5, 2.5)], "i long, j long, value double")
    got = [r.line for r in genome.dense_text(cells, bins, "toy", 1).orderBy("row").collect()]
    assert got == ["2x2\t4|toy|c:1-10\t5|toy|c:11-15", "4|toy|c:1-10\t1.0\tnan", "5|toy|c:11-15\tnan\t2.5"]


def test_path_and_column():
    assert genome.path_and_column("a.tsv") == ("a.tsv", None) and genome.path_and_column("a.tsv::gene") == ("a.tsv", "gene")
    assert genome.path_and_column("a.tsv::4") == ("a.tsv", 3)
    with pytest.raises(ValueError):
        genome.path_and_column("a.tsv::0")


def test_headers():
    assert genome.has_header(["chrom\tstart\tend\tE1", "c\t0\t10\t0.5", "c\t10\t20\tnan"])
    assert not genome.has_header(["c\t0\t10\t0.5", "c\t10\t20\t1e-3"]) and not genome.has_header(["c\t0"]) and not genome.has_header([])


@pytest.mark.parametrize("head", ["", "chrom\tstart\tend\tA\tB\n"])
def test_read_track(spark, tmp_path, head):
    f = tmp_path / "t.tsv"
    f.write_text("# note\n" + head + "c1\t0\t10\t0.5\t7\nc1\t10\t20\tnan\t8\n")
    assert [tuple(r) for r in genome.read_track(spark, str(f)).orderBy("start").collect()] == [("c1", 0, 10, 0.5), ("c1", 10, 20, None)]
    assert [r.value for r in genome.read_track(spark, f"{f}::5").orderBy("start").collect()] == [7.0, 8.0]
    if head:
        assert [r.value for r in genome.read_track(spark, f"{f}::B").orderBy("start").collect()] == [7.0, 8.0]
    with pytest.raises(ValueError):
        genome.read_track(spark, f"{f}::none")


def test_sites():
    assert genome.site_of("HindIII") == ("AAGCTT", 1) and genome.site_of("^GATC") == ("GATC", 0)
    with pytest.raises(ValueError):
        genome.site_of("Nothing")


def test_genome_commands(spark, tmp_path):
    sizes, fasta, genes = tmp_path / "s.tsv", tmp_path / "g.fa", tmp_path / "genes.tsv"
    sizes.write_text("c1\t25\nc2\t7\n")
    fasta.write_text(">c1 first\nACGTAAGCTTAC\nGTNNACGTACGTA\n>c2\nGGGGGGG\n")
    genes.write_text("c1\t5\t12\n")
    seqs = {(r.chrom, r.start): r.seq for r in genome.read_fasta(spark, str(fasta)).collect()}
    assert seqs == {("c1", 0): "ACGTAAGCTTACGTNNACGTACGTA", ("c2", 0): "GGGGGGG"}

    def run(*args):
        out = str(tmp_path / args[0])
        cli.run(spark, cli.parser().parse_args(["genome", *map(str, args), "-o", out]))
        return sorted(tuple(r) for r in spark.read.csv(out, sep="\t", header=True, inferSchema=True).collect())

    assert run("binnify", sizes, 10) == [("c1", 0, 10), ("c1", 10, 20), ("c1", 20, 25), ("c2", 0, 7)]
    assert run("digest", fasta, "HindIII") == [("c1", 0, 5), ("c1", 5, 25), ("c2", 0, 7)]
    bins = str(tmp_path / "binnify")
    assert [r[3] for r in run("gc", bins, fasta)] == pytest.approx([4 / 10, 4 / 8, 2 / 5, 1.0])
    assert [r[3] for r in run("genecov", bins, genes)] == [5, 2, 0, 0]
