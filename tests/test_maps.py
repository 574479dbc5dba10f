"""Known answers on tiny maps, dense oracles, and pure numpy routines."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binlattice import ContactMap
from binlattice.cli import parser, region
from binlattice.functions import arrays, columns
from binlattice.operators import bands, compartments, dots, expected, matrix, profiles, rearrange, snip
from binlattice.plans import joins
from binlattice.schema import is_balanced
from binlattice.sources import genome, maps
from binlattice.streaming.pairs import pixel_stream

BINS = "bin_id long, chrom string, chrom_idx int, start long, end long, weight double"
PIXELS = "bin1_id long, bin2_id long, count long"


def tiny(spark, weights, pixels, chroms):
    rows = [(i, c, {"chr1": 0, "chrX": 1}[c], i, i + 1, w) for i, (c, w) in enumerate(zip(chroms, weights, strict=True))]
    return ContactMap(spark.createDataFrame(rows, BINS), spark.createDataFrame(pixels, PIXELS), 1)


def dense_map(spark, n=12, seed=1, bad=(3,)):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.integers(0, 6, (n, n)))
    px = [(int(i), int(j), int(a[i, j])) for i in range(n) for j in range(i, n) if a[i, j]]
    w = [None if i in bad else 0.5 + i / n for i in range(n)]
    m = tiny(spark, w, px, ["chr1"] * n)
    full = np.array([[a[min(i, j), max(i, j)] * (w[i] or np.nan) * (w[j] or np.nan) for j in range(n)] for i in range(n)])
    return m, full


def test_coverage_known(spark):
    m = tiny(spark, [1.0, 1.0, 1.0], [(0, 1, 1), (0, 2, 2)], ["chr1", "chr1", "chrX"])
    got = profiles.coverage(m).orderBy("bin_id").collect()
    assert [r.cov_cis for r in got] == [1, 1, 0] and [r.cov_tot for r in got] == [3, 1, 2]


def test_coverage_balanced_known(spark):
    m = tiny(spark, [0.5, 1.0, 0.2, None], [(0, 1, 1), (0, 2, 2), (1, 3, 2), (2, 3, 1)], ["chr1", "chr1", "chrX", "chrX"])
    got = profiles.coverage(m, weighted=True).orderBy("bin_id").collect()
    assert [r.cov_cis for r in got] == [0.5, 0.5, 0.0, None] and [r.cov_tot for r in got] == pytest.approx([0.7, 0.5, 0.2, None])


def test_expected_against_dense(spark):
    m, full = dense_map(spark)
    got = {r.dist: r for r in expected.expected_cis(m, maps.chrom_view(m.bins)).collect()}
    for k in range(12):
        d = np.diag(full, k)
        assert got[k].n_total == 12 - k and got[k].n_valid == np.isfinite(d).sum()
        assert got[k].balanced_sum is None if k < 2 else got[k].balanced_sum == pytest.approx(np.nansum(d))


@pytest.mark.parametrize("parts", [1, 3])
def test_insulation_against_dense(spark, parts):
    m, full = dense_map(spark, 20)
    m.pixels = m.pixels.repartition(parts)
    got = {r.bin_id: r for r in bands.insulation(m, maps.chrom_view(m.bins), 3, norm_by_median=False).collect()}
    i, j = np.indices(full.shape)
    a = np.where(j - i >= 2, full, np.nan)
    for p in range(20):
        block = a[max(0, p - 2) : p + 1, p : p + 3]
        assert got[p].n_valid == np.isfinite(block).sum()
        if np.nansum(block) > 0:
            assert got[p].log2_score == pytest.approx(np.log2(np.nanmean(block)))


def test_digitize_known(spark):
    track = spark.createDataFrame([(None,), (-0.5,), (0.5,)], "value double")
    got = compartments.digitize(track, 10, vrange=(-0.1, 0.1)).collect()
    assert [r.cls for r in got] == [-1, 0, 11]


def test_saddle_against_dense(spark):
    m, full = dense_map(spark, 16)
    e = expected.expected_cis(m, maps.chrom_view(m.bins))
    mean = {r.dist: r.balanced_avg for r in e.collect()}
    cls = m.bins.select("bin_id", (F.col("bin_id") % 3).cast("int").alias("cls"))
    got = {(r.ci, r.cj): (r.s, r.c) for r in compartments.saddle_cis(m, cls, maps.chrom_view(m.bins), e, 2).collect()}
    want = {}
    for i in range(16):
        for j in range(16):
            if abs(i - j) >= 3 and np.isfinite(full[i, j]) and mean[abs(i - j)]:
                s, c = want.get((i % 3, j % 3), (0.0, 0))
                want[i % 3, j % 3] = (s + full[i, j] / mean[abs(i - j)], c + 1)
    for (a, b), (s, c) in got.items():
        assert c == 2 * want[a, b][1] and s == pytest.approx(want[a, b][0] + want[b, a][0])


def test_snippets(spark):
    m, full = dense_map(spark, 20)
    f = spark.createDataFrame([(0, "chr1", 10, 11), (1, "chr1", 0, 1)], "snip_id long, chrom string, start long, end long")
    got = snip.snippets(m, f, maps.chrom_view(m.bins), flank=2, min_diag=None).collect()
    assert len(got) == 50 and all(r.value is None for r in got if r.snip_id == 1)
    for r in got:
        if r.snip_id == 0 and np.isfinite(full[8 + r.i, 8 + r.j]):
            assert r.value == pytest.approx(full[8 + r.i, 8 + r.j])
    with pytest.raises(ValueError):
        snip.snippets(m, f.withColumn("end", F.lit(-5).cast("long")), maps.chrom_view(m.bins), flank=2)


def test_rearrange_identity_and_inversion(spark):
    m, _ = dense_map(spark)
    same = rearrange.rearrange(m, maps.chrom_view(m.bins))
    assert sorted(map(tuple, same.pixels.collect())) == sorted(map(tuple, m.pixels.collect()))
    flipped = rearrange.rearrange(m, maps.chrom_view(m.bins).withColumn("strand", F.lit("-")))
    assert sorted(map(tuple, flipped.pixels.collect())) == sorted((11 - r.bin2_id, 11 - r.bin1_id, r["count"]) for r in m.pixels.collect())


def test_sampling(spark):
    m, _ = dense_map(spark, 30)
    total = m.pixels.agg(F.sum("count")).first()[0]
    assert profiles.sample_exact(m.pixels, 50).agg(F.sum("count")).first()[0] == 50
    once = sorted(map(tuple, profiles.sample_approx(m.pixels, 0.5).collect()))
    assert once == sorted(map(tuple, profiles.sample_approx(m.pixels.repartition(7), 0.5).collect()))
    with pytest.raises(ValueError):
        profiles.sample(m, count=total + 1)
    with pytest.raises(ValueError):
        profiles.sample(m, count=1, frac=0.5)


def test_balance(spark):
    m, _ = dense_map(spark, 16, bad=())
    w, _ = matrix.balance(m, ignore_diags=0, max_iter=12)
    x = {r.bin_id: r.weight for r in w.collect()}
    a = np.zeros((16, 16))
    for r in m.pixels.collect():
        a[r.bin1_id, r.bin2_id] = a[r.bin2_id, r.bin1_id] = r["count"] * x[r.bin1_id] * x[r.bin2_id]
    s = a.sum(axis=1)
    assert s.std() / s.mean() < 0.02


def test_eigenvector_signal(spark):
    n = 60
    e = np.sin(2 * np.pi * np.arange(n) / 20) * np.sqrt(0.5)
    px = [(i, j, int(1e6 * (abs(i - j) + 10) ** -2.0 * (1 + e[i] * e[j]))) for i in range(n) for j in range(i, n)]
    m = tiny(spark, [1.0] * n, px, ["chr1"] * n)
    phase = m.bins.select("bin_id", F.sin(2 * np.pi * F.col("bin_id") / 20).alias("value"))
    got = compartments.eigs_cis(m, maps.chrom_view(m.bins), 1, phasing=phase, clip_percentile=0).where("k = 1").orderBy("bin_id").collect()
    assert np.corrcoef([r.value for r in got], e)[0, 1] > 0.95


def test_view_assignment(spark):
    view = spark.createDataFrame([("chr1", 0, 6, "a", 0), ("chr1", 5, 12, "b", 1)], "chrom string, start long, end long, name string, region_idx int")
    m, _ = dense_map(spark)
    got = {r.bin_id: r.region for r in joins.assign_supports(m.bins, view).collect()}
    assert got[4] == "a" and got[5] == "b" and got[11] == "b"
    pairs = spark.createDataFrame([(1, "chr1", 0, 2, "chr1", 8, 9)], "id long, chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long")
    r = joins.assign_view(pairs, view, "id").first()
    assert (r.region1, r.region2, r.region) == ("a", "b", None)


def test_reserved_weights(spark):
    m, _ = dense_map(spark)
    assert is_balanced(m) and not is_balanced(m, "other")
    with pytest.raises(KeyError):
        is_balanced(m, "KR")
    with pytest.raises(TypeError):
        is_balanced(m, 1)


def test_map_round_trip(spark, tmp_path):
    m, _ = dense_map(spark)
    maps.write_map(m, str(tmp_path / "m"))
    back = maps.read_map(spark, str(tmp_path / "m"))
    assert back.binsize == 1 and sorted(map(tuple, back.pixels.collect())) == sorted(map(tuple, m.pixels.collect()))


def test_stream(spark, tmp_path):
    rows = [("chr1", 5, "chr1", 25), ("chr1", 25, "chr1", 5), ("chr1", 1, "chr2", 2)]
    spark.createDataFrame(rows, "chrom1 string, pos1 long, chrom2 string, pos2 long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom1 string, pos1 long, chrom2 string, pos2 long").parquet(str(tmp_path / "in"))
    q = pixel_stream(stream, 10).writeStream.format("memory").queryName("px").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("px").collect())) == [("chr1", 0, "chr1", 2, 2), ("chr1", 0, "chr2", 0, 1)]


def test_run_length_round_trip(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1, 1, None, None, 2, 1])], "region string, i long, v int")
    runs = columns.run_lengths(df, "v", "region", "i")
    assert sorted((r.start, r.length) for r in runs.collect()) == [(0, 2), (2, 2), (4, 1), (5, 1)]
    assert [r.value for r in columns.run_decode(runs, "region").orderBy("at").collect()] == [1, 1, None, None, 2, 1]


def test_binnify(spark):
    got = genome.binnify(spark.createDataFrame([("c", 25)], "chrom string, length long"), 10).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 10), (10, 20), (20, 25)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=3, max_size=25, unique=True))
def test_prominence_is_bounded(values):
    v = np.array(values, dtype=float)
    p = arrays.prominence(v)
    assert (p >= 0).all() and (p <= v.max() - v.min()).all()


def test_numpy_routines():
    assert arrays.poisson_sf(2.0, 3) == pytest.approx([0.8646647, 0.5939942, 0.3233236, 0.1428765], abs=1e-6)
    assert np.isfinite(arrays.poisson_sf(82570.0, 10)).all()
    x = arrays.persistent_log_bins(3)
    assert x[0] == 1 and (np.diff(np.diff(x)) >= 0).all()
    assert arrays.interp_nan(np.array([1.0, np.nan, 3.0])).tolist() == [1, 2, 3]
    assert 1 < arrays.li_threshold(np.array([0.1, 0.2, 0.1, 5, 6, 5.5])) < 5
    assert arrays.zoom(np.ones((4, 4)), (2, 2)).tolist() == [[1, 1], [1, 1]]
    lows, highs = arrays.peakdet(np.array([0, 3, 0, 4, 1.0, 3]), 1)
    assert highs.tolist() == [1, 3] and lows.tolist() == [2, 4]
    with pytest.raises(ValueError):
        arrays.recommend_kernels(50000)
    assert arrays.kernel(3, 1, "donut").shape == (7, 7)


def test_cli_arguments():
    a = parser().parse_args(["insulation", "m", "-o", "out", "--window", "10", "20"])
    assert a.window == [10, 20] and region("chr1:1,000-2000") == ("chr1", 1000, 2000)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr("binlattice.plans.joins.ROWS_A_TASK", 10)
    rows = spark.range(400).selectExpr("id div 4 as g", "id % 4 + id div 40 as b")
    counted = lambda df: df.selectExpr("count(*)", "sum(count)").first()
    plan = maps.pixels_of(rows, "g", "b", once=True)._jdf.queryExecution().toString()
    assert "hashpartitioning(g#" in plan and ", 40)" in plan
    assert tuple(counted(maps.pixels_of(rows, "g", "b", once=True))) == tuple(counted(maps.pixels_of(rows.distinct(), "g", "b")))


def test_pairs_in_few_bins_are_summed_by_task(spark, monkeypatch):
    monkeypatch.setattr(maps, "PAIRS_AT_ONCE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.range(300).selectExpr("'u' || cast(sqrt(id) as int) as g", "pmod(xxhash64(id), 12) as b").union(spark.sql("values (null, 3L), (null, 4L), ('u1', null), ('u1', null), ('one', 11L)"))
        pixels = lambda rows, **how: sorted(map(tuple, maps.pixels_of(rows, "g", "b", **how).collect()))
        plan = lambda rows, bins: maps.pixels_of(rows, "g", "b", bins=bins)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan(rows, 12) and "Join" in plan(rows, 11)
        for once in (False, True):
            assert pixels(rows, once=once) == pixels(rows, once=once, bins=12) == pixels(rows, once=once, bins=11)
        outside = rows.union(spark.sql("values ('u3', -2L), ('u3', 40L)"))
        assert pixels(outside) == pixels(outside, bins=12)
        assert pixels(rows.limit(0), bins=12) == pixels(rows.where("g = 'one'"), bins=12) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
