"""Overlaps through dyadic cells against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from binlattice.plans import intervals, joins

SCHEMA = "chrom string, start long, end long, name string, region_idx int"


def spans(n, seed, longest, nulls=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(0, 5000)
        e = s + rng.choice([0, 1, 7, 64, rng.randrange(1, longest)])
        rows.append((rng.choice("ab"), s, e, f"n{i}", i))
    if nulls:
        rows += [("a", None, 70, "open start", n), ("b", 4000, None, "open end", n + 1), ("a", None, None, "open", n + 2), (None, 1, 5, "nowhere", n + 3)]
    return rows + rows[:3]


def meet(f, r):
    return f[0] is not None and f[0] == r[0] and None not in f[1:3] and (r[1] is None or f[2] > r[1]) and (r[2] is None or f[1] < r[2])


@pytest.mark.parametrize("leaf,longest", [(1, 300), (64, 4900), (1024, 4900), (16, 20)])
def test_all_overlaps_once(spark, leaf, longest):
    fs, rs = spans(60, 1, longest), spans(50, 2, longest, nulls=True)
    fs += [(None, 1, 9, "x", 98), ("a", None, 9, "y", 99), ("z", 1, 9, "z", 97)]
    out = intervals.overlapping(spark.createDataFrame(fs, SCHEMA), spark.createDataFrame(rs, SCHEMA), leaf=leaf)
    got = sorted((x.f.name, x.r.name) for x in out.collect())
    assert got == sorted((f[3], r[3]) for f in fs for r in rs if meet(f, r))


def test_shuffled_as_well_as_broadcast_and_empty(spark, monkeypatch):
    fs, rs = spark.createDataFrame(spans(40, 3, 900), SCHEMA), spark.createDataFrame(spans(40, 4, 900, nulls=True), SCHEMA)
    names = lambda df: sorted((x.f.name, x.r.name) for x in df.collect())
    want = names(intervals.overlapping(fs, rs))
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", -1)
    assert names(intervals.overlapping(fs, rs)) == want
    assert not intervals.overlapping(fs.limit(0), rs).collect() and not intervals.overlapping(fs, rs.limit(0)).collect()


def test_a_cell_holds_no_stack_of_strangers(spark):
    """Regions stacked over one place and features beside it: no cell brings them together before the filter."""
    rs = spark.range(3000).selectExpr("'a' as chrom", "524288 - id as start", "524289 + id as end")
    fs = spark.range(3000).selectExpr("'a' as chrom", "id * 2 as start", "id * 2 + 1 as end").union(spark.range(3000).selectExpr("'a'", "600000 + id", "600001 + id"))
    cells = lambda df, which: intervals._placed(df, "x", F.col("start"), F.col("end"), 1).select(F.explode(which(20)).alias("c"))
    assert cells(fs, intervals._path).join(cells(rs, intervals._cover), "c").count() == 0
    assert cells(fs, intervals._cover).join(cells(rs, intervals._path), "c").count() == 0
    assert intervals.overlapping(fs, rs, leaf=1).count() == 0


def test_long_views_assign_like_short_ones(spark, monkeypatch):
    rows = spans(80, 5, 700)[:80]
    view = spark.createDataFrame(spans(40, 6, 900, nulls=True)[:43], SCHEMA)
    bins = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "bin_id long, chrom string, start long, end long")
    tables = lambda: (sorted(joins.assign_supports(bins, view).collect()), sorted(joins.assign_regions(bins, view, "bin_id").collect(), key=lambda r: r.bin_id))
    short = tables()
    monkeypatch.setattr(joins, "VIEW_ROWS", 5)
    assert tables() == short


def overlap(f, r):
    lo, hi = (-10**6 if r[1] is None else r[1]), (10**6 if r[2] is None else r[2])
    return min(f[2], hi) - max(f[1], lo)


@pytest.mark.parametrize("cell", [1, 64, 4096])
def test_sums_over_overlaps_without_pairs(spark, cell):
    fs, rs = spans(80, 7, 900), spans(70, 8, 4000, nulls=True) + [("a", 5, 5, "empty", 90), ("b", 700, 700, "empty", 91)]
    fs += [("a", 5, 5, "both empty", 95), ("a", 4, 5, "before", 96), ("a", 5, 6, "after", 97), (None, 1, 9, "x", 98), ("z", 1, 9, "z", 99)]
    got = {(r.name, r.n, r.shared) for r in intervals.overlap_sums(spark.createDataFrame(fs, SCHEMA), spark.createDataFrame(rs, SCHEMA), cell=cell).collect()}
    assert got == {(f[3], sum(meet(f, r) for r in rs), sum(overlap(f, r) for r in rs if meet(f, r))) for f in fs}


@pytest.mark.parametrize("leaf,longest", [(1, 60), (16, 4900), (1024, 900), (64, 300)])
@pytest.mark.parametrize("kind", ["largest", "last"])
def test_one_region_a_feature_without_pairs(spark, kind, leaf, longest):
    rng = random.Random(longest)
    rs = [r for r in spans(150, 9, longest, nulls=True)]
    rs = [(*r[:4], i) for i, r in zip(rng.sample(range(1000), len(rs)), rs, strict=True)]
    rs = [(*r[:3], f"n{r[4]}", r[4]) for r in rs]
    fs = spans(120, 10, longest)[:120] + [(None, 1, 9, "x", 98), ("z", 1, 9, "z", 99)]
    out = intervals.best_met(spark.createDataFrame(fs, SCHEMA), spark.createDataFrame(rs, SCHEMA).select("chrom", "start", "end", "name", "region_idx"), kind, leaf=leaf)
    got = {x["name"]: x._r and x._r.region_idx for x in out.collect()}
    rank = (lambda f, r: (overlap(f, r), -r[4])) if kind == "largest" else (lambda f, r: r[4])
    for f in fs:
        met = [r for r in rs if meet(f, r) and (kind == "last" or overlap(f, r) > 0)]
        assert got[f[3]] == (max(met, key=lambda r: rank(f, r))[4] if met else None), f
