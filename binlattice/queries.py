"""Registered queries over maps derived from the test tables, and the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, columns
from .operators import bands, compartments, dots, eigen, expected, matrix, profiles, rearrange, snip
from .plans import joins
from .schema import expected_problems, ratio, track_problems, view_problems
from .sources import genome, maps
from .sources.workspace import Kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EDGES = [1, 2, 4, 8, 16, 32, 64, 128]
ASYMMETRIC = {"k1": [[1, 2, 0], [0, 0, 3], [1, 0, 1]], "k2": [[0, 1, 0], [1, 0, 1], [0, 1, 0]]}
BAND = 40

# CTEs of the hour map and of what most queries need from it
_MAP = """
e AS (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS b FROM events),
pix AS (SELECT least(x.b, y.b) AS bin1_id, greatest(x.b, y.b) AS bin2_id, count(*) AS cnt FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id GROUP BY 1, 2),
cov AS (SELECT b AS bin_id, sum(cnt) AS cov FROM (SELECT bin1_id AS b, cnt FROM pix UNION ALL SELECT bin2_id, cnt FROM pix) u GROUP BY 1),
bins AS (SELECT r.i AS bin_id, 'c' || CAST(r.i // 180 + 1 AS VARCHAR) AS chrom, CAST(r.i % 180 * 3600 AS BIGINT) AS s, CAST((r.i % 180 + 1) * 3600 AS BIGINT) AS t,
         CASE WHEN r.i % 37 = 5 OR coalesce(cov, 0) = 0 THEN NULL ELSE 100.0e0 / sqrt(CAST(cov AS DOUBLE)) END AS w,
         'c' || CAST(r.i // 180 + 1 AS VARCHAR) || CASE WHEN r.i % 180 < 90 THEN '_p' ELSE '_q' END AS arm, r.i // 90 AS arm_idx
         FROM (SELECT unnest(range(0, 720)) AS i) r LEFT JOIN cov ON cov.bin_id = r.i),
px AS (SELECT p.bin1_id, p.bin2_id, p.cnt, a.chrom AS c1, b.chrom AS c2, a.w AS w1, b.w AS w2, a.arm AS r1, b.arm AS r2, p.cnt * a.w * b.w AS bal, p.bin2_id - p.bin1_id AS d
       FROM pix p JOIN bins a ON a.bin_id = p.bin1_id JOIN bins b ON b.bin_id = p.bin2_id)"""
_CIS = """,
dg AS (SELECT a.chrom AS region, b.bin_id - a.bin_id AS dist, count(*) AS n_total, sum(CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN 1 ELSE 0 END) AS n_valid FROM bins a JOIN bins b ON a.chrom = b.chrom AND a.bin_id <= b.bin_id GROUP BY 1, 2),
cs AS (SELECT c1 AS region, d AS dist, sum(cnt) AS cs, sum(bal) AS bs FROM px WHERE c1 = c2 AND w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT dg.region, dg.dist, n_total, n_valid, CASE WHEN dg.dist >= 2 THEN coalesce(cs, 0) END AS count_sum, CASE WHEN dg.dist >= 2 THEN coalesce(bs, 0) END AS balanced_sum,
       CASE WHEN dg.dist >= 2 THEN coalesce(bs, 0) END / nullif(n_valid, 0) AS balanced_avg FROM dg LEFT JOIN cs ON cs.region = dg.region AND cs.dist = dg.dist)"""
_ARMS = """,
dg AS (SELECT a.arm AS region1, b.arm AS region2, b.bin_id - a.bin_id AS dist, count(*) AS n_total, sum(CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN 1 ELSE 0 END) AS n_valid
       FROM bins a JOIN bins b ON a.chrom = b.chrom AND a.arm_idx <= b.arm_idx AND a.bin_id <= b.bin_id GROUP BY 1, 2, 3),
cs AS (SELECT r1 AS region1, r2 AS region2, d AS dist, sum(cnt) AS cs, sum(bal) AS bs FROM px WHERE c1 = c2 AND w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2, 3),
ex AS (SELECT dg.region1, dg.region2, dg.dist, n_total, n_valid, CASE WHEN dg.dist >= 2 THEN coalesce(cs, 0) END AS count_sum, CASE WHEN dg.dist >= 2 THEN coalesce(bs, 0) END AS balanced_sum
       FROM dg LEFT JOIN cs ON cs.region1 = dg.region1 AND cs.region2 = dg.region2 AND cs.dist = dg.dist)"""
_TRANS = """,
nb AS (SELECT chrom, count(w) AS g FROM bins GROUP BY 1),
tr AS (SELECT a.chrom AS region1, b.chrom AS region2, a.g * b.g AS n_valid, coalesce(s.cs, 0) AS count_sum, coalesce(s.bs, 0) AS balanced_sum FROM nb a JOIN nb b ON a.chrom < b.chrom
       LEFT JOIN (SELECT c1, c2, sum(cnt) AS cs, sum(bal) AS bs FROM px WHERE c1 <> c2 AND w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2) s ON s.c1 = a.chrom AND s.c2 = b.chrom)"""
_CLS = ",\ntk AS (SELECT bin_id, chrom, w, CASE WHEN w IS NULL THEN -1 ELSE " + " + ".join(f"CASE WHEN sin(bin_id / 25.0e0) >= {-0.8 + 0.4 * k:.1f}e0 THEN 1 ELSE 0 END" for k in range(5)) + " END AS cls FROM bins)"
def _band(kernels: dict, band: int) -> str:
    """CTEs of the band's cells, of kernels summed over them, and of adjusted expected values."""
    half = len(next(iter(kernels.values()))) // 2
    weights = ", ".join(f"('{n}', {y - half}, {x - half}, {int(v)}.0e0)" for n, m in kernels.items() for y, r in enumerate(m) for x, v in enumerate(r))
    return f""",
cell AS (SELECT a.chrom AS region, a.bin_id AS i, b.bin_id AS j, coalesce(p.cnt, 0) AS cnt, coalesce(p.cnt, 0) * a.w * b.w AS o, x.balanced_avg AS e, x.balanced_avg / (a.w * b.w) AS er
         FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.bin_id - a.bin_id BETWEEN 0 AND {band + 2 * half} LEFT JOIN pix p ON p.bin1_id = a.bin_id AND p.bin2_id = b.bin_id LEFT JOIN ex x ON x.region = a.chrom AND x.dist = b.bin_id - a.bin_id),
ker(k, dy, dx, kw) AS (VALUES {weights}),
ag AS (SELECT k, i + dy AS ti, j + dx AS tj, sum(o * kw) AS ko, sum(e * kw) AS ke, count(*) AS n FROM cell CROSS JOIN ker WHERE o IS NOT NULL AND e IS NOT NULL GROUP BY 1, 2, 3),
no AS (SELECT DISTINCT ti, tj FROM ag WHERE coalesce(ke, 0) = 0),
sc AS (SELECT c.i, c.j, c.cnt, ag.k, coalesce(er, 0e0) * ko / nullif(ke, 0e0) AS la FROM cell c JOIN ag ON ag.ti = c.i AND ag.tj = c.j WHERE c.i < c.j AND c.i > c.j - {band} AND n = {(2 * half + 1) ** 2}
       AND NOT EXISTS (SELECT 1 FROM no WHERE no.ti = c.i AND no.tj = c.j)),
lb AS (SELECT *, """ + " + ".join(f"CASE WHEN round(la, 9) > {round(v, 9)!r}e0 THEN 1 ELSE 0 END" for v in dots.lambda_edges(12)) + " AS lbin FROM sc)"


RECOMMENDED = {k: arrays.kernel(3, 1, k) for k in ("donut", "vertical", "horizontal", "lowleft")}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False):
    """Registers a query on the hour map; uses names the CTEs its SQL stands on."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ctes = _MAP + "".join({"cis": _CIS, "arms": _ARMS, "trans": _TRANS, "cls": _CLS, "band": _band(ASYMMETRIC, BAND), "around": _band(RECOMMENDED, 30)}[u] for u in uses)
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * recursive}{ctes.strip()}\n{sql}"
        return f

    return add


def plain(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _cis(m):
    return expected.expected_cis(m, maps.chrom_view(m.bins))


def _track(m) -> DataFrame:
    value = F.when(F.col("weight").isNotNull(), F.sin(F.col("bin_id") / 25.0))
    return m.bins.select("bin_id", "chrom", "start", "end", value.alias("value"))


def _digitized(m) -> DataFrame:
    edges = [round(-0.8 + 0.4 * k, 1) for k in range(5)]
    return _track(m).select("bin_id", compartments.digitized(F.col("value"), edges).alias("cls"))


@query("pixels", "SELECT bin1_id, bin2_id, cnt AS n FROM pix")
def _(spark, d):
    return maps.hour_map(spark, d).pixels.select("bin1_id", "bin2_id", F.col("count").alias("n"))


@query("bins_weighted", "SELECT bin_id, chrom, s AS start_bp, t AS end_bp, round(w, 6) AS weight FROM bins")
def _(spark, d):
    return rounded(maps.hour_map(spark, d).bins.select("bin_id", "chrom", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"), "weight"))


@query("pixels_balanced", "SELECT bin1_id, bin2_id, c1 AS chrom1, c2 AS chrom2, round(bal, 6) AS balanced FROM px")
def _(spark, d):
    m = maps.hour_map(spark, d)
    px = joins.annotate(m.pixels, m.bins)
    return rounded(px.select("bin1_id", "bin2_id", "chrom1", "chrom2", (F.col("count") * F.col("weight1") * F.col("weight2")).alias("balanced")))


@query("range_query", "SELECT bin1_id, bin2_id, cnt AS n FROM pix WHERE bin1_id >= 100 AND bin1_id < 250 AND bin2_id >= 200 AND bin2_id < 400")
def _(spark, d):
    return maps.range_query(maps.hour_map(spark, d).pixels, 100, 250, 200, 400).select("bin1_id", "bin2_id", F.col("count").alias("n"))


@query("dense_fetch", "SELECT a.bin_id AS i, b.bin_id AS j, round(coalesce(p.cnt, 0) * a.w * b.w, 6) AS value FROM bins a JOIN bins b ON a.arm = b.arm LEFT JOIN pix p ON p.bin1_id = least(a.bin_id, b.bin_id) AND p.bin2_id = greatest(a.bin_id, b.bin_id)")
def _(spark, d):
    m = maps.hour_map(spark, d)
    bins = joins.assign_supports(m.bins, maps.half_view(spark))
    return rounded(compartments.region_cells(m, bins, []).select("i", "j", "value"))


@query("view_pairs", "SELECT DISTINCT a.arm AS region1, b.arm AS region2 FROM bins a JOIN bins b ON a.chrom = b.chrom AND a.arm_idx <= b.arm_idx")
def _(spark, d):
    return joins.view_pairs(maps.halves(maps.hour_map(spark, d).bins), "cis")


@query("assign_supports", "SELECT bin_id, arm AS region FROM bins")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return joins.assign_supports(m.bins, maps.half_view(spark)).select("bin_id", "region")


@query("assign_regions", """SELECT f.id, max_by(b.arm, b.o) AS region FROM (SELECT o_orderkey AS id, 'c' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS chrom, o_custkey * 37 % 600000 AS s, o_custkey * 37 % 600000 + 7200 AS t FROM orders) f
LEFT JOIN (SELECT f2.id, v.arm, least(t, e) - greatest(s, b0) AS o FROM (SELECT o_orderkey AS id, 'c' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS chrom, o_custkey * 37 % 600000 AS s, o_custkey * 37 % 600000 + 7200 AS t FROM orders) f2
 JOIN (SELECT chrom, arm, min(s) AS b0, max(t) AS e FROM bins GROUP BY 1, 2) v ON v.chrom = f2.chrom WHERE least(t, e) - greatest(s, b0) > 0) b ON b.id = f.id GROUP BY f.id""")
def _(spark, d):
    s = F.col("o_custkey") * 37 % 600000
    f = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("chrom"), s.alias("start"), (s + 7200).alias("end"))
    return joins.assign_regions(f, maps.half_view(spark), "id").select("id", "region")


@query("expected_cis_raw", """, dg AS (SELECT a.chrom AS region, b.bin_id - a.bin_id AS dist, count(*) AS n_total FROM bins a JOIN bins b ON a.chrom = b.chrom AND a.bin_id <= b.bin_id GROUP BY 1, 2),
cs AS (SELECT c1 AS region, d AS dist, sum(cnt) AS cs FROM px WHERE c1 = c2 GROUP BY 1, 2)
SELECT dg.region AS region1, dg.region AS region2, dg.dist, n_total, n_total AS n_valid, CAST(CASE WHEN dg.dist >= 2 THEN coalesce(cs, 0) END AS DOUBLE) AS count_sum, round(CASE WHEN dg.dist >= 2 THEN coalesce(cs, 0) END / n_total, 6) AS count_avg, dg.dist * 3600 AS dist_bp FROM dg LEFT JOIN cs USING (region, dist)""")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(expected.expected_cis(m, maps.chrom_view(m.bins), weighted=False))


@query("expected_cis_balanced", "SELECT region AS region1, region AS region2, dist, n_total, n_valid, CAST(count_sum AS DOUBLE) AS count_sum, round(balanced_sum, 6) AS balanced_sum, round(count_sum / n_total, 6) AS count_avg, dist * 3600 AS dist_bp, round(balanced_avg, 6) AS balanced_avg FROM ex", ("cis",))
def _(spark, d):
    return rounded(_cis(maps.hour_map(spark, d)))


@query("expected_cis_arms", "SELECT region1, region2, dist, n_total, n_valid, CAST(count_sum AS DOUBLE) AS count_sum, round(balanced_sum, 6) AS balanced_sum, round(count_sum / n_total, 6) AS count_avg, dist * 3600 AS dist_bp, round(balanced_sum / nullif(n_valid, 0), 6) AS balanced_avg FROM ex", ("arms",))
def _(spark, d):
    return rounded(expected.expected_cis(maps.hour_map(spark, d), maps.half_view(spark), intra_only=False))


@query("expected_trans", "SELECT region1, region2, n_valid, CAST(count_sum AS DOUBLE) AS count_sum, round(balanced_sum, 4) AS balanced_sum, round(count_sum / nullif(n_valid, 0), 6) AS count_avg, round(balanced_sum / nullif(n_valid, 0), 6) AS balanced_avg FROM tr", ("trans",))
def _(spark, d):
    m = maps.hour_map(spark, d)
    out = expected.expected_trans(m, maps.chrom_view(m.bins)).drop("n_total")
    return rounded(out.withColumn("balanced_sum", F.round("balanced_sum", 4)))


@query("expected_full", """SELECT region AS region1, region AS region2, dist, n_valid, CAST(count_sum AS DOUBLE) AS count_sum, round(balanced_sum, 4) AS balanced_sum, round(balanced_avg, 6) AS balanced_avg FROM ex
UNION ALL SELECT region1, region2, -1, n_valid, CAST(count_sum AS DOUBLE), round(balanced_sum, 4), round(balanced_sum / nullif(n_valid, 0), 6) FROM tr""", ("cis", "trans"))
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(expected.expected_full(m, maps.chrom_view(m.bins)).withColumn("balanced_sum", F.round("balanced_sum", 4)))


@query("expected_rolled_up", """, one AS (SELECT region1, region2, dist, n_valid, count_sum, balanced_sum FROM ex UNION ALL
SELECT a.arm, b.arm, -1, a.g * b.g, coalesce(s.cs, 0), coalesce(s.bs, 0) FROM (SELECT arm, arm_idx, chrom, count(w) AS g FROM bins GROUP BY 1, 2, 3) a JOIN (SELECT arm, arm_idx, chrom, count(w) AS g FROM bins GROUP BY 1, 2, 3) b ON a.arm_idx < b.arm_idx AND a.chrom <> b.chrom
LEFT JOIN (SELECT r1, r2, sum(cnt) AS cs, sum(bal) AS bs FROM px WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2) s ON s.r1 = a.arm AND s.r2 = b.arm)
SELECT left(region1, 2) AS chrom1, left(region2, 2) AS chrom2, dist, CAST(sum(n_valid) AS BIGINT) AS n_valid, CAST(sum(count_sum) AS DOUBLE) AS count_sum, round(sum(balanced_sum), 4) AS balanced_sum, round(sum(balanced_sum) / nullif(sum(n_valid), 0), 6) AS balanced_avg FROM one GROUP BY 1, 2, 3""", ("arms",))
def _(spark, d):
    view = maps.half_view(spark)
    out = expected.rolled_up(expected.expected_full(maps.hour_map(spark, d), view), view)
    return rounded(out.withColumn("balanced_sum", F.round("balanced_sum", 4)))


@query("obs_over_exp", """SELECT bin1_id, bin2_id, round(bal / nullif(coalesce(x.balanced_avg, t.balanced_sum / nullif(t.n_valid, 0)), 0), 5) AS oe FROM px LEFT JOIN ex x ON c1 = c2 AND x.region = c1 AND x.dist = d LEFT JOIN tr t ON t.region1 = c1 AND t.region2 = c2 WHERE w1 IS NOT NULL AND w2 IS NOT NULL""", ("cis", "trans"))
def _(spark, d):
    m = maps.hour_map(spark, d)
    view = maps.chrom_view(m.bins)
    return rounded(expected.obs_over_exp(m, view, expected.expected_full(m, view)), 5)


@query("coverage_raw", "SELECT bin_id, CAST(coalesce(cis, 0) AS BIGINT) AS cov_cis, CAST(coalesce(tot, 0) AS BIGINT) AS cov_tot FROM bins LEFT JOIN (SELECT b AS bin_id, sum(CASE WHEN c1 = c2 THEN cnt END) AS cis, sum(cnt) AS tot FROM (SELECT bin1_id AS b, * FROM px UNION ALL SELECT bin2_id, * FROM px) u GROUP BY 1) s USING (bin_id)")
def _(spark, d):
    return profiles.coverage(maps.hour_map(spark, d)).select("bin_id", "cov_cis", "cov_tot")


@query("coverage_balanced", "SELECT bin_id, round(CASE WHEN w IS NOT NULL THEN coalesce(cis, 0) END, 5) AS cov_cis, round(CASE WHEN w IS NOT NULL THEN coalesce(tot, 0) END, 5) AS cov_tot FROM bins LEFT JOIN (SELECT b AS bin_id, sum(CASE WHEN c1 = c2 THEN coalesce(bal, 0) END) AS cis, sum(coalesce(bal, 0)) AS tot FROM (SELECT bin1_id AS b, * FROM px WHERE d >= 2 UNION ALL SELECT bin2_id, * FROM px WHERE d >= 2) u GROUP BY 1) s USING (bin_id)")
def _(spark, d):
    return rounded(profiles.coverage(maps.hour_map(spark, d), weighted=True, ignore_diags=2).select("bin_id", "cov_cis", "cov_tot"), 5)


_GOOD = "g AS (SELECT b AS bin_id FROM (SELECT bin1_id AS b, * FROM px UNION ALL SELECT bin2_id, * FROM px) u GROUP BY 1 HAVING coalesce(sum(CASE WHEN c1 = c2 THEN cnt END), 0) * 1.0e0 / sum(cnt) > 0.25)"


@query("cis_total_ratio", f", {_GOOD} SELECT bin_id, bin_id IN (SELECT bin_id FROM g) AS good FROM bins")
def _(spark, d):
    return profiles.cis_total_ratio(maps.hour_map(spark, d), 0.25)


@query("filtered_map", f", {_GOOD} SELECT bin1_id, bin2_id, cnt AS n FROM pix WHERE bin1_id IN (SELECT bin_id FROM g) AND bin2_id IN (SELECT bin_id FROM g)")
def _(spark, d):
    m = maps.hour_map(spark, d)
    mask = profiles.bin_mask(m, [lambda c: profiles.cis_total_ratio(c, 0.25)])
    return profiles.filtered(m, mask).pixels.select("bin1_id", "bin2_id", F.col("count").alias("n"))


@query("virtual4c", "SELECT b.bin_id, round(v, 6) AS value FROM bins b LEFT JOIN (SELECT o, avg(bal) AS v FROM (SELECT bin2_id AS o, bal FROM px WHERE bin1_id BETWEEN 200 AND 209 AND bin2_id NOT BETWEEN 200 AND 209 UNION ALL SELECT bin1_id, bal FROM px WHERE bin2_id BETWEEN 200 AND 209 AND bin1_id NOT BETWEEN 200 AND 209) u GROUP BY 1) s ON s.o = b.bin_id")
def _(spark, d):
    return rounded(profiles.virtual4c(maps.hour_map(spark, d), "c2", 20 * 3600, 30 * 3600).select("bin_id", "value"))


_DB = " + ".join(f"CASE WHEN d * 3600 >= {3600 * k} THEN 1 ELSE 0 END" for k in EDGES)


@query("cross_score", f", x AS (SELECT bin1_id, bin2_id, cnt, {_DB} AS db FROM px WHERE c1 = c2), y AS (SELECT bin1_id AS bin_id, db, 'down' AS dir, cnt FROM x UNION ALL SELECT bin2_id, db, 'up', cnt FROM x UNION ALL SELECT bin1_id, db, 'both', cnt FROM x UNION ALL SELECT bin2_id, db, 'both', cnt FROM x) SELECT bin_id, db AS dist_bin, dir, CAST(sum(cnt) AS BIGINT) AS score FROM y WHERE db < {len(EDGES)} GROUP BY 1, 2, 3")
def _(spark, d):
    return profiles.cross_score(maps.hour_map(spark, d), [3600 * k for k in EDGES])


@plain("pair_scaling", "WITH p AS (SELECT abs(b.o_custkey - a.o_custkey) AS d FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1), n AS (SELECT " + " + ".join(f"CASE WHEN d >= {k} THEN 1 ELSE 0 END" for k in EDGES) + f" AS b FROM p) SELECT list_extract({EDGES}, b) AS dist_lo, list_extract({EDGES}, b + 1) AS dist_hi, count(*) AS n_pairs, 0.5e0 * (pow(200 - list_extract({EDGES}, b), 2) - pow(200 - list_extract({EDGES}, b + 1), 2)) AS area FROM n WHERE b > 0 AND b < {len(EDGES)} GROUP BY b")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    pairs = o.select("o_orderkey", F.col("o_custkey").alias("pos1")).join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("pos2")), "o_orderkey")
    return profiles.pair_scaling(pairs, EDGES, 200)


_INS = """, bd AS (SELECT a.chrom, a.bin_id AS i, b.bin_id AS j, coalesce(p.cnt, 0) AS cnt, coalesce(p.cnt, 0) * a.w * b.w AS v FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.bin_id - a.bin_id BETWEEN 2 AND 18 LEFT JOIN pix p ON p.bin1_id = a.bin_id AND p.bin2_id = b.bin_id WHERE a.w IS NOT NULL AND b.w IS NOT NULL),
x AS (SELECT chrom, cnt, v, unnest(range(greatest(i, j - 9), least(j, i + 9) + 1)) AS q FROM bd),
s AS (SELECT q AS bin_id, count(*) AS n, sum(cnt) AS sc, sum(v) AS sb FROM x GROUP BY 1),
f AS (SELECT b.bin_id, b.chrom, b.w, coalesce(n, 0) AS n, sc, sb, sb / nullif(n, 0) AS score FROM bins b LEFT JOIN s USING (bin_id)),
md AS (SELECT chrom, median(score) AS m FROM f GROUP BY 1),
ins AS (SELECT bin_id, f.chrom, w IS NULL AS bad, n, sc, sb, CASE WHEN score / m > 0 THEN log2(score / m) END AS l FROM f JOIN md USING (chrom))"""


@query("insulation_10", _INS + " SELECT bin_id, chrom AS region, bad AS is_bad_bin, round(l, 6) AS log2_score, n AS n_valid, CAST(sc AS BIGINT) AS sum_counts, round(sb, 5) AS sum_balanced FROM ins")
def _(spark, d):
    m = maps.hour_map(spark, d)
    out = bands.insulation(m, maps.chrom_view(m.bins), 10).drop("chrom", "start", "end")
    return rounded(out.withColumn("sum_balanced", F.round("sum_balanced", 5)))


_STRENGTHS = _INS + """, ok AS (SELECT bin_id, chrom, -round(l, 9) AS v, row_number() OVER (PARTITION BY chrom ORDER BY bin_id) AS i FROM ins WHERE l IS NOT NULL AND n >= 0.66 * (SELECT max(n) FROM ins)),
nb AS (SELECT *, lag(v) OVER (PARTITION BY chrom ORDER BY i) AS a, lead(v) OVER (PARTITION BY chrom ORDER BY i) AS b FROM ok),
pk AS (SELECT * FROM nb WHERE v > a AND v > b), lw AS (SELECT chrom, min(v) AS m FROM nb WHERE v < a AND v < b GROUP BY 1), mn AS (SELECT chrom, min(v) AS m FROM ok GROUP BY 1),
h AS (SELECT pk.chrom, pk.i, pk.v, pk.bin_id, (SELECT max(o.i) FROM ok o WHERE o.chrom = pk.chrom AND o.i < pk.i AND o.v > pk.v) AS l, (SELECT min(o.i) FROM ok o WHERE o.chrom = pk.chrom AND o.i > pk.i AND o.v > pk.v) AS r FROM pk),
k AS (SELECT h.*, (SELECT min(o.v) FROM ok o WHERE o.chrom = h.chrom AND o.i >= h.l AND o.i < h.i) AS ml, (SELECT min(o.v) FROM ok o WHERE o.chrom = h.chrom AND o.i > h.i AND o.i < h.r) AS mr FROM h)"""


@query("boundaries_10", _STRENGTHS + """
SELECT bin_id, round(CASE WHEN l IS NULL AND r IS NULL THEN v - coalesce(lw.m, mn.m) WHEN l IS NULL THEN v - mr WHEN r IS NULL THEN v - ml ELSE least(v - ml, v - mr) END, 6) AS boundary_strength,
  CASE WHEN l IS NULL AND r IS NULL THEN v - coalesce(lw.m, mn.m) WHEN l IS NULL THEN v - mr WHEN r IS NULL THEN v - ml ELSE least(v - ml, v - mr) END >= 0.1 AS is_boundary
FROM k LEFT JOIN lw USING (chrom) JOIN mn USING (chrom)""")
def _(spark, d):
    m = maps.hour_map(spark, d)
    scores = bands.insulation(m, maps.chrom_view(m.bins), 10).withColumn("log2_score", F.round("log2_score", 9))
    called = bands.call_boundaries(bands.boundaries(scores), 0.1)
    return rounded(called.where("boundary_strength is not null").select("bin_id", "boundary_strength", "is_boundary"))


@query("directionality_10", """, s AS (SELECT bin_id, sum(a) AS a, sum(b) AS b FROM (SELECT bin1_id AS bin_id, 0.0e0 AS a, bal AS b FROM px WHERE c1 = c2 AND d >= 2 AND d < 10 AND bal IS NOT NULL UNION ALL SELECT bin2_id, bal, 0.0e0 FROM px WHERE c1 = c2 AND d >= 2 AND d < 10 AND bal IS NOT NULL) u GROUP BY 1),
n AS (SELECT bin_id, max(CASE WHEN w IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY bin_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR bin_id % 180 = 0 OR bin_id % 180 = 179 AS m FROM bins)
SELECT n.bin_id, m AS bad_bin_masked, round(CASE WHEN NOT m THEN (b - a) / nullif(a + b, 0) END, 6) AS directionality_ratio,
 round(CASE WHEN NOT m THEN sign(b - a) * (pow(a - (a + b) / 2, 2) + pow(b - (a + b) / 2, 2)) / nullif((a + b) / 2, 0) END, 6) AS directionality_index FROM n LEFT JOIN s USING (bin_id)""")
def _(spark, d):
    return rounded(bands.directionality(maps.hour_map(spark, d), 10).drop("chrom", "start", "end"))


@query("dist_bad_bin", """, l AS (SELECT bin_id, bin_id - coalesce(max(CASE WHEN w IS NULL THEN bin_id END) OVER (PARTITION BY chrom ORDER BY bin_id), bin_id // 180 * 180 - 1) AS a, coalesce(min(CASE WHEN w IS NULL THEN bin_id END) OVER (PARTITION BY chrom ORDER BY bin_id DESC), bin_id // 180 * 180 + 180) - bin_id AS b FROM bins)
SELECT bin_id, a AS dist_left, b AS dist_right, least(a, b) AS dist_min, greatest(a, b) AS dist_max FROM l""")
def _(spark, d):
    bins = maps.hour_map(spark, d).bins.withColumn("bad", F.col("weight").isNull())
    return columns.distance_to_mask(bins, "bad", "chrom", "bin_id").select("bin_id", "dist_left", "dist_right", "dist_min", "dist_max")


@query("digitize_values", "SELECT bin_id, cls FROM tk", ("cls",))
def _(spark, d):
    return _digitized(maps.hour_map(spark, d))


@query("digitize_quantiles", ", t AS (SELECT bin_id, CASE WHEN w IS NOT NULL THEN CAST(cov AS DOUBLE) END AS v FROM bins LEFT JOIN cov USING (bin_id)), q AS (SELECT quantile_cont(v, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM t) SELECT bin_id, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(q, lambda x: x <= v)) END AS cls FROM t, q")
def _(spark, d):
    m = maps.hour_map(spark, d)
    cov = profiles.coverage(m).select("bin_id", F.when(F.col("weight").isNotNull(), F.col("cov_tot").cast("double")).alias("value"))
    return compartments.digitize(cov, 4, qrange=(0.1, 0.9)).select("bin_id", "cls")


_SADDLE = """, pr AS (SELECT a.cls AS ci, b.cls AS cj, coalesce(p.cnt, 0) * a.w * b.w / nullif(x.balanced_avg, 0e0) AS oe FROM tk a JOIN tk b ON a.chrom = b.chrom LEFT JOIN pix p ON p.bin1_id = least(a.bin_id, b.bin_id) AND p.bin2_id = greatest(a.bin_id, b.bin_id)
JOIN ex x ON x.region = a.chrom AND x.dist = abs(a.bin_id - b.bin_id) WHERE abs(a.bin_id - b.bin_id) >= 3 AND a.cls >= 0 AND b.cls >= 0),
o AS (SELECT ci, cj, sum(oe) AS s, count(oe) AS c FROM pr GROUP BY 1, 2), sd AS (SELECT ci, cj, sum(s) AS s, sum(c) AS c FROM (SELECT * FROM o UNION ALL SELECT cj, ci, s, c FROM o) u GROUP BY 1, 2)"""


def _saddle(m):
    return compartments.saddle_cis(m, _digitized(m), maps.chrom_view(m.bins), _cis(m), 4)


@query("saddle_cis", _SADDLE + " SELECT ci, cj, round(s, 4) AS s, CAST(c AS BIGINT) AS c FROM sd", ("cis", "cls"))
def _(spark, d):
    return rounded(_saddle(maps.hour_map(spark, d)), 4)


@query("saddle_strength", _SADDLE + """, r AS (SELECT k.k, s, c, ci <= k.k AS li, cj <= k.k AS lj, ci > 4 - k.k AS hi, cj > 4 - k.k AS hj FROM sd, (SELECT unnest([1, 2, 3]) AS k) k WHERE ci BETWEEN 1 AND 4 AND cj BETWEEN 1 AND 4)
SELECT k AS extent, round(((sum(CASE WHEN li AND lj THEN s ELSE 0 END) + sum(CASE WHEN hi AND hj THEN s ELSE 0 END)) / (sum(CASE WHEN li AND lj THEN c ELSE 0 END) + sum(CASE WHEN hi AND hj THEN c ELSE 0 END)))
 / ((sum(CASE WHEN li AND hj THEN s ELSE 0 END) + sum(CASE WHEN hi AND lj THEN s ELSE 0 END)) / (sum(CASE WHEN li AND hj THEN c ELSE 0 END) + sum(CASE WHEN hi AND lj THEN c ELSE 0 END))), 6) AS strength FROM r GROUP BY k UNION ALL SELECT 0, 0.0""", ("cis", "cls"))
def _(spark, d):
    return rounded(compartments.saddle_strength(_saddle(maps.hour_map(spark, d)), 4))


@query("saddle_trans", """, o AS (SELECT a.cls AS ci, b.cls AS cj, sum(coalesce(p.cnt, 0) * a.w * b.w / nullif(t.balanced_sum / t.n_valid, 0)) AS s, count(a.w * b.w) AS c FROM tk a JOIN tk b ON a.chrom < b.chrom LEFT JOIN pix p ON p.bin1_id = a.bin_id AND p.bin2_id = b.bin_id JOIN tr t ON t.region1 = a.chrom AND t.region2 = b.chrom WHERE a.cls >= 0 AND b.cls >= 0 GROUP BY 1, 2)
SELECT ci, cj, round(sum(s), 3) AS s, CAST(sum(c) AS BIGINT) AS c FROM (SELECT * FROM o UNION ALL SELECT cj, ci, s, c FROM o) u GROUP BY 1, 2""", ("trans", "cls"))
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(compartments.saddle_trans(m, _digitized(m), expected.expected_trans(m, maps.chrom_view(m.bins)), 4), 3)


_CON = ", ce AS (SELECT abs(a.bin_id - b.bin_id) AS dist, coalesce(p.cnt, 0) * a.w * b.w AS v, a.bin_id // 20 % 2 AS ta, b.bin_id // 20 % 2 AS tb FROM bins a JOIN bins b ON a.chrom = b.chrom LEFT JOIN pix p ON p.bin1_id = least(a.bin_id, b.bin_id) AND p.bin2_id = greatest(a.bin_id, b.bin_id)), ci AS (SELECT dist, v, CASE WHEN ta = tb THEN 1 ELSE 0 END AS ind FROM ce), cd AS (SELECT dist, count(CASE WHEN ind = 1 THEN v END) AS n1, count(CASE WHEN ind = 0 THEN v END) AS n2, avg(CASE WHEN ind = 1 THEN v END) AS a, avg(CASE WHEN ind = 0 THEN v END) AS b FROM ci GROUP BY 1)"


def _contrast(m):
    bins = joins.assign_supports(m.bins, maps.chrom_view(m.bins)).withColumn("t", F.floor(F.col("bin_id") / 20) % 2)
    cells = compartments.region_cells(m, bins, ["t"])
    return compartments.contrast_by_diag(cells.withColumn("ind", compartments.indicator("any_mixed", F.col("ti"), F.col("tj"))))


@query("contrast_by_diag", _CON + " SELECT dist, n1, n2, round(a / nullif(b, 0), 6) AS contrast FROM cd")
def _(spark, d):
    return rounded(_contrast(maps.hour_map(spark, d)))


@query("contrast", _CON + " SELECT round(sum(sqrt(n1 * n2) * a / nullif(b, 0)) / sum(CASE WHEN a / nullif(b, 0) IS NOT NULL THEN sqrt(n1 * n2) END), 6) AS contrast FROM cd WHERE dist >= 1")
def _(spark, d):
    return rounded(compartments.contrast(_contrast(maps.hour_map(spark, d))))


@query("oe_log_distance", f", ce AS (SELECT a.chrom AS region, a.bin_id AS i, b.bin_id AS j, coalesce(p.cnt, 0) * a.w * b.w AS v, {_DB.replace('d * 3600', 'abs(a.bin_id - b.bin_id) * 3600')} AS db FROM bins a JOIN bins b ON a.chrom = b.chrom LEFT JOIN pix p ON p.bin1_id = least(a.bin_id, b.bin_id) AND p.bin2_id = greatest(a.bin_id, b.bin_id) WHERE a.w IS NOT NULL AND b.w IS NOT NULL) SELECT region, i, j, round(v / coalesce(nullif(avg(v) OVER (PARTITION BY region, db), 0), 1), 5) AS oe FROM ce")
def _(spark, d):
    m = maps.hour_map(spark, d)
    bins = joins.assign_supports(m.bins, maps.chrom_view(m.bins))
    return rounded(compartments.oe_by_log_distance(compartments.region_cells(m, bins, []), EDGES), 5)


def _features(m, two: bool = False):
    f = m.bins.where("bin_id % 45 = 20").select(F.col("bin_id").alias("snip_id"), "chrom", "start", "end")
    if not two:
        return f
    return f.select("snip_id", F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), (F.col("start") + 36000).alias("start2"), (F.col("end") + 36000).alias("end2"))


_SNIP = """, fe AS (SELECT bin_id AS snip_id, bin_id AS c, chrom FROM bins WHERE bin_id % 45 = 20), st AS (SELECT snip_id, i, j, a.w AS wa, b.w AS wb, x.bin_id AS xi FROM fe, (SELECT unnest(range(0, 11)) AS i) ii, (SELECT unnest(range(0, 11)) AS j) jj, bins a, bins b, (SELECT 0 AS bin_id) x WHERE a.bin_id = c - 5 + i AND b.bin_id = c - 5 + j),
sv AS (SELECT fe.snip_id, i, j, CASE WHEN abs(i - j) >= 2 THEN coalesce(p.cnt, 0) * wa * wb END AS v, abs(i - j) AS dist, chrom FROM st JOIN fe USING (snip_id) LEFT JOIN pix p ON p.bin1_id = c - 5 + least(i, j) AND p.bin2_id = c - 5 + greatest(i, j))"""


@query("pileup_bed", _SNIP + " SELECT i, j, round(avg(v), 6) AS value FROM sv GROUP BY 1, 2")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(snip.pileup(snip.snippets(m, _features(m), maps.chrom_view(m.bins), flank=5 * 3600)))


@query("pileup_median", _SNIP + " SELECT i, j, round(median(v), 6) AS value FROM sv GROUP BY 1, 2")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(snip.pileup(snip.snippets(m, _features(m), maps.chrom_view(m.bins), flank=5 * 3600), "median"))


@query("pileup_oe", _SNIP + " SELECT i, j, round(avg(v / nullif(balanced_avg, 0)), 6) AS value FROM sv LEFT JOIN ex ON ex.region = sv.chrom AND ex.dist = sv.dist GROUP BY 1, 2", ("cis",))
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(snip.pileup(snip.snippets(m, _features(m), maps.chrom_view(m.bins), flank=5 * 3600, expected=_cis(m))))


@query("snippets_bedpe", """, fe AS (SELECT bin_id AS c, chrom FROM bins WHERE bin_id % 45 = 20), g AS (SELECT c, i, j, c - 3 + i AS x, c + 7 + j AS y, c % 180 + 13 < 180 AS ok FROM fe, (SELECT unnest(range(0, 7)) AS i) ii, (SELECT unnest(range(0, 7)) AS j) jj)
SELECT c AS snip_id, i, j, round(CASE WHEN ok AND y - x >= 2 THEN coalesce(p.cnt, 0) * a.w * b.w END, 6) AS value FROM g LEFT JOIN bins a ON a.bin_id = x LEFT JOIN bins b ON b.bin_id = y LEFT JOIN pix p ON p.bin1_id = least(x, y) AND p.bin2_id = greatest(x, y)""")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(snip.snippets(m, _features(m, True), maps.chrom_view(m.bins), flank=3 * 3600))


_LOGBIN = """, lbn AS (SELECT region, sum(n_valid) AS n_valid, sum(count_sum) AS cs, sum(balanced_sum) AS bs, sum(dist * n_valid) AS dn, b FROM (SELECT *, len(list_filter({e}, lambda z: z <= dist)) - 1 AS b FROM ex) u WHERE b >= 0 GROUP BY region, b),
lk AS (SELECT region, b, n_valid, cs, bs, dn * 1.0e0 / n_valid AS da, bs / n_valid AS p FROM lbn WHERE n_valid > 20 AND bs / n_valid > 0 AND cs > 5)""".replace("{e}", str(arrays.persistent_log_bins().tolist()[:60]))


def _logbin(m):
    return expected.logbin(_cis(m), min_nvalid=20, min_count=5)


@query("logbin", _LOGBIN + f" SELECT region AS region1, region AS region2, b AS dist_bin_id, CAST(n_valid AS BIGINT) AS n_valid, CAST(cs AS DOUBLE) AS count_sum, round(bs, 5) AS balanced_sum, round(da, 6) AS dist_avg, round(p, 6) AS balanced_avg, list_extract({arrays.persistent_log_bins().tolist()[:60]}, b + 1) AS dist_bin_start, list_extract({arrays.persistent_log_bins().tolist()[:60]}, b + 2) - 1 AS dist_bin_end FROM lk", ("cis",))
def _(spark, d):
    return rounded(_logbin(maps.hour_map(spark, d)).withColumn("balanced_sum", F.round("balanced_sum", 5)))


@query("logbin_slopes", _LOGBIN + ", y AS (SELECT region, b, least(n_valid, lead(n_valid) OVER u) AS n, sqrt(da * lead(da) OVER u) AS da, (ln(lead(p) OVER u) - ln(p)) / nullif(ln(lead(da) OVER u) - ln(da), 0) AS slope, lead(p) OVER u AS nx FROM lk WINDOW u AS (PARTITION BY region ORDER BY b)) SELECT region AS region1, region AS region2, b AS dist_bin_id, CAST(n AS BIGINT) AS n_valid, round(da, 6) AS dist_avg, round(slope, 5) AS slope FROM y WHERE slope IS NOT NULL", ("cis",))
def _(spark, d):
    return rounded(expected.slopes(_logbin(maps.hour_map(spark, d)), None).withColumn("slope", F.round("slope", 5)))


def _smoothed(rows: str, part: str, sigma: float) -> str:
    """CTEs g (rows with smoothed logarithms lx, ly) and z (slopes between them)."""
    reach, by = int(4 * sigma + 0.5), f"PARTITION BY {part} ORDER BY b" if part else "ORDER BY b"
    w = f"exp(-pow(o.i - a.i, 2) / {2 * sigma * sigma!r}e0)"
    same = f"o.{part} = a.{part} AND " if part else ""
    keep = f"a.{part}, " if part else ""
    return f""", nr AS (SELECT *, row_number() OVER ({by}) AS i FROM {rows}),
g AS (SELECT {keep}a.b, a.n_valid, a.da, sum({w} * ln(o.da)) / sum({w}) AS lx, sum({w} * ln(o.p)) / sum({w}) AS ly FROM nr a JOIN nr o ON {same}abs(o.i - a.i) <= {reach} GROUP BY {keep}a.b, a.n_valid, a.da),
z AS (SELECT {keep.replace("a.", "")}b, least(n_valid, lead(n_valid) OVER u) AS n, sqrt(da * lead(da) OVER u) AS da, (lead(ly) OVER u - ly) / nullif(lead(lx) OVER u - lx, 0) AS slope FROM g WINDOW u AS ({by}))"""


@query("logbin_slopes_smoothed", _LOGBIN + _smoothed("lk", "region", 2.0) + " SELECT region AS region1, region AS region2, b AS dist_bin_id, CAST(n AS BIGINT) AS n_valid, round(da, 6) AS dist_avg, round(slope, 5) AS slope FROM z WHERE slope IS NOT NULL", ("cis",))
def _(spark, d):
    return rounded(expected.slopes(_logbin(maps.hour_map(spark, d))).withColumn("slope", F.round("slope", 5)))


_OVER_ALL = ", al AS (SELECT b, sum(n_valid) AS n_valid, sum(n_valid * da) / sum(n_valid) AS da, sum(n_valid * p) / sum(n_valid) AS p FROM lk GROUP BY b)"
_BY_REGION = ", sr AS (SELECT * FROM z), sm AS (SELECT b, sum(n * slope) / sum(n) AS m FROM sr WHERE slope IS NOT NULL GROUP BY b), ss AS (SELECT sr.b, sqrt(sum(n * pow(slope - m, 2)) / sum(n)) AS s FROM sr JOIN sm USING (b) WHERE slope IS NOT NULL GROUP BY sr.b)"


@query("combined_slopes", _LOGBIN + _smoothed("lk", "region", 2.0) + _BY_REGION + _OVER_ALL + _smoothed("al", "", 1.3).replace(" nr ", " nr2 ").replace("nr a", "nr2 a").replace("nr o", "nr2 o").replace("\ng AS", "\ng2 AS").replace("FROM g ", "FROM g2 ").replace("\nz AS", "\nz2 AS") + " SELECT z2.b AS dist_bin_id, CAST(n AS BIGINT) AS n_valid, round(da, 6) AS dist_avg, round(slope, 5) AS slope, round(slope - s, 5) AS low_err, round(slope + s, 5) AS high_err FROM z2 LEFT JOIN ss ON ss.b = z2.b WHERE slope IS NOT NULL", ("cis",))
def _(spark, d):
    binned = _logbin(maps.hour_map(spark, d))
    found = expected.combined_slopes(expected.combine_binned(binned), expected.slopes(binned))
    return rounded(found.withColumns({c: F.round(c, 5) for c in ("slope", "low_err", "high_err")}))


@query("combine_binned", _LOGBIN + """, mm AS (SELECT b, sum(n_valid) AS n, sum(n_valid * da) / sum(n_valid) AS da, sum(n_valid * p) / sum(n_valid) AS p, sum(n_valid * ln(p)) / sum(n_valid) AS lm FROM lk GROUP BY b), sp AS (SELECT lk.b, exp(sqrt(greatest(sum(n_valid * pow(ln(lk.p) - lm, 2)) / sum(n_valid), 0))) AS ls FROM lk JOIN mm USING (b) GROUP BY lk.b),
xt AS (SELECT b, min(p) AS lo, max(p) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY b DESC) AS k FROM lk) u WHERE k > 2 GROUP BY b)
SELECT b AS dist_bin_id, CAST(n AS BIGINT) AS n_valid, round(da, 6) AS dist_avg, round(p, 6) AS balanced_avg, round(ls, 5) AS logstd, round(lo, 6) AS low, round(hi, 6) AS high FROM mm JOIN sp USING (b) LEFT JOIN xt USING (b)""", ("cis",))
def _(spark, d):
    return rounded(expected.combine_binned(_logbin(maps.hour_map(spark, d))).withColumn("logstd", F.round("logstd", 5)))


@query("log_smooth_exact", ", x AS (SELECT region, dist, log10(dist) AS l, n_valid AS v FROM ex WHERE dist > 0) SELECT a.region AS region1, a.dist, round(sum(exp(-pow(b.l - a.l, 2) / 0.02e0) * b.v) / sum(exp(-pow(b.l - a.l, 2) / 0.02e0)), 4) AS smoothed FROM x a JOIN x b ON a.region = b.region AND b.l >= a.l - 0.5e0 AND b.l < a.l + 0.5e0 GROUP BY 1, 2", ("cis",))
def _(spark, d):
    return rounded(expected.log_smooth_exact(_cis(maps.hour_map(spark, d)), "n_valid"), 4)


def _scores(m):
    kernels = {k: np.array(v) for k, v in ASYMMETRIC.items()}
    return dots.scores(m, maps.chrom_view(m.bins), _cis(m), kernels, band=BAND)


@query("dots_neighbourhoods", " SELECT i AS bin1_id, j AS bin2_id, cnt AS n, k AS kernel, round(la, 5) AS la_exp FROM sc", ("cis", "around"))
def _(spark, d):
    m = maps.hour_map(spark, d)
    found = dots.scores(m, maps.chrom_view(m.bins), _cis(m), RECOMMENDED, band=30)
    return rounded(found.select("bin1_id", "bin2_id", F.col("count").alias("n"), "kernel", "la_exp"), 5)


@query("dots_scores", " SELECT i AS bin1_id, j AS bin2_id, cnt AS n, k AS kernel, round(la, 5) AS la_exp FROM sc", ("cis", "band"))
def _(spark, d):
    return rounded(_scores(maps.hour_map(spark, d)).select("bin1_id", "bin2_id", F.col("count").alias("n"), "kernel", "la_exp"), 5)


_E12 = [round(v, 9) for v in dots.lambda_edges(12)]


def _hist(m):
    return dots.histogram(_scores(m).withColumn("la_exp", F.round("la_exp", 9)), _E12)


@query("dots_histogram", " SELECT k AS kernel, lbin, cnt AS n_contacts, count(*) AS n FROM lb GROUP BY 1, 2, 3", ("cis", "band"))
def _(spark, d):
    return _hist(maps.hour_map(spark, d)).withColumnRenamed("count", "n_contacts")


_LIMITS = """, hs AS (SELECT k, lbin, cnt, count(*) AS n FROM lb GROUP BY 1, 2, 3), gr AS (SELECT * FROM (SELECT DISTINCT k, cnt FROM hs) a JOIN (SELECT DISTINCT k, lbin FROM hs) b USING (k)),
pt AS (SELECT b, k, exp(-l + k * ln(l) - lgamma(k + 1)) AS p FROM (SELECT unnest(range(0, 12)) AS b, unnest([{edges}]) AS l) u, (SELECT unnest(range(0, 400)) AS k) v),
sf AS (SELECT lbin, cnt, (SELECT sum(p) FROM pt WHERE pt.b = g.lbin AND pt.k > g.cnt) AS sf FROM (SELECT DISTINCT lbin, cnt FROM gr) g),
f AS (SELECT gr.k, gr.lbin, gr.cnt, coalesce(n, 0) AS n, sf.sf FROM gr JOIN sf ON sf.lbin = gr.lbin AND sf.cnt = gr.cnt LEFT JOIN hs ON hs.k = gr.k AND hs.lbin = gr.lbin AND hs.cnt = gr.cnt),
u AS (SELECT *, sum(n) OVER (PARTITION BY k, lbin ORDER BY cnt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rcs, sum(n) OVER (PARTITION BY k, lbin) * sf AS u FROM f),
w AS (SELECT *, max({fdr}e0 * rcs - u) OVER (PARTITION BY k, lbin ORDER BY cnt) AS best, least(min(u / nullif(rcs, 0)) OVER (PARTITION BY k, lbin ORDER BY cnt), 1) AS q FROM u),
th AS (SELECT k, lbin, cnt, coalesce(min(CASE WHEN best >= 0 THEN cnt END) OVER (PARTITION BY k, lbin), max(cnt) OVER (PARTITION BY k, lbin) + 1) AS threshold, q FROM w)"""


def _limits(fdr: float) -> str:
    return _LIMITS.format(fdr=fdr, edges=", ".join(f"{v!r}e0" for v in _E12))


@query("dots_thresholds", _limits(0.1) + " SELECT k AS kernel, lbin, cnt AS n_contacts, threshold, round(q, 6) AS qval FROM th", ("cis", "band"))
def _(spark, d):
    limits = dots.thresholds(_hist(maps.hour_map(spark, d)).persist(), _E12, 0.1, open_bin=True)
    return rounded(limits.withColumnRenamed("count", "n_contacts"))


_WIDE = ", ".join(f"round(max(CASE WHEN lb.k = '{k}' THEN la END), 5) AS la_{k}, round(max(CASE WHEN lb.k = '{k}' THEN q END), 6) AS q_{k}" for k in RECOMMENDED)


@query("dots_pixels", _limits(0.2) + f" SELECT lb.i AS bin1_id, lb.j AS bin2_id, lb.cnt AS n, {_WIDE} FROM lb JOIN th ON th.k = lb.k AND th.lbin = lb.lbin AND th.cnt = lb.cnt WHERE lb.cnt >= threshold GROUP BY 1, 2, 3 HAVING count(*) = 4", ("cis", "around"))
def _(spark, d):
    m = maps.hour_map(spark, d)
    found = dots.dots(m, maps.chrom_view(m.bins), _cis(m), RECOMMENDED, band=30, fdr=0.2, n_lambda_bins=12, radius_bins=None, open_bin=True)
    las, qs = ([f"{c}_{k}" for k in RECOMMENDED] for c in ("la", "q"))
    return found.select("bin1_id", "bin2_id", F.col("count").alias("n"), *(F.round(c, 5).alias(c) for c in las), *(F.round(c, 6).alias(c) for c in qs))


@plain("dots_called")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return dots.dots(m, maps.chrom_view(m.bins), _cis(m), RECOMMENDED, band=30, fdr=0.2)


@query("matvec", ", x AS (SELECT bin_id, 1.0e0 + bin_id % 7 AS x FROM bins) SELECT bin_id, round(sum(v), 4) AS y FROM (SELECT bin1_id AS bin_id, cnt * x AS v FROM pix JOIN x ON x.bin_id = bin2_id UNION ALL SELECT bin2_id, cnt * x FROM pix JOIN x ON x.bin_id = bin1_id WHERE bin1_id <> bin2_id) u GROUP BY 1")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(matrix.matvec(m.pixels, m.bins.select("bin_id", (1.0 + F.col("bin_id") % 7).alias("x"))), 4)


@query("ice_step", ", y AS (SELECT bin_id, CAST(sum(cnt) AS DOUBLE) AS s FROM (SELECT bin1_id AS bin_id, cnt FROM pix UNION ALL SELECT bin2_id, cnt FROM pix WHERE bin1_id <> bin2_id) u GROUP BY 1), r AS (SELECT bin_id, s / (SELECT avg(s) FROM y WHERE s <> 0) AS s FROM y) SELECT bin_id, round(1 / (1 + 0.8e0 * (s - 1)), 6) AS x, round(s, 6) AS s FROM r")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rounded(matrix.ice_step(m.pixels, m.bins.select("bin_id", F.lit(1.0).alias("x"))))


@plain("eigs_cis")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return compartments.eigs_cis(m, maps.chrom_view(m.bins), phasing=_track(m))


@plain("eigs_trans")
def _(spark, d):
    return compartments.eigs_trans(maps.hour_map(spark, d))


_SOLVED = ", k AS (SELECT unnest([1, 2, 3]) AS k) SELECT {region}CAST(k AS INTEGER) AS k, TRUE AS of_length, TRUE AS solved FROM {rows}k"


def _checked(entries: DataFrame, found: DataFrame, length):
    """Whether each vector has the length it should and solves the eigenvalue equation, by a product with the map."""
    rows = eigen.residuals(entries, found, 3)
    return rows.select("key", "k", (F.abs(F.col("norm") - length) < 1e-9 * F.col("norm")).alias("of_length"), (F.col("residual") < 1e-6).alias("solved"))


@query("eigs_cis_residuals", _SOLVED.format(region="region, ", rows="(SELECT DISTINCT chrom AS region FROM bins) r, "))
def _(spark, d):
    m = maps.hour_map(spark, d)
    view = maps.chrom_view(m.bins)
    kept = Kept(spark)
    entries, members = map(kept.table, compartments.cis_operator(m, view))
    found = compartments.eigs_of((entries, members), m, view, phasing=_track(m)).withColumnRenamed("region", "key")
    return _checked(entries, kept.table(found), F.sqrt(F.abs("eigval"))).withColumnRenamed("key", "region")


@query("eigs_trans_residuals", _SOLVED.format(region="", rows=""))
def _(spark, d):
    m = maps.hour_map(spark, d)
    kept = Kept(spark)
    entries, members = map(kept.table, compartments.trans_operator(m))
    found = kept.table(compartments.solved(entries, members, m.bins.select(F.lit("all").alias("key"), "bin_id"), 3))
    return _checked(entries, found, F.lit(1.0)).drop("key")


@plain("expected_smoothed")
def _(spark, d):
    return expected.smooth_cvd(expected.smooth_cvd(_cis(maps.hour_map(spark, d)), True), False)


@plain("expected_interpolated")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return expected.interpolate_expected(_cis(m), _logbin(m))


def _turned(spark):
    return maps.half_view(spark).where("region_idx in (0, 1, 5, 6)").withColumn("new_chrom", F.when(F.col("region_idx") < 2, "x").otherwise("y")).withColumn("strand", F.when(F.col("region_idx") % 2 == 1, "-").otherwise("+"))


_TURN = ", mp AS (SELECT bin_id, w, row_number() OVER (ORDER BY arm_idx, CASE WHEN arm_idx % 2 = 1 THEN -bin_id ELSE bin_id END) - 1 AS n, CASE WHEN arm_idx < 2 THEN 'x' ELSE 'y' END AS nc FROM bins WHERE arm_idx IN (0, 1, 5, 6))"


@query("rearrange_bins", _TURN + " SELECT bin_id, n AS new_id, nc AS new_chrom, CAST(n % 180 * 3600 AS BIGINT) AS new_start, CAST((n % 180 + 1) * 3600 AS BIGINT) AS new_end, round(w, 6) AS weight FROM mp")
def _(spark, d):
    return rounded(rearrange.rearrange_bins(maps.hour_map(spark, d).bins, _turned(spark)))


@query("rearrange_pixels", _TURN + " SELECT least(a.n, b.n) AS bin1_id, greatest(a.n, b.n) AS bin2_id, cnt AS n FROM pix JOIN mp a ON a.bin_id = bin1_id JOIN mp b ON b.bin_id = bin2_id")
def _(spark, d):
    m = maps.hour_map(spark, d)
    return rearrange.rearrange_pixels(m.pixels, rearrange.rearrange_bins(m.bins, _turned(spark))).withColumnRenamed("count", "n")


@query("coarsen", " SELECT bin1_id // 10 AS i, bin2_id // 10 AS j, CAST(sum(cnt) AS BIGINT) AS value FROM pix GROUP BY 1, 2")
def _(spark, d):
    px = maps.hour_map(spark, d).pixels.select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), F.col("count").alias("value"))
    return columns.coarsen(px, 10)


@query("run_lengths", ", r AS (SELECT bin_id, chrom, w IS NULL AS v, bin_id - row_number() OVER (PARTITION BY chrom, w IS NULL ORDER BY bin_id) AS g FROM bins) SELECT chrom, min(bin_id) AS start_bin, count(*) AS n, v AS value FROM r GROUP BY chrom, v, g")
def _(spark, d):
    bins = maps.hour_map(spark, d).bins.withColumn("bad", F.col("weight").isNull())
    return columns.run_lengths(bins, "bad", "chrom", "bin_id").select("chrom", F.col("start").alias("start_bin"), F.col("length").alias("n"), "value")


@query("robust_scores", ", m AS (SELECT chrom, median(w) AS md, avg(w) AS av, stddev_pop(w) AS sd FROM bins GROUP BY 1), a AS (SELECT chrom, median(abs(w - md)) AS mad FROM bins JOIN m USING (chrom) GROUP BY 1) SELECT bin_id, round(mad, 6) AS mad, round((w - av) / nullif(sd, 0), 5) AS z, round((w - md) / nullif(mad, 0), 5) AS by_mad, round((w - md) * 0.67449e0 / nullif(mad, 0), 5) AS madz FROM bins JOIN m USING (chrom) JOIN a USING (chrom)")
def _(spark, d):
    return rounded(columns.scores(maps.hour_map(spark, d).bins, "weight", "chrom").select("bin_id", F.round("mad", 6).alias("mad"), *(F.round(c, 5).alias(c) for c in ("z", "by_mad", "madz"))))


@query("comedian", ", m AS (SELECT chrom, median(w) AS x, median(sin(bin_id / 25.0e0)) AS y FROM bins GROUP BY 1) SELECT chrom, round(median((w - x) * (sin(bin_id / 25.0e0) - y)), 6) AS comed FROM bins JOIN m USING (chrom) GROUP BY 1")
def _(spark, d):
    bins = maps.hour_map(spark, d).bins.withColumn("s", F.sin(F.col("bin_id") / 25.0))
    return rounded(columns.comedian(bins, "weight", "s", "chrom"))


@query("interpolate_nulls", ", n AS (SELECT bin_id, chrom, w, max(CASE WHEN w IS NOT NULL THEN bin_id END) OVER (PARTITION BY chrom ORDER BY bin_id) AS a, min(CASE WHEN w IS NOT NULL THEN bin_id END) OVER (PARTITION BY chrom ORDER BY bin_id DESC) AS b FROM bins) SELECT n.bin_id, round(coalesce(n.w, x.w + (n.bin_id - n.a) * (y.w - x.w) / nullif(n.b - n.a, 0), x.w, y.w), 6) AS filled FROM n LEFT JOIN bins x ON x.bin_id = n.a LEFT JOIN bins y ON y.bin_id = n.b")
def _(spark, d):
    return rounded(columns.interpolate_nulls(maps.hour_map(spark, d).bins, "weight", "chrom", "bin_id").select("bin_id", "filled"))


@query("box_smooth", ", o AS (SELECT unnest(range(-3, 4)) AS k) SELECT b.bin_id, round(avg(coalesce(c.cov, 0)), 6) AS smooth FROM bins b, o LEFT JOIN cov c ON c.bin_id = least(greatest(b.bin_id + k, b.bin_id // 180 * 180), b.bin_id // 180 * 180 + 179) GROUP BY 1")
def _(spark, d):
    cov = profiles.coverage(maps.hour_map(spark, d)).withColumn("cov_tot", F.col("cov_tot").cast("double"))
    return rounded(columns.box_smooth(cov, "cov_tot", "chrom", "bin_id", 3).select("bin_id", "smooth"))


@query("gauss_smooth", " SELECT a.bin_id, round(sum(exp(-pow(b.bin_id - a.bin_id, 2) / 8.0e0) * b.w) / sum(exp(-pow(b.bin_id - a.bin_id, 2) / 8.0e0)), 6) AS smooth FROM bins a JOIN bins b ON a.chrom = b.chrom AND abs(a.bin_id - b.bin_id) <= 8 AND b.w IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(columns.gauss_smooth(maps.hour_map(spark, d).bins, "weight", "chrom", "bin_id", 2.0).select("bin_id", "smooth"))


@query("align_track", " SELECT bin_id, round(CASE WHEN w IS NOT NULL AND bin_id % 3 = 0 THEN sin(bin_id / 25.0e0) END, 6) AS value FROM bins")
def _(spark, d):
    m = maps.hour_map(spark, d)
    track = m.bins.where("bin_id % 3 = 0").select("chrom", "start", F.sin(F.col("bin_id") / 25.0).alias("value"))
    return rounded(joins.align_track(m.bins, track).select("bin_id", "value"))


@query("trimmed_trans", """, ce AS (SELECT bin1_id AS i, bin2_id AS j, CAST(cnt AS DOUBLE) AS v FROM px WHERE c1 <> c2 UNION ALL SELECT bin2_id, bin1_id, cnt FROM px WHERE c1 <> c2), tp AS (SELECT quantile_cont(v, 0.99) AS t FROM ce), mg AS (SELECT i, sum(v) AS m FROM ce GROUP BY 1), lo AS (SELECT quantile_cont(m, 0.05) AS l FROM mg WHERE m > 0), bd AS (SELECT i FROM mg, lo WHERE m > 0 AND m < l)
SELECT i, j, round(least(v, t), 6) AS value FROM ce, tp WHERE i NOT IN (SELECT i FROM bd) AND j NOT IN (SELECT i FROM bd)""")
def _(spark, d):
    m = maps.hour_map(spark, d)
    px = joins.annotate(m.pixels, m.bins).where("chrom1 <> chrom2")
    ends = F.array(F.struct(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j")), F.struct(F.col("bin2_id").alias("i"), F.col("bin1_id").alias("j")))
    cells = px.select(F.explode(ends).alias("x"), F.col("count").cast("double").alias("value")).select("x.i", "x.j", "value")
    return rounded(matrix.trimmed_trans(cells, 99, 5))


@query("block_sums", " SELECT a.arm AS region1, b.arm AS region2, a.n * b.n AS n_total, a.g * b.g AS n_valid, CAST(coalesce(s.cs, 0) AS DOUBLE) AS count_sum, round(coalesce(s.bs, 0), 4) AS balanced_sum FROM (SELECT arm, arm_idx, count(*) AS n, count(w) AS g FROM bins GROUP BY 1, 2) a JOIN (SELECT arm, arm_idx, count(*) AS n, count(w) AS g FROM bins GROUP BY 1, 2) b ON a.arm_idx < b.arm_idx LEFT JOIN (SELECT r1, r2, sum(cnt) AS cs, sum(bal) AS bs FROM px WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2) s ON s.r1 = a.arm AND s.r2 = b.arm")
def _(spark, d):
    return rounded(expected.block_sums(maps.hour_map(spark, d), maps.half_view(spark)), 4)


@query("validate_view", " SELECT chrom, CAST(0 AS BIGINT) AS start_bp, CAST(700000 AS BIGINT) AS end_bp, 'out of bounds' AS problem FROM bins WHERE bin_id = 0")
def _(spark, d):
    m = maps.hour_map(spark, d)
    bad = maps.half_view(spark).where("region_idx > 2").unionByName(spark.range(1).select(F.lit("c1").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(700000).cast("long").alias("end"), F.lit("wide").alias("name"), F.lit(99).alias("region_idx")))
    return view_problems(bad, m.chromsizes()).select("chrom", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"), "problem")


@query("validate_expected", " SELECT region AS region1, dist, 'repeated key' AS problem FROM ex WHERE dist < 3", ("cis",))
def _(spark, d):
    e = _cis(maps.hour_map(spark, d)).select("region1", "dist")
    return expected_problems(e.union(e.where("dist < 3")), ["region1", "dist"])


@query("validate_track", " SELECT chrom, s AS start_bp, 'overlap' AS problem FROM bins WHERE bin_id % 180 > 0")
def _(spark, d):
    wide = maps.hour_map(spark, d).bins.select("chrom", "start", (F.col("end") + 10).alias("end"))
    return track_problems(wide).select("chrom", F.col("start").alias("start_bp"), "problem")


_SIZES = "sz AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS chrom, 1000 + n_nationkey * 137 AS length FROM nation)"


def _sizes(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("chrom"), (1000 + F.col("n_nationkey") * 137).cast("long").alias("length"))


@plain("binnify", f"WITH {_SIZES} SELECT chrom, CAST(k * 250 AS BIGINT) AS start_bp, CAST(least((k + 1) * 250, length) AS BIGINT) AS end_bp FROM (SELECT chrom, length, unnest(range(0, CAST(ceil(length / 250.0e0) AS BIGINT))) AS k FROM sz) u")
def _(spark, d):
    return genome.binnify(_sizes(spark, d), 250).select("chrom", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"))


def _sequences(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


_SEQ = "sq AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


@plain("digest", f"WITH {_SEQ}, p AS (SELECT chrom, string_split(seq, 'TTA') AS p FROM sq), f AS (SELECT chrom, k, len(p) AS n, list_sum(list_transform(p[1:k], lambda s: length(s))) + (k - 1) * 3 + CASE WHEN k < len(p) THEN 1 ELSE 0 END AS t FROM (SELECT chrom, p, unnest(range(1, len(p) + 1)) AS k FROM p) u), g AS (SELECT chrom, CAST(coalesce(lag(t) OVER (PARTITION BY chrom ORDER BY k), 0) AS BIGINT) AS start_bp, CAST(t AS BIGINT) AS end_bp FROM f) SELECT * FROM g WHERE end_bp > start_bp")
def _(spark, d):
    return genome.digest(_sequences(spark, d), "TTA", 1).select("chrom", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"))


@plain("gc_content", f"WITH {_SEQ}, b AS (SELECT chrom, seq, unnest(range(0, length(seq), 100)) AS s FROM sq WHERE length(seq) > 0), c AS (SELECT chrom, s, least(s + 100, length(seq)) AS t, substr(seq, s + 1, 100) AS q FROM b) SELECT chrom, CAST(s AS BIGINT) AS start_bp, CAST(t AS BIGINT) AS end_bp, round((length(q) - length(replace(replace(q, 'G', ''), 'C', ''))) * 1.0e0 / nullif(length(q), 0), 6) AS gc FROM c")
def _(spark, d):
    seqs = _sequences(spark, d)
    bins = genome.binnify(seqs.select("chrom", F.length("seq").cast("long").alias("length")), 100)
    return rounded(genome.gc(bins, seqs).select("chrom", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"), "gc"))


@plain("gene_coverage", f"WITH {_SIZES}, b AS (SELECT chrom, k * 250 AS s, least((k + 1) * 250, length) AS t FROM (SELECT chrom, length, unnest(range(0, CAST(ceil(length / 250.0e0) AS BIGINT))) AS k FROM sz) u), g AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS chrom, c_custkey * 13 % 900 AS s, c_custkey * 13 % 900 + c_custkey % 400 AS t FROM customer) SELECT b.chrom, CAST(b.s AS BIGINT) AS start_bp, CAST(coalesce(sum(CASE WHEN g.s IS NOT NULL THEN greatest(least(b.t, g.t) - greatest(b.s, g.s), 0) END), 0) AS BIGINT) AS covered FROM b LEFT JOIN g ON g.chrom = b.chrom AND g.s < b.t AND g.t > b.s GROUP BY 1, 2")
def _(spark, d):
    s = F.col("c_custkey") * 13 % 900
    genes = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("chrom"), s.alias("start"), (s + F.col("c_custkey") % 400).alias("end"))
    return genome.gene_coverage(genome.binnify(_sizes(spark, d), 250), genes, 250).select("chrom", F.col("start").alias("start_bp"), F.col("covered").cast("long").alias("covered"))


@plain("part_coverage", "WITH r AS (SELECT DISTINCT l_orderkey AS g, l_partkey - (SELECT min(p_partkey) FROM part) AS b FROM lineitem), p AS (SELECT x.b AS b1, y.b AS b2, count(*) AS cnt FROM r x JOIN r y ON x.g = y.g AND x.b < y.b GROUP BY 1, 2) SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS bin_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cov_tot FROM part LEFT JOIN (SELECT b1 AS b, cnt FROM p UNION ALL SELECT b2, cnt FROM p) u ON u.b = p_partkey - (SELECT min(p_partkey) FROM part) GROUP BY 1")
def _(spark, d):
    return profiles.coverage(maps.part_map(spark, d)).select("bin_id", "cov_tot")
