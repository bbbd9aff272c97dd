"""Queries of the hold-out evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.operators import evaluate
from geotrail.plans.home_queries import QUERY_MAX_DISPERSION_KM, SQL_HOME, ctx_a
from geotrail.plans.home_sql import round_sql
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query

RUNS, ROUNDS = evaluate.RUNS, 5


def sql_holdout(tag: str, weighted: bool, truth: str = "truth", sample: str = "sample") -> str:
    """CTEs <tag>_r1..r5 (fold-keyed rounds) and <tag>_m (per-fold metrics)."""
    parts = [f"""
{tag}_s0 AS (SELECT f.fold, t.user_name, t.lat, t.lon, t.user_location FROM {truth} t CROSS JOIN folds f
             WHERE NOT EXISTS (SELECT 1 FROM {sample} s WHERE s.fold = f.fold AND s.user_name = t.user_name))"""]
    for i in range(1, ROUNDS + 1):
        prev = f"{tag}_s0" if i == 1 else f"{tag}_r{i - 1}"
        parts.append(round_sql("edges_f", prev, f"{tag}_r{i}", weighted, fold=True,
                               max_disp=QUERY_MAX_DISPERSION_KM))
    parts.append(f"""
{tag}_err AS (SELECT s.fold, s.user_name, {hav("s.lon", "s.lat", "r.lon", "r.lat")} AS error
              FROM {sample} s JOIN {tag}_r{ROUNDS} r ON r.fold = s.fold AND r.user_name = s.user_name
              WHERE r.user_location IS NOT NULL),
{tag}_m AS (
  SELECT f.fold, CAST(coalesce(c.coverage, 0) AS BIGINT) AS coverage,
         CAST(coalesce(z.sample_size, 0) AS BIGINT) AS sample_size,
         CASE WHEN coalesce(z.sample_size, 0) = 0 THEN NULL
              ELSE CAST(coalesce(c.coverage, 0) AS DOUBLE) / z.sample_size END AS coverage_share,
         c.error_median, c.error_mean
  FROM folds f
  LEFT JOIN (SELECT fold, COUNT(*) AS sample_size FROM {sample} GROUP BY fold) z ON z.fold = f.fold
  LEFT JOIN (SELECT fold, COUNT(*) AS coverage, median(error) AS error_median, avg(error) AS error_mean
             FROM {tag}_err GROUP BY fold) c ON c.fold = f.fold)""")
    return ",".join(p.lstrip() if j else p for j, p in enumerate(parts))


SQL_EVAL_BASE = SQL_HOME + f""",
folds AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1, {RUNS + 1})),
sample AS (SELECT f.fold, g.user_name, g.lat, g.lon FROM gtp g CROSS JOIN folds f
           WHERE CAST(('0x' || substr(md5(g.user_name || '#' || CAST(f.fold AS VARCHAR)), 1, 8)) AS BIGINT) % 10 = 0),
edges_f AS (SELECT f.fold, e.source, e.target, e.weight FROM rec e CROSS JOIN folds f)"""

SQL_EVAL_W = SQL_EVAL_BASE + "," + sql_holdout("w", True)
SQL_EVAL_WU = SQL_EVAL_W + "," + sql_holdout("u", False)


def _holdout(c, weighted=True, sizes=None, truth=None, truth_posts=None):
    """(sample, final) of the hold-out runs over a chain, A's by default."""
    return evaluate.holdout_run(c.rec, truth or c.truth, truth_posts or c.truth_posts, RUNS, ROUNDS, weighted,
                                sizes=sizes, max_dispersion_km=QUERY_MAX_DISPERSION_KM)


def _metrics(c, weighted=True, **kw):
    return evaluate.holdout_metrics(*_holdout(c, weighted, **kw), RUNS)


def _round_metrics(m):
    return m.select("fold", "coverage", "sample_size", F.round("coverage_share", 6).alias("coverage_share"),
                    F.round("error_median", 3).alias("error_median"), F.round("error_mean", 3).alias("error_mean"))


@query("holdout_split", with_prelude(SQL_EVAL_BASE, "SELECT fold, user_name, lat, lon FROM sample"))
def q_holdout_split(spark, sf):
    return evaluate.holdout_split(ctx_a(spark, sf).truth_posts, RUNS)


@query("holdout_error", with_prelude(SQL_EVAL_W, """
SELECT fold, coverage, sample_size, round(coverage_share, 6) AS coverage_share,
       round(error_median, 3) AS error_median, round(error_mean, 3) AS error_mean FROM w_m"""))
def q_holdout_error(spark, sf):
    return _round_metrics(_metrics(ctx_a(spark, sf)))


@query("holdout_coverage", with_prelude(SQL_EVAL_W, """
SELECT fold, coverage, sample_size, round(coverage_share, 6) AS coverage_share FROM w_m"""))
def q_holdout_coverage(spark, sf):
    return evaluate.holdout_coverage(*_holdout(ctx_a(spark, sf)), RUNS).withColumn(
        "coverage_share", F.round("coverage_share", 6))


@query("coverage_by_round", with_prelude(SQL_EVAL_W, "SELECT round, CAST(round(avg(known)) AS BIGINT) AS known_mean "
    "FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS round, fold, COUNT(*) AS known FROM w_r{i} GROUP BY fold" for i in range(1, ROUNDS + 1))
    + ") GROUP BY round"))
def q_coverage_by_round(spark, sf):
    sizes = []
    _holdout(ctx_a(spark, sf), sizes=sizes)
    return evaluate.mean_by_round(sizes).select(F.col("round").cast("int").alias("round"), "known_mean")


SQL_TTEST = SQL_EVAL_WU + """,
pairs AS (SELECT a.error_median - b.error_median AS d FROM w_m a JOIN u_m b ON a.fold = b.fold
          WHERE a.error_median IS NOT NULL AND b.error_median IS NOT NULL),
tt AS (SELECT COUNT(*) AS n, avg(d) AS md, stddev_samp(d) AS sd FROM pairs),
tv AS (SELECT n, md, CASE WHEN sd > 0 THEN md / (sd / sqrt(n)) END AS t, CAST(n - 1 AS INTEGER) AS df FROM tt),
th AS (SELECT *, atan(abs(t) / sqrt(df)) AS theta FROM tv),
rat AS (SELECT k, CASE WHEN k = 0 THEN 0.0
                      WHEN df % 2 = 1 THEN ln((2.0 * k) / (2.0 * k + 1)) ELSE ln((2.0 * k - 1) / (2.0 * k)) END AS lr,
               theta, df FROM (SELECT *, unnest(range(0, greatest(df, 1))) AS k FROM th)),
terms AS (SELECT k, exp(sum(lr) OVER (ORDER BY k)) * pow(cos(theta) * cos(theta), k) AS term, theta, df FROM rat),
ser AS (SELECT coalesce(sum(term), 0.0) AS s FROM terms
        WHERE k <= CASE WHEN df % 2 = 1 THEN floor((df - 3) / 2) ELSE floor((df - 2) / 2) END),
pv AS (SELECT n, md, t, df, CASE WHEN t IS NULL OR df < 1 THEN NULL
         WHEN df % 2 = 1 THEN 1 - (2 / pi()) * (theta + CASE WHEN df > 1 THEN sin(theta) * cos(theta) * s ELSE 0 END)
         ELSE 1 - sin(theta) * s END AS p FROM th CROSS JOIN ser)"""


@query("paired_t_test", with_prelude(SQL_TTEST, """
SELECT CAST(n AS BIGINT) AS n, round(md, 6) AS mean_diff, round(t, 6) AS t, df, round(p, 6) AS p FROM pv"""))
def q_paired_t_test(spark, sf):
    c = ctx_a(spark, sf)
    a = _metrics(c, weighted=True).select("fold", F.col("error_median").alias("a"))
    b = _metrics(c, weighted=False).select("fold", F.col("error_median").alias("b"))
    r = evaluate.paired_t_test(a.join(b, "fold"))
    return r.select(F.col("n").cast("long").alias("n"), F.round("mean_diff", 6).alias("mean_diff"),
                    F.round("t", 6).alias("t"), F.col("df").cast("int").alias("df"),
                    F.round("p", 6).alias("p"))
