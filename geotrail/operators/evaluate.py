"""Evaluation: hold-out folds, error and coverage, ECDF, paired t-test."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import haversine_km
from geotrail.operators import home
from geotrail.operators.skew import cumulative_weight, group_median, shuffled

RUNS = 10
HOLDOUT_BUCKETS = 10     # 1 of 10 buckets hidden = 10 %


def ecdf(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """Empirical CDF: per distinct value x, y = share of values <= x.

    Values are counted per distinct x (partial aggregation), then a running
    total over the range-partitioned distinct values gives the cumulative
    count — no single-partition window, no collect."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("_c"))
    r = cumulative_weight(counts, [], [F.col("x")], "_c")
    y = F.col("_cum") / F.col("_tot")
    x = F.col("x") if digits is None else F.round("x", digits)
    return r.select(x.alias("x"), y.alias("y"))


def fold_bucket(key: Column, run: Column) -> Column:
    """Deterministic bucket 0..9 of (key, run): md5-based, reproducible in SQL."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("#"), run.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % HOLDOUT_BUCKETS).cast("int")


def runs_frame(df: DataFrame, runs: int = RUNS) -> DataFrame:
    """Replicate rows once per run (``fold`` = 1..runs) without a join."""
    return df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def holdout_split(truth_posts: DataFrame, runs: int = RUNS) -> DataFrame:
    """(fold, user_name, lat, lon): the users hidden in each run (about 10 %)."""
    x = runs_frame(truth_posts.select("user_name", "lat", "lon"), runs)
    return x.filter(fold_bucket(F.col("user_name"), F.col("fold")) == 0).select("fold", "user_name", "lat", "lon")


def holdout_run(edges: DataFrame, truth: DataFrame, truth_posts: DataFrame, runs: int = RUNS,
                rounds: int = 5, weighted: bool = True, sizes: list | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """All runs in one job, ``fold`` as a key column.

    Returns (sample, final): the hidden users per fold and the known set per
    fold after ``rounds`` rounds started from the truth minus the hidden users.
    """
    sample = holdout_split(truth_posts, runs)
    start = runs_frame(truth.select("user_name", "lat", "lon", "user_location"), runs)
    start = start.join(shuffled(sample.select("fold", "user_name")), ["fold", "user_name"], "left_anti")
    final = home.propagate(edges.select("source", "target", "weight"), start, rounds, keys=["fold"], weighted=weighted, sizes=sizes, **kw)
    return sample, final


def holdout_errors(sample: DataFrame, final: DataFrame) -> DataFrame:
    """Per hidden user with an estimate: error km (fold, user_name, error)."""
    s = sample.select("fold", "user_name", F.col("lat").alias("lat_sample"), F.col("lon").alias("lon_sample"))
    x = s.join(shuffled(final), ["fold", "user_name"], "left").filter(F.col("user_location").isNotNull())
    return x.select("fold", "user_name",
                    haversine_km(F.col("lon_sample"), F.col("lat_sample"), F.col("lon"), F.col("lat")).alias("error"))


def holdout_coverage(sample: DataFrame, final: DataFrame, runs: int = RUNS) -> DataFrame:
    """Per fold: coverage (hidden users re-located), sample size and share."""
    size = sample.groupBy("fold").agg(F.count(F.lit(1)).alias("sample_size"))
    cov = holdout_errors(sample, final).groupBy("fold").agg(F.count(F.lit(1)).alias("coverage"))
    folds = sample.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("fold"))
    out = folds.join(size, "fold", "left").join(cov, "fold", "left")
    return out.select(
        "fold", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"),
        F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size"),
        F.try_divide(F.coalesce("coverage", F.lit(0)).cast("double"), F.col("sample_size").cast("double"))
        .alias("coverage_share"))


def holdout_metrics(sample: DataFrame, final: DataFrame, runs: int = RUNS) -> DataFrame:
    """``holdout_coverage`` with the median and mean error (km) per fold."""
    err = holdout_errors(sample, final)
    mean = err.groupBy("fold").agg(F.avg("error").alias("error_mean"))
    med = group_median(err, ["fold"], "error").withColumnRenamed("error", "error_median")
    out = holdout_coverage(sample, final, runs).join(med, "fold", "left").join(mean, "fold", "left")
    return out.select("fold", "coverage", "sample_size", "coverage_share", "error_median", "error_mean")


STEPS = 2000             # Simpson intervals; their number does not depend on df


def _cosine_power_integral(lo: Column, hi: Column, df: Column) -> Column:
    """Integral of cos(u) ** (df - 1) from lo to hi by Simpson's rule."""
    h = (hi - lo) / STEPS

    def term(i):
        s = F.sin(lo + h * i)
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        # log1p keeps the digits that a huge df would lose
        return weight * F.exp((df - 1) / 2 * F.log1p(-F.least(s * s, F.lit(1 - 1e-16))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + term(i)) * h / 3


def _student_t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t: with u = atan(x / sqrt(df)) the density is
    proportional to cos(u) ** (df - 1), and beyond 40 / sqrt(df) it is nil."""
    df = df.cast("double")
    end = F.least(F.lit(math.pi / 2), F.lit(40.0) / F.sqrt(df))
    theta = F.least(F.atan(F.abs(t) / F.sqrt(df)), end)
    p = _cosine_power_integral(theta, end, df) / _cosine_power_integral(F.lit(0.0), end, df)
    return F.when(df >= 1, p)


def paired_t_test(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Paired two-sided t-test of columns ``a`` and ``b`` (rows with both set).
    One row: n, mean_diff, t, df, p. Zero variance gives null t and p."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("_d"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("_sd"))
    t = F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    t = F.when(F.col("_sd") > 0, t)
    s = s.select("n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df"))
    return s.select("n", "mean_diff", "t", "df", F.when(F.col("t").isNotNull(),
                                                          _student_t_two_sided_p(F.col("t"), F.col("df"))).alias("p"))


def mean_by_round(sizes: Sequence[DataFrame]) -> DataFrame:
    """Known-set size per round averaged over folds, rounded to an integer."""
    allr = sizes[0]
    for s in sizes[1:]:
        allr = allr.unionByName(s)
    return allr.groupBy("round").agg(F.round(F.avg("known")).cast("long").alias("known_mean"))
