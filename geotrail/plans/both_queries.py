"""Queries of the chain over both sources (A + B, unweighted): candidates,
activity radius, ground truth, friend distance, hold-out, settings (K4, G9)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.operators import evaluate, home, link
from geotrail.plans.evaluation_queries import (ROUNDS, SQL_EVAL_BASE, SQL_EVAL_WU, _holdout, _metrics, _round_metrics,
                                               sql_holdout)
from geotrail.plans.home_queries import Ctx, _ecdf_sql, friend_distance
from geotrail.plans.home_sql import inferred_dispersion_sql, medoid_sql
from geotrail.plans.link_queries import SQL_LINK_TABLES
from geotrail.plans.mobility_queries import posts_b
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query

SQL_CHAIN = SQL_LINK_TABLES + """,
candb AS (SELECT user_name, media_id, followers_count, lat, lon, place_location FROM cand
          UNION ALL
          SELECT user_name, media_id, followers_count, lat, lon, concat_ws(',', place_name, country_code) FROM cross_b
          WHERE user_name IN (SELECT user_name FROM cross_b GROUP BY user_name HAVING COUNT(DISTINCT media_id) >= 3)),""" \
    + medoid_sql("candb", "user_name", "lat", "lon", "place_location", None, "armedb").lstrip() + "," \
    + inferred_dispersion_sql("candb", "user_name", "lat", "lon", "armedb", "arb", tiebreak="media_id").lstrip() + """,
gtpb AS (SELECT user_name, lat, lon, label AS user_location FROM arb WHERE label IS NOT NULL AND dispersion < 30),
truthb AS (SELECT user_name, lat, lon, user_location FROM prof
           WHERE user_name NOT IN (SELECT user_name FROM gtpb WHERE user_name IS NOT NULL)
           UNION ALL SELECT user_name, lat, lon, user_location FROM gtpb),
fdb AS (SELECT e.source AS user_name, median(""" + hav("t.lon", "t.lat", "s.lon", "s.lat") + """) AS median_distance
        FROM rec e JOIN gtpb s ON s.user_name = e.source JOIN gtpb t ON t.user_name = e.target GROUP BY e.source)"""

SQL_SAMPLE_B = """,
sampleb AS (SELECT f.fold, g.user_name, g.lat, g.lon FROM gtpb g CROSS JOIN folds f
            WHERE CAST(('0x' || substr(md5(g.user_name || '#' || CAST(f.fold AS VARCHAR)), 1, 8)) AS BIGINT) % 10 = 0),"""

SQL_B_ONLY = SQL_EVAL_BASE + "," + SQL_CHAIN + SQL_SAMPLE_B + sql_holdout("b", False, "truthb", "sampleb").lstrip()
SQL_ALL = SQL_EVAL_WU + "," + SQL_CHAIN + SQL_SAMPLE_B + sql_holdout("b", False, "truthb", "sampleb").lstrip()
SQL_HOME_B = SQL_EVAL_BASE + "," + SQL_CHAIN


class CtxBoth(Ctx):
    """The chain of Ctx with the linked users' source-B posts added."""

    @cached_property
    def both(self) -> DataFrame:
        b = posts_b(self.spark, self.sf)
        return link.home_candidates_both(self.cands, link.cross_source_posts(b, link.link_accounts(b, self.net)))

    @cached_property
    def radius(self) -> DataFrame:
        return home.activity_radius(self.both)


def _r3(c):
    return F.round(c, 3)


@query("activity_radius_both", with_prelude(SQL_HOME_B, """
SELECT user_name, lat, lon, label AS user_location, round(dispersion, 3) AS radius FROM arb WHERE label IS NOT NULL"""))
def q_activity_radius_both(spark, sf):
    return CtxBoth(spark, sf).radius.withColumn("radius", _r3("radius"))


@query("ground_truth_both", with_prelude(SQL_HOME_B, "SELECT * FROM gtpb"))
def q_ground_truth_both(spark, sf):
    return CtxBoth(spark, sf).truth_posts


@query("merge_ground_truth_both", with_prelude(SQL_HOME_B, "SELECT * FROM truthb"))
def q_merge_ground_truth_both(spark, sf):
    return CtxBoth(spark, sf).truth


@query("friend_distance_both", with_prelude(SQL_HOME_B,
    "SELECT user_name, round(median_distance, 3) AS median_distance FROM fdb"))
def q_friend_distance_both(spark, sf):
    return friend_distance(CtxBoth(spark, sf)).withColumn("median_distance", _r3("median_distance"))


@query("activity_radius_ecdf_both", with_prelude(SQL_HOME_B, _ecdf_sql(
    "(SELECT * FROM arb WHERE label IS NOT NULL)", "dispersion")))
def q_activity_radius_ecdf_both(spark, sf):
    e = evaluate.ecdf(CtxBoth(spark, sf).radius, "radius")
    return e.select(_r3("x").alias("x"), F.round("y", 6).alias("y"))


@query("friend_distance_ecdf_both", with_prelude(SQL_HOME_B, _ecdf_sql("fdb", "median_distance")))
def q_friend_distance_ecdf_both(spark, sf):
    e = evaluate.ecdf(friend_distance(CtxBoth(spark, sf)), "median_distance")
    return e.select(_r3("x").alias("x"), F.round("y", 6).alias("y"))


@query("coverage_by_round_both", with_prelude(SQL_B_ONLY, "SELECT round, CAST(round(avg(known)) AS BIGINT) AS known_mean "
    "FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS round, fold, COUNT(*) AS known FROM b_r{i} GROUP BY fold" for i in range(1, ROUNDS + 1))
    + ") GROUP BY round"))
def q_coverage_by_round_both(spark, sf):
    sizes = []
    _holdout(CtxBoth(spark, sf), weighted=False, sizes=sizes)
    return evaluate.mean_by_round(sizes).select(F.col("round").cast("int").alias("round"), "known_mean")


_SETTINGS = (("a_weighted", "w"), ("a_unweighted", "u"), ("a_plus_b_unweighted", "b"))


@query("setting_comparison", with_prelude(SQL_ALL, " UNION ALL ".join(f"""
SELECT '{name}' AS setting, fold, coverage, sample_size, round(coverage_share, 6) AS coverage_share,
       round(error_median, 3) AS error_median, round(error_mean, 3) AS error_mean FROM {tag}_m"""
    for name, tag in _SETTINGS)))
def q_setting_comparison(spark, sf):
    """Per-fold hold-out metrics of three settings."""
    a, both = Ctx(spark, sf), CtxBoth(spark, sf)
    runs = [_metrics(a, True), _metrics(a, False), _metrics(both, False)]
    out = [_round_metrics(r).withColumn("setting", F.lit(name)) for r, (name, _) in zip(runs, _SETTINGS)]
    return out[0].unionByName(out[1]).unionByName(out[2])
