"""Queries of home estimation."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import haversine_km
from geotrail.operators import evaluate, graph, home
from geotrail.operators.skew import group_median
from geotrail.plans.graph_queries import SQL_GRAPH
from geotrail.plans.home_sql import cands_sql, inferred_dispersion_sql, medoid_sql, round_sql
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query
from geotrail.session import store
from geotrail.sources import derived


class Ctx:
    """Source-A chain up to the merged ground truth; each stage is built on
    first use only. Reciprocal edges, which several stages read, are stored."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def posts(self) -> DataFrame:
        return derived.posts_a(self.spark, self.sf)

    @cached_property
    def rec(self) -> DataFrame:
        return store(graph.reciprocal_edges(graph.mention_edges(self.posts)), "reciprocal")

    @cached_property
    def net(self) -> DataFrame:
        return graph.network_posts(self.posts, self.rec)

    @cached_property
    def cands(self) -> DataFrame:
        return home.home_candidates(self.net)

    @cached_property
    def radius(self) -> DataFrame:
        return home.activity_radius(self.cands)

    @cached_property
    def truth_posts(self) -> DataFrame:
        return self.radius.filter(F.col("radius") < home.ACTIVITY_RADIUS_KM).select(
            "user_name", "lat", "lon", "user_location")

    @cached_property
    def profile(self) -> DataFrame:
        return home.profile_ground_truth(derived.profile_truth_raw(self.spark, self.sf))

    @cached_property
    def truth(self) -> DataFrame:
        return home.merge_ground_truth(self.profile, self.truth_posts)


def ctx_a(spark, sf) -> Ctx:
    return Ctx(spark, sf)


SQL_HOME = SQL_GRAPH + "," + cands_sql().lstrip() + "," + medoid_sql(
    "cand", "user_name", "lat", "lon", "place_location", None, "armed").lstrip() + "," + \
    inferred_dispersion_sql("cand", "user_name", "lat", "lon", "armed", "ar", tiebreak="media_id").lstrip() + """,
gtp AS (SELECT user_name, lat, lon, label AS user_location FROM ar WHERE label IS NOT NULL AND dispersion < 30),
prof0 AS (SELECT user_name, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon,
                 concat_ws(',', user_city, user_country) AS user_location
          FROM (SELECT DISTINCT * FROM profile_truth_raw)),
prof AS (SELECT user_name, lat, lon, user_location FROM (
           SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY lat, lon, user_location) AS rn
           FROM prof0 WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE rn = 1),
truth AS (SELECT user_name, lat, lon, user_location FROM prof
          WHERE user_name NOT IN (SELECT user_name FROM gtp WHERE user_name IS NOT NULL)
          UNION ALL SELECT user_name, lat, lon, user_location FROM gtp)"""


def _r3(c):
    return F.round(c, 3)


@query("home_candidates", with_prelude(SQL_HOME,
    "SELECT user_name, media_id, followers_count, lat, lon, place_location FROM cand"))
def q_home_candidates(spark, sf):
    return ctx_a(spark, sf).cands


@query("l1_median", with_prelude(SQL_HOME, "SELECT user_name, lat, lon, label FROM armed"))
def q_l1_median(spark, sf):
    return home.l1_median(ctx_a(spark, sf).cands, ["user_name"], label="place_location")


@query("activity_radius", with_prelude(SQL_HOME, """
SELECT user_name, lat, lon, label AS user_location, round(dispersion, 3) AS radius FROM ar WHERE label IS NOT NULL"""))
def q_activity_radius(spark, sf):
    return ctx_a(spark, sf).radius.withColumn("radius", _r3(F.col("radius")))


@query("ground_truth_posts", with_prelude(SQL_HOME, "SELECT * FROM gtp"))
def q_ground_truth_posts(spark, sf):
    return ctx_a(spark, sf).truth_posts


@query("profile_ground_truth", with_prelude(SQL_HOME, "SELECT * FROM prof"))
def q_profile_ground_truth(spark, sf):
    return home.profile_ground_truth(derived.profile_truth_raw(spark, sf))


@query("merge_ground_truth", with_prelude(SQL_HOME, "SELECT * FROM truth"))
def q_merge_ground_truth(spark, sf):
    return ctx_a(spark, sf).truth


SQL_ROUND1 = SQL_HOME + "," + round_sql("rec", "truth", "r1", weighted=True).lstrip()


@query("adjacency_left", with_prelude(SQL_ROUND1, """
SELECT source, target, CAST(weight AS BIGINT) AS weight, tlat AS target_lat, tlon AS target_lon,
       tloc AS target_location, slat AS source_lat, slon AS source_lon, sloc AS source_location FROM r1_adj"""))
def q_adjacency_left(spark, sf):
    c = ctx_a(spark, sf)
    return home.adjacency(c.rec, c.truth)


@query("weighted_l1_median", with_prelude(SQL_ROUND1 + "," + medoid_sql(
    "r1_adj", "source", "tlat", "tlon", "tloc", "weight", "wmed").lstrip(),
    "SELECT source AS user_name, lat, lon, label FROM wmed"))
def q_weighted_l1_median(spark, sf):
    c = ctx_a(spark, sf)
    m = home.l1_median(home.adjacency(c.rec, c.truth), ["source"], "target_lat", "target_lon",
                       "target_location", "weight")
    return m.filter(F.col("lat").isNotNull()).select(F.col("source").alias("user_name"), "lat", "lon", "label")


@query("dispersion", with_prelude(SQL_ROUND1, """
SELECT source AS user_name, lat, lon, label AS user_location, round(dispersion, 3) AS dispersion FROM r1_known
UNION ALL SELECT source, lat, lon, label, round(dispersion, 3) FROM r1_disp"""))
def q_dispersion(spark, sf):
    c = ctx_a(spark, sf)
    est = home.estimate(c.rec, c.truth, weighted=True)
    return est.filter(F.col("lat").isNotNull()).select(
        "user_name", "lat", "lon", "user_location", _r3(F.col("dispersion")).alias("dispersion"))


SQL_FRIENDS = SQL_HOME + """,
fd AS (SELECT e.source AS user_name, median(""" + hav("t.lon", "t.lat", "s.lon", "s.lat") + """) AS median_distance
       FROM rec e JOIN gtp s ON s.user_name = e.source JOIN gtp t ON t.user_name = e.target GROUP BY e.source)"""


def friend_distance(c: Ctx) -> DataFrame:
    """Median distance between a located user and its located friends."""
    adj = home.adjacency(c.rec, c.truth_posts).filter(
        F.col("source_lat").isNotNull() & F.col("target_lat").isNotNull())
    d = haversine_km("target_lon", "target_lat", "source_lon", "source_lat")
    return group_median(adj.select(F.col("source").alias("user_name"), d.alias("median_distance")),
                        ["user_name"], "median_distance")


@query("friend_distance", with_prelude(SQL_FRIENDS,
    "SELECT user_name, round(median_distance, 3) AS median_distance FROM fd"))
def q_friend_distance(spark, sf):
    return friend_distance(ctx_a(spark, sf)).withColumn("median_distance", _r3(F.col("median_distance")))


def _ecdf_sql(src: str, col: str) -> str:
    return f"""SELECT round(x, 3) AS x, round(cum / tot, 6) AS y FROM (
  SELECT x, CAST(sum(c) OVER (ORDER BY x) AS DOUBLE) AS cum, CAST(sum(c) OVER () AS DOUBLE) AS tot
  FROM (SELECT {col} AS x, COUNT(*) AS c FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}))"""


@query("activity_radius_ecdf", with_prelude(SQL_HOME, _ecdf_sql("(SELECT * FROM ar WHERE label IS NOT NULL)",
                                                                "dispersion")))
def q_activity_radius_ecdf(spark, sf):
    e = evaluate.ecdf(ctx_a(spark, sf).radius, "radius")
    return e.select(_r3(F.col("x")).alias("x"), F.round("y", 6).alias("y"))


@query("friend_distance_ecdf", with_prelude(SQL_FRIENDS, _ecdf_sql("fd", "median_distance")))
def q_friend_distance_ecdf(spark, sf):
    e = evaluate.ecdf(friend_distance(ctx_a(spark, sf)), "median_distance")
    return e.select(_r3(F.col("x")).alias("x"), F.round("y", 6).alias("y"))


QUERY_MAX_DISPERSION_KM = home.PROPAGATION_DISPERSION_KM

SQL_ROUND1_Q = SQL_HOME + "," + round_sql("rec", "truth", "q1", weighted=True,
                                          max_disp=QUERY_MAX_DISPERSION_KM).lstrip()


@query("propagate_once", with_prelude(SQL_ROUND1_Q, "SELECT * FROM q1"))
def q_propagate_once(spark, sf):
    c = ctx_a(spark, sf)
    return home.propagate_once(c.rec, c.truth, weighted=True, max_dispersion_km=QUERY_MAX_DISPERSION_KM)


SQL_ROUND5 = SQL_HOME + "," + ",".join(
    round_sql("rec", "truth" if i == 1 else f"r{i - 1}", f"r{i}", weighted=True,
              max_disp=QUERY_MAX_DISPERSION_KM).lstrip() for i in range(1, 6))


@query("propagate_5", with_prelude(SQL_ROUND5, "SELECT * FROM r5"))
def q_propagate_5(spark, sf):
    c = ctx_a(spark, sf)
    return home.propagate(c.rec, c.truth, rounds=5, weighted=True, max_dispersion_km=QUERY_MAX_DISPERSION_KM)


def _work_sql(i: int) -> str:
    """Sources that round ``i`` has to cost: around users that round i - 1 changed."""
    old, new = ("truth" if i == 2 else f"r{i - 2}"), f"r{i - 1}"
    cols = "user_name, lat, lon, user_location"
    return f"""
d{i} AS (SELECT user_name FROM ((SELECT {cols} FROM {old} EXCEPT SELECT {cols} FROM {new}) UNION ALL
                                (SELECT {cols} FROM {new} EXCEPT SELECT {cols} FROM {old}))),
w{i} AS (SELECT DISTINCT source FROM rec WHERE source IN (SELECT user_name FROM d{i}) OR target IN (SELECT user_name FROM d{i}))"""


@query("propagation_work", with_prelude(SQL_ROUND5 + "," + ",".join(_work_sql(i).lstrip() for i in range(2, 6)), " UNION ALL ".join(
    f"SELECT {i} AS round, (SELECT count(*) FROM w{i}) AS costed, (SELECT count(*) FROM r{i}) AS known" for i in range(2, 6))))
def q_propagation_work(spark, sf):
    """Rounds 2 to 5: the sources that were costed anew, and the known set."""
    c, sizes, work = ctx_a(spark, sf), [], []
    home.propagate(c.rec, c.truth, rounds=5, weighted=True, max_dispersion_km=QUERY_MAX_DISPERSION_KM, sizes=sizes,
                   work=work)
    out = None
    for size, costed in zip(sizes[1:], work):
        x = costed.join(size, "round").select("round", "costed", "known")
        out = x if out is None else out.unionByName(x)
    return out
