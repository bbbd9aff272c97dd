"""Queries of scalar functions, windows and filters (F9-F14, F17, F18, F20,
F21, F23, W1, W4, P10, P18, C5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.functions import geo, text
from geotrail.operators import clean, frontier
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query
from geotrail.sources import derived

# Reference point of the distance queries (fixed value of the queries).
REF_LON, REF_LAT = 2.3522, 48.8566
PERIOD = (1704844800, 1705708800)     # 2024-01-10 .. 2024-01-20 UTC, both open
EUROPE_BOX = (-10.0, 35.0, 30.0, 60.0)  # west, south, east, north


def _eid():
    return F.col("media_id").cast("long")


@query("bbox_centroid", with_prelude("", """
SELECT media_id,
  ((place_lat - 0.01) + coalesce(CASE WHEN eid % 19 != 0 THEN place_lat + 0.01 END, place_lat - 0.01)) / 2 AS c_lat,
  ((place_lon - 0.01) + coalesce(CASE WHEN eid % 19 != 0 THEN place_lon + 0.01 END, place_lon - 0.01)) / 2 AS c_lon
FROM posts_a"""))
def q_bbox_centroid(spark, sf):
    p = derived.posts_a(spark, sf)
    keep = _eid() % 19 != 0
    return p.select("media_id",
                    geo.bbox_centroid(F.col("place_lat") - 0.01, F.when(keep, F.col("place_lat") + 0.01)).alias("c_lat"),
                    geo.bbox_centroid(F.col("place_lon") - 0.01, F.when(keep, F.col("place_lon") + 0.01)).alias("c_lon"))


@query("parse_post_time", with_prelude("", """
SELECT media_id, CASE WHEN eid % 89 = 0 THEN NULL WHEN eid % 97 = 0 THEN create_epoch - 3600
                      ELSE create_epoch END AS create_epoch FROM posts_a"""))
def q_parse_post_time(spark, sf):
    p = derived.posts_a(spark, sf)
    t = (F.when(_eid() % 89 == 0, F.lit("garbage"))
         .when(_eid() % 97 == 0, F.regexp_replace("create_time", r"\+0000", "+0100"))
         .otherwise(F.col("create_time")))
    return p.select("media_id", F.unix_timestamp(text.parse_post_time(t)).alias("create_epoch"))


@query("parse_epoch", with_prelude("", """
SELECT media_id, strftime(make_timestamp(create_time_stamp * 1000000), '%Y-%m-%d %H:%M:%S') AS create_time
FROM media_b"""))
def q_parse_epoch(spark, sf):
    m = derived.media_b(spark, sf)
    return m.select("media_id", F.date_format(text.parse_epoch("create_time_stamp"), "yyyy-MM-dd HH:mm:ss")
                    .alias("create_time"))


@query("haversine", with_prelude("", f"""
SELECT media_id, round({hav("place_lon", "place_lat", str(REF_LON), str(REF_LAT))}, 3) AS dist_km,
       round({hav(str(REF_LON), str(REF_LAT), "place_lon", "place_lat")}, 3) AS dist_back_km FROM posts_a"""))
def q_haversine(spark, sf):
    p = derived.posts_a(spark, sf)
    return p.select("media_id",
                    F.round(geo.haversine_km("place_lon", "place_lat", F.lit(REF_LON), F.lit(REF_LAT)), 3).alias("dist_km"),
                    F.round(geo.haversine_km(F.lit(REF_LON), F.lit(REF_LAT), "place_lon", "place_lat"), 3)
                    .alias("dist_back_km"))


@query("cosine_distance", with_prelude("", f"""
SELECT media_id, round(CASE WHEN place_lat = {REF_LAT} AND place_lon = {REF_LON} THEN 0.0 ELSE
  acos(least(greatest(sin(radians(place_lat)) * sin(radians({REF_LAT})) + cos(radians(place_lat)) *
  cos(radians({REF_LAT})) * cos(radians(place_lon) - radians({REF_LON})), -1.0), 1.0)) * 6371.0 END, 3) AS dist_km
FROM posts_a"""))
def q_cosine_distance(spark, sf):
    p = derived.posts_a(spark, sf)
    return p.select("media_id", F.round(geo.cosine_distance_km("place_lon", "place_lat", F.lit(REF_LON),
                                                               F.lit(REF_LAT)), 3).alias("dist_km"))


@query("place_label", with_prelude("", """
SELECT media_id, concat_ws(',', CASE WHEN eid % 23 != 0 THEN place_name END, country_code) AS place_location
FROM posts_a"""))
def q_place_label(spark, sf):
    p = derived.posts_a(spark, sf)
    return p.select("media_id", text.place_label(F.when(_eid() % 23 != 0, F.col("place_name")),
                                                 F.col("country_code")).alias("place_location"))


SQL_LAG = f"""
lg AS (SELECT media_id, user_id, create_epoch, ts, place_lat, place_lon,
         lag(place_lat) OVER w AS p_lat, lag(place_lon) OVER w AS p_lon, lag(create_epoch) OVER w AS p_t,
         lag(ts) OVER w AS p_ts
       FROM posts_a WINDOW w AS (PARTITION BY user_id ORDER BY create_epoch, media_id)),
lg2 AS (SELECT *, {hav("place_lon", "place_lat", "p_lon", "p_lat")} AS dist, create_epoch - p_t AS iat FROM lg)"""


def _moved(spark, sf):
    p = derived.posts_a(spark, sf).withColumn("create_time", text.parse_post_time(F.col("create_time")))
    return clean.with_movement(p)


@query("interarrival", with_prelude(SQL_LAG, "SELECT media_id, CAST(iat AS BIGINT) AS interarrivaltime FROM lg2"))
def q_interarrival(spark, sf):
    return _moved(spark, sf).select("media_id", F.col("interarrivaltime").cast("long"))


@query("interdistance", with_prelude(SQL_LAG, "SELECT media_id, round(dist, 3) AS dist FROM lg2"))
def q_interdistance(spark, sf):
    return _moved(spark, sf).select("media_id", F.round("dist", 3).alias("dist"))


@query("post_speed", with_prelude(SQL_LAG, """
SELECT media_id, round(CASE WHEN iat = 0 THEN NULL ELSE dist * 3600 / iat END, 3) AS speed FROM lg2"""))
def q_post_speed(spark, sf):
    m = _moved(spark, sf)
    return m.select("media_id", F.round(text.safe_speed(F.col("dist"), F.col("interarrivaltime")), 3).alias("speed"))


@query("interarrival_days", with_prelude(SQL_LAG, """
SELECT media_id, CAST(date_diff('day', CAST(to_timestamp(p_t) AS DATE), CAST(to_timestamp(create_epoch) AS DATE))
       AS INTEGER) AS interarrival_days FROM lg2"""))
def q_interarrival_days(spark, sf):
    p = derived.posts_a(spark, sf).withColumn("create_time", text.parse_post_time(F.col("create_time")))
    return clean.with_day_gap(p).select("media_id", "interarrival_days")


@query("profile_coordinates", with_prelude("", r"""
SELECT DISTINCT user_name, user_location,
  CASE WHEN regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 0) != ''
       THEN regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 0) END AS match,
  CASE WHEN regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 0) != ''
       THEN TRY_CAST(regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 1) AS DOUBLE) END AS lat,
  CASE WHEN regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 0) != ''
       THEN TRY_CAST(regexp_extract(user_location, '(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})', 2) AS DOUBLE) END AS lon
FROM posts_a"""))
def q_profile_coordinates(spark, sf):
    p = derived.posts_a(spark, sf).select("user_name", "user_location").distinct()
    c = text.profile_coordinates(F.col("user_location"))
    return p.select("user_name", "user_location", c["match"].alias("match"), c["lat"].alias("lat"),
                    c["lon"].alias("lon"))


@query("posts_in_period", with_prelude("", f"""
SELECT media_id, user_id, create_time_stamp FROM media_b
WHERE create_time_stamp > {PERIOD[0]} AND create_time_stamp < {PERIOD[1]}"""))
def q_posts_in_period(spark, sf):
    m = derived.media_b(spark, sf)
    return frontier.in_period(m, "create_time_stamp", *PERIOD).select("media_id", "user_id", "create_time_stamp")


@query("posts_in_bbox", with_prelude("", f"""
SELECT media_id, lat, lon FROM posts_a WHERE lon BETWEEN {EUROPE_BOX[0]} AND {EUROPE_BOX[2]}
  AND lat BETWEEN {EUROPE_BOX[1]} AND {EUROPE_BOX[3]}"""))
def q_posts_in_bbox(spark, sf):
    p = derived.posts_a(spark, sf)
    return p.filter(geo.in_bbox("lon", "lat", *EUROPE_BOX)).select("media_id", "lat", "lon")


@query("source_b_urls", with_prelude("", """
SELECT media_id, expanded_url || '?__a=1' AS request_url FROM posts_a WHERE expanded_url LIKE '%media.example%'"""))
def q_source_b_urls(spark, sf):
    p = derived.posts_a(spark, sf)
    return frontier.with_request_suffix(p, "expanded_url", contains="media.example").select("media_id", "request_url")
