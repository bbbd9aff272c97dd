"""JSON payloads in the collectors' shapes, built from the derived tables
(``to_json`` over struct columns), to drive the flatteners with data that
grows with ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.sources import derived


def _eid() -> F.Column:
    return F.col("media_id").cast("long")


def post_payloads(spark, sf) -> DataFrame:
    p = derived.posts_a(spark, sf)
    lat, lon = F.col("place_lat"), F.col("place_lon")
    v = lambda dx, dy: F.array((lon + dx), (lat + dy))
    ring = F.when(_eid() % 19 == 0, F.array(v(-0.01, -0.01))).otherwise(
        F.array(v(-0.01, -0.01), v(-0.01, 0.01), v(0.01, 0.01), v(0.01, -0.01)))
    place = F.when(_eid() % 11 != 0, F.struct(
        F.col("country_code").alias("country_code"), F.col("country").alias("country"),
        F.col("place_type").alias("place_type"), F.col("place_full_name").alias("full_name"),
        F.col("place_name").alias("name"), F.col("place_id").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("bounding_box")))
    user = F.struct(F.col("user_id").alias("id_str"), F.col("user_name").alias("screen_name"),
                    F.col("full_name").alias("name"), F.col("user_location").alias("location"),
                    F.col("followers_count").alias("followers_count"), F.col("follows_count").alias("friends_count"),
                    F.col("status_all_count").alias("statuses_count"), F.col("listed_count").alias("listed_count"),
                    F.lit(True).alias("geo_enabled"), F.lit(False).alias("protected"), F.lit(False).alias("verified"))
    coords = F.when(F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"),
                                                       F.array(F.col("lon"), F.col("lat")).alias("coordinates")))
    urls = F.when(F.col("expanded_url").isNotNull(), F.array(F.struct(
        F.col("expanded_url").alias("expanded_url"), F.col("url").alias("url")))).otherwise(
        F.array().cast("array<struct<expanded_url:string,url:string>>"))
    doc = F.struct(F.col("media_id").alias("id_str"), F.col("text").alias("text"),
                   F.col("create_time").alias("created_at"), F.col("lang").alias("lang"), user.alias("user"),
                   place.alias("place"), coords.alias("coordinates"), F.struct(urls.alias("urls")).alias("entities"))
    return p.select(F.to_json(doc).alias("value"))


def media_payloads(spark, sf) -> DataFrame:
    m = derived.media_b(spark, sf)
    caption = F.when(F.col("text").isNotNull(), F.array(F.struct(F.struct(F.col("text").alias("text")).alias("node"))))
    doc = F.struct(F.col("media_id").alias("shortcode"), F.struct(F.col("user_id").alias("id")).alias("owner"),
                   F.when(F.col("location_id").isNotNull(), F.struct(F.col("location_id").alias("id"))).alias("location"),
                   F.struct(F.coalesce(caption, F.array().cast("array<struct<node:struct<text:string>>>"))
                            .alias("edges")).alias("edge_media_to_caption"),
                   F.col("create_time_stamp").alias("taken_at_timestamp"))
    return m.select(F.to_json(doc).alias("value"))


def user_payloads(spark, sf) -> DataFrame:
    """One payload per source-B user; private when uid % 9 = 4, empty id when
    uid % 17 = 5, cut short (broken JSON) when uid % 13 = 6."""
    u = derived.users_b(spark, sf)
    uid = F.substring("user_id", 2, 20).cast("long")
    doc = F.struct(F.when(uid % 17 == 5, F.lit("")).otherwise(F.col("user_id")).alias("id"),
                   F.col("user_name").alias("username"), F.col("full_name").alias("full_name"),
                   (uid % 9 == 4).alias("is_private"),
                   F.struct(F.col("followers_count").alias("count")).alias("followed_by"),
                   F.struct(F.col("follows_count").alias("count")).alias("follows"),
                   F.struct(F.col("status_all_count").alias("count")).alias("media"))
    js = F.to_json(doc)
    return u.select(F.col("user_id").alias("payload_id"),
                    F.when(uid % 13 == 6, F.substring(js, 1, 25)).otherwise(js).alias("value"))


def location_payloads(spark, sf) -> DataFrame:
    l = derived.locations_b(spark, sf)
    doc = F.struct(F.col("location_id").alias("id"), F.col("location_name").alias("name"), F.col("lat").alias("lat"),
                   F.col("lon").alias("lng"),
                   F.struct(F.struct(F.col("country_id").alias("id"), F.col("country_name").alias("name")).alias("country"),
                            F.struct(F.col("city_id").alias("id"), F.col("city_name").alias("name")).alias("city"))
                   .alias("directory"))
    return l.select(F.to_json(doc).alias("value"))


def page_payloads(spark, sf) -> DataFrame:
    """Timeline pages: media of one user grouped by page = floor(event_id / 100)
    (at most 100 posts per page); status 'fail' when (uid + page) % 7 = 3."""
    m = derived.media_b(spark, sf).withColumn("_page", F.floor(F.substring("media_id", 2, 20).cast("long") / 100))
    pages = m.groupBy("user_id", "_page").agg(F.collect_list(F.struct(F.struct(
        F.col("create_time_stamp").alias("taken_at_timestamp"), F.col("media_id").alias("shortcode")).alias("node")))
        .alias("edges"), F.count(F.lit(1)).alias("n"))
    uid = F.substring("user_id", 2, 20).cast("long")
    doc = F.struct(F.when((uid + F.col("_page")) % 7 == 3, F.lit("fail")).otherwise(F.lit("ok")).alias("status"),
                   F.struct(F.struct(F.struct(F.col("n").alias("count"),
                                              F.struct(F.concat(F.col("user_id"), F.lit(":"), F.col("_page").cast("string"))
                                                       .alias("end_cursor")).alias("page_info"),
                                              F.col("edges").alias("edges")).alias("edge_owner_to_timeline_media"))
                            .alias("user")).alias("data"))
    return pages.select("user_id", F.to_json(doc).alias("value"))
