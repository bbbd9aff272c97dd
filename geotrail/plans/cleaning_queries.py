"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.operators import clean
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query
from geotrail.sources import derived

# Country list used by the queries over the derived data (parameter of the operators).
CODES_SQL = ", ".join(f"'{c}'" for c in clean.EUROPE_CODES)

SQL_COPIES = """
copies AS (
  SELECT *, 1 AS batch FROM posts_a
  UNION ALL SELECT *, 2 AS batch FROM posts_a WHERE eid % 17 = 0
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY batch) AS rn FROM copies) WHERE rn = 1
),
eu AS (
  SELECT * FROM dedup WHERE user_id IN (SELECT user_id FROM dedup WHERE country_code IN ({codes}))
),
mv AS (
  SELECT *,
    lag(place_lat) OVER w AS p_lat, lag(place_lon) OVER w AS p_lon, lag(create_epoch) OVER w AS p_t,
    lag(media_id) OVER w AS prev_media_id
  FROM eu WINDOW w AS (PARTITION BY user_id ORDER BY create_epoch, media_id)
),
mv2 AS (
  SELECT *, {dist} AS dist, create_epoch - p_t AS interarrivaltime FROM mv
),
nz AS (
  SELECT *, dist * 3600 / interarrivaltime AS speed FROM mv2
  WHERE interarrivaltime != 0 OR interarrivaltime IS NULL
),
clean AS (SELECT * FROM nz WHERE speed <= 1000 OR speed IS NULL)""".format(
    codes=CODES_SQL, dist=hav("place_lon", "place_lat", "p_lon", "p_lat"))

CLEAN_COLS_SQL = """media_id, user_id, country_code, create_epoch,
  round(dist, 3) AS dist, CAST(interarrivaltime AS BIGINT) AS interarrivaltime, round(speed, 3) AS speed"""


def _clean_cols(df):
    return df.select(
        "media_id", "user_id", "country_code",
        F.unix_timestamp("create_time").alias("create_epoch"),
        F.round("dist", 3).alias("dist"),
        F.col("interarrivaltime").cast("long").alias("interarrivaltime"),
        F.round("speed", 3).alias("speed"))


@query("clean_posts", with_prelude(SQL_COPIES, f"SELECT {CLEAN_COLS_SQL} FROM clean"))
def q_clean_posts(spark, sf):
    return _clean_cols(clean.clean_posts_a(derived.posts_a_with_copies(spark, sf)))


@query("clean_posts_both_ends", with_prelude(SQL_COPIES + """,
jumps AS (SELECT media_id, prev_media_id FROM nz WHERE NOT (speed <= 1000 OR speed IS NULL)),
bad AS (SELECT media_id AS b FROM jumps UNION SELECT prev_media_id FROM jumps WHERE prev_media_id IS NOT NULL)""",
    f"SELECT {CLEAN_COLS_SQL} FROM nz WHERE media_id NOT IN (SELECT b FROM bad)"))
def q_clean_posts_both_ends(spark, sf):
    return _clean_cols(clean.clean_posts_a(derived.posts_a_with_copies(spark, sf), mode="both"))


@query("clean_posts_user", with_prelude(SQL_COPIES,
    f"""SELECT {CLEAN_COLS_SQL} FROM nz WHERE user_id NOT IN
        (SELECT user_id FROM nz WHERE NOT (speed <= 1000 OR speed IS NULL))"""))
def q_clean_posts_user(spark, sf):
    return _clean_cols(clean.clean_posts_a(derived.posts_a_with_copies(spark, sf), mode="user"))


@query("dedup_posts", with_prelude(SQL_COPIES,
    "SELECT media_id, user_id, CAST(batch AS BIGINT) AS batch, create_time FROM dedup"))
def q_dedup_posts(spark, sf):
    # keep the batch column to show which copy survived
    d = clean.dedup_first(derived.posts_a_with_copies(spark, sf), "media_id", ["batch"])
    return d.select("media_id", "user_id", F.col("batch").cast("long").alias("batch"), "create_time")


@query("european_users", with_prelude("",
    f"""SELECT media_id, user_id, country_code FROM posts_a
        WHERE user_id IN (SELECT user_id FROM posts_a WHERE country_code IN ({CODES_SQL}))"""))
def q_european_users(spark, sf):
    return clean.users_ever_in(derived.posts_a(spark, sf)).select("media_id", "user_id", "country_code")


@query("posts_in_countries", with_prelude("",
    f"SELECT media_id, user_id, country_code FROM posts_a WHERE country_code IN ({CODES_SQL})"))
def q_posts_in_countries(spark, sf):
    return clean.posts_in_countries(derived.posts_a(spark, sf)).select("media_id", "user_id", "country_code")
