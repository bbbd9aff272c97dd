"""Queries of the mobility report."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.operators import clean, mobility
from geotrail.plans.cleaning_queries import SQL_COPIES
from geotrail.plans.oracle_prelude import with_prelude
from geotrail.plans.registry import query
from geotrail.session import store
from geotrail.sources import derived


TOP_N = 50      # rows of the report tables, as the mobility report cut them


def posts_b(spark, sf):
    """Source-B posts: users x media (two batches) x locations."""
    media = derived.media_b(spark, sf)
    batches = [media.filter(F.substring("media_id", 2, 20).cast("long") % 4 != 0),
               media.filter(F.substring("media_id", 2, 20).cast("long") % 4 == 0)]
    return clean.assemble_posts_b(derived.users_b(spark, sf), batches, derived.locations_b(spark, sf))


SQL_POSTS_B = """
posts_b AS (
  SELECT u.user_id, u.user_name, u.followers_count, m.media_id, m.location_id, m.text,
         m.create_time_stamp, m.url, l.lat, l.lon, l.country_id, l.country_name, l.city_name
  FROM users_b u JOIN media_b m ON m.user_id = u.user_id JOIN locations_b l ON l.location_id = m.location_id
)"""

SQL_UCC = """
ucc AS (SELECT user_id, country_code, COUNT(DISTINCT media_id) AS cnt FROM posts_a
        WHERE country_code IS NOT NULL GROUP BY user_id, country_code),
res AS (SELECT user_id, country_code FROM ucc u
        WHERE cnt = (SELECT max(cnt) FROM ucc v WHERE v.user_id = u.user_id)),
mob AS (SELECT user_id FROM posts_a WHERE country_code IS NOT NULL GROUP BY user_id
        HAVING COUNT(DISTINCT country_code) > 1)"""

SQL_UCC_B = SQL_POSTS_B + """,
uccb AS (SELECT user_id, country_id, COUNT(DISTINCT media_id) AS cnt FROM posts_b
         WHERE country_id IS NOT NULL GROUP BY user_id, country_id),
resb AS (SELECT user_id, country_id FROM uccb u
         WHERE cnt = (SELECT max(cnt) FROM uccb v WHERE v.user_id = u.user_id))"""


def _a(spark, sf):
    return derived.posts_a(spark, sf)


def _residence_and_mobile(posts, user="user_id", country="country_code"):
    """Both from one pass over the posts: the (user, country) table is stored."""
    counts = store(mobility.user_country_counts(posts, user, country), "counts")
    return mobility.residence(counts, user, country), mobility.mobile_from_counts(counts, user)


def _res_a(spark, sf):
    return mobility.residence(mobility.user_country_counts(_a(spark, sf)))


@query("posts_by_language", with_prelude("", """
SELECT lang, CAST(COUNT(DISTINCT media_id) AS BIGINT) AS posts FROM posts_a WHERE lang IS NOT NULL
GROUP BY lang ORDER BY posts DESC, lang LIMIT 50"""))
def q_posts_by_language(spark, sf):
    return mobility.posts_by_language(_a(spark, sf), TOP_N)


@query("user_country_counts", with_prelude(SQL_UCC,
    "SELECT user_id, country_code, CAST(cnt AS BIGINT) AS count FROM ucc"))
def q_user_country_counts(spark, sf):
    return mobility.user_country_counts(_a(spark, sf)).withColumn("count", F.col("count").cast("long"))


@query("residence", with_prelude(SQL_UCC, "SELECT user_id, country_code FROM res"))
def q_residence(spark, sf):
    return _res_a(spark, sf)


@query("residence_parity", with_prelude(SQL_UCC_B + "," + SQL_UCC.lstrip().rstrip(), """
SELECT DISTINCT user_id, country_id FROM uccb WHERE cnt IN (SELECT max(cnt) FROM ucc GROUP BY user_id)"""))
def q_residence_parity(spark, sf):
    # source B's residence judged against source A's per-user maxima (as the reference did)
    counts_a = mobility.user_country_counts(_a(spark, sf))
    counts_b = mobility.user_country_counts(posts_b(spark, sf), "user_id", "country_id")
    return mobility.residence(counts_b, "user_id", "country_id", maxima_from=counts_a, parity=True)


@query("users_by_country", with_prelude(SQL_UCC, """
SELECT country_code, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users FROM res GROUP BY country_code
ORDER BY users DESC, country_code LIMIT 50"""))
def q_users_by_country(spark, sf):
    return mobility.users_by_country(_res_a(spark, sf), n=TOP_N)


@query("mobile_users", with_prelude(SQL_UCC, "SELECT user_id FROM mob"))
def q_mobile_users(spark, sf):
    return mobility.mobile_users(_a(spark, sf))


@query("mobile_users_by_country", with_prelude(SQL_UCC, """
SELECT r.country_code, CAST(COUNT(DISTINCT m.user_id) AS BIGINT) AS mobile_users
FROM res r JOIN mob m ON r.user_id = m.user_id GROUP BY r.country_code
ORDER BY mobile_users DESC, r.country_code LIMIT 50"""))
def q_mobile_users_by_country(spark, sf):
    return mobility.mobile_users_by_country(*_residence_and_mobile(_a(spark, sf)), n=TOP_N)


@query("mobile_share_by_country", with_prelude(SQL_UCC + """,
mu AS (SELECT r.country_code, COUNT(DISTINCT m.user_id) AS mobile_users FROM res r JOIN mob m
       ON r.user_id = m.user_id GROUP BY r.country_code),
uu AS (SELECT country_code, COUNT(DISTINCT user_id) AS users FROM res GROUP BY country_code)""", """
SELECT mu.country_code, round(CAST(mobile_users AS DOUBLE) / CAST(users AS DOUBLE), 3) AS mobile_share
FROM mu JOIN uu ON mu.country_code = uu.country_code ORDER BY mobile_share DESC, mu.country_code LIMIT 50"""))
def q_mobile_share_by_country(spark, sf):
    return mobility.mobile_share_by_country(*_residence_and_mobile(_a(spark, sf)), n=TOP_N)


SQL_BOTH = SQL_UCC + "," + SQL_UCC_B.lstrip() + """,
mobb AS (SELECT user_id FROM posts_b WHERE country_id IS NOT NULL GROUP BY user_id
         HAVING COUNT(DISTINCT country_id) > 1),
ua AS (SELECT country_code, COUNT(DISTINCT user_id) AS users FROM res GROUP BY country_code),
ub AS (SELECT country_id, COUNT(DISTINCT user_id) AS users_b FROM resb GROUP BY country_id),
ma AS (SELECT r.country_code, COUNT(DISTINCT m.user_id) AS mobile_users FROM res r JOIN mob m
       ON r.user_id = m.user_id GROUP BY r.country_code),
mb AS (SELECT r.country_id, COUNT(DISTINCT m.user_id) AS mobile_users FROM resb r JOIN mobb m
       ON r.user_id = m.user_id GROUP BY r.country_id),
sa AS (SELECT ma.country_code, round(CAST(mobile_users AS DOUBLE) / CAST(users AS DOUBLE), 3) AS mobile_share
       FROM ma JOIN ua ON ma.country_code = ua.country_code),
sb AS (SELECT mb.country_id, round(CAST(mobile_users AS DOUBLE) / CAST(users_b AS DOUBLE), 3) AS mobile_share_b
       FROM mb JOIN ub ON mb.country_id = ub.country_id)"""


def _b(spark, sf):
    """Source B: residence and mobile users."""
    return _residence_and_mobile(posts_b(spark, sf), *B_COLS)


B_COLS = ("user_id", "country_id")


# the two lists are joined whole; a cut of each before the join would lose
# countries that are frequent in one source only
@query("users_by_country_both", with_prelude(SQL_BOTH, """
SELECT ua.country_code, CAST(users AS BIGINT) AS users, CAST(users_b AS BIGINT) AS users_b
FROM ua JOIN ub ON ua.country_code = ub.country_id ORDER BY users DESC, ua.country_code LIMIT 50"""))
def q_users_by_country_both(spark, sf):
    ua = mobility.users_by_country(_res_a(spark, sf))
    ub = mobility.users_by_country(_b(spark, sf)[0], *B_COLS, "users_b")
    return mobility.top_n(ua.join(ub, ua["country_code"] == ub["country_id"]).drop("country_id"),
                          "users", "country_code", TOP_N)


@query("mobile_users_b", with_prelude(SQL_BOTH, "SELECT user_id FROM mobb"))
def q_mobile_users_b(spark, sf):
    return mobility.mobile_users(posts_b(spark, sf), *B_COLS)


@query("mobile_users_by_country_b", with_prelude(SQL_BOTH, """
SELECT country_id, CAST(mobile_users AS BIGINT) AS mobile_users FROM mb
ORDER BY mobile_users DESC, country_id LIMIT 50"""))
def q_mobile_users_by_country_b(spark, sf):
    return mobility.mobile_users_by_country(*_b(spark, sf), *B_COLS, n=TOP_N)


@query("mobile_share_by_country_b", with_prelude(SQL_BOTH, """
SELECT country_id, mobile_share_b AS mobile_share FROM sb ORDER BY mobile_share DESC, country_id LIMIT 50"""))
def q_mobile_share_by_country_b(spark, sf):
    return mobility.mobile_share_by_country(*_b(spark, sf), *B_COLS, n=TOP_N)


@query("mobile_share_both", with_prelude(SQL_BOTH, """
SELECT country_code, mobile_share, mobile_share_b FROM sa JOIN sb ON sa.country_code = sb.country_id
ORDER BY mobile_share DESC, country_code LIMIT 50"""))
def q_mobile_share_both(spark, sf):
    a = mobility.mobile_share_by_country(*_residence_and_mobile(_a(spark, sf)))
    b = mobility.mobile_share_by_country(*_b(spark, sf), *B_COLS, name="mobile_share_b")
    return mobility.top_n(a.join(b, a["country_code"] == b["country_id"]).drop("country_id"),
                          "mobile_share", "country_code", TOP_N)


@query("countries_per_user", with_prelude("", """
SELECT user_id, CAST(COUNT(DISTINCT country_code) AS BIGINT) AS countries FROM posts_a GROUP BY user_id"""))
def q_countries_per_user(spark, sf):
    return mobility.countries_per_user(_a(spark, sf))


@query("mobility_histogram", with_prelude("""
cpu AS (SELECT user_id, CAST(COUNT(DISTINCT country_code) AS DOUBLE) AS v FROM posts_a GROUP BY user_id),
rng AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, COUNT(*) AS n FROM cpu),
b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin FROM cpu, rng),
c AS (SELECT bin, COUNT(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))""", """
SELECT g.bin, lo + g.bin * ((hi - lo) / 10) AS lo, lo + (g.bin + 1) * ((hi - lo) / 10) AS hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count, coalesce(cnt, 0) / (n * ((hi - lo) / 10)) AS density
FROM g CROSS JOIN rng LEFT JOIN c ON c.bin = g.bin"""))
def q_mobility_histogram(spark, sf):
    return mobility.density_histogram(mobility.countries_per_user(_a(spark, sf)), "countries", 10)


@query("mobility_rank", with_prelude("""
cpu AS (SELECT user_id, CAST(COUNT(DISTINCT country_code) AS BIGINT) AS countries FROM posts_a GROUP BY user_id)""",
"""SELECT user_id, countries, CAST(row_number() OVER (ORDER BY countries DESC, user_id) AS BIGINT) AS position
FROM cpu"""))
def q_mobility_rank(spark, sf):
    return mobility.rank_desc(mobility.countries_per_user(_a(spark, sf)), "countries", "user_id") \
        .select("user_id", "countries", F.col("position").cast("long").alias("position"))


@query("geotagged_share", with_prelude("", """
SELECT CAST(COUNT(lat) AS BIGINT) AS tagged, CAST(COUNT(*) AS BIGINT) AS total,
       round(CAST(COUNT(lat) AS DOUBLE) / COUNT(*), 6) AS share FROM posts_a"""))
def q_geotagged_share(spark, sf):
    return mobility.geotagged_share(_a(spark, sf))


@query("stage_counts", with_prelude(SQL_COPIES, """
SELECT 'raw' AS stage, CAST(COUNT(DISTINCT media_id) AS BIGINT) AS posts, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users FROM copies
UNION ALL SELECT 'dedup', COUNT(DISTINCT media_id), COUNT(DISTINCT user_id) FROM dedup
UNION ALL SELECT 'in_countries', COUNT(DISTINCT media_id), COUNT(DISTINCT user_id) FROM eu
UNION ALL SELECT 'clean', COUNT(DISTINCT media_id), COUNT(DISTINCT user_id) FROM clean"""))
def q_stage_counts(spark, sf):
    raw = derived.posts_a_with_copies(spark, sf)
    dedup = clean.dedup_first(raw, "media_id", ["batch"])
    eu = clean.users_ever_in(dedup)
    return mobility.stage_counts([("raw", raw), ("dedup", dedup), ("in_countries", eu),
                                  ("clean", clean.clean_posts_a(raw))])
