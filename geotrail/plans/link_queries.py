"""Queries of source B, linking and crawl bookkeeping (J1, J2, J8, J9, U1, U2,
K2, D2-D5, C1, C2, C7-C9, A11, L4, L5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.operators import clean, frontier, gazetteer, link
from geotrail.plans.cleaning_queries import CODES_SQL
from geotrail.plans.home_queries import SQL_HOME, ctx_a
from geotrail.plans.mobility_queries import SQL_POSTS_B, posts_b
from geotrail.plans.oracle_prelude import hav, with_prelude
from geotrail.plans.registry import query
from geotrail.sources import derived

SQL_LINK_TABLES = SQL_POSTS_B.lstrip() + """,
links AS (SELECT DISTINCT b.user_id, a.user_name, a.user_location FROM posts_b b JOIN net a ON b.url = a.expanded_url),
cross_b AS (SELECT DISTINCT l.user_name, b.media_id, b.followers_count, b.lat, b.lon, b.city_name AS place_name,
                   b.country_id AS country_code
            FROM posts_b b JOIN (SELECT DISTINCT user_id, user_name FROM links) l ON l.user_id = b.user_id)"""
SQL_LINK = SQL_HOME + "," + SQL_LINK_TABLES


def _links(spark, sf):
    c = ctx_a(spark, sf)
    return c, link.link_accounts(posts_b(spark, sf), c.net)


@query("assemble_posts_b", with_prelude(SQL_POSTS_B, """
SELECT media_id, user_id, user_name, location_id, country_id, city_name, lat, lon, create_time_stamp FROM posts_b"""))
def q_assemble_posts_b(spark, sf):
    return posts_b(spark, sf).select("media_id", "user_id", "user_name", "location_id", "country_id", "city_name",
                                     "lat", "lon", "create_time_stamp")


@query("clean_posts_b", with_prelude(SQL_POSTS_B + f""",
eub AS (SELECT * FROM posts_b WHERE user_id IN (SELECT user_id FROM posts_b WHERE country_id IN ({CODES_SQL}))),
mvb AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(create_time_stamp) OVER w AS p_t
        FROM eub WINDOW w AS (PARTITION BY user_id ORDER BY create_time_stamp, media_id)),
mvb2 AS (SELECT *, {hav("lon", "lat", "p_lon", "p_lat")} AS dist, create_time_stamp - p_t AS iat FROM mvb),
nzb AS (SELECT *, dist * 3600 / iat AS speed FROM mvb2 WHERE iat != 0 OR iat IS NULL)""", """
SELECT media_id, user_id, country_id, create_time_stamp AS create_epoch, round(dist, 3) AS dist,
       CAST(iat AS BIGINT) AS interarrivaltime, round(speed, 3) AS speed
FROM nzb WHERE speed <= 1000 OR speed IS NULL"""))
def q_clean_posts_b(spark, sf):
    c = clean.clean_posts_b(posts_b(spark, sf))
    return c.select("media_id", "user_id", "country_id", F.unix_timestamp("create_time").alias("create_epoch"),
                    F.round("dist", 3).alias("dist"), F.col("interarrivaltime").cast("long"),
                    F.round("speed", 3).alias("speed"))


@query("link_accounts", with_prelude(SQL_LINK, "SELECT user_id, user_name, user_location FROM links"))
def q_link_accounts(spark, sf):
    return _links(spark, sf)[1]


@query("cross_source_posts", with_prelude(SQL_LINK, "SELECT * FROM cross_b"))
def q_cross_source_posts(spark, sf):
    _, l = _links(spark, sf)
    return link.cross_source_posts(posts_b(spark, sf), l)


@query("home_candidates_both", with_prelude(SQL_LINK, """
SELECT user_name, media_id, followers_count, lat, lon, place_location FROM cand
UNION ALL
SELECT user_name, media_id, followers_count, lat, lon, concat_ws(',', place_name, country_code) FROM cross_b
WHERE user_name IN (SELECT user_name FROM cross_b GROUP BY user_name HAVING COUNT(DISTINCT media_id) >= 3)"""))
def q_home_candidates_both(spark, sf):
    c, l = _links(spark, sf)
    return link.home_candidates_both(c.cands, link.cross_source_posts(posts_b(spark, sf), l))


@query("profile_strings", with_prelude(SQL_HOME, "SELECT DISTINCT user_name AS source, user_location FROM net"))
def q_profile_strings(spark, sf):
    return gazetteer.profile_strings(ctx_a(spark, sf).net)


@query("geocode_gazetteer", with_prelude(SQL_HOME, r"""
SELECT s.source AS user_name, s.user_location, g.lat AS g_lat, g.lon AS g_lon, g.city || ',' || g.country AS g_label
FROM (SELECT DISTINCT user_name AS source, user_location FROM net) s
LEFT JOIN gazetteer g ON g.key = lower(trim(regexp_replace(s.user_location, '\s+', ' ', 'g')))"""))
def q_geocode_gazetteer(spark, sf):
    s = gazetteer.profile_strings(ctx_a(spark, sf).net)
    return gazetteer.geocode(s, derived.gazetteer(spark)).withColumnRenamed("source", "user_name")


@query("reverse_geocode", with_prelude("", f"""
SELECT media_id, lat, lon, place_label, round(dist_km, 3) AS dist_km FROM (
  SELECT p.media_id, p.lat, p.lon, g.city || ',' || g.country AS place_label,
         {hav("p.lon", "p.lat", "g.lon", "g.lat")} AS dist_km,
         row_number() OVER (PARTITION BY p.media_id ORDER BY {hav("p.lon", "p.lat", "g.lon", "g.lat")},
                            g.city || ',' || g.country) AS rn
  FROM posts_a p LEFT JOIN gazetteer g ON g.city <> 'Rome' AND {hav("p.lon", "p.lat", "g.lon", "g.lat")} <= 100.0)
WHERE rn = 1"""))
def q_reverse_geocode(spark, sf):
    """All posts against a gazetteer that lacks one city: points without a
    coordinate and points out of range stay, with nulls."""
    places = derived.gazetteer(spark).filter("city <> 'Rome'")
    r = gazetteer.reverse_geocode(derived.posts_a(spark, sf).select("media_id", "lat", "lon"), places, 100.0)
    return r.select("media_id", "lat", "lon", "place_label", F.round("dist_km", 3).alias("dist_km"))


AROUND = 177.65      # turns Paris to 180 degrees: its posts lie on both sides


def _turned(c: str) -> str:
    return f"(CASE WHEN {c} + {AROUND} > 180 THEN {c} + {AROUND} - 360 ELSE {c} + {AROUND} END)"


_TURNED_DIST = hav("p.lon", "p.lat", "g.lon", "g.lat")


@query("reverse_geocode_date_line", with_prelude(f"""
tp AS (SELECT media_id, lat, {_turned("lon")} AS lon FROM posts_a WHERE lat IS NOT NULL),
tg AS (SELECT city || ',' || country AS label, lat, {_turned("lon")} AS lon FROM gazetteer)""", f"""
SELECT media_id, lat, lon, place_label, round(dist_km, 3) AS dist_km FROM (
  SELECT p.media_id, p.lat, p.lon, g.label AS place_label, {_TURNED_DIST} AS dist_km,
         row_number() OVER (PARTITION BY p.media_id ORDER BY {_TURNED_DIST}, g.label) AS rn
  FROM tp p LEFT JOIN tg g ON {_TURNED_DIST} <= 12.0) WHERE rn = 1"""))
def q_reverse_geocode_date_line(spark, sf):
    """Posts and places turned about the poles until one city lies on the date line."""
    def turned(df):
        x = F.col("lon") + AROUND
        return df.withColumn("lon", F.when(x > 180, x - 360).otherwise(x))
    posts = derived.posts_a(spark, sf).filter("lat is not null").select("media_id", "lat", "lon")
    r = gazetteer.reverse_geocode(turned(posts), turned(derived.gazetteer(spark)), 12.0)
    return r.select("media_id", "lat", "lon", "place_label", F.round("dist_km", 3).alias("dist_km"))


SQL_NAMES = r"""
ul AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS user_name, CASE user_id % 10
    WHEN 0 THEN city || ', ' || country WHEN 1 THEN city WHEN 2 THEN upper(country || ' - ' || city)
    WHEN 3 THEN city[1:a - 1] || city[a + 1:] || ', ' || country
    WHEN 4 THEN city[1:a] || city[a:]
    WHEN 5 THEN ' near ' || city || '!! '
    WHEN 6 THEN city[1:a - 1] || city[a + 1] || city[a] || city[a + 2:] || ' (' || country || ')'
    WHEN 8 THEN 'somewhere over the rainbow' WHEN 9 THEN city || ' ' || code END AS user_location
  FROM (SELECT u.user_id, g.*, 2 + (u.user_id // 10) % (length(g.city) - 2) AS a
        FROM (SELECT DISTINCT user_id FROM events) u JOIN geo g ON g.k = (u.user_id // 7 * 5) % 12)),
places AS (
  SELECT city, country, code, lat, lon FROM gazetteer UNION ALL
  SELECT n_name, r_name, NULL, CAST(n_nationkey AS DOUBLE) * 3.5 - 40, CAST(n_nationkey AS DOUBLE) * 7 - 80
  FROM nation JOIN region ON n_regionkey = r_regionkey),
pn AS (SELECT city || ',' || country AS label, lat, lon, city,
              unnest([city, concat_ws(' ', city, country), concat_ws(' ', city, code)]) AS name FROM places),
nk AS (SELECT array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name), '[\p{L}\p{M}\p{N}]+'))), ' ') AS id,
              array_to_string(list_sort(list_distinct(regexp_extract_all(lower(city), '[\p{L}\p{M}\p{N}]+'))), ' ') AS city,
              label, lat, lon FROM pn),
names AS (SELECT id, label, lat, lon, city FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY label, lat, lon, city) AS rn FROM nk) WHERE rn = 1),
tk AS (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(user_location), '[\p{L}\p{M}\p{N}]+'))), ' ') AS id
       FROM ul),
words AS (SELECT DISTINCT id, unnest(string_split(id, ' ')) AS w FROM (SELECT id FROM names UNION SELECT id FROM tk) WHERE id <> ''),
feats AS (SELECT id, '=' || w AS f FROM words UNION
          SELECT id, ('^' || w || '$')[i:i + 2] FROM (SELECT id, w, unnest(range(1, length(w) + 1)) AS i FROM words)),
df AS (SELECT f, count(*) AS df FROM feats WHERE id IN (SELECT id FROM names) GROUP BY f),
wt AS (SELECT feats.id, feats.f, CAST(round(1000000 * ln(1 + (SELECT count(*) FROM names)::DOUBLE / coalesce(df.df, 1))) AS BIGINT) AS w
       FROM feats LEFT JOIN df ON df.f = feats.f),
tot AS (SELECT id, sum(w)::BIGINT AS total FROM wt GROUP BY id),
sc AS (SELECT t.id, n.label, n.lat, n.lon, coalesce(sum(c.w), 0)::BIGINT AS cw, any_value(z.total) AS ct,
              (sum(a.w)::BIGINT * 1000000) // (any_value(x.total) + any_value(y.total) - sum(a.w)::BIGINT) AS score
       FROM (SELECT DISTINCT id FROM tk) t JOIN wt a ON a.id = t.id JOIN wt b ON b.f = a.f JOIN names n ON n.id = b.id
       JOIN tot x ON x.id = t.id JOIN tot y ON y.id = n.id JOIN tot z ON z.id = n.city
       LEFT JOIN wt c ON c.id = n.city AND c.f = a.f GROUP BY t.id, n.id, n.label, n.lat, n.lon),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label, lat, lon) AS rn
                        FROM sc WHERE score >= 300000 AND cw * 1000000 >= 500000 * ct) WHERE rn = 1)"""


@query("geocode_text", with_prelude(SQL_NAMES, """
SELECT tk.user_name, tk.user_location, best.lat AS g_lat, best.lon AS g_lon, best.label AS g_label,
       CAST(best.score AS BIGINT) AS g_score FROM tk LEFT JOIN best ON best.id = tk.id"""))
def q_geocode_text(spark, sf):
    """Profile texts with typos, missing countries and turned words against cities and nations."""
    return gazetteer.geocode_text(derived.unclean_locations(spark, sf), derived.gazetteer_with_nations(spark, sf))


SQL_FRONTIER = """
seen_b AS (SELECT m.media_id, m.create_time_stamp, m.location_id, u.user_name
           FROM media_b m JOIN users_b u ON u.user_id = m.user_id)"""


@query("frontier_users", with_prelude(SQL_FRONTIER, """
SELECT user_name, min(create_time_stamp) AS first_create_time_stamp FROM seen_b
WHERE user_name NOT IN (SELECT user_name FROM users_b WHERE uid % 4 = 0) GROUP BY user_name"""))
def q_frontier_users(spark, sf):
    users = derived.users_b(spark, sf)
    seen = derived.media_b(spark, sf).join(users.select("user_id", "user_name"), "user_id")
    queried = users.filter(F.substring("user_id", 2, 20).cast("long") % 4 == 0).select("user_name")
    return frontier.frontier(seen, queried, "user_name", ["create_time_stamp", "media_id"])


@query("frontier_locations", with_prelude("", """
SELECT location_id, min(create_time_stamp) AS first_create_time_stamp FROM media_b
WHERE location_id IS NOT NULL AND location_id NOT IN ('L0', 'L3', 'L6', 'L9') GROUP BY location_id"""))
def q_frontier_locations(spark, sf):
    m = derived.media_b(spark, sf)
    fetched = derived.locations_b_for(m).filter(F.substring("location_id", 2, 8).cast("int") % 3 == 0)
    return frontier.frontier(m, fetched, "location_id", ["create_time_stamp", "media_id"])


@query("user_audit", with_prelude("", """
SELECT u.user_id, u.user_name, CAST(a.n AS BIGINT) AS sample_status_count,
       CAST(a.nl AS BIGINT) AS status_with_location_count
FROM users_b u LEFT JOIN (SELECT user_id, COUNT(*) AS n, COUNT(location_id) AS nl FROM media_b GROUP BY user_id) a
ON a.user_id = u.user_id"""))
def q_user_audit(spark, sf):
    a = frontier.user_audit(derived.users_b(spark, sf), derived.media_b(spark, sf))
    return a.select("user_id", "user_name", "sample_status_count", "status_with_location_count")


SAMPLE_N, FIRST_N = 100, 100


@query("sample_n", with_prelude("", f"""
SELECT media_id, request_url FROM (SELECT media_id, expanded_url || '?__a=1' AS request_url FROM posts_a
WHERE expanded_url LIKE '%media.example%') ORDER BY md5(request_url || '7'), request_url LIMIT {SAMPLE_N}"""))
def q_sample_n(spark, sf):
    u = frontier.with_request_suffix(derived.posts_a(spark, sf), "expanded_url", contains="media.example")
    return frontier.sample_n(u.select("media_id", "request_url"), "request_url", SAMPLE_N, seed=7)


@query("first_n_users", with_prelude("", f"SELECT user_id, user_name FROM users_b ORDER BY user_id LIMIT {FIRST_N}"))
def q_first_n_users(spark, sf):
    return frontier.first_n(derived.users_b(spark, sf).select("user_id", "user_name"), "user_id", FIRST_N)
