"""DuckDB CTEs deriving the mobility tables from ``events`` (FIXTURES.md §2).

Written independently of the Spark derivation (a join to a VALUES table
instead of array lookups) so the oracle checks the formulas too.
"""

from geotrail.sources.derived import GEO_ROWS


def _geo_values() -> str:
    rows = ",\n    ".join(
        f"({k}, '{code}', '{city}', '{country}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))"
        for k, code, city, country, lat, lon in GEO_ROWS)
    return rows


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Haversine km as DuckDB SQL text, radicand clamped to [0, 1]."""
    a = (f"(sin(radians(({lat2}) - ({lat1})) / 2) * sin(radians(({lat2}) - ({lat1})) / 2) + "
         f"cos(radians({lat1})) * cos(radians({lat2})) * "
         f"sin(radians(({lon2}) - ({lon1})) / 2) * sin(radians(({lon2}) - ({lon1})) / 2))")
    a = f"(CASE WHEN {a} < 0 THEN 0.0 WHEN {a} > 1 THEN 1.0 ELSE {a} END)"
    return f"(6371.0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))))"


PRELUDE = f"""
geo(k, code, city, country, lat0, lon0) AS (VALUES
    {_geo_values()}
),
ev AS (
  SELECT event_id, ts, user_id,
    CASE WHEN user_id % 7 = 2 AND event_id % 2 = 0 THEN (user_id + CAST(floor(event_id / 2) AS BIGINT)) % 12
         WHEN user_id % 3 = 0 THEN (user_id // 7 * 5) % 12
         WHEN event_id % 10 = 0 THEN (user_id + CAST(floor(event_id / 10) AS BIGINT)) % 12
         ELSE (user_id // 7 * 5) % 12 END AS k,
    (user_id // 7 * 5) % 12 AS home_k
  FROM events
),
posts_a AS (
  SELECT
    CAST(ev.user_id AS VARCHAR) AS user_id,
    'u' || CAST(ev.user_id AS VARCHAR) AS user_name,
    'User ' || CAST(ev.user_id AS VARCHAR) AS full_name,
    CASE WHEN ev.user_id % 5 = 0 THEN NULL WHEN ev.user_id % 5 = 1 THEN '48.8566, 2.3522'
         ELSE h.city || ', ' || h.country END AS user_location,
    CAST(ev.user_id * 10 + 5 AS BIGINT) AS followers_count,
    CAST(ev.event_id AS VARCHAR) AS media_id,
    ev.event_id AS eid,
    ev.user_id AS uid,
    ev.ts AS ts,
    CASE WHEN ev.event_id % 5 = 0 THEN 'plain text'
         ELSE 'hi @u' || CAST(abs(ev.user_id + ev.event_id % 7 - 3) AS VARCHAR) END AS text,
    strftime(ev.ts, '%a %b %d %H:%M:%S +0000 %Y') AS create_time,
    CAST(floor(epoch(ev.ts)) AS BIGINT) AS create_epoch,
    CASE ev.event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'en' END AS lang,
    g.code AS country_code, g.country AS country,
    CASE WHEN ev.event_id % 4 = 3 THEN 'admin' ELSE 'city' END AS place_type,
    g.city || ', ' || g.country AS place_full_name,
    g.city AS place_name,
    'P' || CAST(g.k AS VARCHAR) AS place_id,
    g.lat0 + CAST((ev.event_id * 37) % 200 - 100 AS DOUBLE) / 1000 AS place_lat,
    g.lon0 + CAST((ev.event_id * 53) % 200 - 100 AS DOUBLE) / 1000 AS place_lon,
    CASE WHEN ev.event_id % 3 = 0 THEN g.lat0 + CAST((ev.event_id * 37) % 200 - 100 AS DOUBLE) / 1000 END AS lat,
    CASE WHEN ev.event_id % 3 = 0 THEN g.lon0 + CAST((ev.event_id * 53) % 200 - 100 AS DOUBLE) / 1000 END AS lon,
    CASE WHEN ev.event_id % 22 = 0 THEN 'https://media.example/p/m' || CAST(ev.event_id AS VARCHAR) || '/'
         WHEN ev.event_id % 13 = 0 THEN 'https://other.example/' || CAST(ev.event_id AS VARCHAR) END AS expanded_url
  FROM ev JOIN geo g ON g.k = ev.k JOIN geo h ON h.k = ev.home_k
),
media_b AS (
  SELECT 'm' || CAST(event_id AS VARCHAR) AS media_id,
         'b' || CAST(user_id AS VARCHAR) AS user_id,
         event_id AS eid, user_id AS uid,
         CASE WHEN event_id % 5 = 0 THEN NULL
              WHEN event_id % 8 = 0 THEN 'L' || CAST((user_id + CAST(floor(event_id / 8) AS BIGINT)) % 12 AS VARCHAR)
              ELSE 'L' || CAST((user_id // 7 * 5) % 12 AS VARCHAR) END AS location_id,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'pic ' || CAST(event_id AS VARCHAR) END AS text,
         CAST(floor(epoch(ts)) AS BIGINT) AS create_time_stamp,
         'https://media.example/p/m' || CAST(event_id AS VARCHAR) || '/' AS url
  FROM events WHERE event_id % 2 = 0
),
users_b AS (
  SELECT 'b' || CAST(user_id AS VARCHAR) AS user_id, 'ig' || CAST(user_id AS VARCHAR) AS user_name,
         user_id AS uid, CAST(user_id * 10 + 5 AS BIGINT) AS followers_count
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 10 != 7
),
locations_b AS (
  SELECT 'L' || CAST(k AS VARCHAR) AS location_id, city AS location_name, lat0 AS lat, lon0 AS lon,
         code AS country_id, country AS country_name, 'C' || CAST(k AS VARCHAR) AS city_id, city AS city_name
  FROM geo WHERE 'L' || CAST(k AS VARCHAR) IN (SELECT location_id FROM media_b)
),
profile_truth_raw AS (
  SELECT 'u' || CAST(u.user_id AS VARCHAR) AS user_name, CAST(g.lat0 AS VARCHAR) AS lat,
         CAST(g.lon0 AS VARCHAR) AS lon, g.city AS user_city, g.country AS user_country
  FROM (SELECT DISTINCT user_id FROM events) u JOIN geo g ON g.k = (u.user_id // 7 * 5) % 12
  WHERE u.user_id % 5 IN (2, 3, 4)
),
gazetteer AS (
  SELECT lower(city || ', ' || country) AS key, city, country, code, lat0 AS lat, lon0 AS lon FROM geo
)"""


def with_prelude(body_ctes: str, final_select: str) -> str:
    """Assemble ``WITH <prelude>, <body ctes> <final select>``."""
    ctes = PRELUDE + ("," + body_ctes if body_ctes.strip() else "")
    return f"WITH {ctes}\n{final_select}"
