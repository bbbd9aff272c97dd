"""Queries of JSON ingestion and parquet batches (S2, S4-S9, F1-F8, F22, F26,
P11, P12, C3, C4) and of the text patterns over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.functions import text
from geotrail.operators import clean, graph, home
from geotrail.plans.cleaning_queries import CLEAN_COLS_SQL, SQL_COPIES, _clean_cols
from geotrail.plans.function_queries import PERIOD
from geotrail.plans.oracle_prelude import with_prelude
from geotrail.plans.registry import query
from geotrail.session import scratch_path
from geotrail.sources import derived, ingest, payloads


@query("flatten_posts", with_prelude("", """
SELECT user_id, user_name, user_location, followers_count, media_id, text, create_time, lang,
  CASE WHEN eid % 11 != 0 THEN country_code END AS country_code,
  CASE WHEN eid % 11 != 0 THEN place_type END AS place_type,
  CASE WHEN eid % 11 != 0 THEN place_name END AS place_name,
  CASE WHEN eid % 11 = 0 THEN NULL WHEN eid % 19 = 0 THEN place_lat + -0.01
       ELSE ((place_lat + -0.01) + (place_lat + 0.01)) / 2 END AS place_lat,
  CASE WHEN eid % 11 = 0 THEN NULL WHEN eid % 19 = 0 THEN place_lon + -0.01
       ELSE ((place_lon + -0.01) + (place_lon + 0.01)) / 2 END AS place_lon,
  lat, lon, expanded_url,
  CASE WHEN expanded_url IS NOT NULL THEN 'https://t.example/' || media_id END AS url
FROM posts_a"""))
def q_flatten_posts(spark, sf):
    f = ingest.flatten_posts(payloads.post_payloads(spark, sf))
    return f.select("user_id", "user_name", "user_location", "followers_count", "media_id", "text", "create_time",
                    "lang", "country_code", "place_type", "place_name", "place_lat", "place_lon", "lat", "lon",
                    "expanded_url", "url")


@query("flatten_media", with_prelude("",
    "SELECT media_id, user_id, location_id, text, create_time_stamp, url FROM media_b"))
def q_flatten_media(spark, sf):
    return ingest.flatten_media(payloads.media_payloads(spark, sf))


@query("flatten_users", with_prelude("", """
SELECT user_id, user_name, 'Insta ' || CAST(uid AS VARCHAR) AS full_name, followers_count,
       CAST(uid * 3 AS BIGINT) AS follows_count, CAST(uid * 2 + 1 AS BIGINT) AS status_all_count
FROM users_b WHERE uid % 9 != 4 AND uid % 13 != 6 AND uid % 17 != 5"""))
def q_flatten_users(spark, sf):
    return ingest.flatten_users(payloads.user_payloads(spark, sf)).drop("user_description")


@query("quarantine_payloads", with_prelude("", "SELECT user_id AS payload_id FROM users_b WHERE uid % 13 = 6"))
def q_quarantine_payloads(spark, sf):
    return ingest.quarantine(payloads.user_payloads(spark, sf), ingest.USER_PAYLOAD).select("payload_id")


@query("flatten_locations", with_prelude("", "SELECT * FROM locations_b"))
def q_flatten_locations(spark, sf):
    return ingest.flatten_locations(payloads.location_payloads(spark, sf))


@query("paged_post_codes", with_prelude("", f"""
SELECT user_id, media_id AS shortcode, create_time_stamp AS taken_at_timestamp,
       'https://media.example/p/' || media_id || '/?__a=1' AS request_url
FROM media_b WHERE (uid + CAST(floor(eid / 100) AS BIGINT)) % 7 != 3
  AND create_time_stamp > {PERIOD[0]} AND create_time_stamp < {PERIOD[1]}"""))
def q_paged_post_codes(spark, sf):
    return ingest.paged_post_codes(payloads.page_payloads(spark, sf), *PERIOD, keys=("user_id",))


@query("scan_merge_schema", with_prelude("", """
SELECT media_id, user_id, country_code, CASE WHEN eid % 2 = 1 THEN lang END AS lang FROM posts_a"""))
def q_scan_merge_schema(spark, sf):
    p = derived.posts_a(spark, sf)
    root = scratch_path(spark, "posts-batches")
    odd = F.col("media_id").cast("long") % 2 == 1
    ingest.write_batch(p.filter(~odd).select("media_id", "user_id", "country_code"), root, "2024_01_01_00_00")
    ingest.write_batch(p.filter(odd).select("media_id", "user_id", "country_code", "lang"), root, "2024_01_01_01_00")
    return ingest.read_parquet_batches(spark, root).select("media_id", "user_id", "country_code", "lang")


FLAT = ("user_id", "media_id", "text", "create_time", "lang", "lat", "lon", "expanded_url")
SQL_FLAT = "SELECT user_id, media_id, text, create_time, lang, lat, lon, expanded_url FROM posts_a"


@query("scan_json_lines", with_prelude("", SQL_FLAT))
def q_scan_json_lines(spark, sf):
    """Post payloads written as JSON-lines files, read back and flattened."""
    path = scratch_path(spark, "json-lines")
    payloads.post_payloads(spark, sf).write.text(path)
    return ingest.flatten_posts(ingest.read_json_lines(spark, path)).select(*FLAT)


@query("scan_csv_profiles", with_prelude("", """
SELECT user_name, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon,
       concat_ws(',', user_city, user_country) AS user_location FROM (SELECT DISTINCT * FROM profile_truth_raw)"""))
def q_scan_csv_profiles(spark, sf):
    """Profile truth written as CSV with a header, read as text and typed."""
    path = scratch_path(spark, "csv")
    derived.profile_truth_raw(spark, sf).write.option("header", True).csv(path)
    return home.profile_ground_truth(ingest.read_csv(spark, path))


@query("overwrite_clean_posts", with_prelude(SQL_COPIES, f"SELECT {CLEAN_COLS_SQL} FROM clean"))
def q_overwrite_clean_posts(spark, sf):
    """Cleaned posts written twice to one place; the second run replaces the first."""
    path = scratch_path(spark, "clean")
    ingest.write_table(derived.posts_a(spark, sf).select("media_id"), path)
    clean_cols = _clean_cols(clean.clean_posts_a(derived.posts_a_with_copies(spark, sf)))
    return spark.read.parquet(ingest.write_table(clean_cols, path))


_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"      # what a name in a text may consist of


@query("document_mentions", rf"""
SELECT doc_id, list_aggregate(m, 'string_agg', ',') AS mention, len(m)::INT AS mentions
FROM (SELECT doc_id, regexp_extract_all(text, '@[\s\x0B\x{{85}}\p{{Z}}]*({_WORD}+)', 1) AS m FROM documents
      WHERE contains(text, '@'))""")
def q_document_mentions(spark, sf):
    """The mention pattern over the given texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = graph.with_mentions(docs)
    return m.select("doc_id", F.nullif("mention", F.lit("")).alias("mention"), F.size("mentions").alias("mentions"))


@query("conversation_mentions", rf"""
SELECT target, count(*)::BIGINT AS weight FROM (
  SELECT unnest(regexp_extract_all(text, '@[\s\x0B\x{{85}}\p{{Z}}]*({_WORD}+)', 1)) AS target
  FROM conversations WHERE contains(text, '@')) GROUP BY target""")
def q_conversation_mentions(spark, sf):
    """Names mentioned in the given conversations, with their number."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("role", F.col("conv_id").alias("media_id"), "text")
    edges = graph.mention_edges(turns, user="role")
    return edges.groupBy("target").agg(F.sum("weight").alias("weight"))


@query("document_coordinates", r"""
SELECT doc_id, nullif(regexp_extract(text, '(-?\d+\.\d{3,}),[\s\x0B]*(-?\d+\.\d{3,})', 0), '') AS match
FROM documents""")
def q_document_coordinates(spark, sf):
    """The coordinate pattern over the given texts (null where there is none)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text.profile_coordinates("text")["match"].alias("match"))
