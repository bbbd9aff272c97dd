"""Queries over ``pages`` (operators 5, 7 and 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.llm.html_extract import extract_text
from geotrail.llm.registry import query, table
from geotrail.llm.url_filter import judge_urls
from geotrail.llm.warc import archive_pages, read_warc

# The rules that the query's contract names.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))


# parsing HTML has no SQL form: tested against an independent parse of known layouts
@query("op5_html_extract")
def op5_html_extract(spark, sf):
    return extract_text(table(spark, sf, "pages"), columns=["page_id", "url"])


@query("op7_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id AND first IS NOT NULL
       THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM r""")
def op7_warc(spark, sf):
    path = archive_pages(table(spark, sf, "pages"), min_bytes=1000)
    page = lambda c: F.substring(F.col(c), 10, 20).cast("long")  # noqa: E731  after 'urn:page:'
    read = read_warc(spark, path).filter(F.col("record_type") == "response").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    seen = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", page("refers_to").alias("refers_to"))
    return read.unionByName(seen)


@query("op9_url_filter", r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest
           FROM pages),
b AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*', 0), '') AS h,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b),
d AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM d""")
def op9_url_filter(spark, sf):
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES).drop("url")
