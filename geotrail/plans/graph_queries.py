"""Queries over the mention graph."""

from __future__ import annotations

from geotrail.operators import graph
from geotrail.plans.oracle_prelude import with_prelude
from geotrail.plans.registry import query
from geotrail.sources import derived

SQL_GRAPH = r"""
ego AS (SELECT media_id, user_name, text, regexp_extract_all(text, '@\s*([\p{L}\p{N}_]+)', 1) AS ms
        FROM posts_a WHERE text LIKE '%@%'),
ego1 AS (SELECT media_id, user_name, unnest(ms) AS mention FROM ego),
edges AS (SELECT user_name AS source, mention AS target, COUNT(media_id) AS weight FROM ego1
          GROUP BY user_name, mention),
rec AS (SELECT a.source, a.target, least(a.weight, b.weight) AS weight FROM edges a JOIN edges b
        ON a.target = b.source AND a.source = b.target WHERE a.source != a.target),
net AS (SELECT * FROM posts_a WHERE user_name IN (SELECT DISTINCT source FROM rec))"""


def rec_edges_a(spark, sf):
    return graph.reciprocal_edges(graph.mention_edges(derived.posts_a(spark, sf)))


@query("extract_mentions", with_prelude(SQL_GRAPH,
    "SELECT media_id, user_name, array_to_string(ms, ',') AS mention FROM ego"))
def q_extract_mentions(spark, sf):
    return graph.with_mentions(derived.posts_a(spark, sf)).select("media_id", "user_name", "mention")


@query("explode_mentions", with_prelude(SQL_GRAPH, "SELECT user_name, media_id, mention FROM ego1"))
def q_explode_mentions(spark, sf):
    return graph.explode_mentions(graph.with_mentions(derived.posts_a(spark, sf)))


@query("mention_edges", with_prelude(SQL_GRAPH,
    "SELECT source, target, CAST(weight AS BIGINT) AS weight FROM edges"))
def q_mention_edges(spark, sf):
    return graph.mention_edges(derived.posts_a(spark, sf))


@query("reciprocal_edges", with_prelude(SQL_GRAPH,
    "SELECT source, target, CAST(weight AS BIGINT) AS weight FROM rec"))
def q_reciprocal_edges(spark, sf):
    return rec_edges_a(spark, sf)


@query("network_posts", with_prelude(SQL_GRAPH, "SELECT media_id, user_name FROM net"))
def q_network_posts(spark, sf):
    return graph.network_posts(derived.posts_a(spark, sf), rec_edges_a(spark, sf)).select("media_id", "user_name")
