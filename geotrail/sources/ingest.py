"""JSON payloads -> typed flat tables (batch), and parquet sources/sinks.

Each flattener parses a string column with an explicit schema (no
inference, so batches never disagree on types), PERMISSIVE mode with a
corrupt-record column: broken payloads are routed to ``quarantine`` instead
of failing the job. Nested paths are null-safe: a missing object, an empty
array or a short array gives null.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.functions.geo import bbox_centroid

CORRUPT = "_corrupt_record"
PARSE_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


POST_PAYLOAD = _st(
    ("id_str", _S), ("text", _S), ("created_at", _S), ("lang", _S),
    ("user", _st(("id_str", _S), ("screen_name", _S), ("name", _S), ("description", _S), ("location", _S),
                 ("followers_count", _L), ("friends_count", _L), ("statuses_count", _L), ("listed_count", _L),
                 ("utc_offset", _I), ("time_zone", _S), ("lang", _S), ("geo_enabled", _B), ("protected", _B),
                 ("verified", _B))),
    ("place", _st(("country_code", _S), ("country", _S), ("place_type", _S), ("full_name", _S), ("name", _S),
                  ("id", _S), ("bounding_box", _st(("type", _S),
                                                   ("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(_D)))))))),
    ("coordinates", _st(("type", _S), ("coordinates", T.ArrayType(_D)))),
    ("entities", _st(("urls", T.ArrayType(_st(("expanded_url", _S), ("url", _S)))))),
    (CORRUPT, _S),
)

MEDIA_PAYLOAD = _st(
    ("shortcode", _S), ("owner", _st(("id", _S), ("username", _S))), ("location", _st(("id", _S))),
    ("edge_media_to_caption", _st(("edges", T.ArrayType(_st(("node", _st(("text", _S)))))))),
    ("taken_at_timestamp", _L), (CORRUPT, _S),
)

USER_PAYLOAD = _st(
    ("id", _S), ("username", _S), ("full_name", _S), ("biography", _S), ("is_private", _B),
    ("followed_by", _st(("count", _L))), ("follows", _st(("count", _L))), ("media", _st(("count", _L))),
    (CORRUPT, _S),
)

LOCATION_PAYLOAD = _st(
    ("id", _S), ("name", _S), ("lat", _D), ("lng", _D),
    ("directory", _st(("country", _st(("id", _S), ("name", _S))), ("city", _st(("id", _S), ("name", _S))))),
    (CORRUPT, _S),
)

PAGE_PAYLOAD = _st(
    ("status", _S),
    ("data", _st(("user", _st(("edge_owner_to_timeline_media", _st(
        ("count", _L), ("page_info", _st(("end_cursor", _S))),
        ("edges", T.ArrayType(_st(("node", _st(("taken_at_timestamp", _L), ("shortcode", _S)))))))))))),
    (CORRUPT, _S),
)

MEDIA_URL_BASE = "https://media.example/p/"


def parse(df: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """Add struct column ``j`` parsed from JSON text ``col``.

    The struct comes out of a one-element explode (a Generate node): filters
    on ``j`` cannot be pushed below it, so each payload is parsed once
    instead of once per predicate."""
    return df.select("*", F.explode(F.array(F.from_json(F.col(col), schema, PARSE_OPTS))).alias("j"))


def _ok(df: DataFrame) -> DataFrame:
    return df.filter(F.col("j").isNotNull() & F.col("j." + CORRUPT).isNull())


def quarantine(df: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """Payloads that failed to parse (kept whole for inspection)."""
    p = parse(df, schema, col)
    return p.filter(F.col("j").isNull() | F.col("j." + CORRUPT).isNotNull()).drop("j")


def _vertex(bbox: Column, i: int, axis: int) -> Column:
    """Coordinate ``axis`` (0 lon, 1 lat) of vertex ``i`` of the first ring."""
    return F.get(F.get(F.get(bbox, 0), i), axis)


def flatten_posts(raw: DataFrame, col: str = "value") -> DataFrame:
    """Post payloads -> the 31-column source-A table (text time kept as text)."""
    j = F.col("j")
    bbox = j["place"]["bounding_box"]["coordinates"]
    url0 = F.get(j["entities"]["urls"], 0)
    point = j["coordinates"]["coordinates"]
    return _ok(parse(raw, POST_PAYLOAD, col)).select(
        j["user"]["id_str"].alias("user_id"), j["user"]["screen_name"].alias("user_name"),
        j["user"]["name"].alias("full_name"), j["user"]["description"].alias("user_description"),
        j["user"]["location"].alias("user_location"), j["user"]["followers_count"].alias("followers_count"),
        j["user"]["friends_count"].alias("follows_count"), j["user"]["statuses_count"].alias("status_all_count"),
        j["user"]["listed_count"].alias("listed_count"), j["user"]["utc_offset"].alias("utc_offset"),
        j["user"]["time_zone"].alias("time_zone"), j["user"]["lang"].alias("user_lang"),
        j["user"]["geo_enabled"].alias("geo_enabled"), j["user"]["protected"].alias("user_protected"),
        j["user"]["verified"].alias("verified"),
        j["id_str"].alias("media_id"), j["text"].alias("text"), j["created_at"].alias("create_time"),
        j["lang"].alias("lang"),
        j["place"]["country_code"].alias("country_code"), j["place"]["country"].alias("country"),
        j["place"]["place_type"].alias("place_type"), j["place"]["full_name"].alias("place_full_name"),
        j["place"]["name"].alias("place_name"), j["place"]["id"].alias("place_id"),
        bbox_centroid(_vertex(bbox, 0, 1), _vertex(bbox, 1, 1)).alias("place_lat"),
        bbox_centroid(_vertex(bbox, 0, 0), _vertex(bbox, 2, 0)).alias("place_lon"),
        F.get(point, 1).alias("lat"), F.get(point, 0).alias("lon"),
        url0["expanded_url"].alias("expanded_url"), url0["url"].alias("url"),
    )


def flatten_media(raw: DataFrame, col: str = "value", url_base: str = MEDIA_URL_BASE) -> DataFrame:
    """Media payloads -> (media_id, user_id, location_id, text, create_time_stamp, url)."""
    j = F.col("j")
    return _ok(parse(raw, MEDIA_PAYLOAD, col)).select(
        j["shortcode"].alias("media_id"), j["owner"]["id"].alias("user_id"), j["location"]["id"].alias("location_id"),
        F.get(j["edge_media_to_caption"]["edges"], 0)["node"]["text"].alias("text"),
        j["taken_at_timestamp"].alias("create_time_stamp"),
        F.concat(F.lit(url_base), j["shortcode"], F.lit("/")).alias("url"))


def flatten_users(raw: DataFrame, col: str = "value", public_only: bool = True) -> DataFrame:
    """User payloads -> users table; private accounts and empty ids dropped."""
    j = F.col("j")
    x = _ok(parse(raw, USER_PAYLOAD, col)).filter(j["id"].isNotNull() & (F.length(j["id"]) > 0))
    if public_only:
        x = x.filter(~F.coalesce(j["is_private"], F.lit(False)))
    return x.select(j["id"].alias("user_id"), j["username"].alias("user_name"), j["full_name"].alias("full_name"),
                    j["biography"].alias("user_description"), j["followed_by"]["count"].alias("followers_count"),
                    j["follows"]["count"].alias("follows_count"), j["media"]["count"].alias("status_all_count"))


def flatten_locations(raw: DataFrame, col: str = "value") -> DataFrame:
    j = F.col("j")
    return _ok(parse(raw, LOCATION_PAYLOAD, col)).select(
        j["id"].alias("location_id"), j["name"].alias("location_name"), j["lat"].alias("lat"), j["lng"].alias("lon"),
        j["directory"]["country"]["id"].alias("country_id"), j["directory"]["country"]["name"].alias("country_name"),
        j["directory"]["city"]["id"].alias("city_id"), j["directory"]["city"]["name"].alias("city_name"))


def paged_post_codes(raw: DataFrame, lo_epoch: int, hi_epoch: int, col: str = "value",
                     url_base: str = MEDIA_URL_BASE, suffix: str = "?__a=1", keys: tuple[str, ...] = ()) -> DataFrame:
    """Timeline pages -> one row per post code taken inside (lo, hi), pages
    with a status other than 'ok' skipped. Extra ``keys`` columns are kept."""
    j = F.col("j")
    x = _ok(parse(raw, PAGE_PAYLOAD, col)).filter(j["status"] == "ok")
    x = x.select(*keys, F.explode(j["data"]["user"]["edge_owner_to_timeline_media"]["edges"]).alias("e"))
    t = F.col("e.node.taken_at_timestamp")
    x = x.filter((t > lo_epoch) & (t < hi_epoch))
    return x.select(*keys, F.col("e.node.shortcode").alias("shortcode"), t.alias("taken_at_timestamp"),
                    F.concat(F.lit(url_base), F.col("e.node.shortcode"), F.lit("/" + suffix)).alias("request_url"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files as raw text (one payload per line)."""
    return spark.read.text(path)


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """CSV files with a header, every column as text, quotes doubled inside quotes.
    Nothing is inferred; the caller casts.

    A large file is split into many tasks, which needs every record on one line. Set
    ``line_breaks`` for files with line breaks inside quotes: each file is then one task."""
    return spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)


def read_parquet_batches(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """Many parquet batches whose columns grew over time, read as one table."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> str:
    """Parquet sink (S8): replace the table at ``path``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


STAMP = "batch_ts"
BATCH_STATES = "batch_ts string, state string, at long"


def _ledger(root: str) -> str:
    return f"{root.rstrip('/')}-ledger"


def _enter(spark: SparkSession, root: str, stamp: str, state: str) -> None:
    entry = spark.range(0, 1, 1, 1).select(F.lit(stamp).alias(STAMP), F.lit(state).alias("state"),
                                           F.lit(time.time_ns()).alias("at"))
    entry.write.mode("append").parquet(_ledger(root))


def write_batch(df: DataFrame, root: str, stamp: str) -> str:
    """Write one capture batch under ``root/batch_ts=<stamp>`` (S9); may be run again.

    A rerun of a stamp replaces that batch, also by an empty one, and touches no other.
    The ledger ``<root>-ledger`` notes when a batch is opened and when all its rows are in
    place; ``read_batches`` leaves out batches that were opened last, so one whose writer
    died half-way is not read, neither its new rows nor what is left of its old ones.
    Different stamps may be written at the same time, one stamp by one writer."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", stamp) or re.fullmatch("0[0-9]+", stamp):
        raise ValueError(f"a stamp is letters, digits, _ and - (no number with leading zeros), not {stamp!r}")
    spark = df.sparkSession
    _enter(spark, root, stamp, "open")
    df.write.mode("overwrite").parquet(f"{root}/{STAMP}={stamp}")
    _enter(spark, root, stamp, "done")
    return root


def committed_batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch_ts) of the batches whose last entry in the ledger says done."""
    last = spark.read.schema(BATCH_STATES).parquet(_ledger(root)).groupBy(STAMP).agg(
        F.max_by("state", "at").alias("state"))
    return last.filter("state = 'done'").select(STAMP)


def has_batches(spark: SparkSession, root: str) -> bool:
    """Whether any batch was ever opened under ``root`` (asked of Spark's file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_ledger(root))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_batches(spark: SparkSession, root: str, merge_schema: bool = True) -> DataFrame:
    """All committed batches under ``root`` as one table with ``batch_ts`` (text).

    The join is on the partition column, so Spark prunes the folders of other batches."""
    rows = read_parquet_batches(spark, root, merge_schema)
    rows = rows.withColumn(STAMP, F.col(STAMP).cast("string"))
    return rows.join(committed_batches(spark, root), STAMP, "left_semi")
