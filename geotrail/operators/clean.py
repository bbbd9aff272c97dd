"""Trajectory cleaning: de-duplication, country restriction, per-user lag,
inter-arrival time, distance and impossible-speed filtering."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import haversine_km, cosine_distance_km
from geotrail.functions.text import parse_epoch, parse_post_time, safe_speed
from geotrail.operators.skew import lag_in_order, shuffled

# Fixed value of the reference: the 39 country codes whose posters are kept
# (its own spelling, with EL and UK).
EUROPE_CODES = (
    "BE", "BG", "CZ", "DK", "DE", "EE", "IE", "EL", "ES", "FR", "HR", "IT", "CY",
    "LV", "LT", "LU", "HU", "MT", "NL", "AT", "PL", "PT", "RO", "SI", "SK", "FI",
    "SE", "UK", "IS", "LI", "NO", "CH", "ME", "MK", "AL", "RS", "TR", "XK", "BA",
)
# Preset with the ISO spellings of Greece and the United Kingdom added.
EUROPE_CODES_ISO = EUROPE_CODES + ("GR", "GB")
MAX_SPEED_KMH = 1000.0


def dedup_first(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per ``key``: the first by ``order`` (then by the whole row).

    ``min(struct(order..., row...))`` is combined before the shuffle, so a key
    with millions of copies reaches one task as one row per input task. The
    buffer is a whole row, which Spark aggregates by sorting each input
    partition on the key (SortAggregate), not by hashing.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    out = df.groupBy(key).agg(F.min(packed).alias("_first"))
    return out.select(*[F.col(c) if c == key else F.col("_first." + c).alias(c) for c in df.columns])


def users_ever_in(df: DataFrame, user: str = "user_id", country: str = "country_code",
                  codes: Sequence[str] = EUROPE_CODES) -> DataFrame:
    """All posts of users who posted at least once from one of ``codes``.

    The user set is built with partial aggregation; the semi join is planned
    by AQE (broadcast when the measured user set is small, shuffle otherwise,
    skewed partitions split).
    """
    users = df.filter(F.col(country).isin(list(codes))).select(user).distinct()
    return df.join(users, user, "left_semi")


def posts_in_countries(df: DataFrame, country: str = "country_code",
                       codes: Sequence[str] = EUROPE_CODES) -> DataFrame:
    return df.filter(F.col(country).isin(list(codes)))


def lag_within_user(df: DataFrame, user: str, time_col: str, tiebreak: str,
                    cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Previous row's ``cols`` within each user in (time, tiebreak) order.

    Equivalent to ``lag(c).over(partitionBy(user).orderBy(time, tiebreak))``:
    null times come first and null users form one sequence. A user of any
    size, also one with bursts of equal times, spans as many range partitions
    as its rows need (see skew.py)."""
    return lag_in_order(df, user, [time_col, tiebreak], cols, prefix)


def with_movement(df: DataFrame, user: str = "user_id", time_col: str = "create_time",
                  tiebreak: str = "media_id", lat: str = "place_lat", lon: str = "place_lon",
                  method: str = "haversine", keep_prev_id: bool = False) -> DataFrame:
    """Add ``dist`` (km from the previous post), ``interarrivaltime`` (s) and
    ``prev_media_id`` (optional) over the unfiltered sequence of each user."""
    cols = [lat, lon, time_col] + ([tiebreak] if keep_prev_id else [])
    x = lag_within_user(df, user, time_col, tiebreak, cols, prefix="_p_")
    dist_fn = haversine_km if method == "haversine" else cosine_distance_km
    x = x.withColumn("dist", dist_fn(F.col(lon), F.col(lat), F.col("_p_" + lon), F.col("_p_" + lat)))
    x = x.withColumn("interarrivaltime",
                     F.unix_timestamp(F.col(time_col)) - F.unix_timestamp(F.col("_p_" + time_col)))
    if keep_prev_id:
        x = x.withColumnRenamed("_p_" + tiebreak, "prev_" + tiebreak)
    return x.drop("_p_" + lat, "_p_" + lon, "_p_" + time_col)


def with_day_gap(df: DataFrame, user: str = "user_id", time_col: str = "create_time",
                 tiebreak: str = "media_id") -> DataFrame:
    """Day-granular gap to the previous post (``datediff``)."""
    x = lag_within_user(df, user, time_col, tiebreak, [time_col], prefix="_p_")
    return x.withColumn("interarrival_days", F.datediff(F.col(time_col), F.col("_p_" + time_col))) \
            .drop("_p_" + time_col)


def drop_impossible(df: DataFrame, mode: str = "later", max_speed: float = MAX_SPEED_KMH,
                    user: str = "user_id", media: str = "media_id") -> DataFrame:
    """Filters of the cleaning step on a frame from ``with_movement``.

    Zero inter-arrival rows are dropped (the first post, null, is kept), then
    ``speed`` is added and impossible jumps removed:
    ``later`` drops the later post of a jump (reference default),
    ``both`` drops both posts of a jump (needs ``prev_media_id``),
    ``user`` drops every post of a user with any jump.
    Lags are not recomputed after removals.
    """
    x = df.filter((F.col("interarrivaltime") != 0) | F.col("interarrivaltime").isNull())
    x = x.withColumn("speed", safe_speed(F.col("dist"), F.col("interarrivaltime")))
    ok = (F.col("speed") <= max_speed) | F.col("speed").isNull()
    if mode == "later":
        return x.filter(ok)
    jumps = x.filter(~ok)
    if mode == "both":
        bad = (jumps.select(F.col(media).alias("_bad"))
               .unionByName(jumps.select(F.col("prev_" + media).alias("_bad")))
               .filter(F.col("_bad").isNotNull()).distinct())
        return x.join(bad, x[media] == bad["_bad"], "left_anti").drop("prev_" + media)
    if mode == "user":
        return x.join(jumps.select(user).distinct(), user, "left_anti")
    raise ValueError(f"unknown mode {mode!r}")


def clean_posts_a(posts: DataFrame, codes: Sequence[str] = EUROPE_CODES, mode: str = "later",
                  max_speed: float = MAX_SPEED_KMH) -> DataFrame:
    """Source-A cleaning: dedup by media_id -> users ever in ``codes`` ->
    parse time -> distance between consecutive place centroids and seconds
    between posts -> drop zero intervals -> drop impossible speed."""
    order = ["batch"] if "batch" in posts.columns else []
    x = dedup_first(posts, "media_id", order)
    if "batch" in x.columns:
        x = x.drop("batch")
    x = users_ever_in(x, "user_id", "country_code", codes)
    x = x.withColumn("create_time", parse_post_time(F.col("create_time")))
    x = with_movement(x, lat="place_lat", lon="place_lon", keep_prev_id=(mode == "both"))
    return drop_impossible(x, mode, max_speed)


def assemble_posts_b(users: DataFrame, media: DataFrame | Sequence[DataFrame],
                     locations: DataFrame) -> DataFrame:
    """users x media (one or many batches, unioned by name) x locations.

    Media without a location drop out (inner join). The location dimension
    is joined without a hint: AQE broadcasts it once its measured size is
    below the threshold and shuffles otherwise.
    """
    if not isinstance(media, DataFrame):
        batches = list(media)
        media = batches[0]
        for b in batches[1:]:
            media = media.unionByName(b)
    x = shuffled(users).join(media, "user_id", "inner")
    return x.join(locations, "location_id", "inner")


def clean_posts_b(posts_b: DataFrame, codes: Sequence[str] = EUROPE_CODES, mode: str = "later",
                  max_speed: float = MAX_SPEED_KMH) -> DataFrame:
    """Source-B cleaning: dedup -> users ever in ``codes`` -> epoch time ->
    distance between exact points -> same filters as source A."""
    x = dedup_first(posts_b, "media_id")
    x = users_ever_in(x, "user_id", "country_id", codes)
    x = x.withColumn("create_time", parse_epoch(F.col("create_time_stamp")))
    x = with_movement(x, lat="lat", lon="lon", keep_prev_id=(mode == "both"))
    return drop_impossible(x, mode, max_speed)
