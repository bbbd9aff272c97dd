"""String and time parsing as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regexes; (?U) makes \w and \s Unicode-aware like Python's re.
MENTION_PATTERN = r"(?U)@\s*(\w+)"
COORDINATE_PAIR_PATTERN = r"(-?\d+\.\d{3,}),\s*(-?\d+\.\d{3,})"
# Text time such as "Sat Dec 23 10:26:01 +0000 2017" after the day name is cut.
POST_TIME_PATTERN = "MMM dd HH:mm:ss Z yyyy"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def parse_post_time(c) -> Column:
    """Text post time -> TIMESTAMP. Any UTC offset is honoured; bad text -> null."""
    return F.try_to_timestamp(F.substring(_c(c), 5, 64), F.lit(POST_TIME_PATTERN))


def parse_epoch(c) -> Column:
    """Epoch seconds -> TIMESTAMP."""
    return F.timestamp_seconds(_c(c).cast("long"))


def extract_mentions(text) -> Column:
    """All @names of a text as array<string>, in order, repeats kept."""
    return F.regexp_extract_all(_c(text), F.lit(MENTION_PATTERN), 1)


def profile_coordinates(c) -> Column:
    """struct<match, lat, lon> of the first 'lat, lon' pair found in free text."""
    c = _c(c)
    m = F.regexp_extract(c, COORDINATE_PAIR_PATTERN, 0)
    return F.struct(
        F.when(m != "", m).alias("match"),
        F.when(m != "", F.regexp_extract(c, COORDINATE_PAIR_PATTERN, 1)).try_cast("double").alias("lat"),
        F.when(m != "", F.regexp_extract(c, COORDINATE_PAIR_PATTERN, 2)).try_cast("double").alias("lon"),
    )


def place_label(name, country) -> Column:
    """'name,country' with null parts skipped."""
    return F.concat_ws(",", _c(name), _c(country))


def safe_speed(dist_km, seconds) -> Column:
    """km/h; null when the interval is null or zero."""
    return F.try_divide(_c(dist_km) * 3600, _c(seconds).cast("double"))
