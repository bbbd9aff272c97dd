"""Great-circle geometry as Catalyst expressions (whole-stage codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value shared with the reference: mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x)).cast("double")


def great_circle_km(m, p, q):
    """Great-circle distance of two points given in radians, by half chords.

    ``m`` is the module with the functions (pyspark.sql.functions for columns,
    numpy for arrays); p and q are (latitude, longitude, cosine of latitude).
    The one distance kernel of the library: callers that compare many points
    compute radians and cosines once per point."""
    up, along = m.sin((q[0] - p[0]) / 2), m.sin((q[1] - p[1]) / 2)
    chord = up * up + along * along * (p[2] * q[2])         # equal in both directions, to the last bit
    # rounding may put the squared half chord of antipodes just above 1
    return m.atan2(m.sqrt(chord), m.sqrt(m.abs(1 - chord))) * (2 * EARTH_RADIUS_KM)


def radian_point(lat, lon) -> tuple[Column, Column, Column]:
    rlat = F.radians(_c(lat))
    return rlat, F.radians(_c(lon)), F.cos(rlat)


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance in km; argument order (lon1, lat1, lon2, lat2).

    Null in any coordinate gives null; antipodal points give pi * R."""
    return great_circle_km(F, radian_point(lat1, lon1), radian_point(lat2, lon2))


def cosine_distance_km(lon1, lat1, lon2, lat2) -> Column:
    """Spherical law of cosines; exactly 0 on equal points, argument clamped."""
    lon1, lat1, lon2, lat2 = _c(lon1), _c(lat1), _c(lon2), _c(lat2)
    x = (F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon1) - F.radians(lon2)))
    x = F.when(x < -1, F.lit(-1.0)).when(x > 1, F.lit(1.0)).otherwise(x)
    return (F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0))
            .otherwise(F.acos(x) * F.lit(EARTH_RADIUS_KM)))


def bbox_centroid(a, b) -> Column:
    """Mean of two optional coordinates; one missing -> the other; both -> null."""
    a, b = _c(a), _c(b)
    return (F.coalesce(a, b) + F.coalesce(b, a)) / 2


def in_bbox(lon, lat, west=-180.0, south=-85.0, east=180.0, north=85.0) -> Column:
    lon, lat = _c(lon), _c(lat)
    return lon.between(F.lit(west), F.lit(east)) & lat.between(F.lit(south), F.lit(north))
