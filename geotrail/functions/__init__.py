from geotrail.functions.geo import (bbox_centroid, cosine_distance_km, haversine_km,
                                    in_bbox, EARTH_RADIUS_KM)
from geotrail.functions.text import (extract_mentions, parse_epoch, parse_post_time,
                                     place_label, profile_coordinates, safe_speed)

__all__ = [
    "EARTH_RADIUS_KM", "bbox_centroid", "cosine_distance_km", "haversine_km", "in_bbox",
    "extract_mentions", "parse_epoch", "parse_post_time", "place_label",
    "profile_coordinates", "safe_speed",
]
