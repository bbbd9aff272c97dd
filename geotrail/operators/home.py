"""Home location: L1 median (medoid) of a point set, dispersion around it,
ground truth from profiles and posts, and propagation over the reciprocal
mention graph."""

from __future__ import annotations

import heapq
import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import EARTH_RADIUS_KM, great_circle_km, haversine_km
from geotrail.functions.text import place_label
from geotrail.operators.skew import PART, group_median, in_ranges, join_null_safe, shuffled
from geotrail.session import store

TILE_POINTS = 1024          # distinct points per key evaluated in one array
ACTIVITY_RADIUS_KM = 30.0
PROPAGATION_DISPERSION_KM = 100.0
MIN_POSTS = 3
CLUSTERS = 2048             # of a large key: their means bound the costs of its points
CLUSTER_POINTS = 4          # points of a cluster on average, at least
COST_TILE = 2048            # points a side in one pair of tiles of a large key
COST_DIGITS = 6


def _hav(p: Column, q: Column) -> Column:
    """Distance of two point structs carrying rlat, rlon (radians) and clat
    (cosine of latitude), for higher-order functions, where no
    common-subexpression elimination happens. Both points are located."""
    return great_circle_km(F, (p["rlat"], p["rlon"], p["clat"]), (q["rlat"], q["rlon"], q["clat"]))


def _pt(lat: Column, lon: Column, *extra: Column) -> Column:
    rlat = F.radians(lat)
    return F.struct(lat.alias("lat"), lon.alias("lon"), rlat.alias("rlat"), F.radians(lon).alias("rlon"),
                    F.cos(rlat).alias("clat"), *extra)


def collapse_points(df: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon",
                    label: str = "label", weight: str | None = None,
                    home: Sequence[str] | None = None) -> DataFrame:
    """Rows -> one row per (key, distinct point) with ``w`` (summed weight),
    ``m`` (row count) and ``label`` (smallest). Rows without a point are kept
    as one (null, null) entry so that every key survives. ``home`` names
    (lat, lon, label) columns of a known home, constant within a key.
    Map-side partial aggregation makes this the first, cheapest shuffle."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("double")
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    aggs = [F.sum(F.when(F.col("lat").isNotNull(), F.col("_w"))).alias("w"), F.count(F.lit(1)).alias("m"),
            F.min(F.col(label)).alias("label")]
    if home:
        known = F.col(home[0]).isNotNull() & F.col(home[1]).isNotNull()
        aggs.append(F.min(F.when(known, F.struct(F.col(home[0]).alias("lat"), F.col(home[1]).alias("lon"),
                                                 F.col(home[2]).alias("label")))).alias("H"))
    return (df.select(*keys, F.when(located, F.col(lat)).alias("lat"), F.when(located, F.col(lon)).alias("lon"),
                      w.alias("_w"), *[c for c in [label, *(home or [])] if c not in keys])
            .groupBy(*keys, "lat", "lon").agg(*aggs))


def _with_median(df: DataFrame, vals: str, out: str) -> DataFrame:
    """Add ``out`` = median of the multiset in array<struct<d double, m long>>
    column ``vals`` (0.0 when empty). Staged through named columns so the
    count is computed once, not inside the scan lambda."""
    df = df.withColumn("_s", F.array_sort(F.filter(F.col(vals), lambda v: v["m"] > 0)))
    df = df.withColumn("_n", F.aggregate(F.col("_s"), F.lit(0).cast("long"), lambda a, v: a + v["m"]))
    df = df.withColumn("_klo", F.floor((F.col("_n") - 1) / 2)).withColumn("_khi", F.floor(F.col("_n") / 2))
    init = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("lo"),
                    F.lit(None).cast("double").alias("hi"))
    klo, khi = F.col("_klo"), F.col("_khi")

    def step(acc, v):
        c2 = acc["c"] + v["m"]
        return F.struct(c2.alias("c"),
                        F.when((acc["c"] <= klo) & (klo < c2), v["d"]).otherwise(acc["lo"]).alias("lo"),
                        F.when((acc["c"] <= khi) & (khi < c2), v["d"]).otherwise(acc["hi"]).alias("hi"))
    df = df.withColumn("_r", F.aggregate(F.col("_s"), init, step))
    df = df.withColumn(out, F.when(F.col("_n") == 0, F.lit(0.0)).otherwise((F.col("_r.lo") + F.col("_r.hi")) / 2))
    return df.drop("_s", "_n", "_klo", "_khi", "_r")


def _argmin(P: Column) -> Column:
    """struct(cost, lat, lon, label) of the member point with least weighted
    distance sum to all points; ties by (rounded cost, lat, lon, label)."""
    costs = F.transform(P, lambda c: F.struct(
        F.round(F.aggregate(P, F.lit(0.0), lambda a, p: a + p["w"] * _hav(p, c)), COST_DIGITS).alias("cost"),
        c["lat"].alias("lat"), c["lon"].alias("lon"), c["label"].alias("label")))
    return F.array_min(costs)


def medoid_and_dispersion(pts: DataFrame, keys: Sequence[str], tile: int = TILE_POINTS) -> DataFrame:
    """From ``collapse_points`` output: per key the home and its dispersion.

    Home: the known home ``H`` when present, else the medoid of the located
    points (weighted L1 median restricted to member points). Dispersion: the
    median distance from the home to the located rows; for an inferred home
    one row at the home itself is left out; 0.0 when nothing is left.
    Output (keys..., lat, lon, label, dispersion, inferred).

    Keys with at most ``tile`` distinct located points are solved in one
    array per key with higher-order functions (JVM side); larger keys by
    ``_large_medoids``. Null keys are keys. The point table feeds several
    branches and is stored once; so is the result, one row per key, because a
    filter on dispersion would otherwise be pushed into the higher-order
    expressions and evaluate them again.
    """
    if "H" not in pts.columns:
        pts = pts.withColumn("H", F.lit(None).cast("struct<lat:double,lon:double,label:string>"))
    pts = store(pts, "points")
    located = F.col("lat").isNotNull()
    large = (pts.filter(located).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > tile))
    # the point table is stored, so this is one small aggregate; like AQE it
    # only leaves out a branch that would get no rows
    some_large = not large.isEmpty()
    flagged = join_null_safe(pts, store(large, "large-keys"), keys, "left") if some_large else None
    small = pts if flagged is None else flagged.filter(F.col("_n").isNull())

    cold = small.groupBy(*keys).agg(
        F.collect_list(F.when(located, _pt(F.col("lat"), F.col("lon"), F.col("w").alias("w"),
                                           F.col("m").alias("m"), F.col("label").alias("label")))).alias("P"),
        F.min("H").alias("H"))
    cold = cold.withColumn("inferred", F.col("H").isNull())
    cold = cold.withColumn("_home", F.when(F.col("inferred"), _argmin(F.col("P"))).otherwise(
        F.struct(F.lit(None).cast("double").alias("cost"), F.col("H.lat").alias("lat"),
                 F.col("H.lon").alias("lon"), F.col("H.label").alias("label"))))
    cold = cold.withColumn("_hp", F.when(F.col("_home.lat").isNotNull(),
                                         _pt(F.col("_home.lat"), F.col("_home.lon"))))
    hp_ = F.col("_hp")
    cold = cold.withColumn("_vals", F.transform(F.col("P"), lambda p: F.struct(
        _hav(p, hp_).alias("d"),
        (p["m"] - F.when(F.col("inferred") & (p["lat"] == hp_["lat"]) & (p["lon"] == hp_["lon"]), 1)
         .otherwise(0)).cast("long").alias("m"))))
    cold = _with_median(cold, "_vals", "_disp")
    out = cold.select(*keys, F.col("_home.lat").alias("lat"), F.col("_home.lon").alias("lon"),
                      F.col("_home.label").alias("label"),
                      F.when(F.col("_hp").isNull(), F.lit(0.0)).otherwise(F.col("_disp")).alias("dispersion"),
                      "inferred")
    if flagged is not None:
        out = out.unionByName(_large_keys(flagged.filter(F.col("_n").isNotNull()), keys))
    return store(out, "medoids")


def _large_keys(pts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Home and dispersion of keys with many points, from their point rows."""
    located = F.col("lat").isNotNull()
    homes = pts.groupBy(*keys).agg(F.min("H").alias("H"))
    unknown = join_null_safe(pts.filter(located).drop("H"), homes.filter(F.col("H").isNull()).select(*keys), keys)
    homes = join_null_safe(homes, large_medoids(unknown, keys), keys, "left")
    homes = store(homes.select(*keys, F.coalesce("H.lat", "_med.lat").alias("_hlat"),
                               F.coalesce("H.lon", "_med.lon").alias("_hlon"),
                               F.coalesce("H.label", "_med.label").alias("_hlabel"),
                               F.col("H").isNull().alias("inferred")), "large-homes")
    d = join_null_safe(pts.filter(located), homes, keys)
    at_home = (F.col("lat") == F.col("_hlat")) & (F.col("lon") == F.col("_hlon"))
    d = d.select(*keys, haversine_km(F.col("lon"), F.col("lat"), F.col("_hlon"), F.col("_hlat")).alias("d"),
                 (F.col("m") - F.when(F.col("inferred") & at_home, 1).otherwise(0)).alias("m"))
    return join_null_safe(homes, group_median(d, keys, "d", "m"), keys, "left").select(
        *keys, F.col("_hlat").alias("lat"), F.col("_hlon").alias("lon"), F.col("_hlabel").alias("label"),
        F.coalesce(F.col("d"), F.lit(0.0)).alias("dispersion"), "inferred")


def _radians(lat: np.ndarray, lon: np.ndarray) -> tuple:
    rlat = np.radians(lat)
    return rlat, np.radians(lon), np.cos(rlat)


def _across(a: tuple, b: tuple) -> np.ndarray:
    """Distances (rows of a) x (rows of b)."""
    return great_circle_km(np, tuple(x[:, None] for x in a), tuple(x[None, :] for x in b))


def _cost_bounds(at: tuple, own: np.ndarray | float, clusters: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest cost (km) of members within ``own`` radians of the points ``at``.

    clusters: clat, clon (spherical mean), w (weight) and, in radians, s1 = sum of w s,
    s2 = sum of w s s, s3 = sum of w (s - sin s), r = largest s, of the members' distances
    s to the mean. Along a geodesic the distance to a fixed point at distance d has a
    second derivative of at most max(1 / d, 1 / (pi - d)); the first-order parts add up to
    s3 at most, because the tangents of length sin s cancel at the spherical mean."""
    ref = _radians(clusters["clat"].to_numpy(), clusters["clon"].to_numpy())
    w, s1, s2, s3, r = (clusters[c].to_numpy().astype(float) for c in ("w", "s1", "s2", "s3", "r"))
    low, high = np.empty(len(at[0])), np.empty(len(at[0]))
    reach = own * w.sum()
    for i in range(0, len(low), 256):
        d = _across(tuple(x[i:i + 256] for x in at), ref) / EARTH_RADIUS_KM
        least = np.minimum(d - r, np.pi - d - r)
        off = np.where(least > 1e-6, np.minimum(s3 + s2 / (2 * np.maximum(least, 1e-6)), s1), s1).sum(axis=1)
        cost, off = d @ w, off + (reach[i:i + 256] if np.ndim(reach) else reach)
        low[i:i + 256], high[i:i + 256] = cost - off, cost + off
    return low * EARTH_RADIUS_KM, high * EARTH_RADIUS_KM


def _may_be_least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Against rounding: costs are compared at COST_DIGITS digits."""
    return low <= high.min() * (1 + 1e-9) + 4 * 10.0 ** -COST_DIGITS


def _possible_clusters(clusters: pa.Table) -> pa.Table:
    """Clusters of one key that may hold its medoid."""
    at = _radians(clusters["clat"].to_numpy(), clusters["clon"].to_numpy())
    low, high = _cost_bounds(at, clusters["r"].to_numpy().astype(float), clusters)
    return clusters.filter(pa.array(_may_be_least(low, high))).drop_columns(["clat", "clon", "w", "s1", "s2", "s3", "r"])


def _bounded(keys: Sequence[str]):
    """One tile of candidates against all clusters of their key."""
    def run(cands: pa.Table, clusters: pa.Table) -> pa.Table:
        cands = cands.select([*keys, "lat", "lon", "label"])
        if not cands.num_rows or not clusters.num_rows:
            return cands.slice(0, 0).append_column("low", pa.array([], pa.float64())).append_column(
                "high", pa.array([], pa.float64()))
        low, high = _cost_bounds(_radians(cands["lat"].to_numpy(), cands["lon"].to_numpy()), 0.0, clusters)
        return cands.append_column("low", pa.array(low)).append_column("high", pa.array(high))
    return run


def _partial_costs(keys: Sequence[str]):
    """Candidates of one tile against one tile of points."""
    def run(cands: pa.Table, points: pa.Table) -> pa.Table:
        out = cands.select([*keys, "lat", "lon", "label"])
        if not points.num_rows or not cands.num_rows:
            return out.slice(0, 0).append_column("part", pa.array([], pa.float64()))
        c = _radians(cands["lat"].to_numpy(), cands["lon"].to_numpy())
        p = _radians(points["lat"].to_numpy(), points["lon"].to_numpy())
        w = points["w"].to_numpy().astype(float)
        part = np.concatenate([_across(tuple(x[i:i + 128] for x in c), p) @ w for i in range(0, len(c[0]), 128)])
        return out.append_column("part", pa.array(part))
    return run


def _curve(lat: Column, lon: Column) -> Column:
    """Place on the Z curve over latitude and longitude, 26 bits each."""
    def spread(x):
        for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(keep))
        return x
    steps = float((1 << 26) - 1)
    y = F.floor((lat + 90) / 180 * steps).cast("long")
    x = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * steps).cast("long")
    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def _cut(z: np.ndarray, lat: np.ndarray, lon: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """Cluster number of each point: a tree over the points along the curve.

    The stretch with the largest weighted distance sum to its mean is cut next, where a
    gap makes up a quarter of its way at that gap (an outlier leaves alone), else in the
    middle, until there are ``most`` stretches or none has any extent."""
    order = np.argsort(z, kind="stable")
    rlat, rlon, clat = _radians(lat[order], lon[order])
    at, w = np.stack((clat * np.cos(rlon), clat * np.sin(rlon), np.sin(rlat)), axis=1), w[order]
    way = np.linalg.norm(np.diff(at, axis=0), axis=1)

    def extent(i: int, j: int) -> float:
        mean = w[i:j] @ at[i:j]
        mean /= max(float(np.linalg.norm(mean)), 1e-300)
        return float(w[i:j] @ np.linalg.norm(at[i:j] - mean, axis=1))
    heap, done = [(-extent(0, len(w)), 0, len(w))], []
    while heap and len(heap) + len(done) < most:
        e, i, j = heapq.heappop(heap)
        if j - i < 2 or e > -1e-15:
            done.append((i, j))
            continue
        gaps = way[i:j - 1]
        g = int(gaps.argmax())
        m = i + 1 + g if 4 * gaps[g] > gaps.sum() else (i + j) // 2
        for part in ((i, m), (m, j)):
            heapq.heappush(heap, (-extent(*part), *part))
    starts = sorted(i for i, _ in [*done, *(h[1:] for h in heap)])
    out = np.empty(len(w), np.int64)
    out[order] = np.searchsorted(starts, np.arange(len(w)), "right") - 1
    return out


def _cut_ranges(cols: Sequence[str]):
    """The points of one key in one range, each with its cluster."""
    def run(t: pa.Table) -> pa.Table:
        n = t["_n"][0].as_py()
        most = math.ceil(min(CLUSTERS, n / CLUSTER_POINTS) * t.num_rows / n)
        own = _cut(*(t[c].to_numpy() for c in ("_z", "lat", "lon")), t["w"].to_numpy().astype(float), most)
        return t.select(cols).append_column("_cluster", pa.array(own + (t[PART][0].as_py() << 24)))
    return run


def clustered(points: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(points with _cluster and _n, clusters) of keys with many distinct points.

    A key's points are ranged along the Z curve and cut, range by range, into about
    CLUSTERS clusters where the cuts save most: dense regions get small clusters, outliers
    their own. Clusters carry what ``_cost_bounds`` needs."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = join_null_safe(points, store(n, "sizes"), keys).withColumn("_z", _curve(F.col("lat"), F.col("lon")))
    ranges = in_ranges(placed, keys, [F.col("_z"), F.col("lat"), F.col("lon")])
    cols = [*keys, "lat", "lon", "w", "label", "_n"]
    schema = ranges.select(*cols).withColumn("_cluster", F.lit(0).cast("long")).schema
    x = store(ranges.groupBy(PART, *keys).applyInArrow(_cut_ranges(cols), schema), "clustered")
    w = F.col("w").cast("double")
    rlat, rlon = F.radians("lat"), F.radians("lon")
    mean = x.groupBy(*keys, "_cluster").agg(
        F.sum(w * F.cos(rlat) * F.cos(rlon)).alias("_x"), F.sum(w * F.cos(rlat) * F.sin(rlon)).alias("_y"),
        F.sum(w * F.sin(rlat)).alias("_z"), F.sum(w).alias("w"), F.min(F.struct("lat", "lon")).alias("_any"))
    length = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2)
    firm = length > F.col("w") * 1e-3           # else the members are all around: bounds of the first order
    mean = mean.select(*keys, "_cluster", firm.alias("_firm"),
                       F.when(firm, F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))))
                       .otherwise(F.col("_any.lat")).alias("clat"),
                       F.when(firm, F.degrees(F.atan2("_y", "_x"))).otherwise(F.col("_any.lon")).alias("clon"))
    near = join_null_safe(x, store(mean, "means"), [*keys, "_cluster"])
    s = haversine_km(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")) / EARTH_RADIUS_KM
    third = F.when(F.col("_firm"), F.col("s") - F.sin("s") + 1e-12).otherwise(F.lit(100.0))
    clusters = near.withColumn("s", s).groupBy(*keys, "_cluster", "clat", "clon").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("s")).alias("s1"), F.sum(w * F.col("s") * F.col("s")).alias("s2"),
        F.sum(w * third).alias("s3"), F.max("s").alias("r"))
    return x, store(clusters, "clusters")


def possible_medoids(x: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., lat, lon, label) of the points that may be their key's medoid.

    Branch and bound in two steps: clusters whose least possible cost is above another
    cluster's highest are dropped with their members; the other members are bounded one
    by one, in tiles, against the clusters of their key, of which there are about
    CLUSTERS whatever its size."""
    kept_schema = clusters.select(*keys, "_cluster").schema
    kept = store(clusters.groupBy(*keys).applyInArrow(_possible_clusters, kept_schema), "possible-clusters")
    cands = join_null_safe(x, kept, [*keys, "_cluster"])
    sizes = cands.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / COST_TILE).alias("_tiles"))
    cands = join_null_safe(store(cands, "open-points"), store(sizes, "tiles"), keys)
    cands = store(cands.withColumn("_t", F.pmod(F.xxhash64("lat", "lon"), F.col("_tiles"))), "tiled-points")
    tiles = cands.select(*keys, "_t").distinct()
    served = store(join_null_safe(clusters, tiles, keys), "served-clusters")
    schema = cands.select(*keys, "lat", "lon", "label", F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).schema
    bounded = store(cands.groupBy(*keys, "_t").cogroup(served.groupBy(*keys, "_t"))
                    .applyInArrow(_bounded(keys), schema), "bounded")
    best = bounded.groupBy(*keys).agg(F.min("high").alias("_best"))
    open_ = join_null_safe(bounded, best, keys).filter(
        F.col("low") <= F.col("_best") * (1 + 1e-9) + 4 * 10.0 ** -COST_DIGITS)
    return open_.select(*keys, "lat", "lon", "label")


def large_medoids(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact medoid of keys with many distinct points: (keys..., _med).

    points: keys, lat, lon (located), w, label. The candidates that ``possible_medoids``
    leaves are costed exactly: tiles of candidates meet tiles of points, and a pair of
    tiles returns one partial sum per candidate, so neither pairs of points nor a whole
    key get into one task."""
    boxed, clusters = clustered(points.select(*keys, "lat", "lon", "w", "label"), keys)
    cands = store(possible_medoids(boxed, clusters, keys), "candidates")
    cands = store(join_null_safe(cands, cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc")), keys), "counted")
    sizes = boxed.groupBy(*keys).agg(F.max("_n").alias("_n"))
    cands = join_null_safe(cands, sizes, keys)
    tiles = lambda n: F.ceil(F.col(n) / COST_TILE).cast("long")
    mine = F.xxhash64("lat", "lon")
    per_key = cands.groupBy(*keys).agg(F.max(tiles("_nc")).alias("_ct"))
    left = cands.select(*keys, "lat", "lon", "label", F.pmod(mine, tiles("_nc")).alias("_c"),
                        F.explode(F.sequence(F.lit(0).cast("long"), tiles("_n") - 1)).alias("_p"))
    right = join_null_safe(boxed, per_key, keys).select(
        *keys, "lat", "lon", "w", F.pmod(mine, tiles("_n")).alias("_p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ct") - 1)).alias("_c"))
    schema = left.select(*keys, "lat", "lon", "label", F.lit(0.0).alias("part")).schema
    parts = (left.groupBy(*keys, "_c", "_p").cogroup(right.groupBy(*keys, "_c", "_p"))
             .applyInArrow(_partial_costs(keys), schema))
    cost = parts.groupBy(*keys, "lat", "lon", "label").agg(F.sum("part").alias("cost"))
    return cost.groupBy(*keys).agg(F.min(F.struct(F.round("cost", COST_DIGITS).alias("cost"), "lat", "lon",
                                                  "label")).alias("_med"))


def l1_median(points: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon",
              label: str = "label", weight: str | None = None, tile: int = TILE_POINTS) -> DataFrame:
    """Medoid per key: (keys..., lat, lon, label), null point when no row is located."""
    pts = collapse_points(points, keys, lat, lon, label, weight)
    return medoid_and_dispersion(pts, keys, tile).select(*keys, "lat", "lon", "label")


def home_candidates(net_posts: DataFrame, min_posts: int = MIN_POSTS, max_posts: int | None = None,
                    count_by: str = "user_id") -> DataFrame:
    """Geo-tagged city posts of users with min_posts <= distinct posts (< max_posts).

    ``max_posts`` drops the most active users; by default nobody is dropped. Posts are counted over all geo-tagged rows of the user (any place type),
    then only 'city' rows are kept, as the reference did.
    """
    geo = net_posts.filter(F.col("lat").isNotNull())
    n = F.col("_n")
    keep = (n >= min_posts) if max_posts is None else (n >= min_posts) & (n < max_posts)
    users = geo.groupBy(count_by).agg(F.count_distinct("media_id").alias("_n")).filter(keep).select(count_by)
    x = geo.filter(F.col("place_type") == "city").join(shuffled(users), count_by, "left_semi")
    return x.select("user_name", "media_id", "followers_count", "lat", "lon",
                    place_label(F.col("place_name"), F.col("country_code")).alias("place_location"))


def activity_radius(cands: DataFrame, tile: int = TILE_POINTS) -> DataFrame:
    """Per user: medoid of own posts and the median distance of the other
    posts to it. Own posts are unweighted. (user_name, lat, lon, user_location, radius)."""
    pts = collapse_points(cands, ["user_name"], "lat", "lon", "place_location")
    r = medoid_and_dispersion(pts, ["user_name"], tile)
    return r.filter(F.col("label").isNotNull()).select(
        "user_name", "lat", "lon", F.col("label").alias("user_location"), F.col("dispersion").alias("radius"))


def ground_truth_from_posts(cands: DataFrame, max_radius_km: float = ACTIVITY_RADIUS_KM,
                            tile: int = TILE_POINTS) -> DataFrame:
    return (activity_radius(cands, tile).filter(F.col("radius") < max_radius_km)
            .select("user_name", "lat", "lon", "user_location"))


def unique_truth(df: DataFrame, keys: Sequence[str] = ("user_name",)) -> DataFrame:
    """One located row per user: the lowest (lat, lon, user_location)."""
    best = (df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .groupBy(*keys).agg(F.min(F.struct("lat", "lon", "user_location")).alias("_b")))
    return best.select(*keys, "_b.lat", "_b.lon", "_b.user_location")


def profile_ground_truth(raw: DataFrame) -> DataFrame:
    """Profile CSV rows (all strings) -> (user_name, lat, lon, user_location):
    whole-row dedup, 'city,country' label, text cast to double (bad -> null),
    rows without both coordinates dropped, one row per user."""
    x = raw.dropDuplicates()
    x = x.select("user_name", F.col("lat").try_cast("double").alias("lat"),
                 F.col("lon").try_cast("double").alias("lon"),
                 place_label(F.col("user_city"), F.col("user_country")).alias("user_location"))
    return unique_truth(x)


def merge_ground_truth(profile: DataFrame, posts_truth: DataFrame, keys: Sequence[str] = ("user_name",)) -> DataFrame:
    """Profile truth for users absent from the post truth, plus the post truth.
    The anti join ignores null names (NOT IN with a null would empty the result)."""
    names = posts_truth.select(*keys).filter(F.col(keys[-1]).isNotNull())
    cols = [*keys, "lat", "lon", "user_location"]
    return profile.join(shuffled(names), list(keys), "left_anti").select(*cols).unionByName(posts_truth.select(*cols))


def adjacency(edges: DataFrame, truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges with the known location of the target and of the source (left joins).
    ``keys`` (e.g. fold) prefix both join keys. Truth must be unique per key."""
    k = list(keys)
    t = truth.select(*k, F.col("user_name").alias("target"), F.col("lat").alias("target_lat"),
                     F.col("lon").alias("target_lon"), F.col("user_location").alias("target_location"))
    s = truth.select(*k, F.col("user_name").alias("source"), F.col("lat").alias("source_lat"),
                     F.col("lon").alias("source_lon"), F.col("user_location").alias("source_location"))
    x = edges.join(shuffled(t), [*k, "target"], "left").join(shuffled(s), [*k, "source"], "left")
    return x.select(*k, "source", "target", "weight", "target_lat", "target_lon", "target_location",
                    "source_lat", "source_lon", "source_location")


def neighbour_points(edges: DataFrame, truth: DataFrame, keys: Sequence[str] = (),
                     weighted: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Points per (keys..., source) for ``estimate``: the located targets of a
    source's edges and, as ``H``, the source's own known point.

    Edges carry no key (fold) columns and are shuffled once: a known point
    holds its keys in an array through the join and is spread over them
    afterwards. Sources with neither drop out. ``only``, distinct (keys...,
    source), restricts the result before anything is spread."""
    k = list(keys)
    cols = ["user_name", "lat", "lon", "user_location"]
    here = truth.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at = here.groupBy(*cols).agg(F.collect_list(F.struct(*k)).alias("_ks")) if k else here.select(*cols)
    sources = edges.select("source").distinct()
    if only is not None:
        sources = (only.groupBy("source").agg(F.collect_list(F.struct(*k)).alias("_only")) if k else only)
        edges = edges.join(shuffled(sources), "source")
    none = F.lit(None).cast("double")
    near = edges.join(shuffled(at), edges["target"] == at["user_name"])
    own = at.join(shuffled(sources.withColumnRenamed("source", "user_name")), "user_name")
    if k and only is not None:      # the same struct of keys on both sides
        near, own = (x.withColumn("_ks", F.array_intersect("_ks", "_only")).filter(F.size("_ks") > 0)
                     for x in (near, own))
    near = near.select(
        "source", "lat", "lon", F.col("user_location").alias("label"),
        (F.col("weight") if weighted else F.lit(1)).cast("double").alias("_weight"),
        none.alias("hlat"), none.alias("hlon"), F.lit(None).cast("string").alias("hlabel"),
        *(["_ks"] if k else []))
    own = own.select(
        F.col("user_name").alias("source"), none.alias("lat"), none.alias("lon"),
        F.lit(None).cast("string").alias("label"), none.alias("_weight"), F.col("lat").alias("hlat"),
        F.col("lon").alias("hlon"), F.col("user_location").alias("hlabel"), *(["_ks"] if k else []))
    rows = near.unionByName(own)
    if k:
        rows = rows.withColumn("_k", F.explode("_ks")).select("*", "_k.*").drop("_ks", "_k")
    return collapse_points(rows, [*k, "source"], weight="_weight", home=["hlat", "hlon", "hlabel"])


def estimate(edges: DataFrame, truth: DataFrame, keys: Sequence[str] = (), weighted: bool = True,
             tile: int = TILE_POINTS, only: DataFrame | None = None) -> DataFrame:
    """One estimate per source that is known or has a located neighbour: known
    sources keep their point; others take the (edge-weighted) medoid of their
    located neighbours. Truth must be unique per (keys..., user_name).
    (keys..., user_name, lat, lon, user_location, dispersion, inferred).
    ``only`` as in ``neighbour_points``."""
    r = medoid_and_dispersion(neighbour_points(edges, truth, keys, weighted, only), [*keys, "source"], tile)
    return r.select(*keys, F.col("source").alias("user_name"), "lat", "lon",
                    F.col("label").alias("user_location"), "dispersion", "inferred")


def propagate_once(edges: DataFrame, known: DataFrame, keys: Sequence[str] = (), weighted: bool = True,
                   max_dispersion_km: float = PROPAGATION_DISPERSION_KM, keep_unlocated: bool = False,
                   tile: int = TILE_POINTS, only: DataFrame | None = None) -> DataFrame:
    """One round: the new known set (keys..., user_name, lat, lon, user_location),
    or what it says of the sources in ``only`` (keys..., source).

    Users with dispersion >= max are dropped (and may be re-estimated later);
    users outside the edge table vanish; users without any located neighbour
    are dropped unless ``keep_unlocated`` (the reference kept them with a null
    point; only without ``keys``)."""
    est = estimate(edges, known, keys, weighted, tile, only).filter(F.col("dispersion") < max_dispersion_km)
    out = est.select(*keys, "user_name", "lat", "lon", "user_location")
    if keep_unlocated:
        if keys:
            raise ValueError("keep_unlocated needs a run without keys")
        if only is not None:
            edges = edges.join(shuffled(only), "source", "left_semi")
        heard = edges.join(shuffled(known.filter("lat is not null and lon is not null").select(
            F.col("user_name").alias("target"))), "target", "left_semi").select(F.col("source").alias("user_name"))
        placed = heard.unionByName(known.filter("lat is not null and lon is not null").select("user_name"))
        lost = edges.select(F.col("source").alias("user_name")).distinct().join(
            shuffled(placed), "user_name", "left_anti")
        none = F.lit(None)
        out = out.unionByName(lost.select("user_name", none.cast("double").alias("lat"),
                                          none.cast("double").alias("lon"),
                                          none.cast("string").alias("user_location")))
    return out


def changed_users(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., user_name) that entered, left or moved between two known sets."""
    cols = [*keys, "user_name", "lat", "lon", "user_location"]
    both = before.select(*cols).unionByName(after.select(*cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return both.filter(F.col("_n") == 1).select(*keys, "user_name").distinct()


def affected_sources(edges: DataFrame, changed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., source) whose next estimate can differ: the changed users that have
    edges, and the sources of edges to them.

    Changed users carry their keys in an array through the join, so edges meet each
    user once, not once per key."""
    k = list(keys)
    who = changed.groupBy("user_name").agg(F.collect_list(F.struct(*k)).alias("_ks")) if k else changed
    near = edges.join(shuffled(who.withColumnRenamed("user_name", "target")), "target").drop("target", "weight")
    own = edges.select("source").distinct().join(shuffled(who.withColumnRenamed("user_name", "source")), "source")
    both = near.select("source", *(["_ks"] if k else [])).unionByName(own)
    if k:
        both = both.select("source", F.explode("_ks").alias("_k")).select("_k.*", "source")
    return both.distinct()


def propagate(edges: DataFrame, known: DataFrame, rounds: int = 5, keys: Sequence[str] = (),
              weighted: bool = True, max_dispersion_km: float = PROPAGATION_DISPERSION_KM,
              keep_unlocated: bool = False, tile: int = TILE_POINTS,
              sizes: list | None = None, work: list | None = None) -> DataFrame:
    """``rounds`` rounds of ``propagate_once``, each over what can have changed.

    A source's estimate depends on its own point and its neighbours' points only.
    After the first round a round therefore takes over the estimates of sources
    around which nobody entered, left or moved in the round before, and costs
    the others (semi-naive evaluation); a round without any ends the work.

    The edge table is stored once in the shared folder, without a copy per
    key; every round's point table, estimates and known set are stored, so the plan
    does not grow with the rounds and a lost executor never forces earlier rounds to
    be computed again. When ``sizes`` is a list, the per-round known-set sizes
    (keys..., round, known) are appended to it as DataFrames; ``work`` likewise gets
    the sources costed in each round after the first (keys..., round, costed)."""
    cols = [*keys, "user_name", "lat", "lon", "user_location"]
    edges, before, only = store(edges, "edges"), known.select(*cols), None
    cur = store(propagate_once(edges, known, keys, weighted, max_dispersion_km, keep_unlocated, tile), "known")
    for i in range(1, rounds + 1):
        if i > 1 and (only is None or not only.isEmpty()):
            only = store(affected_sources(edges, changed_users(before, cur, keys), keys), "affected")
            new = propagate_once(edges, cur, keys, weighted, max_dispersion_km, keep_unlocated, tile, only)
            same = join_null_safe(cur, shuffled(only.withColumnRenamed("source", "user_name")), [*keys, "user_name"],
                                  "left_anti")
            before, cur = cur, store(same.select(*cols).unionByName(new.select(*cols)), "known")
        if sizes is not None:
            sizes.append(cur.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"))
                         .withColumn("round", F.lit(i)))
        if work is not None and only is not None:
            work.append(only.groupBy(*keys).agg(F.count(F.lit(1)).alias("costed")).withColumn("round", F.lit(i)))
    return cur
