"""Work from one capture batch to the next, without reading the history again.

State lies in batch tables (``ingest.write_batch``): every function that writes takes
the batch's stamp, reads only what earlier stamps left and replaces what an earlier try
at the same stamp wrote, so a batch may be run again at any time. Stamps must sort in
the order of the batches.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.text import parse_post_time
from geotrail.operators.clean import EUROPE_CODES, MAX_SPEED_KMH, dedup_first, drop_impossible, with_movement
from geotrail.session import store
from geotrail.sources.ingest import STAMP, committed_batches, has_batches, read_batches, write_batch

LAST = ("user_id", "media_id", "create_time", "place_lat", "place_lon")


def _before(spark: SparkSession, root: str, stamp: str) -> str | None:
    """The last committed stamp before ``stamp``."""
    if not has_batches(spark, root):
        return None
    return committed_batches(spark, root).filter(F.col(STAMP) < stamp).agg(F.max(STAMP)).first()[0]


# --- cleaning ----------------------------------------------------------------

def move_batch(posts: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moved, late, new last posts) of one batch of posts of distinct media_id.

    ``last`` holds each user's last post so far (LAST, one row per user). ``moved`` are
    the posts with distance and seconds from the user's previous post, which for the
    first one of the batch is the stored one. Posts that are not after the user's stored
    last post, or have no readable time, cannot be placed any more: ``late``."""
    x = posts.withColumn("create_time", parse_post_time(F.col("create_time")))
    known = last.select("user_id", F.struct("create_time", "media_id").alias("_last"))
    x = store(x.join(known, "user_id", "left"), "placed")
    after = F.col("create_time").isNotNull() & F.coalesce(F.struct("create_time", "media_id") > F.col("_last"), F.lit(True))
    new, late = x.filter(after).drop("_last"), x.filter(~after).drop("_last")
    before = last.select(*LAST).join(new.select("user_id").distinct(), "user_id", "left_semi")
    both = new.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False)), True)
    moved = with_movement(both).filter("_new").drop("_new")
    best = F.max(F.struct(*[F.col(c) for c in ("create_time", "media_id", "place_lat", "place_lon")])).alias("_b")
    ends = last.select(*LAST).unionByName(new.select(*LAST)).groupBy("user_id").agg(best)
    return moved, late, ends.select("user_id", "_b.media_id", "_b.create_time", "_b.place_lat", "_b.place_lon")


def clean_batch(posts: DataFrame, root: str, stamp: str, codes: Sequence[str] = EUROPE_CODES,
                max_speed: float = MAX_SPEED_KMH) -> None:
    """Source-A cleaning of one batch (text create_time) into the tables under ``root``.

    Repeated media_id within the batch and those of earlier batches are dropped. Written
    are the cleaned posts of all users, late posts, the users seen in ``codes`` and every
    user's last post; read are the last posts and the seen ids, not the history."""
    spark = posts.sparkSession
    x = dedup_first(posts, "media_id", ["batch"] if "batch" in posts.columns else [])
    x = store(unseen(x.drop("batch"), "media_id", f"{root}/seen", stamp), "new-posts")
    earlier = _before(spark, f"{root}/last", stamp)
    if earlier is None:
        last = x.withColumn("create_time", parse_post_time("create_time")).select(*LAST).limit(0)
    else:
        last = spark.read.parquet(f"{root}/last/{STAMP}={earlier}")
    moved, late, ends = move_batch(x, last)
    write_batch(drop_impossible(moved, "later", max_speed), f"{root}/posts", stamp)
    write_batch(late, f"{root}/late", stamp)
    write_batch(x.filter(F.col("country_code").isin(list(codes))).select("user_id").distinct(), f"{root}/users", stamp)
    remember(x.select("media_id"), "media_id", f"{root}/seen", stamp)
    write_batch(ends, f"{root}/last", stamp)


def cleaned_posts(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned posts of all batches, of users who ever posted from one of the codes.

    The user restriction is applied here, as a user's later batch may bring the first
    such post."""
    users = read_batches(spark, f"{root}/users").select("user_id").distinct()
    return read_batches(spark, f"{root}/posts").drop(STAMP).join(users, "user_id", "left_semi")


# --- seen ids ----------------------------------------------------------------

SEEN_BITS = 30              # positions that ids are hashed to
BUCKET_BITS = 15            # positions of one Spark bitmap: 4 KB


def _bucket(item: str) -> Column:
    return F.shiftright(_place(item), BUCKET_BITS).alias("bucket")


def _place(item: str) -> Column:
    return F.xxhash64(F.col(item).cast("string")).bitwiseAND(F.lit((1 << SEEN_BITS) - 1))


def _bit(item: str) -> Column:
    return _place(item).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def remember(ids: DataFrame, item: str, root: str, stamp: str) -> None:
    """Add one batch of ids to the seen set at ``root``: the ids and their bitmaps."""
    x = store(ids.select(item).filter(F.col(item).isNotNull()).distinct(), "ids")
    write_batch(x, f"{root}/ids", stamp)
    write_batch(x.groupBy(_bucket(item)).agg(F.bitmap_construct_agg(_bit(item)).alias("bitmap")), f"{root}/bits", stamp)


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


def unseen(df: DataFrame, item: str, root: str, stamp: str) -> DataFrame:
    """Rows of ``df`` whose ``item`` is in no batch of the seen set before ``stamp``
    (null items are never seen).

    Distinct items meet the bitmaps of their bucket, one row per bucket; an unset bit
    proves an item new. Only items with a set bit go on to the stored ids, so an id that
    shares its position with a seen one is still told apart."""
    spark = df.sparkSession
    if _before(spark, f"{root}/ids", stamp) is None:
        return df
    bits = read_batches(spark, f"{root}/bits").filter(F.col(STAMP) < stamp)
    bits = bits.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    mine = (df.select(item).filter(F.col(item).isNotNull()).distinct()
            .groupBy(_bucket(item)).agg(F.collect_list(F.struct(F.col(item).alias("id"), _bit(item).alias("bit"))).alias("ids")))
    hit = mine.join(bits, "bucket").select(F.explode(F.filter("ids", lambda x: _is_set(F.col("bitmap"), x["bit"]))).alias("x"))
    stored = read_batches(spark, f"{root}/ids").filter(F.col(STAMP) < stamp).select(item)
    seen = hit.select(F.col("x.id").alias(item)).join(stored, item, "left_semi")
    return df.join(store(seen, "seen"), item, "left_anti")


# --- sketches ----------------------------------------------------------------

def sketch_batch(df: DataFrame, keys: Sequence[str], item: str, value: str, lg_k: int = 12, k: int = 1000) -> DataFrame:
    """Per key a HyperLogLog sketch of the distinct ``item``, a KLL sketch of ``value``
    (null ones left out) and the number of rows. Sketches have a bounded size, are
    aggregated map-side and may be merged over batches in any order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                 F.hll_sketch_agg(item, F.lit(lg_k)).alias("items"),
                                 F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("values"))


def merge_sketches(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key over all batches of ``sketch_batch``."""
    return batches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("items").alias("items"),
                                      F.kll_merge_agg_double("values").alias("values"))


def sketch_estimates(merged: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """(keys..., rows, items, q<percent>...): estimated distinct items and quantiles.

    With lg_k 12 the distinct count has a standard error of 1.6 %, with k 1000 a
    quantile's rank is off by about 0.3 % of the rows."""
    return merged.select(*keys, "rows", F.hll_sketch_estimate("items").alias("items"), *[
        F.kll_sketch_get_quantile_double("values", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles])
