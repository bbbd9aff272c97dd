"""SimHash near-duplicate grouping with covering locality-sensitive hashing.

Every bit of the fingerprint gets a non-zero vector of GF(2)^(radius+1); for
each non-zero vector v of that space there is one table, whose mask keeps the
bits whose vector has odd product with v. Two fingerprints that differ in at
most ``radius`` bits differ in positions whose vectors span at most ``radius``
dimensions, so some v is orthogonal to all of them and the pair agrees on
that table's mask: the pair meets in at least one of the 2^(radius+1) - 1
tables, always. With 64 bits and radius 4 that is 31 tables keeping about 33
bits each.

Only distinct fingerprints enter the tables. A bucket is solved in one task by
a search that scans only members not yet reached, and emits a spanning forest
of its links, never its pairs. The members of a bucket over BUCKET are dealt anew
by another family of masks, and again, up to FAMILIES: a pair in reach meets in some
table of every family, and a bucket's members agree on the bits that its masks keep,
about 33 of the first one, 48 of two, 56 of three and 60 of four (39 of two at worst),
so after four families few fingerprints can share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.components import connected_components
from geotrail.session import store

BUCKET = 2000
FAMILIES = 4
KEY = "_sh_fp"
SEED = 42


# --- fingerprints ----------------------------------------------------------

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle (ASCII white space, A-Z lowered)."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), len(parts)
    h = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([h(joined, SEED)], np.uint64)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    ends = [s - 1 for s in starts[words:]]
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        part = hashes[lo:lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(words: int, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fp = [fingerprint(shingle_hashes(x, words)) for x in part.column(text_col).to_pylist()]
                yield part.select(columns).append_column(KEY, pa.array(fp, pa.int64()))
    return run


def with_fingerprint(docs: DataFrame, words: int, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` plus the signed 64-bit fingerprint (column KEY)."""
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])])
    schema = src.select(*[F.col(f"`{c}`") for c in columns]).schema.add(KEY, "long")
    return src.mapInArrow(_fingerprints(words, text_col, columns), schema)


def fingerprint_hex(col: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


# --- covering masks --------------------------------------------------------

def covering_masks(radius: int, bits: int = 64, turn: int = 0) -> list[int]:
    """Masks (signed 64-bit) of the 2^(radius+1) - 1 tables.

    Bit i gets vector 1 + (step * i + turn) mod (2^(radius+1) - 1), so the
    vectors are spread evenly; another ``turn`` gives another family."""
    space = (1 << (radius + 1)) - 1
    step = 1 + 2 * turn
    vectors = [1 + (step * i + i // space + turn) % space for i in range(bits)]
    masks = []
    for v in range(1, space + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, g): one row per fingerprint and table; g names the bucket.

    A bucket inside another has the outer name, the table and the masked bits hashed
    into its own; two buckets of one name are solved together, which finds no less."""
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    return rows.select("fp", "g", F.posexplode(values).alias("t", "k")).select("fp", F.xxhash64("g", "t", "k").alias("g"))


# --- links inside buckets --------------------------------------------------

def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (from, to) of the links among distinct fingerprints."""
    left = fps.copy()
    src, dst = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                src.append(np.full(len(found), x))
                dst.append(found)
                queue.extend(found)
                left = left[~near]
    if not src:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(src), np.concatenate(dst)


def _solve(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            us, vs = [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                u, v = bucket_links(flat[lo:hi], radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))],
                                                 schema=schema)
    return run


def fingerprint_links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning set of all links (<= radius bits) between ``fp`` values.

    fps: one column ``fp`` of distinct, non-null longs. Buckets are counted before they
    are collected; those over BUCKET members go on to the next family of masks."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out before each row becomes one per table
    rows = fps.select("fp", F.lit(0).cast("long").alias("g")).repartition(parts, "fp")
    buckets = None
    for turn in range(FAMILIES):
        dealt = _dealt(rows, covering_masks(radius, turn=turn))
        light = dealt
        if turn < FAMILIES - 1:
            sizes = dealt.groupBy("g").agg(F.count("*").alias("n"))
            heavy = store(sizes.filter(F.col("n") > BUCKET).select("g"), "heavy-buckets")
            light = dealt.join(heavy, "g", "left_anti")
        light = light.groupBy("g").agg(F.collect_list("fp").alias("fps")).select("fps")
        buckets = light if buckets is None else buckets.unionByName(light)
        if turn == FAMILIES - 1 or heavy.isEmpty():
            break
        rows = store(dealt.join(heavy, "g", "left_semi").repartition(parts, "fp"), "heavy-rows")
    return buckets.filter(F.size("fps") > 1).mapInArrow(_solve(radius), "u long, v long").distinct()


# --- the operator ----------------------------------------------------------

def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id",
                   text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked.

    Texts are lower-cased (A-Z), split at ASCII white space and cut into
    ``words``-word shingles, repeats included; a shorter text is one shingle,
    a null, empty or blank text has fingerprint zero and is linked like any
    other. Two fingerprints link at ``radius`` or fewer differing bits; a
    group is a connected component of all links.

    Returns ``columns`` of ``docs`` (all, by default) plus ``fingerprint``
    (signed long), ``component_id``: the smallest ``id_col`` in the group, and
    ``leads``: the row has that id and, of the group's rows with it, the
    smallest fingerprint. Null ids belong to their group but never name it; a
    group of null ids only has a null component, and is led by its smallest
    fingerprint. Repeated rows and ids stay, each with its result (copies of
    the leading row lead too); an empty table gives an empty one. Input
    columns with the result names are replaced. A text of any length is hashed
    whole in one task.
    """
    keep = [c for c in (columns or docs.columns) if c not in ("fingerprint", "component_id", "leads")]
    rows = store(with_fingerprint(docs, words, text_col, list(dict.fromkeys([*keep, id_col]))), "fingerprints")
    fps = store(rows.groupBy(F.col(KEY).alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("least")), "distinct")
    roots = connected_components(fingerprint_links(fps.select("fp"), radius))
    labelled = store(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first")
    least = labelled.groupBy("component").agg(first).select(
        "component", F.col("first.least").alias("component_id"), F.col("first.fp").alias("_sh_lead"))
    names = labelled.select("component", F.col("fp").alias(KEY)).join(least, "component").drop("component")
    leads = (F.col(KEY) == F.col("_sh_lead")) & F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))
    return rows.join(names, KEY).select(*[F.col(f"`{c}`") for c in keep], F.col(KEY).alias("fingerprint"),
                                        "component_id", leads.alias("leads"))
