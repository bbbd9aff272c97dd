"""Removal of lines that recur across documents.

Method: a sharded minimal perfect hash over the distinct line hashes. Every
shard is a bit-array hierarchy (a key goes to the first level where it falls
alone on its position; its slot is the rank of that bit) that indexes two
compact arrays: a 32-bit fingerprint and a saturated document count.
Documents probe the arrays with their line hashes; lines are never joined.

Flow, all of it linear in the input:

1. one pass over the texts gives each text's 128-bit key and, per distinct
   line, its 128-bit hash and positions; equal texts are merged first, so a
   group of copies counts once with a multiplicity;
2. document counts per line hash (partial sums before the shuffle);
3. one index row per shard; shards with many probes (a line that a third of
   all documents share) are served by several tasks, each with its own copy of
   that shard's arrays;
4. probes go to (shard, slice) and return the positions to drop per text;
5. documents join those positions by text key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.session import store

BLANK = b" \t\n\x0b\x0c\r"
GAMMA = 1.6         # bits per key and level
MAX_LEVELS = 48
KEYS_PER_SHARD = 200_000
SHARDS_PER_PARTITION = 4


def line_key(line: bytes) -> bytes:
    """White space cut at both ends, A-Z lower-cased (ASCII only)."""
    return line.strip(BLANK).lower()


def _halves(digest: bytes) -> tuple[int, int]:
    return (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))


# --- minimal perfect hash of one shard -------------------------------------

def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of the key for each level."""
    x = h1 ^ (h2 * np.uint64(2 * level + 1)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (two uint64 arrays).

    ``slot`` maps every key of the set to its own slot in 0..n-1; other keys
    get -1 or any slot, so the caller compares the fingerprint kept there."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.start = np.concatenate(([0], np.cumsum(sizes // 64)))
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        for level in range(MAX_LEVELS):
            if not len(h1):
                break
            m = max(64, int(math.ceil(len(h1) * GAMMA / 64)) * 64)
            pos = (_mix(h1, h2, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(pos, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[pos]
            h1, h2 = h1[rest], h2[rest]
        if len(h1):
            raise ValueError("keys of a perfect hash must be distinct")
        return PerfectHash(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, "<u8"))

    def slot(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            pos = (_mix(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64)
            word = self.start[level] + (pos >> 6)
            bits, at = self.words[word], (pos & 63).astype(np.uint64)
            hit = ((bits >> at) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits & ((np.uint64(1) << at) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.rank[word] + below)[hit]
            left = left[~hit]
        return out


def fingerprint(h2: np.ndarray) -> np.ndarray:
    """32 bits that the slot computation does not use on their own."""
    return (h2 >> np.uint64(32)).astype(np.uint32)


INDEX_SCHEMA = "shard long, slices int, sizes binary, words binary, fingerprints binary, counts binary, cap int"


def _build_shard(min_docs: int, fair: float):
    """(shard, h1, h2, n_docs, n_texts) of one shard -> its index row."""
    cap = max(min_docs, 255)
    kind = "<u1" if cap <= 255 else "<u4"

    def build(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        h2 = table["h2"].to_numpy().view(np.uint64)
        ph = PerfectHash.build(h1, h2)
        slot = ph.slot(h1, h2)
        prints, counts = np.empty(len(h1), "<u4"), np.empty(len(h1), kind)
        prints[slot] = fingerprint(h2)
        counts[slot] = np.minimum(table["n_docs"].to_numpy(), cap)
        slices = max(1, math.ceil(float(table["n_texts"].to_numpy().sum()) / fair))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                         "slices": pa.array([slices], pa.int32()),
                         "sizes": [ph.sizes.astype("<i8").tobytes()], "words": [ph.words.tobytes()],
                         "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()],
                         "cap": pa.array([cap], pa.int32())})
    return build


def _probe(min_docs: int):
    """One index shard against one slice of its probes -> positions to drop."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.list_(pa.int32()))])

    def probe(index: pa.Table, probes: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return schema.empty_table()
        row = index.slice(0, 1).to_pylist()[0]
        ph = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["words"], "<u8"))
        prints = np.frombuffer(row["fingerprints"], "<u4")
        counts = np.frombuffer(row["counts"], "<u1" if row["cap"] <= 255 else "<u4")
        h1 = probes["h1"].to_numpy().view(np.uint64)
        h2 = probes["h2"].to_numpy().view(np.uint64)
        slot = ph.slot(h1, h2)
        known = np.flatnonzero(slot >= 0)
        known = known[prints[slot[known]] == fingerprint(h2[known])]
        hit = known[counts[slot[known]] >= min_docs]
        return probes.select(["t1", "t2", "at"]).take(pa.array(hit)).cast(schema)
    return probe


# --- the operator ----------------------------------------------------------

def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (t1, t2, lines: [(h1, h2, positions)]) of the keyed lines."""
    item = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.list_(pa.int32()))])
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("lines", pa.list_(item))])
    hash128 = xxhash.xxh3_128_digest
    for batch in batches:
        texts = batch.column(0)
        for lo in range(0, len(texts), 512):
            t1, t2, lines = [], [], []
            for text in texts.slice(lo, 512).to_pylist():
                raw = (text or "").encode("utf-8")
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(raw.split(b"\n")):
                    key = line_key(line)
                    if key:
                        at.setdefault(hash128(key), []).append(i)
                a, b = _halves(hash128(raw))
                t1.append(a)
                t2.append(b)
                lines.append([{"h1": x, "h2": y, "at": p} for (x, y), p in
                              ((_halves(d), p) for d, p in at.items())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(lines, pa.list_(item))], schema=schema)


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the 128-bit text key to every row."""
    hash128 = xxhash.xxh3_128_digest
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            keys = [_halves(hash128((x or "").encode("utf-8"))) for x in part.column("_ld_text").to_pylist()]
            yield (part.append_column("_ld_t1", pa.array([k[0] for k in keys], pa.int64()))
                   .append_column("_ld_t2", pa.array([k[1] for k in keys], pa.int64())).drop_columns(["_ld_text"]))


def line_index(texts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """Index rows (INDEX_SCHEMA) over all distinct line hashes, and the
    number of shards.

    texts: (t1, t2, copies, lines). The number of shards follows the number
    of distinct lines (KEYS_PER_SHARD) and the parallelism of the session."""
    spark = texts.sparkSession
    counts = store(texts.select("copies", F.explode("lines").alias("l"))
                   .groupBy(F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"))
                   .agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_texts")), "line-counts")
    size = counts.agg(F.count("*").alias("keys"), F.sum("n_texts").alias("probes")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(math.ceil(size["keys"] / 200), max(parts * SHARDS_PER_PARTITION,
                                                            math.ceil(size["keys"] / KEYS_PER_SHARD))))
    fair = max(1000.0, 2.0 * (size["probes"] or 0) / shards)
    return (counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
            .groupBy("shard").applyInArrow(_build_shard(min_docs, fair), INDEX_SCHEMA)), shards


def dedup_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text") -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents.

    A text is split at \\n; a null or empty text is one empty line. A line's
    key is the line without ASCII white space at its ends, A-Z lower-cased;
    lines with an empty key always stay. A line that a document repeats counts
    once for it; repeated rows count as documents of their own. Returns all
    columns of ``docs`` with ``text_col`` replaced by the kept lines joined by
    \\n ('' if none is left, also for a null text), plus ``n_lines`` (before)
    and ``n_dropped`` as longs. Rows are not matched by any id, so null or
    repeated ids do not matter; an empty table gives an empty result. Columns
    of ``docs`` named n_lines or n_dropped are replaced.

    Each document's own lines are held in one task (bounded by the longest
    text). Keys are 128-bit hashes and a probe also compares a 32-bit
    fingerprint; all probed lines are in the index, so no foreign key is met.
    """
    texts = (docs.select(F.col(text_col).alias("text"))
             .mapInArrow(_lines_of, "t1 long, t2 long, lines array<struct<h1:long,h2:long,at:array<int>>>")
             .groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("lines").alias("lines")))
    texts = store(texts, "line-texts")
    index, shards = line_index(texts, min_docs)
    index = store(index, "line-index")
    probes = (texts.select("t1", "t2", F.explode("lines").alias("l"))
              .select("t1", "t2", F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"), F.col("l.at").alias("at"),
                      F.pmod("l.h1", F.lit(shards)).cast("long").alias("shard"))
              .join(index.select("shard", "slices"), "shard")
              .withColumn("slice", F.pmod("t1", F.col("slices")).cast("int")).drop("slices"))
    served = (index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))))
    drops = (served.groupBy("shard", "slice").cogroup(probes.groupBy("shard", "slice"))
             .applyInArrow(_probe(min_docs), "t1 long, t2 long, at array<int>")
             .groupBy(F.col("t1").alias("_ld_t1"), F.col("t2").alias("_ld_t2"))
             .agg(F.flatten(F.collect_list("at")).alias("_ld_drop")))
    # stored, so that the join below has plain shuffles on both sides and Spark
    # can split the rows of a text that very many documents share
    drops = store(drops, "drops")

    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_ld_text"))
    keyed = doc.mapInArrow(_text_keys, doc.drop("_ld_text").schema.add("_ld_t1", "long").add("_ld_t2", "long"))
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    dropped = F.coalesce(F.col("_ld_drop"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_ld_lines"), i)), "\n")
    out = (keyed.join(drops, ["_ld_t1", "_ld_t2"], "left")
           .withColumn("_ld_lines", lines).withColumn("_ld_n", F.size("_ld_lines").cast("long"))
           .withColumn("n_dropped", F.size(dropped).cast("long")))
    new_text = F.when(F.col("n_dropped") == 0, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).otherwise(kept)
    return out.select(*[new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
                      F.col("_ld_n").alias("n_lines"), "n_dropped")
