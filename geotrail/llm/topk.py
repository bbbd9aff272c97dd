"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores, one per slice of the components; each
(slice, block of rows) holds one local list. All phases run over pairs of a
block of queries and a block of rows, in tiles of neighbouring blocks: a block is
sent once for a tile, and a tile returns at most k entries a query:

1. every block sums the first rows of its lists, which are those with the longest
   vectors, and gives the best few for each query. The k-th largest sum gathered for
   a query is a safe cutoff: the true k-th score is not lower;
2. the cutoffs go back with the query blocks. A row whose total reaches the
   cutoff has a partial score of at least cutoff / slices in some list, so every
   list gives the entries from that uniform threshold on. A list whose longest
   vector cannot reach it with a query is not scored for that query;
3. only these entries are summed exactly, and those that reach the cutoff, at most
   k a block, are ranked.

Phase 1 is sent and scores HEAD rows of a block, phase 2 every open list once, phase 3
single pairs.

Scores are integers and stay exact: in 32-bit floats up to 2^24, else in 64-bit
floats up to 2^53, else in Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.llm.vectors import usable
from geotrail.session import store

ROWS = 4096         # rows in a block
QUERIES = 1024      # queries in a block
SLICES = 2
HEAD = 64           # rows of a block that phase 1 scores
TILES_PER_TASK = 4  # tiles of block pairs for each core
TILE_BYTES = 1 << 26    # of a tile's rows, and of its queries with what they find
ENTRY_BYTES = 40    # of an entry found
HELD = 1 << 20      # entries of a query block after which only the best k a query are held on
LONG = (-(1 << 63), (1 << 63) - 1)


def whole_components(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), x as double."""
    return np.floor(scale * flat.astype(np.float64))


BLOCK = ("n", "ids", "small", "values")
BLOCK_SCHEMA = ("d int, block long, n int, ids binary, small boolean, values binary, "
                "head_n int, head_ids binary, head_values binary")


def _longest(squares: np.ndarray, n: int) -> np.ndarray:
    """Positions, ascending, of the n longest vectors by their squared lengths."""
    return np.arange(len(squares)) if len(squares) <= n else np.sort(np.argpartition(-squares, n - 1)[:n])


def _block(scale: float, head: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d = table["d"][0].as_py()
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = whole_components(flat.reshape(-1, d)[order], scale)
        small = bool(np.abs(values).max(initial=0) < 1 << 15)
        ids, kind = table["id"].to_numpy()[order].astype("<i8"), "<i2" if small else "<f8"
        first = _longest(np.square(values).sum(axis=1), head)
        return pa.table({
            "d": pa.array([d], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "n": pa.array([len(values)], pa.int32()), "ids": [ids.tobytes()],
            "small": [small], "values": [values.astype(kind).tobytes()],
            "head_n": pa.array([len(first)], pa.int32()), "head_ids": [ids[first].tobytes()],
            "head_values": [values[first].astype(kind).tobytes()]})
    return pack


def _blocks(rows: DataFrame, size: int, scale: float, head: int = 0) -> tuple[DataFrame, int]:
    """(id, vec) -> blocks of about ``size`` different rows, dealt by hash, and their ``head`` longest rows."""
    # counted by hash: the number of blocks is all that follows, and the vectors are not shuffled for it
    n = max(1, math.ceil(rows.select(F.xxhash64("id", "vec")).distinct().count() / size))
    keyed = rows.distinct().select("id", "vec", F.size("vec").alias("d"),
                        F.pmod(F.xxhash64("id", "vec"), F.lit(n)).alias("block"))
    return store(keyed.groupBy("d", "block").applyInArrow(_block(scale, head), BLOCK_SCHEMA), "blocks"), n


def _width(blocks: DataFrame) -> int:
    """Bytes of the longest vector."""
    return blocks.agg(F.max(F.col("d") * F.when(F.col("small"), 2).otherwise(8))).first()[0] or 1


def _sides(n_queries: int, n_rows: int, query_bytes: int, row_bytes: int, tasks: int) -> tuple[int, int]:
    """Query blocks and row blocks along the sides of a tile, from the bytes of a block.

    A row block is sent once for each interval of queries, a query block and what it finds
    once for each interval of rows: about TILES_PER_TASK tiles for every task that send the
    least, and not more than TILE_BYTES on a side."""
    tiles = TILES_PER_TASK * tasks
    least_q, least_r = (math.ceil(n / max(1, TILE_BYTES // size))
                        for n, size in ((n_queries, query_bytes), (n_rows, row_bytes)))
    by_q = min(n_queries, max(least_q, round(math.sqrt(tiles * n_queries * query_bytes / (n_rows * row_bytes)))))
    by_r = min(n_rows, max(least_r, math.ceil(tiles / by_q)))
    by_q = min(n_queries, max(by_q, math.ceil(tiles / by_r)))
    return math.ceil(n_queries / by_q), math.ceil(n_rows / by_r)


def _best_entries(entries: pa.Table, k: int) -> pa.Table:
    """The k best entries of each query of a block, ties to the smaller vec_id."""
    q, score = entries["q"].to_numpy(), entries["score"].to_numpy()
    keys = [-score if score.dtype.kind == "f" else ~score, q]       # the least long has no negative
    if "vec_id" in entries.column_names:
        keys.insert(0, entries["vec_id"].to_numpy())
    order = np.lexsort(keys)
    nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return entries.take(pa.array(order[nth < k]))


def _tile(run, k: int, schema: pa.Schema):
    """Every pair of a tile's blocks through ``run``; the k best entries of each query."""

    def pair(q: pa.Table, r: pa.Table) -> pa.RecordBatch:
        named = {c: t[c].combine_chunks() for t in (r, q) for c in t.column_names}
        return pa.RecordBatch.from_arrays([*named.values()], names=[*named])

    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for i in range(queries.num_rows):
            found, most = schema.empty_table(), HELD
            for batch in run(pair(queries.slice(i, 1), rows.slice(j, 1)) for j in range(rows.num_rows)):
                found = pa.concat_tables([found, pa.Table.from_batches([batch])])
                if len(found) > most:
                    found = _best_entries(found, k)
                    most = max(HELD, 2 * len(found))
            out.append(_best_entries(found, k))
        return pa.concat_tables(out)
    return tile


def _tiled(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, sides: tuple[int, int],
           run, k: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """``run`` over every query block next to every row block of the same vector length."""
    side_q, side_r = sides
    by_q, by_r = math.ceil(n_queries / side_q), math.ceil(n_rows / side_r)
    interval = lambda side: F.floor(F.col("block") / side).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("d", interval(side_q).alias("tq"), every(by_r).alias("tr"), F.col("block").alias("qb"),
                       *[F.col(c).alias(f"q_{c}") for c in BLOCK], *[c for c in queries.columns if c == "cutoffs"])
    r = rows.select("d", every(by_q).alias("tq"), interval(side_r).alias("tr"), F.col("block").alias("rb"),
                    *[F.col(c).alias(f"r_{c}") for c in BLOCK])
    tile = ("d", "tq", "tr")
    # a number of its own: tiles are few and small, but long work
    q, r = (x.repartition(2 * by_q * by_r, *tile).groupBy(*tile) for x in (q, r))
    return q.cogroup(r).applyInArrow(_tile(run, k, schema), ddl)


class Lists:
    """The local lists of one pair of blocks: partial scores per slice."""

    def __init__(self, row: dict, slices: int):
        d = row["d"]
        q = np.frombuffer(row["q_values"], "<i2" if row["q_small"] else "<f8").reshape(-1, d)
        r = np.frombuffer(row["r_values"], "<i2" if row["r_small"] else "<f8").reshape(-1, d)
        bound = d * float(np.abs(q.astype(float)).max()) * float(np.abs(r.astype(float)).max())
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        self.cuts = np.array_split(np.arange(d), min(slices, d))
        # lengths of the parts of the vectors, a little too long against rounding
        self.q_len, self.r_len = (np.stack([np.linalg.norm(x[:, c].astype(float), axis=1) for c in self.cuts], axis=1)
                                  * (1 + 1e-9) for x in (q, r))
        if self.kind is object:
            q, r = (np.vectorize(int, otypes=[object])(x) for x in (q, r))
        self.q, self.r = q.astype(self.kind), r.astype(self.kind)
        self.q_ids, self.r_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["r_ids"], "<i8")
        self.scored = 0         # partial scores and products of pairs so far, in components

    def own(self, queries: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.q_ids[queries][:, None] == self.r_ids[rows][None, :]

    def partial(self, queries: np.ndarray, which: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Scores of ``queries`` with ``rows`` over the components ``which``, for comparing."""
        r = self.r[rows][:, which]
        self.scored += len(queries) * len(r) * len(which)
        return _floats(self.q[queries][:, which] @ r.T)

    def exact(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Score of each pair."""
        self.scored += len(queries) * self.q.shape[1]
        parts = [(self.q[queries[i:i + 16384]] * self.r[rows[i:i + 16384]]).sum(axis=1)
                 for i in range(0, len(queries), 16384)]
        return np.concatenate(parts) if parts else np.empty(0, self.kind)

    def head(self, n: int) -> np.ndarray:
        """Rows with the longest vectors."""
        return _longest((self.r_len ** 2).sum(axis=1), n)


def _as_long(scores) -> pa.Array:
    return pa.array([int(min(max(int(s), LONG[0]), LONG[1])) for s in scores], pa.int64())


def _best(order_by: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row (any order, ties broken freely)."""
    if order_by.shape[1] <= k:
        return np.broadcast_to(np.arange(order_by.shape[1]), order_by.shape)
    return np.argpartition(-order_by, k - 1, axis=1)[:, :k]


ENTRY = pa.schema([("d", pa.int32()), ("qb", pa.int64()), ("q", pa.int32()), ("score", pa.float64())])


def _gather(slices: int, few: int):
    """Phase 1: the best ``few`` sums among the first rows of the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lists = Lists(row, slices)
                head, every = lists.head(max(HEAD, few)), np.concatenate(lists.cuts)
                qs, scores = [], []
                for lo in range(0, len(lists.q), 128):
                    queries = np.arange(lo, min(lo + 128, len(lists.q)))
                    total = np.where(lists.own(queries, head), -np.inf, lists.partial(queries, every, head))
                    best = np.take_along_axis(total, _best(total, few), axis=1)
                    i, j = np.nonzero(np.isfinite(best))
                    qs.append(queries[i])
                    scores.append(best[i, j])
                q = np.concatenate(qs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), row["d"], np.int32)), pa.array(np.full(len(q), row["qb"], np.int64)),
                     pa.array(q.astype(np.int32)), pa.array(np.concatenate(scores).astype(np.float64))], schema=ENTRY)
    return run


def _floats(x: np.ndarray) -> np.ndarray:
    """Scores for comparing only; exact integers rounded down to doubles."""
    if x.dtype != object:
        return x
    return np.nextafter(np.array([[float(v) for v in r] for r in x]).reshape(x.shape), -np.inf)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("q", pa.int32()),
                   ("qb", pa.int64()), ("d", pa.int32())])


def _collect(slices: int, k: int):
    """Phases 2 and 3: entries from the uniform threshold on, summed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lists = Lists(row, slices)
                cutoff = np.full(len(lists.q), -np.inf)
                for c in row["cutoffs"] or []:
                    cutoff[c["q"]] = c["cutoff"]
                out = [[], [], []]
                for lo in range(0, len(lists.q), 128):
                    queries = np.arange(lo, min(lo + 128, len(lists.q)))
                    level = cutoff[queries]
                    slack = np.abs(level) * 1e-12 if lists.kind is object else np.zeros(len(level))
                    need = (level - slack) / len(lists.cuts)
                    passed = np.zeros((len(queries), len(lists.r)), bool)
                    for s, which in enumerate(lists.cuts):
                        open_ = np.flatnonzero(lists.q_len[queries, s] * lists.r_len[:, s].max() >= need)
                        if len(open_):
                            passed[open_] |= lists.partial(queries[open_], which) >= need[open_, None]
                    i, j = np.nonzero(passed & ~lists.own(queries))
                    total = lists.exact(queries[i], j)
                    keep = np.array(total >= level[i] - slack[i], bool)
                    i, j, total = i[keep], j[keep], total[keep]
                    # rows are in id order, so a stable sort ranks ties by smaller id
                    order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -total[x], j[x])), np.int64) \
                        if lists.kind is object else np.lexsort((j, -total, i))
                    i, j, total = i[order], j[order], total[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    first = nth < k
                    out[0].append(i[first] + lo)
                    out[1].append(j[first])
                    out[2].append(total[first])
                q, j, total = (np.concatenate(x) for x in out)
                scores = _as_long(total) if lists.kind is object else pa.array(total.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.q_ids[q]), pa.array(lists.r_ids[j]), scores, pa.array(q.astype(np.int32)),
                     pa.array(np.full(len(q), row["qb"], np.int64)),
                     pa.array(np.full(len(q), row["d"], np.int32))], schema=FOUND)
    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, scale: float = 64.0, slices: int = SLICES,
                id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the largest integer inner products.

    Components become floor(scale * x). ``queries`` and ``vectors`` have
    ``id_col`` (integers) and ``vec_col``; a query never returns a row of its
    own id. Returns query_id, rank (int, from 1), vec_id, score (long, held to
    the range of a long): k rows a query, all if there are fewer, ties to the
    smaller vec_id. Vectors that are null, empty or hold null or non-finite
    components, and rows without an id, take no part; vectors of different
    length are not compared; rows equal in id and vector count once, and an id
    with several vectors has each of them ranked. Empty tables give an empty
    result. Further columns, whatever their names, are ignored; a vector of any length
    lies in one block.
    """
    def rows(df):
        vec = F.col(f"`{vec_col}`")
        return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"))
                .filter(F.col("id").isNotNull() & usable(F.col("vec"))))

    q_blocks, nq = _blocks(rows(queries), QUERIES, scale)
    r_blocks, nr = _blocks(rows(vectors), ROWS, scale, head=max(HEAD, k))
    few = max(1, min(k, math.ceil(2 * k / nr)))
    tasks = r_blocks.sparkSession.sparkContext.defaultParallelism
    q_bytes, r_width = QUERIES * (_width(q_blocks) + ENTRY_BYTES * k), _width(r_blocks)
    heads = r_blocks.select("d", "block", "small", *[F.col(f"head_{c}").alias(c) for c in ("n", "ids", "values")])
    gathered = _tiled(q_blocks, heads, nq, nr, _sides(nq, nr, q_bytes, max(HEAD, k) * r_width, tasks),
                      _gather(slices, few), k, ENTRY, "d int, qb long, q int, score double")
    nth = Window.partitionBy("d", "qb", "q").orderBy(F.col("score").desc())
    cutoffs = (gathered.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") == k)
               .groupBy("d", F.col("qb").alias("block")).agg(
                   F.collect_list(F.struct("q", F.col("score").alias("cutoff"))).alias("cutoffs")))
    # without the hint Spark would broadcast one side, through the driver, while its compressed size seems small
    ready = store(q_blocks.join(cutoffs.hint("merge"), ["d", "block"], "left"), "queries")
    found = _tiled(ready, r_blocks, nq, nr, _sides(nq, nr, q_bytes, ROWS * r_width, tasks),
                   _collect(slices, k), k, FOUND, "query_id long, vec_id long, score long, q int, qb long, d int")
    best = Window.partitionBy("d", "qb", "q").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
