"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so cosine >= t is a distance
join with epsilon = sqrt(2 - 2t). Vectors are projected on their leading
principal directions, put into the order of the grid of epsilon cells on those
directions, and cut into sequence intervals (blocks). Two blocks meet only if
they own neighbouring cells and their boxes are at most epsilon apart; inside
a pair the intervals are halved recursively, skipping every sub-pair whose
boxes are further apart than epsilon and linking as a whole those that lie
within epsilon of each other, down to leaves that are compared by one matrix
product. A projection never makes two vectors further apart, so nothing
is lost, whatever sample the directions were fitted on.

Equal vectors are one class with a multiplicity and take part once. Block pairs are
worked on in square tiles of neighbouring intervals, whose vectors travel once for a
tile; a tile returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.components import connected_components
from geotrail.llm.unionfind import union
from geotrail.llm.vectors import nonzero, usable
from geotrail.session import store

BLOCK = 2048            # vectors in a sequence interval
LEAF = 256              # vectors a side in one matrix product
DIRECTIONS = 8          # leading principal directions
CELL_DIRECTIONS = 3     # of them, those whose cells pair up blocks
FIT_VALUES = 1 << 19    # components in the sample that the directions are fitted on
TILES_PER_TASK = 4      # tiles of block pairs for each shuffle partition
TILE_BYTES = 1 << 27    # of vectors in a tile, in double precision
CLOSE = 1e-9            # double scores this near to the threshold are summed again exactly


def principal_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading directions per vector length, from a bounded sample.

    The sample is the first FIT_VALUES / length vectors in hash order; the
    directions steer the pruning only, never the result."""
    longest = classes.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return {}
    rows = (classes.select("vec").orderBy(F.xxhash64("vec")).limit(max(16, FIT_VALUES // longest)).collect())
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    out = {}
    for d, vecs in by_length.items():
        x = np.array(vecs, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))
        out[d] = np.ascontiguousarray(axes[:, ::-1][:, :DIRECTIONS].T)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and without overflow."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(x: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    d = x.shape[1]
    axes = directions.get(d)
    if axes is None:
        axes = np.eye(d)[:DIRECTIONS]
    p = np.zeros((len(x), DIRECTIONS))
    p[:, :len(axes)] = x @ axes.T
    return p


def _with_cells(directions: dict[int, np.ndarray], epsilon: float):
    """(cid, n, vec) -> plus length, leading coordinate and grid cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            lengths = np.diff(vec.offsets.to_numpy())
            flat = vec.values.to_numpy(zero_copy_only=False)
            starts = vec.offsets.to_numpy()[:-1]
            first = np.zeros(batch.num_rows)
            cells = np.zeros((batch.num_rows, DIRECTIONS), np.int32)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                p = _project(unit(flat[starts[own][:, None] + np.arange(d)]), directions)
                first[own] = p[:, 0]
                cells[own] = np.floor(p / epsilon)
            out = batch.append_column("d", pa.array(lengths.astype(np.int32)))
            out = out.append_column("p", pa.array(first))
            for k in range(DIRECTIONS):
                out = out.append_column(f"c{k}", pa.array(np.ascontiguousarray(cells[:, k])))
            yield out
    return run


BLOCKS = ("block long, d int, lo array<double>, hi array<double>, cells array<array<int>>, "
          "cids binary, counts binary, wide boolean, vecs binary")


def _cut_blocks(directions: dict[int, np.ndarray], epsilon: float):
    """Sorted rows of a partition -> blocks of at most BLOCK vectors."""
    cells_kind = pa.list_(pa.list_(pa.int32()))

    def block(number: int, rows: pa.Table, d: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        raw = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        p = _project(unit(raw), directions)
        cells = np.unique(np.floor(p[:, :CELL_DIRECTIONS] / epsilon).astype(np.int32), axis=0)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([d], pa.int32()), pa.array([p.min(0).tolist()]),
            pa.array([p.max(0).tolist()]), pa.array([cells.tolist()], cells_kind),
            pa.array([rows["cid"].to_numpy().astype("<i8").tobytes()]),
            pa.array([rows["n"].to_numpy().astype("<i8").tobytes()]), pa.array([raw.dtype.itemsize == 8]),
            pa.array([raw.tobytes()])],
            names=["block", "d", "lo", "hi", "cells", "cids", "counts", "wide", "vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held, d = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["cid", "n", "vec", "d"])
            lengths = table["d"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1), len(lengths)]
            for lo, hi in itertools.pairwise(cuts):
                if hi == lo:
                    continue
                if held is not None and d != lengths[lo]:
                    yield block(base + made, held, d)
                    made, held = made + 1, None
                d = int(lengths[lo])
                part = table.slice(lo, hi - lo)
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= BLOCK:
                    yield block(base + made, held.slice(0, BLOCK), d)
                    made, held = made + 1, held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield block(base + made, held, d)
    return run


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b, of blocks that may hold vectors within epsilon."""
    meta = blocks.select("block", "d", "lo", "hi", "cells")
    steps = F.array(*[F.array(*[F.lit(s) for s in step])
                      for step in itertools.product((-1, 0, 1), repeat=CELL_DIRECTIONS)])
    near = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.transform(
        steps, lambda s: F.zip_with(c, s, lambda x, y: x + y)))))
    a = meta.select(F.col("block").alias("a"), "d", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                    F.explode(near).alias("cell"))
    b = meta.select(F.col("block").alias("b"), "d", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                    F.explode("cells").alias("cell"))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1)), lambda k: F.pow(F.greatest(
        F.lit(0.0), F.get("lo_a", k) - F.get("hi_b", k), F.get("lo_b", k) - F.get("hi_a", k)), F.lit(2.0)))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    return (a.join(b, ["d", "cell"]).filter(F.col("a") <= F.col("b"))
            .filter(total <= F.lit(epsilon * epsilon + CLOSE)).select("a", "b").distinct())


class PairJoin:
    """Recursive join of two blocks; the second may be the first itself."""

    def __init__(self, a: dict, b: dict | None, threshold: float):
        self.same = b is None
        sides = [a] if b is None else [a, b]
        self.x = np.concatenate([s["x"] for s in sides])
        self.p = np.concatenate([s["p"] for s in sides])
        self.n = np.concatenate([s["n"] for s in sides]).astype(np.float64)
        self.threshold, self.reach = threshold, 2 - 2 * threshold + CLOSE
        self.single, self.margin = self.x.astype(np.float32), 2e-7 * (self.x.shape[1] + 50)
        self.links = np.zeros(len(self.x), np.float64)
        self.parent = np.arange(len(self.x))
        na, nb = len(a["x"]), (0 if b is None else len(b["x"]))
        if b is None:
            self.join(0, na, 0, na)
        else:
            self.join(0, na, na, na + nb)

    def join(self, i0: int, i1: int, j0: int, j1: int) -> None:
        p, q = self.p[i0:i1], self.p[j0:j1]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > self.reach:
            return
        if self.all_near(i0, i1, j0, j1):
            self.link_all(i0, i1, j0, j1)
        elif i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            self.leaf(i0, i1, j0, j1)
        elif i0 == j0:
            m = (i0 + i1) // 2
            self.join(i0, m, i0, m)
            self.join(i0, m, m, i1)
            self.join(m, i1, m, i1)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            self.join(i0, m, j0, j1)
            self.join(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            self.join(i0, i1, j0, m)
            self.join(i0, i1, m, j1)

    def all_near(self, i0: int, i1: int, j0: int, j1: int) -> bool:
        """Whether balls around the two intervals prove every pair a link."""
        def ball(x):
            centre = x.mean(axis=0)
            return centre, math.sqrt(np.square(x - centre).sum(axis=1).max())
        a, ra = ball(self.x[i0:i1])
        b, rb = (a, ra) if i0 == j0 else ball(self.x[j0:j1])
        return np.linalg.norm(a - b) + ra + rb + 1e-6 <= math.sqrt(max(2 - 2 * self.threshold, 0))

    def link_all(self, i0: int, i1: int, j0: int, j1: int) -> None:
        i, j = np.arange(i0, i1), np.arange(j0, j1)
        if i0 == j0:
            self.links[i] += self.n[i].sum() - self.n[i]
        else:
            self.links[i] += self.n[j].sum()
            self.links[j] += self.n[i].sum()
        every = np.concatenate([i, j])
        union(self.parent, every[1:], np.full(len(every) - 1, every[0]))

    def leaf(self, i0: int, i1: int, j0: int, j1: int) -> None:
        # single precision can be off by less than margin: what it leaves open is scored in double
        score = self.single[i0:i1] @ self.single[j0:j1].T
        hit = score >= self.threshold - self.margin
        if not hit.any():
            return
        i, j = np.nonzero(hit & (score <= self.threshold + self.margin))
        exact = np.einsum("ij,ij->i", self.x[i0 + i], self.x[j0 + j])
        hit[i, j] = exact >= self.threshold
        for k in np.flatnonzero(np.abs(exact - self.threshold) <= CLOSE):
            a, b = self.x[i0 + i[k]], self.x[j0 + j[k]]
            hit[i[k], j[k]] = math.fsum(a * b) >= self.threshold * math.sqrt(math.fsum(a * a) * math.fsum(b * b))
        if i0 == j0:
            hit = np.triu(hit, 1)
        self.links[i0:i1] += hit @ self.n[j0:j1]
        self.links[j0:j1] += self.n[i0:i1] @ hit
        i, j = np.nonzero(hit)
        union(self.parent, i + i0, j + j0)


def _side(row: dict, directions: dict[int, np.ndarray]) -> dict:
    """A block from its bytes: vectors travel as they came and are scaled here."""
    x = unit(np.frombuffer(row["vecs"], "<f8" if row["wide"] else "<f4").reshape(-1, row["d"]))
    return {"x": x, "p": _project(x, directions), "n": np.frombuffer(row["counts"], "<i8"),
            "cid": np.frombuffer(row["cids"], "<i8")}


def _join_tile(threshold: float, directions: dict[int, np.ndarray]):
    """The block pairs of a tile -> rows (u, v, n): link counts (v null) and forest edges."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        sides = {row["block"]: _side(row, directions) for row in blocks.to_pylist()}
        counted, links, tied_to, tied = [], [], [], []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            j = PairJoin(sides[a], None if a == b else sides[b], threshold)
            cid = sides[a]["cid"] if a == b else np.concatenate([sides[a]["cid"], sides[b]["cid"]])
            some = np.flatnonzero(j.links > 0)
            counted.append(cid[some])
            links.append(j.links[some])
            child = np.flatnonzero(j.parent != np.arange(len(cid)))
            tied.append(cid[child])
            tied_to.append(cid[j.parent[child]])
        if not counted:
            return schema.empty_table()
        who, at = np.unique(np.concatenate(counted), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(links), minlength=len(who)).astype(np.int64)
        u, v = np.concatenate(tied), np.concatenate(tied_to)
        return pa.table([pa.array(np.concatenate([who, u])), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(v)]),
                         pa.concat_arrays([pa.array(n), pa.nulls(len(u), pa.int64())])], schema=schema)
    return run


def _tile_side(pairs: int, parallelism: int, longest: int) -> int:
    """Intervals along a side of a tile: about TILES_PER_TASK tiles for every task, and not
    more vectors in one than TILE_BYTES."""
    fair = math.isqrt(max(1, pairs // max(1, TILES_PER_TASK * parallelism)))
    return max(1, min(fair, TILE_BYTES // (2 * BLOCK * 8 * max(1, longest))))


def class_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between classes (cid, n, vec) of distinct vectors.

    Returns (cid, linked): rows linked in other classes, and (u, v): a
    spanning set of the links."""
    epsilon = math.sqrt(max(2 - 2 * threshold, 1e-12))
    directions = principal_directions(classes)
    parts = max(1, math.ceil(classes.count() / BLOCK))
    kinds = {c: dict(classes.dtypes)[c] for c in ("cid", "n", "vec")}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "d int", "p double",
                        *(f"c{k} int" for k in range(DIRECTIONS))])
    order = ["d", *(f"c{k}" for k in range(DIRECTIONS)), "p", "cid"]
    ordered = (classes.select("cid", "n", "vec").mapInArrow(_with_cells(directions, epsilon), schema)
               .repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts))
    blocks = store(ordered.mapInArrow(_cut_blocks(directions, epsilon), BLOCKS), "blocks")
    pairs = store(_block_pairs(blocks, epsilon), "block-pairs")
    side = _tile_side(pairs.count(), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                      max(directions, default=1))
    # an interval travels once for each tile that it has pairs in, not once for each pair
    tile = lambda c: F.floor(F.shiftright(c, 32) / side).cast("long")
    tiled = pairs.select("a", "b", tile("a").alias("ta"), tile("b").alias("tb"))
    need = tiled.select("ta", "tb", F.col("a").alias("block")).union(tiled.select("ta", "tb", "b")).distinct()
    of = tiled.select("a", "b", F.col("ta").alias("of_a"), F.col("tb").alias("of_b"))
    load = need.join(blocks.select("block", "d", "cids", "counts", "wide", "vecs"), "block")
    found = store(load.groupBy("ta", "tb").cogroup(of.groupBy("of_a", "of_b")).applyInArrow(
        _join_tile(threshold, directions), "u long, v long, n long"), "links")
    counts = (found.filter(F.col("v").isNull()).groupBy(F.col("u").alias("cid"))
              .agg(F.sum("n").alias("linked")))
    return counts, found.filter(F.col("v").isNotNull()).select("u", "v")


def link_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """Links, groups and representatives of near-duplicate vectors.

    Two rows link if the cosine of their vectors, in double precision, is at
    least ``threshold`` (0 < threshold <= 1). Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. Returns all columns of ``vectors`` (replacing
    columns of these names) plus n_links (long, other rows linked directly),
    component_id (smallest id reachable by links, itself included) and kept
    (id = component_id). Repeated rows are vectors of their own and link with
    each other; null ids take part but never name a component, and are never
    kept. An empty table gives an empty one.
    """
    keep = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    vec, vid = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`")
    sound = usable(vec) & nonzero(vec)
    classes = store(vectors.filter(sound).groupBy(vec.alias("vec"))
                    .agg(F.min(vid).alias("least"), F.count("*").alias("n"))
                    .withColumn("cid", F.monotonically_increasing_id()), "classes")
    counts, edges = class_links(classes, threshold)
    roots = connected_components(edges)
    labelled = (classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                .withColumn("component", F.coalesce("component", "cid")))
    labelled = store(labelled, "labelled")
    names = labelled.groupBy("component").agg(F.min("least").alias("_ed_component"))
    per_class = store(labelled.join(names, "component").select(
        F.col("vec").alias("_ed_vec"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("_ed_links"),
        "_ed_component"), "per-class")
    base = vectors.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_ed_key", F.when(sound, vec))
    out = base.join(per_class, F.col("_ed_key") == F.col("_ed_vec"), "left")
    component = F.when(F.col("_ed_key").isNull(), vid).otherwise(F.col("_ed_component"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("_ed_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(vid == component, F.lit(False)).alias("kept"))
