"""Best-fit-decreasing packing of tokenised documents into fixed sequences.

Best-fit decreasing looks at piece lengths alone, and bins with the same room
left are interchangeable. So the whole corpus is packed exactly as one
best-fit-decreasing run would do it, from the histogram of lengths: pieces of
one length are placed together, and a segment tree over the remaining
capacities finds the tightest open capacity in logarithmic time. The plan
that comes out is a list of runs ("pieces number a..a+t of length L go to bins
b..b+t at offset o"); its size depends on the capacity, not on the data: a
length adds at most three groups of bins and a bin holds at most about
sqrt(2 * capacity) different lengths, so there are at most
3 * capacity * sqrt(2 * capacity) runs (under 400,000, or 16 MB, at 2048
tokens). Pieces are numbered within their length by Spark, in parallel, and
look their run up in the broadcast plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.session import store

END_ID = 0

# --- tokenizer -------------------------------------------------------------

# Up to here the two libraries' Unicode tables agree; other texts go to the slow one.
_PLAIN = re.compile(r"[^\x00-ɏ]")
_TOKENIZERS: dict[str, ByteBpe] = {}


class ByteBpe:
    """Token ids of a byte-level BPE given as a ``tokenizers`` JSON file.

    ``tiktoken`` gives the same ids several times faster from the same ranks;
    it is used for texts in Latin script (``_PLAIN``) without the strings of
    special tokens, and ``tokenizers`` itself for all others."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.search(text) and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except ValueError:      # a run too long for the fast pattern engine
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


# The split pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def _tokenizer(path: str) -> ByteBpe:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def _tokenise(path: str, capacity: int, text_col: str, columns: list[str], names: tuple[str, ...]):
    """Rows -> pieces with the columns ``names``, numbered per length within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = _tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                of, piece, start, length, ids, crc, rank = [], [], [], [], [], [], []
                for i, text in enumerate(rows.column(text_col).to_pylist()):
                    tokens = np.append(bpe.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                        data = tokens[s:s + n].tobytes()
                        of.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        ids.append(data)
                        crc.append(zlib.crc32(data))
                        rank.append(seen[n])
                        seen[n] += 1
                out = rows.select(columns).take(pa.array(of, pa.int64()))
                for name, values, kind in (("piece", piece, pa.int32()), ("start", start, pa.int64()),
                                           ("length", length, pa.int64()), ("ids", ids, pa.binary()),
                                           ("ids_crc32", crc, pa.int64()), ("_pk_rank", rank, pa.int64()),
                                           ("_pk_part", [part] * len(of), pa.int32())):
                    if name in names:
                        out = out.append_column(name, pa.array(values, kind))
                yield out
    return run


RESULT = ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


PIECE = (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("ids_crc32", "long"),
         ("_pk_rank", "long"), ("_pk_part", "integer"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, text_col: str, columns: list[str],
                 results: tuple[str, ...] = RESULT) -> DataFrame:
    """One row per piece: ``columns`` and, of PIECE, what ``results`` and the packing need."""
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])])
    schema = src.select(*[F.col(f"`{c}`") for c in columns]).schema
    wanted = tuple(n for n, _ in PIECE if n in results or n in ("length", "_pk_rank", "_pk_part"))
    for name, kind in PIECE:
        if name in wanted:
            schema = schema.add(name, kind)
    return src.mapInArrow(_tokenise(tokenizer, capacity, text_col, columns, wanted), schema)


# --- plan ------------------------------------------------------------------

class CapacityTree:
    """Segment tree over remaining capacities; finds the tightest open one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The smallest open capacity >= need, or -1."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first piece, pieces, first bin, pieces a bin, offset) of
    best-fit decreasing. Bins b, b+1, ... of a run take ``pieces a bin``
    consecutive pieces each, from ``offset`` on."""
    tree, rooms = CapacityTree(capacity), {}
    plan, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        at, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:        # open new bins for all that is left
                each = capacity // length
                full, rest = divmod(left, each)
                for n, per in ((full, each), (1, rest)):
                    if n and per:
                        plan.append((length, at, n * per, bins, per, 0))
                        put(capacity - per * length, bins, n)
                        bins, at = bins + n, at + n * per
                break
            first, n = rooms[room].pop()
            if not rooms[room]:
                tree.set(room, False)
            # best fit puts the next piece into the bin it has just used while that has room
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, at, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                at, left = at + full * each, left - full * each
            rest = left if full < n and left < each else 0
            if rest:
                plan.append((length, at, rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                at, left = at + rest, 0
            used = full + (1 if rest else 0)
            put(room, first + used, n - used)
    return np.array(plan, np.int64).reshape(-1, 6)


def _assign(plan, capacity: int, columns: list[str]):
    """Piece number within its length -> sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        runs = runs[order]
        span = np.int64(1) << np.int64(44)
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_pk_number").to_numpy()
            r = runs[np.searchsorted(keys, length * span + number, side="right") - 1]
            within = number - r[:, 1]
            out = batch.select(columns)
            out = out.append_column("sequence_id", pa.array(r[:, 3] + within // r[:, 4]))
            yield out.append_column("offset", pa.array(r[:, 5] + (within % r[:, 4]) * length))
    return run


# --- the operator ----------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, text_col: str = "text",
         columns: list[str] | None = None, results: tuple[str, ...] = RESULT) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    tokenizer: path of a byte-level BPE in ``tokenizers`` JSON format, at the
    same place on every executor. A document is its ids followed by id 0; a
    null or empty text is that one id. Documents over ``capacity`` are cut
    into pieces of that size, of which the first may be shorter.

    Returns one row per piece: ``columns`` of ``docs`` (all, by default) and,
    of RESULT, those in ``results``: piece (from 0), start (ids of the
    document before it), length, ids (little-endian unsigned 32-bit),
    ids_crc32, sequence_id (0 .. number of sequences - 1) and offset; pieces
    of a sequence lie gapless from 0. Every row is packed, also repeated rows
    and null ids; an empty table gives an empty one. Input columns named like
    a result are replaced. The packing is that of one best-fit-decreasing run
    over the whole table; which of several pieces of equal length goes where
    follows the input's partitions.
    """
    keep = [c for c in (columns or docs.columns) if c not in RESULT]
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    pieces = store(token_pieces(src, tokenizer, capacity, text_col, keep, results), "pieces")
    counts = store(pieces.groupBy("length", "_pk_part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_pk_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_pk_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pk_start"))
    own = [c for c in results if c not in ("sequence_id", "offset")]
    need = list(dict.fromkeys([*keep, *own, "length"]))
    numbered = (pieces.join(starts, ["length", "_pk_part"])
                .select(*[F.col(f"`{c}`") for c in need],
                        (F.col("_pk_start") + F.col("_pk_rank")).alias("_pk_number")))
    schema = numbered.select(*[F.col(f"`{c}`") for c in need]).schema.add("sequence_id", "long").add("offset", "long")
    placed = numbered.mapInArrow(_assign(plan, capacity, need), schema)
    return placed.select(*[F.col(f"`{c}`") for c in [*keep, *results]])
