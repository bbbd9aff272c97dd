"""Audit of how document filters interact.

Method: every part's documents are counted into a contingency tensor with one
axis of length two (pass, fail) per filter. Whatever an order of the filters
does at a step is a contraction of that tensor: along each axis a selector picks
pass, fail or all, and one ``einsum`` contracts the selectors of every step of
every order at once. The corpus is read once; what the contractions see is at
most 2**filters numbers per part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.session import store

MAX_FILTERS = 6     # n! orders: 720 at six
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
FACTS = ("n", "good", "toxic")


# --- the five filters -------------------------------------------------------

def text_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) per row; null text and part are empty.

    A: under 100 words; B: distinct words under 80 % of the words; C: A-Z over
    10 % of the code points; D: holds one of #$%&*|. An empty text fails A only."""
    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                    F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    x = x.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    words, kinds = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    length = F.length("text").cast("long")
    capitals = length - F.length(F.translate("text", UPPER, ""))
    return x.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                    (words < 100).alias("A"), (100 * kinds < 80 * words).alias("B"),
                    (100 * capitals > 10 * length).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"))


def with_copies(facts: DataFrame) -> DataFrame:
    """Add E: the digest also belongs to a row with a smaller doc_id.

    The first id of each digest is found by partial minima and joined back by
    (doc_id, digest), so a text that a third of all rows share meets no join on
    the text. Rows without an id precede nothing and follow nothing."""
    first = store(facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
                  .withColumn("leads", F.lit(True)), "firsts")
    return (facts.join(first, ["doc_id", "digest"], "left")
            .withColumn("E", F.col("doc_id").isNotNull() & F.col("leads").isNull()).drop("leads"))


def labelled(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``facts`` whose id is labelled good or toxic, with those flags.

    labels: doc_id, quality, toxic; of repeated ids any 1 counts."""
    marks = (labels.filter("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic"))
    return facts.join(store(marks, "marks"), "doc_id")


# --- tensors and contractions -----------------------------------------------

def _mask(filters: Sequence[str]) -> Column:
    """Cell of the tensor: the first filter is the highest bit (axis 0)."""
    bits = [F.when(F.col(f"`{f}`"), F.lit(1 << (len(filters) - 1 - i))).otherwise(F.lit(0))
            for i, f in enumerate(filters)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total.cast("int")


def contingency(facts: DataFrame, marked: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and combination of failures."""
    zero = F.lit(0).cast("long")
    all_rows = facts.groupBy("part", _mask(filters).alias("cell")).agg(F.count("*").alias("n"))
    good = marked.groupBy("part", _mask(filters).alias("cell")).agg(
        F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    both = (all_rows.select("part", "cell", "n", zero.alias("good"), zero.alias("toxic"))
            .unionByName(good.select("part", "cell", zero.alias("n"), "good", "toxic")))
    return both.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in FACTS])


def steps_of(filters: Sequence[str]) -> list[tuple[str, int, int]]:
    """(order, step from 1, filter's axis) of every step of every order."""
    orders = permutations(range(len(filters)))
    return [("".join(filters[i] for i in o), s + 1, o[s]) for o in orders for s in range(len(filters))]


def selectors(filters: Sequence[str]) -> dict[str, np.ndarray]:
    """steps x axes x 2: what each reported count picks along each axis."""
    n, kept, removed, fails, unique = len(filters), [], [], [], []
    for order in permutations(range(n)):
        for s, f in enumerate(order):
            before = [PASS if i in order[:s] else ALL for i in range(n)]
            at = lambda rest, own: [own if i == f else rest[i] for i in range(n)]
            kept.append(at(before, PASS))
            removed.append(at(before, FAIL))
            fails.append(at([ALL] * n, FAIL))
            unique.append(at([PASS] * n, FAIL))
    return {k: np.array(v, np.int64) for k, v in
            (("kept", kept), ("removed", removed), ("fails", fails), ("unique", unique))}


def contract(tensors: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """tensors (facts, 2, 2, ...), picks (steps, axes, 2) -> facts x steps, exact in 64 bits."""
    n = picks.shape[1]
    operands: list = [tensors, [0, *range(2, n + 2)]]
    for axis in range(n):
        operands += [picks[:, axis], [1, axis + 2]]
    return np.einsum(*operands, [0, 1])


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def _report(filters: tuple[str, ...]):
    steps, picks = steps_of(filters), selectors(filters)
    axis = np.array([f for _, _, f in steps])
    shape = (len(FACTS),) + (2,) * len(filters)

    def report(table: pa.Table) -> pa.Table:
        flat = np.zeros((len(FACTS), 2 ** len(filters)), np.int64)
        cell = table["cell"].to_numpy()
        for i, c in enumerate(FACTS):
            flat[i, cell] = table[c].to_numpy()
        tensors = flat.reshape(shape)
        removed = contract(tensors, picks["removed"])
        shapley = np.zeros(len(filters), np.int64)
        np.add.at(shapley, axis, removed[0])
        counts = {"kept": contract(tensors, picks["kept"])[0], "removed": removed[0],
                  "redundant": contract(tensors, picks["fails"])[0] - removed[0],
                  "unique_fails": contract(tensors, picks["unique"])[0],
                  "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[axis]}
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(steps), pa.string()),
                         "filter_order": pa.array([s[0] for s in steps], pa.string()),
                         "step": pa.array([s[1] for s in steps], pa.int32()),
                         **{k: pa.array(v, pa.int64()) for k, v in counts.items()}})
    return report


def audit_filters(facts: DataFrame, marked: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """What each filter does at each step of every order of ``filters``, per part.

    facts: one row per document with ``part`` (a string) and a boolean column per
    filter, true where the document fails it (null: passes); filter names are one
    letter each, at most six. marked: the rows of ``facts`` that are labelled, with
    booleans ``good`` and ``toxic``. Further columns are ignored.

    Per part, order and step (1 to n; its filter is that letter of the order), zeros
    included: kept (documents left after the step), removed (failing here), redundant
    (failing this filter but removed earlier), unique_fails (failing this filter only),
    good_lost and toxic_lost (removed here, so labelled), shapley (this filter's
    removed, summed over all orders at any step). No documents give no rows. Repeated
    rows count as documents of their own; text length and ties do not matter here."""
    filters = tuple(filters)
    if not 1 <= len(filters) <= MAX_FILTERS or len(set(filters)) != len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError(f"one to {MAX_FILTERS} different one-letter filters, not {filters}")
    return contingency(facts, marked, filters).groupBy("part").applyInArrow(_report(filters), RESULT)


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``audit_filters`` over the filters A to E of ``text_facts`` and ``with_copies``.

    docs: doc_id, text and ``part``; labels: doc_id, quality, toxic. Null text is the
    empty text and null part the empty string. Identical texts (SHA-256) fail E but for
    the rows with the smallest id; rows with a null id pass it. Texts are read once and
    only flags are stored, so a very long text costs its own length in one task. Extra
    columns are ignored; no documents give no rows, no labels give zero losses."""
    facts = store(text_facts(docs, part=part), "text-facts")
    facts = store(with_copies(facts).drop("digest"), "facts")
    return audit_filters(facts, labelled(facts, labels))
