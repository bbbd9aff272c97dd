"""Mixing sources to target weights by Pareto order sampling.

Built from DataFrame functions only. Each source gets a target number of
words; a document's expected number of copies is target / source size. The
whole part of it is given to every document of the source. For the rest, pi,
documents are ranked by the ratio of their random odds to their inclusion
odds, (u / (1 - u)) / (pi / (1 - pi)), and the first of that order are taken
until the words still missing are reached (Pareto order sampling of fixed
size, the size being counted in words).

The order is never built as a whole: the rank value is mapped to (0, 1), words
are summed per (source, one of 4096 slots), the slot in which a source
reaches its size is cut into 4096 again, and only the documents in that last
slot are put in order. A source that holds most rows is thus spread over all
tasks; what a source's window sees is 4096 sums, and about one document in 16
million.

Documents that share id and source share their draw. If such a group crosses
the line, its documents are ordered by a second draw, from id and text, in the
same way; rows that are equal in both are numbered and taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.session import store

SLOTS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column) -> Column:
    """Uniform number in (0, 1) from the first 13 hex digits of md5(key)."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def second_draw(key: Column, text: Column) -> Column:
    """Uniform number in (0, 1) from a document's id and text."""
    return draw(F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("null")), text.isNull().cast("string"),
                            F.xxhash64(text).cast("string")))


def lean(size: Column, mean: Column) -> Column:
    """Factor of a document's inclusion odds: 1 at its source's mean size, 0 without words."""
    return F.when(mean > 0, F.sqrt(size.cast("double") / mean)).otherwise(F.lit(1.0))


def pareto_rank(u: Column, pi: Column, factor: Column) -> Column:
    """Odds ratio q = (u/(1-u)) / (factor * pi/(1-pi)) mapped to (0, 1] by q / (1 + q)."""
    a, b = u * (F.lit(1.0) - pi), pi * factor * (F.lit(1.0) - u)
    return F.when(pi > 0, a / (a + b)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """Targets per source from (source, source_size, documents).

    Sources in code point order, null last, take the weights in turn. They
    share ``share`` times the size of all; no target exceeds ``max_copies``
    times its source, and what a source cannot take goes to the others by
    weight: target = min(level * weight, cap) with the level that spends all.
    Adds mean (words a document), target, whole (copies of every document) and pi. The
    windows run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.array(*[F.lit(x).cast("double") for x in weights])
    x = (sizes.withColumn("weight", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
         .withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_copies)))
         .withColumn("budget", F.sum("source_size").over(every).cast("double") * F.lit(float(share))))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    x = (x.withColumn("cap_before", F.coalesce(
            F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left")))
    # sources are full up to the first whose cap is not below the level
    x = x.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    target = F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("cap")), F.col("cap"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (x.withColumn("target", target)
            .withColumn("whole", F.floor(ratio).cast("long"))
            .withColumn("pi", ratio - F.floor(ratio))
            .select("source", "source_size", (F.col("source_size").cast("double") / F.col("documents").cast("double"))
                    .alias("mean"), "target", "whole", "pi",
                    (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")))


def _first_over(sums: DataFrame, by: str) -> DataFrame:
    """Per source: the first ``by`` whose running words pass ``rest``."""
    run = Window.partitionBy("sid").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    x = sums.withColumn("before", F.col("done") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    over = x.filter(F.col("before") + F.col("words") > F.col("rest"))
    return over.groupBy("sid").agg(F.min(F.struct(by, "before", "words", "rest")).alias("f")).select("sid", "f.*")


def _crossing(docs: DataFrame) -> DataFrame:
    """(sid, z, before, words, rest): per source, the z whose words cross
    ``rest``, and the words before it.

    docs: (sid, z, size, rest, done), done being the words before all of them.
    A source that takes all has no row."""
    slot = F.floor(F.col("z") * SLOTS).cast("int")
    fine = F.floor(F.col("z") * SLOTS * SLOTS).cast("long")
    words = (F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    first = _first_over(docs.groupBy("sid", slot.alias("slot")).agg(*words), "slot").select(
        "sid", "slot", F.col("before").alias("done"))
    inside = docs.drop("done").withColumn("slot", slot).join(first, ["sid", "slot"]).withColumn("fine", fine)
    second = _first_over(inside.groupBy("sid", "fine").agg(*words), "fine").select(
        "sid", "fine", F.col("before").alias("done"))
    return _first_over(inside.drop("done").join(second, ["sid", "fine"]).groupBy("sid", "z").agg(*words), "z")


def _cuts(docs: DataFrame) -> DataFrame:
    """(sid, cut, cut_v, n, some): documents of the source with (z, v) <
    (cut, cut_v) get one more copy, and ``some`` of the ``n`` at the cut.

    docs: (sid, z, v, size, rest). A source that takes all has no row."""
    cut = store(_crossing(docs.drop("v").withColumn("done", F.lit(0))).select(
        "sid", F.col("z").alias("cut"), F.col("before").alias("done")), "cut")
    tied = docs.join(cut, "sid").filter(F.col("z") == F.col("cut")).select(
        "sid", F.col("v").alias("z"), "size", "rest", "done")
    cut_v = store(_crossing(tied).withColumnRenamed("z", "cut_v"), "cut-v")
    n = (tied.select("sid", F.col("z").alias("cut_v")).join(cut_v.select("sid", "cut_v"), ["sid", "cut_v"])
         .groupBy("sid").agg(F.count("*").alias("n")))
    x = cut.drop("done").join(cut_v, "sid").join(n, "sid").withColumn("each", F.col("words") / F.col("n"))
    x = x.withColumn("whole", F.least(F.floor((F.col("rest") - F.col("before")) / F.col("each")), F.col("n") - 1))
    x = x.withColumn("before", F.col("before") + F.col("whole") * F.col("each"))
    # the document that crosses the line is taken if that ends nearer to it
    near = F.col("before") + F.col("each") - F.col("rest") <= F.col("rest") - F.col("before")
    return x.select("sid", "cut", "cut_v", "n", (F.col("whole") + near.cast("int")).alias("some"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of every source from 1, in column _mx_number.

    Rows keep the task that stored them; a window sees one task's rows of a
    source, or one count per task."""
    rows = store(rows.withColumn("_mx_row", F.monotonically_increasing_id()), "tied").withColumn(
        "_mx_task", F.shiftright("_mx_row", 33))
    run = Window.partitionBy("_mx_source").orderBy("_mx_task").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("_mx_source", "_mx_task").agg(F.count("*").alias("_mx_n"))
              .withColumn("_mx_before", F.coalesce(F.sum("_mx_n").over(run), F.lit(0)))
              .select(F.col("_mx_source").alias("_mx_s"), F.col("_mx_task").alias("_mx_t"), "_mx_before"))
    at = Window.partitionBy("_mx_source", "_mx_task").orderBy("_mx_row")
    return (rows.withColumn("_mx_number", F.row_number().over(at))
            .join(before, F.col("_mx_source").eqNullSafe(F.col("_mx_s")) & (F.col("_mx_task") == F.col("_mx_t")))
            .withColumn("_mx_number", F.col("_mx_number") + F.col("_mx_before")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often each document is taken, so that sources meet their targets.

    A document's size is its number of words (null text: 0). Sources in code
    point order, null last as a source of its own, take ``weights`` in turn
    and share ``share`` times the size of all documents; a target stops at
    ``max_copies`` times its source's size and the excess is shared again.

    Returns all columns of ``docs`` (replacing columns of these names) plus
    size, source_size, target (double, its source's), copies (int, 0 ..
    max_copies) and taken = copies * size, as longs. A source's taken words
    end within half a document of its target. The draw of a document is a
    hash of ``id_col`` (null ids share one draw), then one of id and text:
    reruns agree but for which of several rows with equal id, source and
    text are taken. Sources whose documents
    are all empty have target 0; an empty table gives an empty one. A text of any length
    is only counted and hashed, in one task.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in added]
    src = F.col(f"`{source_col}`")
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    narrow = store(docs.select(src.alias("source"), draw(key).alias("u"), second_draw(key, text).alias("v"),
                               word_count(text).alias("size")), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    targets = store(source_targets(sizes, weights, share, max_copies)
                    .withColumn("sid", F.row_number().over(order)), "targets")
    ranked = (narrow.join(targets.filter("pi > 0 and rest > 0"), narrow["source"].eqNullSafe(targets["source"]))
              .select("sid", pareto_rank(F.col("u"), F.col("pi"), lean(F.col("size"), F.col("mean"))).alias("z"), "v", "size",
                      "rest"))
    cuts = _cuts(ranked)
    per_source = store(targets.join(cuts, "sid", "left").select(
        F.col("source").alias("_mx_source"), F.col("source_size").alias("_mx_size"),
        F.col("target").alias("_mx_target"), *[F.col(c).alias(f"_mx_{c}") for c in
                                               ("mean", "whole", "pi", "rest", "cut", "cut_v", "n", "some")]), "mix")
    z = pareto_rank(draw(key), F.col("_mx_pi"), lean(F.col("_mx_words"), F.col("_mx_mean")))
    v = second_draw(key, text)
    more = (F.col("_mx_pi") > 0) & (F.col("_mx_rest") > 0)
    at_cut = F.coalesce(more & (z == F.col("_mx_cut")) & (v == F.col("_mx_cut_v")), F.lit(False))
    one_more = more & (F.col("_mx_cut").isNull() | (z < F.col("_mx_cut")) | (
        (z == F.col("_mx_cut")) & ((v < F.col("_mx_cut_v")) | (at_cut & (F.col("_mx_some") == F.col("_mx_n"))))))
    part = (F.col("_mx_some") > 0) & (F.col("_mx_some") < F.col("_mx_n"))
    base = docs.select(*[F.col(f"`{c}`") for c in keep], word_count(text).alias("_mx_words")).join(per_source, src.eqNullSafe(F.col("_mx_source")))

    def result(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("_mx_words").alias("size"),
                           F.col("_mx_size").alias("source_size"), F.col("_mx_target").alias("target"),
                           (F.col("_mx_whole") + F.when(extra, 1).otherwise(0)).cast("int").alias("copies")) \
            .withColumn("taken", F.col("copies") * F.col("size"))

    if per_source.filter(part).isEmpty():
        return result(base, one_more)
    split = at_cut & F.coalesce(part, F.lit(False))
    return result(base.filter(~split), one_more).unionByName(
        result(_numbered(base.filter(split)), F.col("_mx_number") <= F.col("_mx_some")))
