"""Corpus pipeline: from raw documents to packed training sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Every
stage works on all that its predecessor kept; duplicated rows (a document that
the mix takes twice) stay duplicated.

In every stage a null text counts as the empty one, null ids, languages and sources
are values like any other, an empty table gives an empty one, and columns besides
COLUMNS are dropped before anything else, so their names cannot clash. A text of any
length is worked on whole. What a stage does with repeated rows and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm.line_dedup import dedup_lines
from geotrail.llm.mixing import mix_sources
from geotrail.llm.packing import pack
from geotrail.llm.registry import table
from geotrail.llm.simhash import simhash_groups
from geotrail.llm.text_queries import tokenizer_path
from geotrail.llm.toxicity import score_toxicity, train
from geotrail.session import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 and more go. A score depends on the text alone: repeated rows
    go or stay together. Without labels all texts score alike, and stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select(*COLUMNS), model, threshold=0.7, spans=False)
    return scored.filter("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents and more go; n_chars follows the text. Every row is a
    document, so rows repeated ten times lose all their lines; a null text becomes ''."""
    kept = dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays, once. Of several rows
    with that id the one with the smallest fingerprint stays, of equal ones any; a group
    of null ids is led by its smallest fingerprint. Empty texts are a group too."""
    groups = simhash_groups(docs.select(*COLUMNS), words=4, radius=4)
    # only copies of a group's leading row are left, and those share its fingerprint
    return groups.filter("leads").dropDuplicates(["fingerprint"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as repeated rows. Rows that share id and
    source are split at the target by a second draw, equal ones by number."""
    mixed = mix_sources(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, max_copies=2)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").withColumn("copy", copies).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece. Every row is packed, the empty
    text as its end token; which of several pieces of one length goes where follows the
    input's partitions."""
    return pack(docs, tokenizer_path(), capacity=2048, columns=["doc_id"],
                results=("piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix),
          ("packing", packing)]

# a fitted model, hashes and token ids have no SQL form: tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
