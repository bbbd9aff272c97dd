"""Queries over ``documents`` (operators 1, 2, 3, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.llm.line_dedup import dedup_lines
from geotrail.llm.mixing import mix_sources
from geotrail.llm.packing import pack
from geotrail.llm.registry import query, table
from geotrail.llm.simhash import fingerprint_hex, simhash_groups
from geotrail.llm.toxicity import held_out, score_toxicity, train

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_line_dedup", r"""
WITH lines AS (
  SELECT rid, doc_id, i, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id,
                     string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
flagged AS (SELECT l.*, f.k IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY rid""")
def op1_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


# XXH64, the shingles' hash, has no DuckDB function: tested against brute force
@query("op6_simhash")
def op6_simhash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = simhash_groups(docs, words=4, radius=4, columns=["doc_id"])
    return out.select("doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


# a fitted model has no SQL form: tested by held-out accuracy and against brute force
@query("op2_toxicity")
def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return (score_toxicity(docs, model, threshold=0.7, columns=["doc_id"])
            .withColumn("held_out", held_out(F.col("doc_id"))).withColumn("offsets", offsets)
            .select("doc_id", "held_out", "score", "predicted", "offsets"))


# token ids have no SQL form: tested against brute force and by round trip
@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path(), capacity=2048, columns=["doc_id"],
                results=("piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


@query("op4_mix_sources", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS documents FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]
             [1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight,
      source_size::DOUBLE * 2.0::DOUBLE AS cap,
      (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, documents, least((SELECT level FROM f) * weight, cap) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM t),
p AS (SELECT source, source_size, source_size::DOUBLE / documents::DOUBLE AS mean, target, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS pi,
             target - (floor(ratio)::BIGINT * source_size)::DOUBLE AS rest FROM r),
o AS (SELECT d.*, p.source_size, p.target, p.whole, p.pi, p.rest,
             CASE WHEN p.mean > 0 THEN sqrt(d.size::DOUBLE / p.mean) ELSE 1.0::DOUBLE END AS lean
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
z AS (SELECT *, CASE WHEN pi > 0 THEN (u * (1.0::DOUBLE - pi))
                / ((u * (1.0::DOUBLE - pi)) + (pi * lean * (1.0::DOUBLE - u))) ELSE 1.0::DOUBLE END AS z FROM o),
g AS (SELECT source, z, sum(size)::BIGINT AS words, any_value(rest) AS rest FROM z
      WHERE pi > 0 AND rest > 0 GROUP BY source, z),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY z
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g),
k AS (SELECT source, min(z) AS cut, arg_min(before + words - rest <= rest - before, z) AS with_cut
      FROM c WHERE before + words > rest GROUP BY source)
SELECT z.doc_id, z.size, z.source_size::BIGINT AS source_size, z.target,
       (z.size * (z.whole + CASE WHEN z.pi > 0 AND z.rest > 0 AND (k.cut IS NULL OR z.z < k.cut
          OR (k.with_cut AND z.z = k.cut)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z LEFT JOIN k ON z.source IS NOT DISTINCT FROM k.source""")
def op4_mix_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    out = mix_sources(docs, weights=(3, 1, 2), share=1.5, max_copies=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")
