"""Queries over ``documents`` that describe the corpus (operators 11 to 13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotrail.llm.collocations import collocations
from geotrail.llm.filter_audit import audit_documents
from geotrail.llm.registry import query, table
from geotrail.llm.secrets import find_secrets, span_count, span_list
from geotrail.llm.text_queries import tokenizer_path

SECRET_VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op11_filter_audit", r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals FROM t),
m AS (SELECT min(doc_id) AS first_id, text FROM t GROUP BY text),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT w.rid, w.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * capitals > 10 * length(w.text),
          regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > m.first_id, false)] AS f
  FROM w JOIN m ON m.text = w.text LEFT JOIN lab ON lab.doc_id = w.doc_id),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f),
letters(l, k) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
hit AS (
  SELECT c.part, s.filter_order, s.step, s.o[s.step] AS own, c.n, c.good, c.toxic, c.f[s.o[s.step]] AS fails,
         len(list_filter(s.o[1:s.step - 1], lambda k: c.f[k])) > 0 AS gone,
         len(list_filter(c.f, lambda b: b)) AS failures
  FROM cells c, steps s),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""")
def op11_filter_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return audit_documents(docs, table(spark, sf, "labels"))


@query("op12_collocations", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w
           FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) AS p FROM d)),
grams AS (
  SELECT lang, s AS words, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i
        FROM (SELECT lang, w, unnest([1, 2, 3]) AS s FROM pieces) WHERE len(w) >= s)),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY lang, words, phrase),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, fx.n AS l, fy.n AS r,
         (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (fx.n::HUGEINT * fy.n::HUGEINT) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = cuts.x
  JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = cuts.y),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored)
         WHERE o = 1),
around AS (SELECT lang, p AS phrase, max(a) AS a FROM (
             SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM c WHERE words = 3)
           GROUP BY lang, p),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
  FROM best LEFT JOIN around u ON u.lang = best.lang AND u.phrase = best.phrase
  WHERE coalesce(100 * u.a < 50 * best.a, true))
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r,
       t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000""")
def op12_collocations(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang")
    return collocations(docs, max_words=3, min_count=10, percent=50, top=2000)


# token counts have no SQL form: tested against brute force
@query("op13_secret_scan")
def op13_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = find_secrets(docs, tokenizer_path(SECRET_VOCABULARY), columns=["doc_id"])
    base = F.col("base_spans")
    return out.select("doc_id", *[span_count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
