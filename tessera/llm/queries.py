"""The queries of this subpackage: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import collocations, ctw, embedding_dedup, html_density, mixing, packing, pii, quality_cnn, simhash_dedup, url_filter, vector_packing, whitening, winnowing
from .shared import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.winnow(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))


def of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", partial(of_kind, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cnn.quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return out.select("doc_id", "copy", "copies", "lang", "source", "order_key", F.round("rate", 6).alias("rate"), "n_chars", F.md5("text").alias("text_md5"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.vector_bins(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_document_fingerprints, op3_lm_scoring, op4_url_filter, op5_best_fit_packing, op6_pii, op7_html_extraction, op8_quality_classifier, op9_source_mixing, op10_simhash_near_dedup, op11_embedding_whitening, op12_phrase_collocations, op13_vector_bin_packing, pipeline)
}

#: Cosine and links for all pairs, the reachable set by recursion: the plain reading of op1's contract.
OP1_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""

OP9_SQL = f"""
WITH weights(source, w) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in mixing.SOURCE_WEIGHTS.items())}),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
named AS (SELECT s.source, n, w, CASE WHEN w IS NULL THEN n::DOUBLE ** {mixing.EXPONENT} END AS part FROM sizes s LEFT JOIN weights USING (source)),
shares AS (SELECT source, n, coalesce(w, part * greatest(0, 1 - coalesce(sum(w) OVER (), 0)) / sum(part) OVER ()) AS w FROM named),
rates AS (SELECT source, (sum(n) OVER ())::DOUBLE * w / sum(w) OVER () / n AS rate FROM shares),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + {mixing.TAIL} * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS p FROM ks),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
drawn AS (SELECT *, (('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.c < d.u) AS copies
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
SELECT doc_id, copy::INT AS copy, copies::INT AS copies, lang, source,
       md5('{mixing.SEED}:order:' || doc_id || ':' || copy) AS order_key, round(rate, 6) AS rate, n_chars, md5(text) AS text_md5
FROM counted, LATERAL (SELECT unnest(range(0, copies)) AS copy)
"""

#: Every run of one to three words as a phrase; phrases cut by their words, in whole numbers of 128 bits.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 10),
parted AS MATERIALIZED (SELECT lang, phrase, k AS words, j AS cut, f AS a, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 : k], ' ') AS y FROM f, (VALUES (1), (2)) t(j) WHERE j < k),
cuts AS (
  SELECT c.lang, c.phrase, words, cut, a, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parted c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(ws[1 : 2], ' ') AS phrase, f FROM f WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2 : 3], ' '), f FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM least c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase AND c.words = 2 WHERE o.f IS NULL OR 100 * o.f < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op12_phrase_collocations": OP12_SQL, "op1_embedding_near_dedup": OP1_SQL, "op9_source_mixing": OP9_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
