"""Queries on text, identifiers and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluate, search
from ..operators.shared import small, stored
from ..sources import derived
from ..sources.derived import STAR, table
from .registry import query


def quoted(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({quoted(T.STOP_WORDS)})))"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_answer(x: str) -> str:
    return f"(CASE WHEN split_part({sql_norm(x)}, ' ', 1) IN ({quoted(T.YES)}) THEN '1' WHEN split_part({sql_norm(x)}, ' ', 1) IN ({quoted(T.NO)}) THEN '0' ELSE {sql_norm(x)} END)"


def sql_strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '(?i)\\s*-\\s*(Season|Episode|Series|Vol\\.?|Volume|Part)\\s+\\S+\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_boost(q: str, r: str) -> str:
    hits = [(f"list_has_any({q}, [{quoted(a.split())}])", f"list_has_any({r}, [{quoted(b.split())}])") for a, b in T.RELATION_HINTS]
    product = " * ".join(f"(CASE WHEN {a} AND {b} THEN 4.0::DOUBLE ELSE 1.0 END)" for a, b in hits)
    return f"({product} * (CASE WHEN ({' OR '.join(a for a, _ in hits)}) AND NOT ({' OR '.join(b for _, b in hits)}) THEN 0.5::DOUBLE ELSE 1.0 END))"


def sql_hash_vector(x: str) -> str:
    tokens = f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> '')"
    return "[" + ", ".join(f"coalesce(list_sum(list_transform({tokens}, lambda t: ('0x' || substr(md5(t), {2 * k + 1}, 2))::BIGINT)), 0)::DOUBLE" for k in range(16)) + "]"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    """B-1."""
    t = table(spark, d, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("tokens_md5"))


QUESTION = "where was the person born and what language do people speak in the capital of the country"


@query(f"""WITH q AS (SELECT {sql_tokens(f"'{QUESTION}'")} AS q), {STAR}, r AS (SELECT DISTINCT r FROM star), t AS (SELECT i.item_id, r.r, {sql_tokens('i.text')} AS a, {sql_tokens('r.r')} AS b FROM benchmark i, r)
SELECT item_id, r, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END, 6) AS overlap FROM t""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """B-2, B-3: questions against the relations of the graph (a handful)."""
    relations = stored(derived.star_kg(spark, d).select("r").distinct())
    items = table(spark, d, "benchmark").select("item_id", T.content_tokens(F.col("text")).alias("a"))
    met = items.crossJoin(small(relations))
    return met.select("item_id", "r", F.round(T.overlap(F.col("a"), T.relation_tokens(F.col("r"))), 6).alias("overlap"))


@query(f"""WITH {STAR}, r AS (SELECT DISTINCT r FROM star UNION SELECT 'location.place_of_birth' UNION SELECT 'government.head_of_state' UNION SELECT 'common.language_spoken'),
q(q) AS (VALUES ('{QUESTION}'), ('which brand made it'), ('who is the president')), t AS (SELECT q, r, {sql_tokens('q')} AS a, {sql_tokens('r')} AS b FROM q, r)
SELECT q AS question, r AS relation, {sql_boost('a', 'b')} AS boost FROM t""")
def question_relation_boost(spark: SparkSession, d: str) -> DataFrame:
    """B-14: a few questions against the relations of the graph and of a public schema."""
    relations = derived.star_kg(spark, d).select("r").distinct().union(spark.createDataFrame([("location.place_of_birth",), ("government.head_of_state",), ("common.language_spoken",)], "r string"))
    questions = spark.createDataFrame([(QUESTION,), ("which brand made it",), ("who is the president",)], "q string")
    met = relations.join(F.broadcast(questions), F.lit(True))
    return met.select(F.col("q").alias("question"), F.col("r").alias("relation"), T.relation_boost(T.content_tokens(F.col("q")), T.relation_tokens(F.col("r"))).alias("boost"))


@query(f"WITH t AS (SELECT item_id, {sql_hash_vector('text')} AS v FROM benchmark) SELECT item_id, array_to_string(list_transform(v, lambda x: printf('%.6f', x / sqrt(list_dot_product(v, v)))), ' ') AS vector FROM t")
def hash_encode(spark: SparkSession, d: str) -> DataFrame:
    """B-8: the first 16 dimensions; the others are 0."""
    v = table(spark, d, "benchmark").select("item_id", T.hash_vector(F.col("text")).alias("v"))
    return v.select("item_id", F.array_join(F.transform(F.slice("v", 1, 16), lambda x: F.format_string("%.6f", x)), " ").alias("vector"))


@query(f"WITH t AS (SELECT doc_id, {sql_hash_vector('text')} AS v FROM documents) SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS v1, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS v16 FROM t")
def encode_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """B-9: each distinct text is encoded once, by a function that the caller gives."""
    import hashlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * 16
            for token in t.lower().split():
                for k, b in enumerate(hashlib.md5(token.encode()).digest()):
                    v[k] += b
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size if size else 0.0 for x in v])
        return out

    v = search.encode_distinct(table(spark, d, "documents").select("doc_id", "text"), "text", encode)
    return v.select("doc_id", F.round(F.col("vector")[0], 6).alias("v1"), F.round(F.col("vector")[15], 6).alias("v16"))


@query(f"WITH {STAR} SELECT r, count(*) AS n, min(s || ' ' || r || ' ' || o) AS first_plain, max('(' || s || ', ' || r || ', ' || o || ')') AS last_tuple, max('(' || s || ' | ' || r || ' | ' || o || ')') AS last_bars FROM star GROUP BY r")
def linearise_edges(spark: SparkSession, d: str) -> DataFrame:
    """B-11."""
    s, r, o = F.col("s"), F.col("r"), F.col("o")
    return derived.star_kg(spark, d).groupBy("r").agg(F.count("*").alias("n"), F.min(T.linearised(s, r, o)).alias("first_plain"), F.max(T.linearised(s, r, o, "tuple")).alias("last_tuple"), F.max(T.linearised(s, r, o, "bars")).alias("last_bars"))


@query(f"WITH {STAR} SELECT edge_id, round(1 / (1 + exp(-(conf + 0.7 * trust - 0.3 * (1 - exp(-age / 365.0))))), 6) AS score FROM star")
def provenance_score(spark: SparkSession, d: str) -> DataFrame:
    """B-4, B-5."""
    return derived.star_kg(spark, d).select("edge_id", F.round(V.provenance_score(F.col("conf"), F.col("trust"), F.col("age")), 6).alias("score"))


#: The first line of a document as the prediction, and what it is held against.
ANSWERS = "p AS (SELECT doc_id, split_part(text, chr(10), 1) AS pred, [split_part(text, chr(10), 2), split_part(text, chr(10), -1), source || ' (x)'] AS golds FROM documents)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    line = lambda k: F.split_part(F.col("text"), F.lit("\n"), F.lit(k))
    return table(spark, d, "documents").select("doc_id", line(1).alias("pred"), F.array(line(2), line(-1), F.concat("source", F.lit(" (x)"))).alias("golds"))


@query(f"WITH {ANSWERS} SELECT doc_id, len(list_filter(golds, lambda g: {sql_answer('g')} = {sql_answer('pred')})) > 0 AS em FROM p")
def norm_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """B-15, B-16."""
    return answers(spark, d).select("doc_id", (T.exact_match(F.col("pred"), F.col("golds")) == 1).alias("em"))


@query(f"""WITH {ANSWERS}, w AS (SELECT doc_id, unnest(golds) AS g0, pred FROM p), t AS (
  SELECT doc_id, list_filter(string_split({sql_answer('pred')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({sql_answer('g0')}, ' '), lambda x: x <> '') AS b FROM w),
f AS (SELECT doc_id, len(list_filter(a, lambda x: list_contains(b, x))) / nullif(len(a), 0)::DOUBLE AS p, len(list_filter(b, lambda x: list_contains(a, x))) / nullif(len(b), 0)::DOUBLE AS r FROM t)
SELECT doc_id, round(max(coalesce(CASE WHEN p > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 0)), 6) AS f1 FROM f GROUP BY doc_id""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """B-17."""
    return answers(spark, d).select("doc_id", F.round(T.token_f1(F.col("pred"), F.col("golds")), 6).alias("f1"))


def sql_relaxed(mode: str) -> str:
    n = (lambda x: sql_norm(sql_strip(x))) if mode in ("paren", "both") else sql_norm
    p, g = n("pred"), n("g")
    same = f"{p} = {g}"
    if mode in ("substring", "both"):
        same += f" OR (length({g}) >= 3 AND contains({p}, {g})) OR (length({p}) >= 3 AND contains({g}, {p}))"
    return f"(len(list_filter(golds, lambda g: {p} <> '' AND {g} <> '' AND ({same}))) > 0)::INT AS \"{mode}\""


RELAXED = f"SELECT doc_id, {', '.join(sql_relaxed(m) for m in T.MATCH_MODES)} FROM p"


@query(f"WITH {ANSWERS} {RELAXED}")
def relaxed_match(spark: SparkSession, d: str) -> DataFrame:
    """B-18, B-19."""
    return answers(spark, d).select("doc_id", *[T.relaxed_match(F.col("pred"), F.col("golds"), m).alias(m) for m in T.MATCH_MODES])


@query(f"WITH {ANSWERS}, m AS ({RELAXED}) SELECT source AS method, count(*) AS n, {', '.join(f'round(avg({chr(34)}{m}{chr(34)}), 6) AS {chr(34)}{m}{chr(34)}' for m in T.MATCH_MODES)}, round(avg(\"both\") - avg(strict), 6) AS gain FROM m JOIN documents USING (doc_id) GROUP BY source")
def relaxed_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """E-37."""
    gold = table(spark, d, "documents").select("doc_id", F.col("source").alias("method"))
    return evaluate.relaxed_accuracy(answers(spark, d).join(gold.hint("merge"), "doc_id"), "method")


@query(f"WITH {ANSWERS.replace('golds FROM', 'own FROM')}, p2 AS (SELECT doc_id, pred, CASE WHEN doc_id % 3 = 0 THEN [source, lang, split_part(text, chr(10), 1)] ELSE [own[2]] END AS golds FROM p JOIN documents USING (doc_id)), m AS ({RELAXED.replace('FROM p', 'FROM p2')}) SELECT count(*) AS n, {', '.join(f'round(avg({chr(34)}{m}{chr(34)}), 6) AS {chr(34)}{m}{chr(34)}' for m in T.MATCH_MODES)}, round(avg(\"both\") - avg(strict), 6) AS gain FROM m")
def gold_lists(spark: SparkSession, d: str) -> DataFrame:
    """D-12: lists of golds for some of the queries; the others are held against the gold of their own row."""
    docs = table(spark, d, "documents").where("doc_id % 3 = 0")
    lists = docs.select(F.col("doc_id").alias("qid"), F.array("source").alias("answer"), F.array("lang", "source", F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("all_answers"))
    rows = answers(spark, d).select(F.col("doc_id").alias("qid"), "pred", F.col("golds")[1].alias("gold"))
    return evaluate.relaxed_accuracy(evaluate.with_gold_lists(rows, lists))


@query("SELECT page_id, trim(replace(regexp_extract(trim(coalesce(url, '')), '[^/#]+$'), '_', ' ')) AS name, trim(replace(regexp_extract(trim(coalesce(url, '')), '[^/]+$'), '_', ' ')) AS tail FROM pages")
def uri_labels(spark: SparkSession, d: str) -> DataFrame:
    """A-6, B-20."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.uri_name(u).alias("name"), T.uri_name(u, "/").alias("tail"))


@query(f"""WITH {STAR}, e AS (SELECT s AS name FROM star UNION SELECT o FROM star UNION SELECT 'm.' || replace(s, ':', '_') FROM star)
SELECT name, regexp_matches(trim(name), '^[mg]\\.[0-9a-z_]+$') AS opaque, regexp_matches(name, '^(Q|P)[0-9]+$') AS code FROM e""")
def opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    """B-12: the entities of the graph, and subjects as identifiers."""
    kg = derived.star_kg(spark, d)
    e = kg.select(F.col("s").alias("name")).union(kg.select("o")).union(kg.select(F.concat(F.lit("m."), F.translate("s", ":", "_")))).distinct()
    return e.select("name", T.opaque(F.col("name")).alias("opaque"), T.opaque_code(F.col("name")).alias("code"))


@query(f"""WITH {STAR}, e AS (SELECT s AS name FROM star UNION SELECT o FROM star UNION SELECT 'm.' || replace(s, ':', '_') FROM star UNION SELECT p_name FROM part)
SELECT CASE WHEN name LIKE 'm.%' OR name LIKE 'g.%' THEN 'mid' WHEN contains(name, ' ') THEN 'surface_with_space' ELSE 'other' END AS style, count(*) AS n FROM e GROUP BY style""")
def id_style_counts(spark: SparkSession, d: str) -> DataFrame:
    """B-21, E-41."""
    kg = derived.star_kg(spark, d)
    e = kg.select(F.col("s").alias("name")).union(kg.select("o")).union(kg.select(F.concat(F.lit("m."), F.translate("s", ":", "_")))).union(table(spark, d, "part").select("p_name")).distinct()
    return e.groupBy(T.identifier_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


@query(f"""WITH {STAR}, r AS (SELECT DISTINCT r FROM star UNION SELECT '~common.topic.alias' UNION SELECT 'Type.Object.Name.x')
SELECT r, {' OR '.join(f"contains(lower(ltrim(r, '~')), '{x}')" for x in T.METADATA_FRAGMENTS)} AS metadata FROM r""")
def metadata_relations(spark: SparkSession, d: str) -> DataFrame:
    """B-13."""
    r = derived.star_kg(spark, d).select("r").distinct().union(spark.createDataFrame([("~common.topic.alias",), ("Type.Object.Name.x",)], "r string"))
    return r.select("r", T.metadata_relation(F.col("r")).alias("metadata"))


# ---------------------------------------------------------------- vectors

PROBES = "q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS cand, label, embedding::DOUBLE[] AS w FROM embeddings), sims AS (SELECT qid, cand, q.label AS ql, c.label AS cl, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 9) AS sim FROM q, c WHERE qid <> cand)"


def probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query vectors (ids divisible by 50), and all vectors as candidates; a vector is no candidate for itself."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), "embedding"), e.select(F.col("vec_id").alias("cand"), F.col("label").alias("cl"), "embedding")


@query(f"WITH {PROBES} SELECT qid, count(*) AS n, round(avg(sim), 6) AS mean, round(max(sim), 6) AS most, round(min((sim + 1) / 2), 6) AS least01 FROM sims GROUP BY qid")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """B-6, B-7, B-24."""
    s = search.similarity_stats(*probes(spark, d))
    return s.select("qid", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"), F.round(V.to_unit_interval(F.col("least")), 6).alias("least01"))


@query(f"WITH {PROBES}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cand) AS rank FROM sims WHERE sim > 0) SELECT qid, rank, cand, round(sim, 6) AS sim FROM k WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """F-1."""
    top = search.nearest(*probes(spark, d), 10, over=0.0, but_self=True)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "cand", F.round("sim", 6).alias("sim"))


@query(f"WITH {PROBES}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cand) AS rank FROM sims) SELECT qid, round(greatest(0, least(1, avg(sim))), 6) AS confidence, array_to_string(list(cand ORDER BY rank), ',') AS evidence FROM k WHERE rank <= 8 GROUP BY qid")
def dense_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """G-2: the 8 nearest as evidence, their mean similarity as confidence."""
    r = search.dense_retrieval(*probes(spark, d), 8, but_self=True)
    return r.select("qid", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


GOLD = f"{PROBES}, gold AS (SELECT qid, min(cand) AS gold FROM sims WHERE ql = cl GROUP BY qid), ranks AS (SELECT s.qid, 1 + count(*) FILTER (WHERE s.sim > g.sim) AS rank FROM sims s JOIN (SELECT x.qid, x.sim FROM sims x JOIN gold ON gold.qid = x.qid AND gold.gold = x.cand) g USING (qid) GROUP BY s.qid)"


def gold_ranks(spark: SparkSession, d: str, ties: bool = False) -> DataFrame:
    """The gold candidate is the first other one with the query's label: one of the label's first two."""
    q, c = probes(spark, d)
    first = search.top_k(c.select("cand", F.col("cl").alias("ql")), ["ql"], F.lit(0), ["cand"], 2)
    gold = q.select("qid", "ql").join(first.hint("merge"), "ql").where("qid <> cand").groupBy("qid").agg(F.min("cand").alias("gold"))
    return search.gold_ranks(q, c, gold, but_self=True, ties=ties)


@query(f"WITH {GOLD} SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS hits_at_1, round(avg((rank <= 3)::INT), 6) AS hits_at_3, round(avg((rank <= 10)::INT), 6) AS hits_at_10, round(avg(1.0 / rank), 6) AS mrr FROM ranks")
def gold_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """F-2, E-29."""
    return evaluate.rank_metrics(gold_ranks(spark, d))


@query(f"WITH {GOLD} SELECT count(*) AS n, round(median(rank), 6) AS median_rank, round(avg(rank), 6) AS mean_rank FROM ranks")
def rank_stats(spark: SparkSession, d: str) -> DataFrame:
    """E-39."""
    ranks = stored(gold_ranks(spark, d))
    median = evaluate.quantiles(ranks, "rank", {"median_rank": 0.5}).select(F.round("median_rank", 6).alias("median_rank"))  # one row
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank")).crossJoin(F.broadcast(median))


@query(f"WITH {PROBES}, gold AS (SELECT qid, min(cand) AS gold FROM sims WHERE ql = cl GROUP BY qid), k AS (SELECT qid, cand, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cand) AS rank FROM sims) SELECT count(*) AS n, round(avg((rank <= 10)::INT), 6) AS hits_at_10, round(avg(1.0 / rank), 6) AS mrr FROM k JOIN gold ON gold.qid = k.qid AND gold.gold = k.cand")
def matrix_hits_mrr(spark: SparkSession, d: str) -> DataFrame:
    """E-30: from a long score matrix, ties by candidate."""
    m = evaluate.rank_metrics(gold_ranks(spark, d, ties=True))
    return m.select("n", "hits_at_10", "mrr")
