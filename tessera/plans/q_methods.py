"""Queries on other retrieval methods and on prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import evaluate, generate, graph, methods
from ..operators.shared import stored
from ..sources.derived import star_kg, star_queries, table
from .q_graph import ANSWERED, CANDIDATES, GOLD_OF, RETRIEVED, golds, rescored_paths, sql_scored
from .q_text import sql_answer
from .registry import query


def sql_beam(step: int, source: str) -> str:
    return f"""
b{step} AS (SELECT * FROM (SELECT f.qid, f.spot, kg.*, row_number() OVER (PARTITION BY f.qid ORDER BY f.spot, kg.edge_id) AS k FROM {source} f JOIN kg ON kg.s = f.node) WHERE k <= 32),
p{step} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS place FROM ({sql_scored(f'b{step}')})) WHERE place <= 4)"""


BEAM = f"{RETRIEVED}, g0 AS (SELECT qid, node, 1 AS spot FROM anchors),{sql_beam(1, 'g0')}, g1 AS (SELECT qid, o AS node, min(place) AS spot FROM p1 GROUP BY ALL),{sql_beam(2, 'g1')}, beam AS (SELECT 1 AS depth, * FROM p1 UNION ALL SELECT 2, * FROM p2)"


def beam(spark: SparkSession, d: str) -> DataFrame:
    kg, q = stored(star_kg(spark, d)), star_queries(spark, d)
    return methods.beam_search(q, graph.exact_anchors(q, kg, ["anchor"]), kg)


@query(f"WITH {BEAM} SELECT qid, depth, place, s, r, o, round(score, 6) AS score FROM beam")
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    """G-4."""
    return beam(spark, d).select("qid", "depth", F.col("place").cast("long").alias("place"), "s", "r", "o", F.round("score", 6).alias("score"))


@query(f"WITH {BEAM}, e AS (SELECT qid, depth, s AS node FROM beam UNION SELECT qid, depth, o FROM beam), k AS (SELECT *, row_number() OVER (PARTITION BY qid, depth ORDER BY node) AS k FROM e) SELECT qid, depth, string_agg(node, ' ' ORDER BY node) AS context FROM k WHERE k <= 8 GROUP BY qid, depth")
def frontier_context(spark: SparkSession, d: str) -> DataFrame:
    """G-6."""
    return methods.frontier_context(beam(spark, d)).select("qid", "depth", F.array_join("context", " ").alias("context"))


SIM = "round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9)"


@query(f"""WITH e AS MATERIALIZED (SELECT vec_id AS cand, embedding::DOUBLE[] AS v FROM embeddings),
s1 AS MATERIALIZED (SELECT * FROM (SELECT a.cand AS qid, b.cand, {SIM} AS sim, row_number() OVER (PARTITION BY a.cand ORDER BY {SIM} DESC, b.cand) AS place FROM e a, e b WHERE a.cand % 50 = 0 AND a.cand <> b.cand) WHERE place <= 4),
s2 AS (SELECT * FROM (SELECT f.qid, b.cand, {SIM} AS sim, row_number() OVER (PARTITION BY f.qid ORDER BY {SIM} DESC, b.cand) AS place FROM s1 f JOIN e a ON a.cand = f.cand, e b WHERE f.place = 1 AND b.cand <> f.qid AND NOT EXISTS (SELECT 1 FROM s1 u WHERE u.qid = f.qid AND u.cand = b.cand)) WHERE place <= 4)
SELECT qid, 1 AS step, place, cand, round(sim, 6) AS sim FROM s1 UNION ALL SELECT qid, 2, place, cand, round(sim, 6) FROM s2""")
def iterative_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """G-7."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("cand"), "embedding")
    r = methods.iterative_retrieval(e.where("cand % 50 = 0").withColumnRenamed("cand", "qid"), e)
    return r.select("qid", "step", F.col("place").cast("long").alias("place"), "cand", F.round("sim", 6).alias("sim"))


RAW = "raw AS (SELECT doc_id, replace(text, '. ', chr(10)) || chr(10) || n_chars || ' x' || chr(10) || '0.5' AS raw FROM documents)"


@query(f"""WITH {RAW}, n AS (SELECT doc_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: TRY_CAST(split_part(trim(x, ' '), ' ', 1) AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM raw)
SELECT doc_id, CASE WHEN len(n) >= 2 THEN n[1] ELSE 0.5 END AS first_score, CASE WHEN len(n) >= 2 THEN n[2] ELSE 0.5 END AS second_score FROM n""")
def parse_edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """G-5: two numbers from generated lines, or one half each."""
    raw = F.concat(F.replace("text", F.lit(". "), F.lit("\n")), F.lit("\n"), F.col("n_chars").cast("string"), F.lit(" x\n0.5"))
    s = table(spark, d, "documents").select("doc_id", T.parsed_scores(raw, F.lit(2)).alias("s"))
    return s.select("doc_id", F.col("s")[0].alias("first_score"), F.col("s")[1].alias("second_score"))


@query("SELECT doc_id, CASE WHEN regexp_extract(text || ' B)', '([A-Z])\\)', 1) = 'A' THEN lang WHEN regexp_extract(text || ' B)', '([A-Z])\\)', 1) = 'B' THEN source END AS choice FROM documents")
def letter_parse(spark: SparkSession, d: str) -> DataFrame:
    """G-16."""
    return table(spark, d, "documents").select("doc_id", T.lettered_choice(F.concat("text", F.lit(" B)")), F.array("lang", "source")).alias("choice"))


PICKED = f"""{CANDIDATES}, pf AS (SELECT qid, node, min(spot) AS spot FROM (SELECT qid, place * 10 + 0 AS spot, tail AS node, place FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.qid = r.qid AND a.node = r.tail) UNION ALL SELECT qid, place * 10 + 1, mid, place FROM ranked r WHERE mid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.qid = r.qid AND a.node = r.mid)) WHERE place <= 8 GROUP BY ALL),
picked AS MATERIALIZED (SELECT qid, list(node ORDER BY k) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, node) AS k FROM pf) WHERE k <= 16 GROUP BY qid)"""


def picked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    q, a, _, p = rescored_paths(spark, d)
    order = A.ranked(p)
    return q, a, order, A.selection_candidates(order, a)


@query(f"WITH {PICKED} SELECT qid, len(candidates) AS n, array_to_string(candidates, ' ') AS candidates FROM picked")
def selection_candidates(spark: SparkSession, d: str) -> DataFrame:
    """G-9."""
    return picked(spark, d)[3].select("qid", F.size("candidates").cast("long").alias("n"), F.array_join("candidates", " ").alias("candidates"))


def sql_lines(where: str, most: int) -> str:
    return f"""st AS (SELECT qid, place, 0 AS k, head AS a, CASE WHEN len = 2 THEN string_split(path, '|')[2] ELSE last_r END AS r, coalesce(mid, tail) AS z FROM ranked WHERE {where} UNION ALL SELECT qid, place, 1, mid, last_r, tail FROM ranked WHERE len = 2 AND {where}),
fl AS (SELECT qid, '(' || a || ' | ' || ltrim(r, '~') || ' | ' || z || ')' AS line, min(place * 10 + k) AS spot FROM st GROUP BY ALL),
facts AS (SELECT qid, string_agg(line, chr(10) ORDER BY n) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, line) AS n FROM fl) WHERE n <= {most} GROUP BY qid)"""


@query(f"WITH {PICKED}, {sql_lines('place <= 8', 32)} SELECT qid, md5('Facts:' || chr(10) || facts || chr(10) || chr(10) || 'Candidates:' || chr(10) || array_to_string(list_transform(candidates, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Number of the answer:') AS prompt_md5 FROM picked JOIN facts USING (qid) JOIN questions USING (qid)")
def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    """G-8."""
    q, _, order, c = picked(spark, d)
    return A.prompts(q, A.evidence(order), c).select("qid", F.md5("prompt").alias("prompt_md5"))


@query(f"WITH {PICKED}, g AS (SELECT qid, candidates, ' ' || (length(qid) % 5) || '. it' || chr(10) || 'x' AS raw FROM picked) SELECT qid, coalesce(CASE WHEN length(qid) % 5 BETWEEN 1 AND len(candidates) THEN candidates[length(qid) % 5] END, list_filter(candidates, lambda c: contains((length(qid) % 5) || '. it', lower(c)) AND length(c) > 2)[1], 'none') AS answer FROM g")
def snap_answer(spark: SparkSession, d: str) -> DataFrame:
    """G-10, G-11: a stub in the place of the generator."""
    c = picked(spark, d)[3]
    raw = F.concat(F.lit(" "), (F.length("qid") % 5).cast("string"), F.lit(". it\nx"))
    return c.select("qid", T.snapped(raw, F.col("candidates"), F.lit("none")).alias("answer"))


@query(f"""WITH {PICKED}, {GOLD_OF}, {sql_lines('place <= 8', 32)}, h AS (SELECT qid, candidates, md5('Facts:' || chr(10) || facts || chr(10) || chr(10) || 'Candidates:' || chr(10) || array_to_string(list_transform(candidates, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Number of the answer:') AS h FROM picked JOIN facts USING (qid) JOIN questions USING (qid)),
n AS (SELECT qid, candidates, ('0x' || h[2])::INT % 4 + 1 AS n FROM h WHERE h[1] NOT IN ('0', '1', '2', '3')),
given AS (SELECT qid, coalesce(CASE WHEN n <= len(candidates) THEN candidates[n] END, list_filter(candidates, lambda c: contains(n || '. it', lower(c)) AND length(c) > 2)[1], 'none') AS prediction FROM n)
SELECT qid, prediction, prediction IS NULL AS abstained, coalesce(({sql_answer('prediction')} = {sql_answer('gold')})::INT, 0) AS em FROM gold LEFT JOIN given USING (qid)""")
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """G-11, G-12: prompts through a generator that fails on some of them, answers taken from what it says; failed prompts,
    and no others of their batches, come back as abstained."""

    def stub() -> generate.Generate:
        """A generator that names a candidate by a digit of the prompt's digest, and fails on a quarter of the prompts."""
        import hashlib

        def answer(prompts: list[str]) -> list[str]:
            digests = [hashlib.md5(p.encode()).hexdigest() for p in prompts]
            if any(d[0] in "0123" for d in digests):
                raise RuntimeError("the stub has no answer")
            return [f" {int(d[1], 16) % 4 + 1}. it\nx" for d in digests]

        return answer

    q, _, order, c = picked(spark, d)
    said = generate.generated(A.prompts(q, A.evidence(order), c), stub, batch=8)
    answer = F.when(F.col("raw").isNotNull(), T.snapped(F.col("raw"), F.col("candidates"), F.lit("none")))
    answers = said.select("qid", answer.alias("prediction"), F.lit(1.0).alias("confidence"), F.col("candidates").alias("ranking"))
    gold = golds(q, star_kg(spark, d)).select("qid", F.array("gold").alias("golds"))
    return evaluate.evaluated(gold, answers).select("qid", "prediction", "abstained", "em")


@query(f"""WITH {ANSWERED}, {GOLD_OF}, {sql_lines('place <= 32', 24)}, tf AS (SELECT qid, tail, min(place) AS spot FROM ranked WHERE place <= 32 GROUP BY ALL), tc AS (SELECT qid, list(tail ORDER BY k) AS c FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, tail) AS k FROM tf) WHERE k <= 16 GROUP BY qid),
h AS (SELECT qid, c, question, facts, list_position(list_transform(c, lambda x: {sql_answer('x')}), {sql_answer('gold')}) AS hit FROM tc JOIN gold USING (qid) JOIN questions USING (qid) JOIN facts USING (qid))
SELECT qid, chr(64 + hit::INT) || ')' AS label, md5('Facts:' || chr(10) || facts || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(c, lambda x, i: chr(64 + i::INT) || ') ' || x), chr(10)) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt_md5 FROM h WHERE hit > 0""")
def selection_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """G-15, A-14: written as JSON lines and read again."""
    from ..sources import files

    q, _, order, _ = picked(spark, d)
    rows = A.training_rows(order, q, golds(q, star_kg(spark, d)).select("qid", F.array("gold").alias("golds")))
    path = files.scratch(spark, "training")
    rows.write.json(path)
    return spark.read.schema("qid string, prompt string, label string").json(path).select("qid", "label", F.md5("prompt").alias("prompt_md5"))
