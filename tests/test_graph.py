"""The toy graph of five capitals, opaque identifiers, abstention, and resumable runs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.operators import answer as A
from tessera.operators import evaluate, graph
from tessera.sources import files
from tessera.streaming import resume

TOY = [("Paris", "capital_of", "France", "City", "Country"), ("France", "in_continent", "Europe", "Country", "Continent"), ("Paris", "located_in", "Europe", "City", "Continent"), ("Berlin", "capital_of", "Germany", "City", "Country"), ("Germany", "in_continent", "Europe", "Country", "Continent")]


def edges(spark, rows):
    t = spark.createDataFrame(rows, "s string, r string, o string, s_type string, o_type string")
    return t.select(F.md5(F.concat_ws("|", "s", "r", "o")).alias("edge_id"), "*", F.lit(None).cast("long").alias("ts"), F.lit(1.0).alias("conf"), F.lit(0.0).alias("age"), F.lit(1.0).alias("trust"))


def run(spark, rows, question, anchor, hops=2):
    kg = edges(spark, rows)
    q = spark.createDataFrame([("q1", question, anchor)], "qid string, question string, anchor string")
    a = graph.exact_anchors(q, kg, ["anchor"])
    nodes, found = graph.retrieve(q, a, kg, hops=hops, top_k=8)
    states, attention = graph.propagate(nodes, found, a.withColumn("sim", F.lit(1.0)))
    p = graph.score_paths(graph.enumerate_paths(found, a, length=hops), found, states, attention)
    return q, a, nodes, found, states, attention, p.withColumn("violates", C.violates_monotone_time(F.col("steps")))


@pytest.fixture(scope="module")
def toy(spark):
    return run(spark, TOY, "capital of France", "Paris")


def test_retrieval_reaches_two_hops(toy):
    nodes = {r["node"] for r in toy[2].collect()}
    assert {"Paris", "France", "Europe"} <= nodes
    assert toy[3].count() == toy[3].select("edge_id").distinct().count()


def test_unknown_anchors_are_dropped(spark):
    kg = edges(spark, TOY)
    q = spark.createDataFrame([("q1", "x", "Nowhere"), ("q2", "x", None)], "qid string, question string, anchor string")
    a = graph.exact_anchors(q, kg, ["anchor"])
    assert a.count() == 0
    nodes, found = graph.retrieve(q, a, kg)
    assert nodes.count() == 0 and found.count() == 0


def test_attention_sums_to_one(toy):
    sums = toy[5].groupBy("qid", "dst").agg(F.sum("attn").alias("x")).collect()
    assert all(r["x"] == pytest.approx(1) for r in sums)


def test_belief_and_uncertainty(toy):
    for r in toy[4].collect():
        assert r["pos"] / (r["pos"] + r["neg"] + 2) + 2 / (r["pos"] + r["neg"] + 2) <= 1


def test_prefix_of_a_path_is_a_path(toy):
    keys = {r["path"] for r in toy[6].collect()}
    assert all("|".join(k.split("|")[:3]) in keys for k in keys)


def test_named_answer_before_opaque_one(spark):
    rows = [("Jamaica", "location.country.languages_spoken", "m.04dryy0", "Entity", "Entity"), ("Jamaica", "language.has_label", "Jamaican English", "Entity", "Entity")]
    q, a, _, found, _, _, p = run(spark, rows, "what does jamaican people speak", "Jamaica", hops=1)
    order = A.ranked(A.rescore(p, graph.question_features(q), a))
    assert A.best_answer(order).first()["answer"] == "Jamaican English"


def two_paths(spark, violates):
    step = lambda o: F.array(F.struct(F.lit("a").alias("s"), F.lit("r").alias("r"), F.lit(o).alias("o")))
    p = spark.range(1).select(F.lit("q").alias("qid"), F.explode(F.array(F.struct(F.lit("1").alias("path"), step("b").alias("steps")), F.struct(F.lit("2").alias("path"), step("c").alias("steps")))).alias("x")).select("qid", "x.*")
    return p.withColumn("score", F.lit(1.0)).withColumn("violates", F.lit(violates))


def test_abstention_by_entropy_and_by_mass(spark):
    r = A.abstention(two_paths(spark, False), 0.0, 0.5).first()
    assert r["abstained"] and r["entropy"] == pytest.approx(1)
    r = A.abstention(two_paths(spark, True), 0.05).first()
    assert r["abstained"] and r["mass"] == 0
    assert A.answer_posterior(two_paths(spark, False)).agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_bfs(spark):
    start = spark.createDataFrame([("q", "Paris")], "qid string, node string")
    dist = {r["node"]: r["dist"] for r in graph.bfs(edges(spark, TOY), start, 3).collect()}
    assert dist == {"Paris": 0, "France": 1, "Europe": 1, "Germany": 2, "Berlin": 3}


def test_resume_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, text string")
    answer = lambda df: df.select("id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"))
    out = f"file://{tmp_path}/answers"
    answer(rows.where("id = 1")).write.parquet(out)
    assert resume.resume(rows, out, answer, "id").count() == 3
    assert resume.resume(rows, out, answer, "id").count() == 3
    rows.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        got = resume.stream_answers(spark, f"file://{tmp_path}/in", rows.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", answer, "id")
    assert got.count() == 3


def test_sources(spark):
    lines = spark.createDataFrame([("1 2 3 4",), (" 5\t6 7 8 9",), ("1 2",)], "value string")
    assert sorted(tuple(r) for r in files.temporal_source(lines).collect()) == [(1, 2, 3, 4), (5, 6, 7, 8)]
    ids = spark.createDataFrame([("7\thttp://x/a_b#New_York",), ("",)], "value string")
    assert [tuple(r) for r in files.id_labels(ids).collect()] == [(7, "New York")]


def test_paired_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([(i, 1, int(i % 4 > 0)) for i in range(80)], "qid long, a int, b int")
    a, b = evaluate.paired_bootstrap(rows).first(), evaluate.paired_bootstrap(rows.repartition(7)).first()
    assert a == b and a["mean_delta"] == 0.25 and a["low"] > 0 and a["stars"]
