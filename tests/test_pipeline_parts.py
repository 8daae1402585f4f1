"""Global numbering, intervals, grants, blocks of similarities and the question-answering operator against plain versions."""

import logging
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import text as T
from tessera.operators import access, evaluate, graph, qa, search
from tessera.operators.shared import numbered, within_intervals
from tessera.sources import files

from test_graph import TOY, edges


def test_numbering_is_that_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.5, 0.9, rng.random()]), rng.randint(0, 1)) for i in range(400)]
    got = {r["qid"]: (r["position"], r["sum_em"]) for r in numbered(spark.createDataFrame(rows, "qid long, confidence double, em int"), F.desc("confidence"), F.col("qid"), sums=("em",)).collect()}
    total = 0
    for k, (i, _, em) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += em
        assert got[i] == (k, total)
    assert numbered(spark.createDataFrame([], "x int"), F.col("x")).count() == 0


def test_interleaving(spark):
    rows = [(k, int(k % 3 == 0)) for k in range(31)]
    got = sorted((r["place"], r["label"], r["pos"]) for r in files.balanced_interleave(spark.createDataFrame(rows, "pos long, label int")).collect())
    ones, zeros = [k for k, v in rows if v], [k for k, v in rows if not v]
    want = [x for p in zip(ones, zeros, strict=False) for x in p] + zeros[len(ones) :]
    assert [p for p, *_ in got] == list(range(1, 32)) and [k for *_, k in got] == want


def test_points_in_intervals(spark):
    rng = random.Random(2)
    points, spans = sorted({rng.randint(-50, 4000) for _ in range(60)}), [(i, a, None if i % 7 == 0 else a + rng.randint(0, 900)) for i, a in enumerate(rng.choices(range(-100, 4100), k=80))]
    got = {(r["t"], r["i"]) for r in within_intervals(spark.createDataFrame([(p,) for p in points], "t long"), "t", spark.createDataFrame(spans, "i int, `from` long, `to` long"), bins=16).collect()}
    assert got == {(p, i) for p in points for i, a, b in spans if a <= p and (b is None or p < b)}


def test_grants_by_classes_are_those_of_pairs(spark):
    rng = random.Random(3)
    pick = lambda n: rng.randrange(n)
    kg = {
        "has_role": spark.createDataFrame(sorted({(f"u{pick(6)}", f"r{pick(5)}", pick(12)) for _ in range(25)}), "user string, role string, t long"),
        "revoked": spark.createDataFrame([("r1", 6), ("r3", 2)], "role string, t long"),
        "grants": spark.createDataFrame(sorted({(f"r{pick(5)}", f"x{pick(30)}") for _ in range(60)}), "role string, resource string"),
        "governed_by": spark.createDataFrame([(f"x{i}", f"p{i % 4}") for i in range(30)], "resource string, policy string"),
        "valid_in": spark.createDataFrame([("p0", "c0"), ("p1", "c1"), ("p2", "c0"), ("p2", "c2")], "policy string, context string"),
        "schedule": spark.createDataFrame([(t, f"c{t % 3}") for t in range(12)], "t long, context string"),
    }
    times = kg["schedule"].select("t")
    pairs = access.grantable_pairs(kg, times).groupBy("t", "user").agg(F.count("*").alias("n"), F.min("resource").alias("first"))
    want = sorted(map(tuple, pairs.collect()))
    got = sorted(map(tuple, access.grantable_counts(kg, times).select("t", "user", "n_resources", "first_resource").collect()))
    assert got == want and want


def test_largest_of_each_row():
    rng = np.random.default_rng(4)
    scores = np.round(rng.random((20, 30)), 1)
    scores[3] = -np.inf
    ids = pd.Series(rng.permutation(30))
    i, j = search.largest(scores, ids, 5)
    for row in range(20):
        want = sorted((c for c in range(30) if scores[row, c] > -np.inf), key=lambda c: (-scores[row, c], ids[c]))[:5]
        assert set(j[i == row]) == set(want)


@pytest.mark.parametrize("cell", [1000, 10])
def test_nearest_in_several_tiles(spark, monkeypatch, cell):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(40, 6)), 1)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cand long, embedding array<double>")
    q = c.where("cand < 13").withColumnRenamed("cand", "qid")
    for name, size in (("QUERY_ROWS", 5), ("CANDIDATE_ROWS", 7), ("CELL", cell)):
        monkeypatch.setattr(search, name, size)
    got = sorted((r["qid"], r["rank"], r["cand"]) for r in search.nearest(q, c, 3, but_self=True).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    want = [(i, k, j) for i in range(13) for k, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-sims[i, j], j))[:3], 1)]
    assert got == sorted(want)
    gold = q.select("qid", (F.col("qid") + 20).alias("gold"))
    ranks = {r["qid"]: r["rank"] for r in search.gold_ranks(q, c, gold, but_self=True).collect()}
    assert ranks == {i: 1 + sum(sims[i, j] > sims[i, i + 20] for j in range(40) if j != i) for i in range(13)}


def test_tiles_that_cannot_reach_the_threshold_are_left_out(spark, monkeypatch, caplog):
    """Vectors around few directions, one of them zero: exact results, and most tiles are never compared."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 12))
    v = np.concatenate([c + 0.05 * rng.normal(size=(40, 12)) for c in centres] + [np.zeros((1, 12))])
    for name, size in (("QUERY_ROWS", 20), ("CANDIDATE_ROWS", 20), ("CELL", 30)):
        monkeypatch.setattr(search, name, size)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cand long, embedding array<double>")
    q = c.where("cand % 3 = 0 or cand = 320").withColumnRenamed("cand", "qid")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    sims = np.round(u @ u.T, 9)
    with caplog.at_level(logging.INFO, logger="tessera.operators.search"):
        got = {(r["qid"], r["rank"]): r["cand"] for r in search.nearest(q, c, 4, but_self=True).collect()}
        gold = q.where("qid < 320").select("qid", ((F.col("qid") + 1) % 40 + F.floor(F.col("qid") / 40) * 40).alias("gold"))
        ranks = {r["qid"]: r["rank"] for r in search.gold_ranks(q, c, gold, but_self=True).collect()}
    for i in [*range(0, 321, 3), 320]:
        want = sorted((j for j in range(321) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        assert [got[i, k] for k in range(1, 5)] == want
        if i < 320:
            assert ranks[i] == 1 + sum(sims[i, j] > sims[i, (i + 1) % 40 + i // 40 * 40] for j in range(321) if j != i)
    counts = [tuple(map(int, re.findall(r"\d+", r.message))) for r in caplog.records]
    assert counts and all(done < total / 2 for done, total in counts)
    own = q.select("qid", F.explode(F.array(*[(F.col("qid") * 7 + k) % 321 for k in range(9)])).alias("cand"))
    for r in search.nearest_among(q, c, own, 3, over=0.0).collect():
        allowed = sorted((j for j in {(r["qid"] * 7 + k) % 321 for k in range(9)} if sims[r["qid"], j] > 0), key=lambda j: (-sims[r["qid"], j], j))
        assert allowed[r["rank"] - 1] == r["cand"]


def test_answers_yes_no_and_unknown(spark):
    kg = edges(spark, TOY)
    rows = [("a", "capital of France", ["Paris"], False, None, None), ("b", "in", ["Paris"], True, "Paris", "Europe"), ("c", "in", ["Paris"], True, "Paris", "Berlin"), ("d", "x", ["Nowhere"], False, None, None), ("e", "where", None, False, None, None)]
    q = spark.createDataFrame(rows, "qid string, question string, names array<string>, yes_no boolean, user string, target string")
    got = {r["qid"]: r for r in qa.answer(q, kg, ["names"], qa.Settings(top_k=8)).collect()}
    assert got["a"]["prediction"] in ("France", "Europe") and got["b"]["prediction"] == "1" and got["c"]["prediction"] == "0"
    assert got["d"]["prediction"] is None and got["e"]["prediction"] is None
    golds = q.select("qid", F.when(F.col("qid") == "a", F.array(F.lit("france"), F.lit("Europe"))).otherwise(T.strings(["1"])).alias("golds"))
    scored = {r["qid"]: r for r in evaluate.evaluated(golds, qa.answer(q, kg, ["names"], qa.Settings(top_k=8, aggregation="sum"))).collect()}
    assert scored["a"]["em"] == 1 and scored["b"]["em"] == 1 and scored["c"]["em"] == 0
    assert scored["d"]["abstained"] and scored["d"]["confidence"] == 0 and scored["d"]["f1"] == 0


def test_checks_rule_paths_out(spark):
    kg = edges(spark, TOY)
    q = spark.createDataFrame([("a", "where", ["Paris", "Berlin"], ["Continent"])], "qid string, question string, names array<string>, expected array<string>")
    checks = (C.violates_answer_type(F.col("steps"), F.col("expected")), C.violates_domain_range(F.col("steps"), [("City", "capital_of", "Country"), ("Country", "in_continent", "Continent"), ("City", "located_in", "Continent")]))
    row = qa.answer(q, kg, ["names"], qa.Settings(top_k=8, checks=checks)).first()
    assert row["prediction"] == "Europe"


def test_best_of_each_node(spark):
    kg = edges(spark, [("a", "r", f"x{i}", "T", "T") for i in range(5)] + [("b", "r", f"y{i}", "T", "T") for i in range(5)] + [("a", "r", "b", "T", "T"), ("a", "r", "a", "T", "T")])
    q = spark.createDataFrame([("q", "r")], "qid string, question string")
    anchors = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, node string")
    _, found = graph.retrieve(q, anchors, kg, hops=1, top_k=3, per_node=True)
    rows = found.collect()
    assert len({r["edge_id"] for r in rows}) == len(rows) and 3 <= len(rows) <= 6
    schema = F.when(F.col("o").startswith("y"), 1.0).otherwise(0.0)
    _, found = graph.retrieve(q, anchors, kg, hops=1, top_k=5, schema=schema)
    assert {r["o"][0] for r in found.collect()} == {"y"}


def test_dictionary_and_gold_lists(spark):
    t = spark.createDataFrame([("http://x/b_c", "http://x/r", "http://x/a")], "s string, r string, o string")
    names, relations = files.dictionary(t)
    assert sorted((r["id"], r["name"]) for r in names.collect()) == [(0, "http://x/a"), (1, "http://x/b_c")] and relations.first()["id"] == 0
    rows = spark.createDataFrame([("1", "x", "g"), ("2", "x", "g"), ("3", "x", ""), ("4", "x", None)], "qid string, pred string, gold string")
    lists = spark.createDataFrame([("1", ["a"], ["a", "b"])], "qid string, answer array<string>, all_answers array<string>")
    assert {r["qid"]: sorted(r["golds"]) for r in evaluate.with_gold_lists(rows, lists).collect()} == {"1": ["a", "b"], "2": ["g"]}
    sample = files.seeded_sample(rows, 2, "qid").collect()
    assert sample == files.seeded_sample(rows.repartition(3), 2, "qid").collect() and len(sample) == 2
