"""Retrieval against a plain loop over one query after another, with shared hubs, own graphs, settings of a query, and without broadcasts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, shared
from test_graph import edges

NODES = [f"n{i}" for i in range(14)]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    triples = {("hub", rng.choice(["of kind", "made by", "near"]), n) for n in NODES} | {(n, "part of", "hub") for n in NODES[:9]}
    triples |= {(rng.choice(NODES), rng.choice(["of kind", "made by"]), rng.choice(NODES)) for _ in range(40)}
    kg = edges(spark, [(*t, "T", "T") for t in sorted(triples)])
    texts = ["which kind is it", "who made it", "which kind is it", "which kind is it", None]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")
    anchors = [("q0", "n0"), ("q0", "n3"), ("q1", "n0"), ("q2", "n0"), ("q3", "hub"), ("q4", "n5"), ("q4", "n5")]
    every = graph.scored(graph.with_features(kg).crossJoin(q.select("qid")), graph.question_features(q)).collect()
    bare = graph.scored(graph.with_features(kg).crossJoin(q.select("qid")), graph.question_features(q), relation_bias=0.0).collect()
    score = {(r["qid"], r["edge_id"]): r["score"] for r in every}
    return kg, q, spark.createDataFrame(anchors, "qid string, node string"), anchors, {r["edge_id"]: (r["s"], r["o"]) for r in every}, score, {(r["qid"], r["edge_id"]): r["score"] for r in bare}


def plain(world, hops=2, top_k=5, dedup=True, allowed=None, both_ways=lambda q: True, most=lambda q: 9, score=None):
    _, _, _, anchors, ends, scores, bare = world
    out = set()
    for q in {a for a, _ in anchors}:
        nodes = frontier = {n for a, n in anchors if a == q}
        found = set()
        for hop in range(1, min(hops, most(q)) + 1):
            c = {e for e, (s, o) in ends.items() if s in frontier or (both_ways(q) and o in frontier)}
            c = {e for e in c if (allowed is None or (q, e) in allowed) and not (dedup and e in found)}
            value = lambda e, q=q: (bare if score == q else scores)[q, e]
            best = [e for e in sorted(c, key=lambda e: (-value(e), e))[:top_k] if value(e) >= 0.05]
            out |= {(q, e, hop, k, value(e)) for k, e in enumerate(best, 1)}
            found |= set(best)
            frontier = {n for e in best for n in ends[e]} - nodes
            nodes = nodes | frontier
    return out


def rows(found):
    return {(r["qid"], r["edge_id"], r["hop"], r["rank"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("broadcast", [200_000, 3])
def test_shared_lists(world, monkeypatch, broadcast):
    kg, q, anchors, *_ = world
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(shared.small, "__defaults__", (broadcast,))
    got = rows(graph.retrieve(q, anchors, kg, hops=2, top_k=5)[1])
    assert got == plain(world) and len(got) > 30


def test_an_edge_may_come_twice(world):
    kg, q, anchors, *_ = world
    assert rows(graph.retrieve(q, anchors, kg, hops=2, top_k=5, dedup_edges=False)[1]) == plain(world, dedup=False) != plain(world)


def test_own_graphs(world, spark):
    kg, q, anchors, _, ends, *_ = world
    rng = random.Random(9)
    allowed = {(a, e) for a in ("q0", "q1", "q3", "q4") for e in ends if rng.random() < 0.5}
    own = spark.createDataFrame(sorted(allowed) * 2, "qid string, edge_id string")
    assert rows(graph.retrieve(q, anchors, kg, hops=2, top_k=5, allowed=own)[1]) == plain(world, allowed=allowed)
    nodes = {(r["qid"], r["node"]) for r in graph.own_nodes(kg, own).collect()}
    assert nodes == {(a, n) for a, e in allowed for n in ends[e]}


def test_settings_of_a_query(world):
    kg, q, anchors, *_ = world
    q = q.withColumns({"both_ways": F.col("qid") != "q0", "hops": F.when(F.col("qid") == "q2", 1).otherwise(3), "relation_bias": F.when(F.col("qid") == "q1", 0.0).otherwise(0.4)})
    got = rows(graph.retrieve(q, anchors, kg, hops=3, top_k=4)[1])
    assert got == plain(world, hops=3, top_k=4, both_ways=lambda a: a != "q0", most=lambda a: 1 if a == "q2" else 3, score="q1")


def test_anchors_by_name_and_by_likeness(world, spark):
    """Names in the own graph; unknown names: the nearest of all, then the mask; no names: the mask, then the nearest."""
    kg, *_ = world
    vector = lambda c: T.hash_vector(F.col(c), 16)
    vectors = graph.entities(kg).select("node", vector("node").alias("vector"))
    q = spark.createDataFrame([("a", "n1", "n1"), ("b", "nobody", "n2"), ("c", None, "n3"), ("d", "n4", "n4")], "qid string, name string, like string").withColumn("vector", vector("like"))
    own = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n2"), ("c", "n3"), ("c", "hub"), ("d", "hub")], "qid string, node string")
    got = {(r["qid"], r["node"]) for r in graph.linked_anchors(q, kg, ["name"], vectors, 1, own).collect()}
    assert got == {("a", "n1"), ("b", "n2"), ("c", "n3")}  # d's name is known, but not in its graph, and its nearest isn't either
    assert ("d", "n4") in {(r["qid"], r["node"]) for r in graph.linked_anchors(q, kg, ["name"], vectors, 1).collect()}
