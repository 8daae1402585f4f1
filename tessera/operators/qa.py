"""The whole question-answering pipeline over a graph: a table of questions in, a table of answers out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import text as T
from ..functions import vectors as V
from . import answer as A
from . import graph
from .shared import stored


@dataclass(frozen=True)
class Settings:
    """``checks`` are conditions on ``steps`` and the columns of a query, each of which rules a path out; ``schema`` rates an
    edge's fit; ``follows`` are columns that follow from an edge's others (``graph.retrieve``); ``aggregation`` is ``max`` (the best path) or ``sum`` (the tail whose paths score most together)."""

    hops: int = 2
    top_k: int = 32
    path_length: int = 2
    path_cap: int = 512
    rounds: int = 2
    least_mass: float = 0.0
    most_entropy: float = 999.0
    aggregation: str = "max"
    schema: Column | None = None
    follows: Mapping[str, Column] | None = None
    checks: Sequence[Column] = field(default_factory=lambda: (C.violates_monotone_time(F.col("steps")),))


class Evidence(NamedTuple):
    queries: DataFrame
    anchors: DataFrame
    found: DataFrame
    paths: DataFrame


def anchor_similarities(features: DataFrame, anchors: DataFrame) -> DataFrame:
    met = anchors.join(features.hint("merge"), "qid")
    return met.select("qid", "node", V.dot(F.col("q_vec"), T.hash_vector(F.col("node"), graph.DIM)).alias("sim"))


def evidence(queries: DataFrame, edges: DataFrame, names: Sequence[str], s: Settings, keep: bool = True) -> Evidence:
    """What the graph has on each query: anchors, edges, and scored paths with ``violates``."""
    edges = stored(edges) if keep else edges  # every hop reads them
    anchors = stored(graph.exact_anchors(queries, edges, names))
    features = graph.question_features(queries)
    nodes, found = graph.retrieve(queries, anchors, edges, hops=s.hops, top_k=s.top_k, schema=s.schema, follows=s.follows)
    states, attention = graph.propagate(nodes, found, anchor_similarities(features, anchors), rounds=s.rounds)
    paths = graph.score_paths(graph.enumerate_paths(found, anchors, s.path_length, s.path_cap), found, states, attention)
    own = queries.dropDuplicates(["qid"]).select("qid", *[c for c in queries.columns if c not in ("qid", *paths.columns)])
    broken = F.lit(False)
    for check in s.checks:
        broken = broken | F.coalesce(check, F.lit(False))
    paths = stored(paths.join(own.hint("merge"), "qid").withColumn("violates", broken).select(*paths.columns, "violates"))
    return Evidence(queries, anchors, found, paths)


@dataclass(frozen=True)
class Variant:
    """One row of an ablation: a full configuration, or one with a component taken away or put in another's place."""

    name: str
    hops: int = 2
    relation_bias: float = 0.4
    both_ways: bool = True
    rescoring: bool = True
    aggregation: str = "max"


def ablate(queries: DataFrame, edges: DataFrame, names: Sequence[str], variants: Sequence[Variant], s: Settings, keep: bool = True) -> DataFrame:
    """``(variant, qid, prediction)`` of all variants in one run.

    Settings are small tables that queries are joined with. Variants that differ in hops alone share their retrieval, since
    a hop doesn't depend on how many follow; those that differ in rescoring or aggregation share all evidence. ``keep`` is
    false for edges that are a stored table already.
    """
    spark, edges = queries.sparkSession, stored(edges) if keep else edges
    ways = sorted({(v.relation_bias, v.both_ways) for v in variants})
    sets = sorted({(ways.index((v.relation_bias, v.both_ways)), v.hops) for v in variants})
    most = max(v.hops for v in variants)
    by_way = F.broadcast(spark.createDataFrame([(i, b, w, max(h for j, h in sets if j == i)) for i, (b, w) in enumerate(ways)], "way int, relation_bias double, both_ways boolean, hops int"))
    by_set = F.broadcast(spark.createDataFrame([(k, i, h) for k, (i, h) in enumerate(sets)], "k int, way int, most int"))  # no more rows than variants
    key, rest = (lambda c: F.concat(F.col(c).cast("string"), F.lit("|"), "qid")), F.expr("substring(qid, instr(qid, '|') + 1)")

    q = queries.select("qid", "question", *names).dropDuplicates(["qid"])
    anchors = stored(graph.exact_anchors(q, edges, names))
    asked = q.select("qid", "question").crossJoin(by_way).withColumn("qid", key("way"))
    nodes, found = graph.retrieve(asked, anchors.crossJoin(by_way.select("way")).select(key("way").alias("qid"), "node"), edges, hops=most, top_k=s.top_k, schema=s.schema, follows=s.follows)

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with a hop, for each set of evidence that has it."""
        r = rows.withColumn("way", F.substring_index("qid", "|", 1).cast("int")).withColumn("qid", rest).join(by_set, "way").where(F.col("hop") <= F.col("most"))
        return stored(r.withColumn("qid", key("k")).drop("way", "k", "most"))

    nodes, found = dealt(nodes), dealt(found)
    every = by_set.select("k")
    anchors = stored(anchors.crossJoin(every).select(key("k").alias("qid"), "node"))
    features = stored(graph.question_features(q.select("qid", "question").crossJoin(every).select(key("k").alias("qid"), "question")))
    states, attention = graph.propagate(nodes, found, anchor_similarities(features, anchors), rounds=s.rounds)
    of_set = lambda values: F.element_at(F.array(*map(F.lit, values)), F.substring_index("qid", "|", 1).cast("int") + 1)
    length, both_ways = of_set([h for _, h in sets]), of_set([ways[i][1] for i, _ in sets])
    paths = graph.enumerate_paths(found, anchors, most, s.path_cap, both_ways, length)
    paths = graph.score_paths(paths, found, states, attention)
    broken = F.lit(False)
    for check in s.checks:
        broken = broken | F.coalesce(check, F.lit(False))
    paths = stored(paths.withColumn("violates", broken))

    out = None
    for rescoring in sorted({v.rescoring for v in variants}):
        order = stored(A.ranked(A.convergence(A.rescore(paths, features, anchors), anchors) if rescoring else paths))
        onward = A.fallback_answer(order, found).withColumnRenamed("answer", "onward")
        for aggregation in sorted({v.aggregation for v in variants if v.rescoring == rescoring}):
            best = A.voted_answer(order).select("qid", "answer") if aggregation == "sum" else A.best_answer(order)
            some = [(v.name, sets.index((ways.index((v.relation_bias, v.both_ways)), v.hops))) for v in variants if (v.rescoring, v.aggregation) == (rescoring, aggregation)]
            named = F.broadcast(spark.createDataFrame(some, "variant string, k int"))
            given = onward.join(best.hint("merge"), "qid", "left").select(F.substring_index("qid", "|", 1).cast("int").alias("k"), rest.alias("qid"), F.coalesce("answer", "onward").alias("prediction"))
            part = q.select("qid").crossJoin(named).join(given.hint("merge"), ["qid", "k"], "left").select("variant", "qid", "prediction")
            out = part if out is None else out.unionByName(part)
    return out


def yes_or_no(order: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, answer)`` of the queries with ``yes_no``: 1 if a valid path leads from their ``user`` to their ``target``, else 0."""
    asked = queries.where("yes_no").select("qid", "user", "target").dropDuplicates(["qid"])
    met = order.join(asked.hint("merge"), "qid").where((C.head(F.col("steps")) == F.col("user")) & (C.tail(F.col("steps")) == F.col("target"))).select("qid").distinct()
    return asked.join(met.withColumn("met", F.lit("1")).hint("merge"), "qid", "left").select("qid", F.coalesce("met", F.lit("0")).alias("answer"))


def answer(queries: DataFrame, edges: DataFrame, names: Sequence[str] = ("anchor",), settings: Settings | None = None, keep: bool = True) -> DataFrame:
    """``(qid, prediction, abstained, confidence, entropy, n_triples, top_path, ranking)`` for each query.

    ``queries(qid, question, ..)`` name their entities in the columns ``names``. Retrieval, propagation, paths, checks and
    abstention come first; then paths are rescored by their tails, those of tails that several anchors reach are raised,
    and an answer is taken: the best named tail, or one step on from an opaque one. With the columns ``yes_no``, ``user``
    and ``target`` some queries may ask whether a path exists. A query without paths has no prediction. ``keep`` is false for
    edges that are a stored table already.
    """
    s = settings or Settings()
    q, anchors, found, paths = evidence(queries, edges, names, s, keep)
    judged = A.abstention(paths, s.least_mass, s.most_entropy)
    order = stored(A.ranked(A.convergence(A.rescore(paths, graph.question_features(q), anchors), anchors)))
    best = A.voted_answer(order).select("qid", "answer") if s.aggregation == "sum" else A.best_answer(order)
    parts = [
        judged,
        best,
        A.fallback_answer(order, found).withColumnRenamed("answer", "onward"),
        found.groupBy("qid").agg(F.count("*").alias("n_triples")),
        order.where("place = 1").select("qid", F.col("path").alias("top_path")),
        A.candidate_ranking(order, anchors),
    ]
    out = q.select("qid", "question").dropDuplicates(["qid"])
    if "yes_no" in q.columns:
        parts.append(yes_or_no(order, q).withColumnRenamed("answer", "yes"))
    for part in parts:
        out = out.join(part.hint("merge"), "qid", "left")
    given = F.coalesce(F.col("yes"), "answer", "onward") if "yes_no" in q.columns else F.coalesce("answer", "onward")
    return out.withColumn("prediction", F.when(~F.coalesce("abstained", F.lit("yes_no" not in q.columns)), given))
