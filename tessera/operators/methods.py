"""Other retrieval methods: beam search over out-edges, iterative retrieval with exclusion, lenient scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .search import nearest, top_k
from .shared import small, stored


def beam_search(queries: DataFrame, anchors: DataFrame, edges: DataFrame, depth: int = 2, beam: int = 4, width: int = 32, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(qid, depth, place, edge_id, s, r, o, score)``: at each depth the first ``width`` out-edges of the beam's nodes (by
    the node's place, then edge_id) are scored and the best ``beam`` go on. ``score`` adds that column to candidate edges;
    the edge score of retrieval is the default."""
    if score is None:
        features, edges = stored(graph.question_features(queries)), graph.edge_features(edges)
        score = lambda c: graph.scored(c, features)
    now = anchors.select("qid", "node", F.row_number().over(Window.partitionBy("qid").orderBy("node")).alias("at"))
    out = None
    for step in range(1, depth + 1):
        c = edges.join(small(stored(now)).withColumnRenamed("node", "s"), "s")
        c = c.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("at", "edge_id"))).where(F.col("k") <= width)
        picked = top_k(score(c), ["qid"], F.col("score"), ["k"], beam)
        picked = stored(picked.select("qid", F.lit(step).alias("depth"), F.col("rank").alias("place"), "edge_id", "s", "r", "o", "score"))
        out = picked if out is None else out.unionByName(picked)
        now = picked.groupBy("qid", F.col("o").alias("node")).agg(F.min("place").alias("at"))
    return out


def frontier_context(evidence: DataFrame, most: int = 8) -> DataFrame:
    """``(qid, depth, context)``: up to ``most`` entities that the beam has at a depth, in order of name."""
    ends = evidence.select("qid", "depth", F.explode(F.array("s", "o")).alias("node")).distinct()
    top = top_k(ends, ["qid", "depth"], F.lit(0), ["node"], most)
    return top.groupBy("qid", "depth").agg(F.sort_array(F.collect_list("node")).alias("context"))


def iterative_retrieval(queries: DataFrame, candidates: DataFrame, steps: int = 2, k: int = 4, follow: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(qid, step, place, cand, sim)``: each step takes the ``k`` nearest that were not used before, and asks again.

    ``follow(evidence, candidates)`` gives the next ``(qid, embedding)``; by default that of the best evidence.
    """
    out, now = None, queries.select("qid", "embedding")
    for step in range(1, steps + 1):
        gone = None
        if out is not None:
            taken = out.groupBy("qid").agg(F.collect_list("cand").alias("used"))  # k for each step
            now, gone = now.join(taken.hint("merge"), "qid"), "used"
        top = nearest(now, candidates.select("cand", "embedding"), k, but_self=True, used=gone)
        top = stored(top.select("qid", F.lit(step).alias("step"), F.col("rank").alias("place"), "cand", "sim"))
        out = top if out is None else out.unionByName(top)
        now = follow(top, candidates) if follow else top.where("place = 1").join(candidates.select("cand", "embedding").hint("merge"), "cand").select("qid", "embedding")
    return out
