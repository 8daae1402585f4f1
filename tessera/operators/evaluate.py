"""Evaluation: ranking, classification and calibration metrics, summaries, bootstrap, pivots and snapshots.

All metrics are aggregations (partial on the map side) over result rows; doubles are rounded to 6 places at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import numbered, partitions, small, stored


def r6(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


# ---------------------------------------------------------------- matching and ranks


def relaxed_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy of ``rows(pred, golds)`` in all four modes, and what the widest gains over the strictest."""
    hits = rows.select(*by, *[T.relaxed_match(F.col("pred"), F.col("golds"), m).alias(m) for m in T.MATCH_MODES])
    return hits.groupBy(*by).agg(F.count("*").alias("n"), *[r6(F.avg(m), m) for m in T.MATCH_MODES], r6(F.avg("both") - F.avg("strict"), "gain"))


def with_gold_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows(qid, pred, gold)`` with ``golds``: the union of ``lists(qid, answer, all_answers)``, else the row's own gold;
    rows without any are dropped."""
    known = lists.select("qid", F.array_union(F.coalesce("answer", F.array().cast("array<string>")), F.coalesce("all_answers", F.array().cast("array<string>"))).alias("_list"))
    own = F.when(F.coalesce("gold", F.lit("")) != "", F.array("gold"))
    return rows.join(known.hint("merge"), "qid", "left").withColumn("golds", F.coalesce("_list", own)).where(F.size("golds") > 0).drop("_list")


def aligned_runs(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """``(.., qid, a, b)``: what two runs ``(.., qid, em)`` have for the same query."""
    return a.select(*by, "qid", F.col("em").alias("a")).join(b.select(*by, "qid", F.col("em").alias("b")).hint("merge"), [*by, "qid"])


def evaluated(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each of ``queries(qid, golds)``, from ``answers(qid, prediction, confidence, ranking)``: em, f1, rank.

    A query without an answer, for whatever reason, has abstained with confidence 0.
    """
    x = queries.join(answers.select("qid", "prediction", "confidence", "ranking").hint("merge"), "qid", "left")
    given = F.col("prediction").isNotNull()
    score = lambda x, zero: F.when(given, F.coalesce(x, zero)).otherwise(zero)
    place = F.array_position(F.transform("ranking", lambda y: F.array_contains(F.transform("golds", T.normalized_answer), T.normalized_answer(y))), F.lit(True))
    return x.select(
        "qid",
        "prediction",
        (~given).alias("abstained"),
        score(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        score(T.exact_match(F.col("prediction"), F.col("golds")), F.lit(0)).alias("em"),
        score(T.token_f1(F.col("prediction"), F.col("golds")), F.lit(0.0)).alias("f1"),
        F.coalesce(place, F.lit(0)).alias("rank"),
    )


def comparison_table(report: DataFrame) -> DataFrame:
    """The rows of ``paired_bootstrap`` as they are printed: signed difference, interval, p and stars."""
    signed = lambda c: F.format_string("%+.3f", c)
    interval = F.concat(F.lit("["), signed("low"), F.lit(", "), signed("high"), F.lit("]"))
    return report.select("dataset", "n", signed("mean_delta").alias("delta"), interval.alias("interval"), F.format_string("%.3f", "p").alias("p"), F.col("stars").alias("sig"))


def hits_at(k: int, rank: Column | None = None) -> Column:
    rank = F.col("rank") if rank is None else rank
    return share((rank >= 1) & (rank <= k))


def reciprocal(rank: Column | None = None) -> Column:
    rank = F.col("rank") if rank is None else rank
    return F.avg(F.when(rank >= 1, 1 / rank).otherwise(F.lit(0.0)))


def rank_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Hits@1, 3 and 10 and the mean reciprocal rank of ``ranks(rank)``; rank 0 says that gold is absent."""
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), r6(hits_at(1), "hits_at_1"), r6(hits_at(3), "hits_at_3"), r6(hits_at(10), "hits_at_10"), r6(reciprocal(), "mrr"))


# ---------------------------------------------------------------- binary


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, *by: str, pred: str = "pred", gold: str = "gold", positive: int | str = 1) -> DataFrame:
    p, g = F.coalesce(F.col(pred) == positive, F.lit(False)), F.coalesce(F.col(gold) == positive, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def balanced(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean recall of both classes; 0.5 if one is missing."""
    return F.when((tp + fn == 0) | (tn + fp == 0), F.lit(0.5)).otherwise((tp / (tp + fn) + tn / (tn + fp)) / 2)


def binary_prf(rows: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of the positive class, supports, and macro F1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(rows, *by).select(*by, r6(ratio(tp.cast("double"), tp + fp), "precision"), r6(ratio(tp.cast("double"), tp + fn), "recall"), r6(f1_of(tp, fp, fn), "f1"), (tp + fn).alias("support_pos"), (tn + fp).alias("support_neg"), r6((f1_of(tp, fp, fn) + f1_of(tn, fn, fp)) / 2, "macro_f1"))


def balanced_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    return confusion(rows, *by).select(*by, "tp", "fp", "fn", "tn", r6(balanced(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))), "balanced_accuracy"))


# ---------------------------------------------------------------- calibration


def ece(rows: DataFrame, *by: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi]; a confidence of 0 is in no bin but counts in n."""
    b = rows.groupBy(*by, F.ceil(F.col("confidence") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("em").alias("acc"), F.avg("confidence").alias("conf"))
    return b.groupBy(*by).agg(r6(F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)) / F.sum("n"), "ece"))


def reliability(rows: DataFrame, *by: str, bins: int = 15, left_closed: bool = False, least: int = 1) -> DataFrame:
    """Per bin: how many, mean accuracy and mean confidence. ``left_closed`` bins are [lo, hi), with 1 in the last one."""
    x = F.col("confidence") * bins
    b = F.least(F.floor(x), F.lit(bins - 1)) + 1 if left_closed else F.ceil(x)
    out = rows.groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("em"), "accuracy"), r6(F.avg("confidence"), "confidence"))
    return out.where((F.col("n") >= least) & (F.col("bin") > 0))


def confidence_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    return rows.groupBy((F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)) + 1).cast("int").alias("bin"), "em").agg(F.count("*").alias("n"))


def brier(rows: DataFrame, *by: str) -> DataFrame:
    """Binary Brier score, mean of 2 (confidence - em)^2."""
    return rows.groupBy(*by).agg(r6(F.avg(2 * F.pow(F.col("confidence") - F.col("em"), 2)), "brier"))


def brier_multiclass(probs: Column, targets: Column) -> Column:
    return F.avg(F.aggregate(F.zip_with(probs, targets, lambda p, t: (p - t) * (p - t)), F.lit(0.0), lambda s, x: s + x))


def nll(rows: DataFrame, *by: str, eps: float = 1e-9) -> DataFrame:
    p = F.when(F.col("em") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    return rows.groupBy(*by).agg(r6(-F.avg(F.ln(F.greatest(p, F.lit(eps)))), "nll"))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows(qid, confidence, em)`` with ``position`` and ``errors`` up to it, by falling confidence and then qid."""
    r = rows.select("qid", "confidence", "em", (1 - F.col("em")).alias("error"))
    return numbered(r, F.desc("confidence"), F.col("qid"), sums=("error",)).select("qid", "confidence", "em", "position", F.col("sum_error").alias("errors"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    curve = ordered(rows).crossJoin(F.broadcast(n))
    return curve.select("qid", r6(F.col("position") / F.col("n"), "coverage"), r6(F.col("errors") / F.col("position"), "risk"))


def aurc(rows: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve by the trapezoid rule, from coverage 1/n on."""
    o = ordered(rows).withColumn("risk", F.col("errors") / F.col("position"))
    ends = F.min_by("risk", "position") + F.max_by("risk", "position")
    return o.agg(F.count("*").alias("n"), r6((F.sum("risk") - ends / 2) / F.count("*"), "aurc"))


# ---------------------------------------------------------------- summaries


def quantiles(rows: DataFrame, value: str, qs: Mapping[str, float], *by: str) -> DataFrame:
    """One row for each group with a column for each of ``qs``: exact quantiles, between two values on the line through them.

    Values are counted first, so equal ones are one row, and dealt by ranges; the ranges' totals say which of them holds a
    rank, and only those are put in order. No buffer holds a group. Nulls don't count; a group without values has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cut = stored(counted.repartitionByRange(partitions(rows), *by, "_v").withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))  # a row for each range, and one more for each group
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumns({"_before": before, "_all": F.sum("_n").over(w)})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in qs.items()]))
    at = totals.withColumn("_q", asked).withColumn("_h", F.col("_q.q") * (F.col("_all") - 1))
    at = at.withColumn("_p", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))).where((F.col("_p") >= F.col("_before")) & (F.col("_p") < F.col("_before") + F.col("_n")))
    at = stored(at.select(*by, "_range", F.col("_q.name").alias("_name"), "_h", "_p", (F.col("_p") - F.col("_before")).alias("_k")))
    keys = [*by, "_range"]
    some = cut.join(small(at.select(*keys).distinct()), keys)
    some = some.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    met = some.join(small(at), keys).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
    share_of = 1 - F.abs(F.col("_h") - F.col("_p"))
    return met.groupBy(*by).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_v") * share_of)).alias(name) for name in qs])


def task_summary(rows: DataFrame, *by: str, task: str = "qa") -> DataFrame:
    """One row for each group of ``rows(em, f1, abstained, latency_ms, rank, pred, gold)``, with the task's main metric."""
    p, g = F.col("pred") == 1, F.col("gold") == 1
    main = {"access_control": "balanced_accuracy", "link_prediction": "mrr", "qa": "accuracy"}[task]
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("abstained")).alias("n_attempted"),
        share(F.col("abstained")).alias("abstention_rate"),
        F.avg("em").alias("exact_match"),
        F.coalesce(F.avg(F.when(~F.col("abstained"), F.col("em"))), F.lit(0.0)).alias("exact_match_when_attempted"),
        F.avg("f1").alias("f1"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        hits_at(1).alias("hits_at_1"),
        hits_at(10).alias("hits_at_10"),
        reciprocal().alias("mrr"),
        *[F.count_if(c).alias(n) for n, c in (("tp", p & g), ("fp", p & ~g), ("fn", ~p & g), ("tn", ~p & ~g))],
    )
    p95 = quantiles(rows, "latency_ms", {"p95_latency_ms": 0.95}, *by)
    s = s.join(p95.hint("merge"), list(by), "left") if by else s.crossJoin(F.broadcast(p95))  # one row without groups
    s = s.withColumn("balanced_accuracy", balanced(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))).withColumn("accuracy", F.col("exact_match"))
    s = s.withColumn("primary_metric", F.lit(main)).withColumn("primary_value", F.col(main)).drop("tp", "fp", "fn", "tn", "accuracy")
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


#: Cumulative probabilities of a Poisson variable with mean 1.
POISSON_1 = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def paired_bootstrap(rows: DataFrame, *by: str, rounds: int = 200, seed: str = "boot-1") -> DataFrame:
    """Mean difference of ``rows(qid, a, b)``, its 95 % interval and two-sided p from ``rounds`` resamples.

    A query's weight in a resample is a Poisson(1) number hashed from seed, round and qid: no index is joined and no
    row order is needed, each round is a partial sum.
    """
    d = rows.select(*by, "qid", (F.col("a") - F.col("b")).cast("double").alias("delta"))
    mean = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))
    r = d.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "round", "qid")), 1, 8), 16, 10).cast("double") / 2**32
    r = r.withColumn("u", u).withColumn("w", reduce(add, [(F.col("u") > c).cast("int") for c in POISSON_1]))
    r = r.groupBy(*by, "round").agg(F.try_divide(F.sum(F.col("w") * F.col("delta")), F.sum("w")).alias("m"))
    b = r.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))).alias("p"))
    p = F.col("p")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    out = mean.join(b.hint("merge"), list(by)) if by else mean.crossJoin(b)
    return out.select(*by, "n", r6(F.col("mean_delta"), "mean_delta"), r6(F.col("low"), "low"), r6(F.col("high"), "high"), r6(p, "p"), stars.alias("stars"))


#: Rows that are drawn from together.
LEAF = 1024


def multinomial_bootstrap(rows: DataFrame, *by: str, rounds: int = 200, seed: str = "boot-1") -> DataFrame:
    """As ``paired_bootstrap``, with weights that sum to n in every round: n draws with replacement from the group's n rows.

    Rows are numbered and cut into leaves. A range's draws are split between its halves by a binomial number that range
    and group decide, so each leaf finds its own draws by going down from the whole, without meeting another; there they
    are dealt to its rows. What leaves a task is a sum for each round. ``least_weight`` and ``most_weight`` are the rounds'
    smallest and largest sums of weights.
    """
    d = rows.select(*by, "qid", (F.col("a") - F.col("b")).cast("double").alias("delta"))
    order = numbered(d, *by, "qid")
    sizes = order.groupBy(*by).agg(F.count("*").alias("n"), F.min("position").alias("first"), F.avg("delta").alias("mean_delta"))
    leaves = (order.join(small(sizes), list(by)) if by else order.crossJoin(F.broadcast(sizes))).withColumn("leaf", F.floor((F.col("position") - F.col("first")) / LEAF))

    def random(*key: object) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.md5(":".join(map(str, (seed, *key))).encode()).digest()[:8], "little"))

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        group, n, leaf = [f[c].iloc[0] for c in by], int(f["n"].iloc[0]), int(f["leaf"].iloc[0])
        low, high = 0, -(-n // LEAF)
        draws = np.full(rounds, n)
        while high - low > 1:
            middle = (low + high) // 2
            left = random(*group, low, high).binomial(draws, (middle - low) * LEAF / (min(high * LEAF, n) - low * LEAF))
            low, high, draws = (low, middle, left) if leaf < middle else (middle, high, draws - left)
        f = f.sort_values("position")
        weights = random(*group, "leaf", leaf).multinomial(draws, np.full(len(f), 1 / len(f)))
        return pd.DataFrame({c: [g] * rounds for c, g in zip(by, group, strict=True)} | {"round": np.arange(rounds), "weight": weights.sum(1), "total": weights @ f["delta"].to_numpy()})

    kinds = "".join(f"`{c}` {t}, " for c, t in d.dtypes if c in by)
    drawn = leaves.select(*by, "position", "delta", "n", "leaf").groupBy(*by, "leaf").applyInPandas(draw, f"{kinds}round int, weight long, total double")
    r = stored(drawn.groupBy(*by, "round").agg(F.sum("weight").alias("weight"), (F.sum("total") / F.sum("weight")).alias("m")))
    share_below = F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0)))
    b = r.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), share_below.alias("p"), F.min("weight").alias("least_weight"), F.max("weight").alias("most_weight"))  # a row a round
    out = sizes.join(b.hint("merge"), list(by)) if by else sizes.crossJoin(F.broadcast(b))
    return out.select(*by, "n", r6(F.col("mean_delta"), "mean_delta"), r6(F.col("low"), "low"), r6(F.col("high"), "high"), r6(F.col("p"), "p"), "least_weight", "most_weight")


# ---------------------------------------------------------------- runs and reports


def canonical_runs(runs: DataFrame, priority: Sequence[str]) -> DataFrame:
    """One run for each (method, dataset): the tag that comes first in ``priority``, then the largest, then by tag."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("tag")), F.lit(0))
    order = F.when(order == 0, F.lit(len(priority) + 1)).otherwise(order)
    w = Window.partitionBy("method", "dataset").orderBy(order, F.desc("n"), "tag")
    return runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def best_against(runs: DataFrame, published: DataFrame) -> DataFrame:
    """The best run of each dataset beside ``published(dataset, reference)``."""
    best = runs.groupBy("dataset").agg(F.max_by(F.struct("method", "value"), F.struct("value", "method")).alias("x"))
    return best.select("dataset", "x.method", "x.value").join(published, "dataset", "left").withColumn("delta", F.round(F.col("value") - F.col("reference"), 6))


def pivot(runs: DataFrame, datasets: Sequence[str], value: str = "value", rows: str = "method") -> DataFrame:
    return runs.groupBy(rows).pivot("dataset", list(datasets)).agg(F.first(value))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """All (method, dataset) of either snapshot with both values and their difference."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["method", "dataset"], "full_outer")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def ablation(answers: DataFrame, golds: DataFrame, *by: str) -> DataFrame:
    """One summary row for each variant and group of ``answers(variant, qid, prediction)`` against ``golds(qid, golds, ..)``."""
    rows = golds.select("qid", "golds", *by).join(answers.hint("merge"), "qid")
    em = F.when(F.col("prediction").isNotNull(), F.coalesce(T.exact_match(F.col("prediction"), F.col("golds")), F.lit(0))).otherwise(0)
    return rows.groupBy("variant", *by).agg(F.count("*").alias("n"), F.count_if(F.col("prediction").isNull()).alias("n_abstained"), r6(F.avg(em), "value"))
