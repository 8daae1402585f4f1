"""Queries on evaluation: labelled documents as predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources.derived import PRED, predictions
from .registry import query

DATASETS = ["de", "en", "es", "fr"]
COUNTED = "c AS (SELECT count(*) FILTER (WHERE pred = 1 AND gold = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND gold = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND gold = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND gold = 0) AS tn, dataset FROM pred GROUP BY dataset)"
BALANCED = "CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0.5 ELSE (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END"
F1P, F1N = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)"


@query(f"WITH {PRED}, {COUNTED} SELECT dataset, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round({F1P}, 6) AS f1, tp + fn AS support_pos, tn + fp AS support_neg, round(({F1P} + {F1N}) / 2, 6) AS macro_f1 FROM c")
def binary_prf(spark: SparkSession, d: str) -> DataFrame:
    """E-26, E-28."""
    return E.binary_prf(predictions(spark, d), "dataset")


@query(f"WITH {PRED}, {COUNTED} SELECT dataset, tp, fp, fn, tn, round({BALANCED}, 6) AS balanced_accuracy FROM c")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """E-27."""
    return E.balanced_accuracy(predictions(spark, d), "dataset")


@query(f"WITH {PRED} SELECT dataset, round(avg(2 * (confidence - em) ** 2), 6) AS brier FROM pred GROUP BY dataset")
def brier(spark: SparkSession, d: str) -> DataFrame:
    """E-33."""
    return E.brier(predictions(spark, d), "dataset")


@query(f"WITH {PRED} SELECT dataset, round(-avg(ln(greatest(CASE WHEN em = 1 THEN confidence ELSE 1 - confidence END, 1e-9))), 6) AS nll FROM pred GROUP BY dataset")
def nll(spark: SparkSession, d: str) -> DataFrame:
    """E-34."""
    return E.nll(predictions(spark, d), "dataset")


@query(f"WITH {PRED}, b AS (SELECT dataset, ceil(confidence * 15) AS bin, count(*) AS n, avg(em) AS acc, avg(confidence) AS conf FROM pred GROUP BY ALL) SELECT dataset, round(sum(CASE WHEN bin > 0 THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS ece FROM b GROUP BY dataset")
def ece(spark: SparkSession, d: str) -> DataFrame:
    """E-31."""
    return E.ece(predictions(spark, d), "dataset")


@query(f"WITH {PRED}, b AS (SELECT ceil(confidence * 15)::INT AS bin, 'closed right' AS kind, count(*) AS n, avg(em) AS a, avg(confidence) AS c FROM pred GROUP BY ALL UNION ALL SELECT least(floor(confidence * 10), 9)::INT + 1, 'closed left', count(*), avg(em), avg(confidence) FROM pred GROUP BY ALL) SELECT kind, bin, n, round(a, 6) AS accuracy, round(c, 6) AS confidence FROM b WHERE bin > 0 AND (kind = 'closed right' OR n >= 5)")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    """E-32, both kinds of bins."""
    p = predictions(spark, d)
    return E.reliability(p).withColumn("kind", F.lit("closed right")).unionByName(E.reliability(p, bins=10, left_closed=True, least=5).withColumn("kind", F.lit("closed left")))


@query(f"WITH {PRED} SELECT least(floor(confidence * 10), 9)::INT + 1 AS bin, em, count(*) AS n FROM pred GROUP BY ALL")
def conf_hist(spark: SparkSession, d: str) -> DataFrame:
    """E-32, histogram."""
    return E.confidence_histogram(predictions(spark, d))


CURVE = "o AS (SELECT qid, row_number() OVER w AS k, sum(1 - em) OVER (ORDER BY confidence DESC, qid ROWS UNBOUNDED PRECEDING) AS e, count(*) OVER () AS n FROM pred WINDOW w AS (ORDER BY confidence DESC, qid))"


@query(f"WITH {PRED}, {CURVE}, c AS (SELECT k, e / k AS risk, n, lag(e / k) OVER (ORDER BY k) AS prev FROM o) SELECT count(*) AS n, round(sum((risk + prev) / 2 / n), 6) AS aurc FROM c")
def aurc(spark: SparkSession, d: str) -> DataFrame:
    """F-5."""
    return E.aurc(predictions(spark, d))


@query(f"WITH {PRED}, {CURVE} SELECT qid, round(k / n::DOUBLE, 6) AS coverage, round(e / k, 6) AS risk FROM o")
def rc_curve(spark: SparkSession, d: str) -> DataFrame:
    """F-5, the curve."""
    return E.risk_coverage(predictions(spark, d))


SUMMED = f"""SELECT KEYS, count(*) AS n, count(*) FILTER (WHERE NOT abstained) AS n_attempted, avg(abstained::INT) AS abstention_rate, avg(em) AS exact_match,
  coalesce(avg(em) FILTER (WHERE NOT abstained), 0) AS exact_match_when_attempted, avg(f1) AS f1, avg(latency_ms) AS mean_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
  avg((rank = 1)::INT) AS hits_at_1, avg((rank BETWEEN 1 AND 10)::INT) AS hits_at_10, avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END) AS mrr,
  count(*) FILTER (WHERE pred = 1 AND gold = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND gold = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND gold = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND gold = 0) AS tn
  FROM pred GROUP BY KEYS"""
NUMBERS = "round(abstention_rate, 6) AS abstention_rate, round(exact_match, 6) AS exact_match, round(exact_match_when_attempted, 6) AS exact_match_when_attempted, round(f1, 6) AS f1, round(mean_latency_ms, 6) AS mean_latency_ms, round(p95_latency_ms, 6) AS p95_latency_ms, round(hits_at_1, 6) AS hits_at_1, round(hits_at_10, 6) AS hits_at_10, round(mrr, 6) AS mrr"


def summary_sql(keys: str, metric: str, value: str) -> str:
    return f"WITH {PRED}, s AS ({SUMMED.replace('KEYS', keys)}) SELECT {keys}, n, n_attempted, {NUMBERS}, round({BALANCED}, 6) AS balanced_accuracy, '{metric}' AS primary_metric, round({value}, 6) AS primary_value FROM s"


@query(summary_sql("method, dataset", "balanced_accuracy", BALANCED))
def task_summary(spark: SparkSession, d: str) -> DataFrame:
    """E-35, E-26."""
    return E.task_summary(predictions(spark, d), "method", "dataset", task="access_control")


@query(summary_sql("dataset", "mrr", "mrr"))
def resummarise(spark: SparkSession, d: str) -> DataFrame:
    """E-36, A-12, A-13: results are written by method and dataset and read again."""
    from ..sources import files

    stored = files.read_results(spark, files.write_results(predictions(spark, d), "resummarise"))
    return E.task_summary(stored, "dataset", task="link_prediction")


BOOT = f"""deltas AS (SELECT dataset, qid, (em - gold)::DOUBLE AS delta FROM pred),
drawn AS (SELECT dataset, delta, b, len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in E.POISSON_1)}], lambda c: c < ('0x' || substr(md5('boot-1:' || b || ':' || qid), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS w FROM deltas, range(200) t(b)),
m AS (SELECT dataset, b, sum(w * delta) / nullif(sum(w), 0) AS m FROM drawn GROUP BY ALL),
boot AS (SELECT dataset, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, least(1, 2 * least(avg(coalesce(m <= 0, FALSE)::INT), avg(coalesce(m >= 0, FALSE)::INT))) AS p FROM m GROUP BY dataset),
report AS (SELECT d.dataset, n, round(mean_delta, 6) AS mean_delta, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
  FROM (SELECT dataset, count(*) AS n, avg(delta) AS mean_delta FROM deltas GROUP BY dataset) d JOIN boot USING (dataset))"""


def compared(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    runs = E.aligned_runs(p.select("dataset", "qid", "em"), p.select("dataset", "qid", F.col("gold").alias("em")), "dataset")
    return E.paired_bootstrap(runs, "dataset")


@query(f"WITH {PRED}, {BOOT} SELECT * FROM report")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """E-38, D-10: the classifier against always answering yes, two runs that are met by query."""
    return compared(spark, d)


@query(f"WITH {PRED} SELECT dataset, count(*) AS n, round(avg((em - gold)::DOUBLE), 6) AS mean_delta, count(*) AS least_weight, count(*) AS most_weight, TRUE AS like_poisson FROM pred GROUP BY dataset")
def multinomial_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """E-38 with exact resamples: weights sum to n in every round, and the interval's ends are less than half an interval
    from those of the Poisson one."""
    p = predictions(spark, d)
    runs = E.aligned_runs(p.select("dataset", "qid", "em"), p.select("dataset", "qid", F.col("gold").alias("em")), "dataset")
    other = E.paired_bootstrap(runs, "dataset").select("dataset", F.col("low").alias("low_p"), F.col("high").alias("high_p"))
    half = (F.col("high_p") - F.col("low_p")) / 2
    near = (F.abs(F.col("low") - F.col("low_p")) <= half) & (F.abs(F.col("high") - F.col("high_p")) <= half)
    both = E.multinomial_bootstrap(runs, "dataset").join(other.hint("merge"), "dataset")
    return both.select("dataset", "n", "mean_delta", "least_weight", "most_weight", near.alias("like_poisson"))


@query(f"WITH {PRED}, {BOOT} SELECT count(*) AS n, count(*) FILTER (WHERE low > 0) AS wins, count(*) FILTER (WHERE high < 0) AS losses FROM report")
def bootstrap_report(spark: SparkSession, d: str) -> DataFrame:
    """E-42: comparisons won and lost."""
    return compared(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("low") > 0).alias("wins"), F.count_if(F.col("high") < 0).alias("losses"))


@query(f"WITH {PRED}, {BOOT} SELECT dataset, n, printf('%+.3f', mean_delta) AS delta, '[' || printf('%+.3f', low) || ', ' || printf('%+.3f', high) || ']' AS interval, printf('%.3f', p) AS p, stars AS sig FROM report")
def bootstrap_table(spark: SparkSession, d: str) -> DataFrame:
    """H-7: the comparison table."""
    return E.comparison_table(compared(spark, d))


RUNS = "runs AS (SELECT method, dataset, 'tag' || (qid % 3) AS tag, count(*) AS n, round(avg(em), 6) AS value, round(avg(latency_ms), 6) AS latency FROM pred GROUP BY ALL)"
CANONICAL = "canonical AS (SELECT method, dataset, tag, n, value, latency FROM (SELECT *, row_number() OVER (PARTITION BY method, dataset ORDER BY CASE tag WHEN 'tag2' THEN 1 WHEN 'tag0' THEN 2 ELSE 3 END, n DESC, tag) AS k FROM runs) WHERE k = 1)"
PIVOTED = lambda v: ", ".join(f"max({v}) FILTER (WHERE dataset = '{x}') AS {x}" for x in DATASETS)


def runs(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("method", "dataset", F.concat(F.lit("tag"), (F.col("qid") % 3).cast("string")).alias("tag")).agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("value"), F.round(F.avg("latency_ms"), 6).alias("latency"))


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_runs(runs(spark, d), ["tag2", "tag0"])


@query(f"WITH {PRED}, {RUNS}, {CANONICAL} SELECT * FROM canonical")
def canonical_run(spark: SparkSession, d: str) -> DataFrame:
    """F-10, H-3."""
    return canonical(spark, d)


@query(f"WITH {PRED}, {RUNS}, {CANONICAL}, ref(dataset, reference) AS (VALUES ('de', 0.7::DOUBLE), ('en', 0.65)) SELECT dataset, b.method, b.value, reference, round(b.value - reference, 6) AS delta FROM (SELECT dataset, x.m AS method, x.v AS value FROM (SELECT dataset, max({{'v': value, 'm': method}}) AS x FROM canonical GROUP BY dataset)) b LEFT JOIN ref USING (dataset)")
def best_run_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    """F-11, D-15."""
    return E.best_against(canonical(spark, d), spark.createDataFrame([("de", 0.7), ("en", 0.65)], "dataset string, reference double"))


@query(f"WITH {PRED}, {RUNS}, {CANONICAL} SELECT method, {PIVOTED('value')} FROM canonical GROUP BY method")
def method_pivot(spark: SparkSession, d: str) -> DataFrame:
    """H-4."""
    return E.pivot(canonical(spark, d), DATASETS)


@query(f"WITH {PRED}, {RUNS}, {CANONICAL} SELECT method, {PIVOTED('latency')} FROM canonical GROUP BY method")
def latency_pivot(spark: SparkSession, d: str) -> DataFrame:
    """H-5."""
    return E.pivot(canonical(spark, d), DATASETS, "latency")


@query(f"WITH {PRED}, b AS (SELECT method, dataset, ceil(confidence * 15) AS bin, count(*) AS n, avg(em) AS acc, avg(confidence) AS conf FROM pred GROUP BY ALL), e AS (SELECT method, dataset, round(sum(CASE WHEN bin > 0 THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS ece FROM b GROUP BY ALL) SELECT method, {PIVOTED('ece')} FROM e GROUP BY method")
def calibration_pivot(spark: SparkSession, d: str) -> DataFrame:
    """H-5, calibration."""
    return E.pivot(E.ece(predictions(spark, d), "method", "dataset"), DATASETS, "ece")


def snap(spark: SparkSession, d: str, tag: str) -> DataFrame:
    return runs(spark, d).where(F.col("tag") == tag).select("method", "dataset", "value")


@query(f"WITH {PRED}, {RUNS} SELECT tag AS snapshot_id, method, dataset, value FROM runs WHERE tag IN ('tag0', 'tag1')")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """H-8: two snapshots, appended to one table."""
    from ..sources import files

    path = files.scratch(spark, "snapshots")
    for tag in ("tag0", "tag1"):
        files.append_snapshot(snap(spark, d, tag), path, tag)
    return spark.read.parquet(path).select(F.col("snapshot_id").cast("string").alias("snapshot_id"), "method", "dataset", "value")


@query(f"WITH {PRED}, {RUNS} SELECT coalesce(a.method, b.method) AS method, coalesce(a.dataset, b.dataset) AS dataset, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta FROM (SELECT * FROM runs WHERE tag = 'tag0') a FULL JOIN (SELECT * FROM runs WHERE tag = 'tag1') b ON a.method = b.method AND a.dataset = b.dataset")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """D-11, H-9."""
    return E.snapshot_diff(snap(spark, d, "tag0"), snap(spark, d, "tag1"))


@query(f"WITH {PRED} SELECT gold, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pred GROUP BY gold")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """E-41."""
    p = predictions(spark, d)
    n = p.agg(F.count("*").alias("all"))
    return p.groupBy("gold").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("gold", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(f"WITH {PRED}, s AS (SELECT qid, ('0x' || substr(md5('split-1:' || qid), 1, 8))::BIGINT % 100 AS h FROM pred) SELECT qid, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'valid' ELSE 'test' END AS split FROM s")
def split_requests(spark: SparkSession, d: str) -> DataFrame:
    """E-43."""
    from ..sources.derived import draw

    h = draw(F.concat(F.lit("split-1:"), F.col("qid").cast("string"))) % 100
    return predictions(spark, d).select("qid", F.when(h < 70, "train").when(h < 85, "valid").otherwise("test").alias("split"))
