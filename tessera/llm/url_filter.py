"""URL filters: rules for known sites, and logistic regression on hashed character n-grams of host and path for the rest.

The model is trained on a small labelled table of URLs (a parameter). Its features are made by the same expressions as
at scoring; the table's few rows of feature numbers go to the driver, where the weights are fitted by gradient descent.
Scoring is one projection: n-grams of host and path, hashed to ``DIM`` buckets, looked up in the weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIM = 4096
GRAMS = (3, 4)
#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: (host, path, 1 to block): the labelled table.
LABELLED = (
    ("cheap-pills.example.com", "/en/12", 1), ("www.cheap-pills.test", "/offer", 1), ("best-pills.test", "/en/buy-now", 1), ("pills-online.test", "/cheap", 1),
    ("spam-farm.example.org", "/en/7", 1), ("www.spam-farm.example.net", "/es/9", 1), ("link-farm.test", "/fr/3", 1), ("spam-links.test", "/de/4.html", 1),
    ("casino-win.test", "/en/bonus", 1), ("online-casino.test", "/jackpot", 1), ("m.casino-royal.test", "/es/slots", 1), ("free-casino.test", "/win", 1),
    ("adult-cams.test", "/live", 1), ("xxx-video.test", "/en/1", 1), ("free-xxx.test", "/adult", 1), ("payday-loans.test", "/apply", 1),
    ("cheap-loans.test", "/en/credit", 1), ("replica-watches.test", "/shop", 1), ("cheap-watches.test", "/sale", 1), ("malware-download.test", "/free.exe", 1),
    ("news.example.net", "/en/1", 0), ("www.example.com", "/en/100", 0), ("blog.example.net", "/es/20", 0), ("m.example.net", "/fr/301.html", 0),
    ("university.test", "/en/research", 0), ("library.test", "/books/12", 0), ("museum.test", "/de/art", 0), ("weather.test", "/en/today", 0),
    ("blog.garden.test", "/en/roses", 0), ("www.recipes.test", "/fr/soup", 0), ("docs.python.test", "/en/3", 0), ("www.city.test", "/es/plan", 0),
    ("thering.example.com", "/en/853/", 0), ("ththen.example.net", "/en/671", 0), ("www.therti.example.com", "/es/533", 0), ("blog.ththan.example.net", "/en/960", 0),
    ("m.therou.example.com", "/en/474.html", 0), ("tionsh.example.net", "/es/25930", 0), ("www.tionble.example.net", "/de/612", 0), ("science.test", "/en/paper/4", 0),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = F.when(((h == name) | h.endswith("." + name)) & p.startswith(prefix), F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def features(h: Column, p: Column, dim: int = DIM) -> Column:
    """Distinct buckets (from 1) of the character n-grams of ``^host$`` and ``^path$``."""

    def grams(text: Column, tag: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.char_length(framed) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(tag), framed.substr(i, F.lit(n))), F.lit(dim)).cast("int") + 1)

    return F.array_distinct(F.concat(*[grams(text, tag, n) for text, tag in ((h, "host"), (p, "path")) for n in GRAMS]))


def train(rows: list[tuple[list[int], int]], dim: int = DIM, steps: int = 1000, rate: float = 1.0, penalty: float = 1e-3) -> tuple[float, list[float]]:
    """Weights by full-batch gradient descent on the few labelled rows; features of a row are scaled to unit length."""
    bias, weights = 0.0, [0.0] * dim
    for _ in range(steps):
        g_bias, g = 0.0, {}
        for buckets, label in rows:
            scale = 1 / math.sqrt(len(buckets) or 1)
            z = bias + scale * sum(weights[b - 1] for b in buckets)
            err = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            g_bias += err
            for b in buckets:
                g[b - 1] = g.get(b - 1, 0.0) + err * scale
        bias -= rate * g_bias / len(rows)
        for b, v in g.items():
            weights[b] -= rate * (v / len(rows) * 10 + penalty * weights[b])
    return bias, weights


def url_filter(pages: DataFrame, labelled: Sequence[tuple[str, str, int]] = LABELLED, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages(page_id, url)``.

    ``score`` is the model's probability to block; the verdict is the rule's, else ``block`` from ``threshold`` on. A
    null url and one without ``://`` have an empty host and path and are judged by the model like any other. Repeated
    rows come back as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(list(labelled), "host string, path string, label int")
    rows = [(r["f"], r["label"]) for r in table.select(features(F.col("host"), F.col("path")).alias("f"), "label").collect()]  # as many as the labelled table
    bias, weights = train(rows)
    look_up = F.expr(f"cast(split('{','.join(f'{w:.9g}' for w in weights)}', ',') as array<double>)")
    out = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = out.withColumn("f", features(F.col("host"), F.col("path"))).withColumn("r", rule(F.col("host"), F.col("path"), rules))
    total = F.aggregate("f", F.lit(0.0), lambda s, b: s + F.element_at(look_up, b))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size("f"))))))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
