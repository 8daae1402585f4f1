"""Exact quantiles, resamples whose weights sum to n, and lines numbered over the blocks of files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, shared
from tessera.sources import files


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.full(300, 2.5), "c": np.array([7.0]), "d": np.round(rng.normal(size=400), 1), "e": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("f", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in evaluate.quantiles(d, "v", {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}, "g").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n in ("low", "mid", "p95", "top")] == pytest.approx(list(np.quantile(v, [0, 0.5, 0.95, 1])), abs=1e-12)
    whole = evaluate.quantiles(d, "v", {"p95": 0.95}).first()["p95"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.95), abs=1e-12)


def test_multinomial_weights_sum_to_n(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "LEAF", 64)
    rng = np.random.default_rng(2)
    rows = [(g, i, int(rng.random() < p), int(rng.random() < 0.5)) for g, n, p in (("x", 1000, 0.7), ("y", 130, 0.5), ("z", 1, 1.0)) for i in range(n)]
    got = {r["g"]: r for r in evaluate.multinomial_bootstrap(spark.createDataFrame(rows, "g string, qid long, a int, b int").repartition(3), "g").collect()}
    for g in "xyz":
        delta = np.array([a - b for h, _, a, b in rows if h == g])
        r = got[g]
        assert (r["n"], r["least_weight"], r["most_weight"]) == (len(delta),) * 3 and r["mean_delta"] == pytest.approx(delta.mean(), abs=1e-6)
        spread = 1.96 * delta.std() / len(delta) ** 0.5
        assert abs(r["high"] - r["low"] - 2 * spread) <= 0.8 * spread and r["low"] <= r["mean_delta"] <= r["high"]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Several files, each of several blocks: numbers as one reader would give."""
    rng = np.random.default_rng(3)
    want = []
    for name in ("a.txt", "b.txt", "empty.txt", "c.txt"):
        lines = ["x" * int(k) + f" {name} {i}" for i, k in enumerate(rng.integers(0, 60, 300))] if name != "empty.txt" else []
        lines[3:4] = [""] * bool(lines)
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        want += [(name, i, x) for i, x in enumerate(lines, 1)]
    want = [(n, i, k, x) for k, (n, i, x) in enumerate(sorted(want, key=lambda t: (t[0], t[1])))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.numbered_lines(spark, f"file://{tmp_path}/*.txt").select(F.element_at(F.split("file", "/"), -1), "line", "pos", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted(want)


def test_hubs_of_both_sides_meet_in_lots(spark):
    """A key with a third of all rows on either side, null keys and keys of one side alone: the rows of a plain join."""
    rows = shared.stored(spark.range(600).selectExpr("case when id % 3 = 0 then 'hub' when id % 50 = 1 then null else concat('k', id % 40) end as k", "id as a"))
    others = shared.stored(spark.range(300).selectExpr("case when id % 3 = 0 then 'hub' when id % 3 = 1 then 'wide' when id % 50 = 2 then null else concat('k', id % 60) end as k", "id as b"))
    want = sorted(map(tuple, rows.join(others, "k").select("k", "a", "b").collect()))
    for limits in ({}, {"broadcast_rows": 0, "least": 7}, {"broadcast_rows": 0}):
        got = shared.met_in_lots(rows, others, "k", "a", "b", **limits)
        assert got.columns == ["k", "a", "b"] and sorted(map(tuple, got.collect())) == want
    empty = rows.where("false")
    assert shared.met_in_lots(empty, others, "k", "a", "b", 0, 7).count() == shared.met_in_lots(rows, others.where("false"), "k", "a", "b", 0, 7).count() == 0
