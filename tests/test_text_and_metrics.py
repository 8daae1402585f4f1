"""Small inputs with exact expected values for the expressions and the metrics."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import evaluate as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_opaque_identifiers(spark):
    names = ["m.04dryy0", "g.1257kpk96", "William Roache", "Jamaican English", "m", "m.", None, ""]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", T.opaque(F.col("n")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [True, True, False, False, False, False, False, False]


def test_content_tokens(spark):
    assert sorted(value(spark, T.content_tokens(F.lit("What is the Capital of France? x")))) == ["capital", "france"]
    assert value(spark, T.content_tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("pred", "gold", "em"), [("Paris", "paris", 1), ("paris.", "Paris", 1), ("London", "Paris", 0), ("No Country", "0", 1)])
def test_exact_match(spark, pred, gold, em):
    assert value(spark, T.exact_match(F.lit(pred), F.array(F.lit(gold)))) == em


def test_token_f1(spark):
    assert value(spark, T.token_f1(F.lit("Paris France"), F.array(F.lit("Paris")))) == pytest.approx(2 / 3)
    assert value(spark, T.token_f1(F.lit(""), F.array(F.lit("Paris")))) == 0


def test_relaxed_match(spark):
    golds = F.array(F.lit("Lost (TV series)"))
    assert [value(spark, T.relaxed_match(F.lit("Lost"), golds, m)) for m in T.MATCH_MODES] == [0, 1, 1, 1]


def test_relation_boost(spark):
    boost = lambda q, r: value(spark, T.relation_boost(T.content_tokens(F.lit(q)), T.relation_tokens(F.lit(r))))
    assert boost("language spoken", "location.language_spoken") == 4
    assert boost("language spoken", "brand") == 0.5
    assert boost("hello", "brand") == 1


def test_hash_vector(spark):
    v = value(spark, T.hash_vector(F.lit("paris")))
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1) and v[0] / v[1] == pytest.approx(204 / 190)
    assert value(spark, T.hash_vector(F.lit(""))) == [0.0] * 64


def test_provenance_score_falls_with_age(spark):
    score = lambda age: value(spark, V.provenance_score(F.lit(1.0), F.lit(1.0), F.lit(age)))
    assert 0 < score(1000.0) < score(0.0) < 1


def test_snapped_and_letters(spark):
    c = F.array(F.lit("Rome"), F.lit("Paris"))
    assert value(spark, T.snapped(F.lit("2. it"), c, F.lit("?"))) == "Paris"
    assert value(spark, T.snapped(F.lit("it is rome"), c, F.lit("?"))) == "Rome"
    assert value(spark, T.snapped(F.lit("9"), c, F.lit("?"))) == "?"
    assert value(spark, T.lettered_choice(F.lit("B) x"), c)) == "Paris"
    assert value(spark, T.parsed_scores(F.lit("0.5 a\nx\n0.25"), F.lit(2))) == [0.5, 0.25]
    assert value(spark, T.parsed_scores(F.lit("x"), F.lit(2))) == [0.5, 0.5]


def path(*steps):
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(("s", "r", "o", "s_type", "o_type", "ts"), ("string",) * 5 + ("long",), s, strict=True)]) for s in steps])


def test_domain_and_range(spark):
    ok, bad = path(("Paris", "capital_of", "France", "City", "Country", None)), path(("Paris", "capital_of", "France", "City", "Continent", None))
    schema = [("City", "capital_of", "Country")]
    assert not value(spark, C.violates_domain_range(ok, schema))
    assert value(spark, C.violates_domain_range(bad, schema))
    assert value(spark, C.domain_range_edge(bad, schema)) == 0
    assert not value(spark, C.violates_domain_range(bad, []))


def test_monotone_time(spark):
    step = lambda t: ("a", "r", "b", "X", "X", t)
    assert not value(spark, C.violates_monotone_time(path(step(5), step(None), step(7))))
    assert value(spark, C.violates_monotone_time(path(step(7), step(3))))


def test_access_rules(spark):
    one = path(("u1", "has_role", "r1", "U", "R", 2))
    none = F.lit(None).cast("string")
    assert value(spark, C.access_reason(one, none, strict=False)) is None
    assert value(spark, C.access_reason(one, none, strict=True)) == "incomplete chain"
    full = path(("u", "has_role", "r", "", "", 2), ("r", "grants", "x", "", "", 3), ("x", "governed_by", "p", "", "", 4), ("p", "valid_in", "c", "", "", 5), ("r", "revoked_at", "r", "", "", 3))
    assert value(spark, C.access_reason(full, none)) == "revoked"


def test_ranks(spark):
    r = E.rank_metrics(spark.createDataFrame([(x,) for x in (1, 2, 3, 11, 0)], "rank int")).first()
    assert (r["hits_at_1"], r["hits_at_3"], r["hits_at_10"]) == (0.2, 0.6, 0.6)
    assert E.rank_metrics(spark.createDataFrame([(x,) for x in (1, 2, 0, 4)], "rank int")).first()["mrr"] == 0.4375


def test_balanced_accuracy_of_the_majority(spark):
    rows = spark.createDataFrame([(0, 0)] * 91 + [(0, 1)] * 9, "pred int, gold int")
    assert E.balanced_accuracy(rows).first()["balanced_accuracy"] == 0.5
    prf = E.binary_prf(rows).first()
    assert prf["f1"] == 0 and prf["recall"] == 0
    assert E.binary_prf(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "pred int, gold int")).first()["macro_f1"] == 0.733333


def test_calibration(spark):
    rows = spark.createDataFrame([(i, 0.99, i % 2) for i in range(1000)], "qid long, confidence double, em int")
    assert E.ece(rows, bins=20).first()["ece"] == pytest.approx(0.49)
    edge = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 1)], "qid long, confidence double, em int")
    assert [r["bin"] for r in E.reliability(edge).collect()] == [15]
    assert E.ece(edge).first()["ece"] == 0


def test_aurc_against_plain_sums(spark):
    data = [(i, (i * 37 % 100) / 100, int(i % 3 > 0)) for i in range(60)]
    order = sorted(data, key=lambda x: (-x[1], x[0]))
    risk, wrong = [], 0
    for k, (_, _, em) in enumerate(order, 1):
        wrong += 1 - em
        risk.append(wrong / k)
    want = sum((a + b) / 2 for a, b in zip(risk, risk[1:])) / 60
    rows = spark.createDataFrame(data, "qid long, confidence double, em int")
    assert E.aurc(rows).first()["aurc"] == pytest.approx(want, abs=1e-6)
