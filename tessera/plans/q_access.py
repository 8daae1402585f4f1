"""Queries on access control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..operators import access
from ..operators.shared import stored
from ..sources import derived
from ..sources.derived import ACCESS
from .registry import query

DECIDED = f"""
WITH {ACCESS},
granted AS (
  SELECT DISTINCT q.qid FROM requests q JOIN has_role h ON h.user = q.user AND h.t <= q.t JOIN grants g ON g.role = h.role AND g.resource = q.resource
  WHERE NOT EXISTS (SELECT 1 FROM revoked v WHERE v.role = h.role AND v.t <= q.t)),
valid AS (SELECT DISTINCT q.qid FROM requests q JOIN schedule c ON c.t = q.t JOIN governed_by p ON p.resource = q.resource JOIN valid_in w ON w.policy = p.policy AND w.context = c.context),
decided AS (SELECT q.*, q.qid IN (SELECT qid FROM granted) AND q.qid IN (SELECT qid FROM valid) AS allowed FROM requests q)
"""


@query(f"{DECIDED} SELECT qid, user, resource, t, allowed FROM decided")
def access_decision(spark: SparkSession, d: str) -> DataFrame:
    """C-7: every request decided at its own time."""
    kg = derived.access_kg(spark, d)
    return access.access_decisions(kg, kg["requests"])


@query(f"""WITH {ACCESS}, live AS (
  SELECT DISTINCT c.t, h.user, h.role FROM schedule c JOIN has_role h ON h.t <= c.t
  WHERE NOT EXISTS (SELECT 1 FROM revoked v WHERE v.role = h.role AND v.t <= c.t)),
pairs AS (
  SELECT DISTINCT l.t, l.user, g.resource FROM live l JOIN grants g ON g.role = l.role JOIN schedule c ON c.t = l.t
  JOIN governed_by p ON p.resource = g.resource JOIN valid_in w ON w.policy = p.policy AND w.context = c.context)
SELECT t, user, count(*) AS n_resources, min(resource) AS first_resource FROM pairs GROUP BY t, user""")
def grantable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C-8: what each user could get at each time, counted."""
    kg = derived.access_kg(spark, d)
    return access.grantable_counts(kg, stored(kg["schedule"].select("t")))


def access_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths user - role - resource - policy - context of every request, with a revocation at the end if there is one."""
    kg = derived.access_kg(spark, d)
    step = lambda s, r, o, st, ot, ts: F.struct(s.alias("s"), F.lit(r).alias("r"), o.alias("o"), F.lit(st).alias("s_type"), F.lit(ot).alias("o_type"), ts.cast("long").alias("ts"))
    none, c = F.lit(None), F.col
    p = kg["requests"].join(kg["has_role"].withColumnRenamed("t", "since").hint("merge"), "user").join(kg["grants"].hint("merge"), ["role", "resource"])
    p = p.join(kg["governed_by"].hint("merge"), "resource").join(kg["valid_in"].hint("merge"), "policy").join(kg["revoked"].withColumnRenamed("t", "gone").hint("merge"), "role", "left")
    steps = F.array(
        step(c("user"), "has_role", c("role"), "User", "Role", c("since")), step(c("role"), "grants", c("resource"), "Role", "Resource", none),
        step(c("resource"), "governed_by", c("policy"), "Resource", "Policy", none), step(c("policy"), "valid_in", c("context"), "Policy", "Context", none),
    )
    revoke = F.array(step(c("role"), "revoked_at", c("role"), "Role", "Role", c("gone")))
    return p.select("qid", "since", "role", "policy", "context", F.when(c("gone").isNotNull(), F.concat(steps, revoke)).otherwise(steps).alias("steps"))


@query(f"""WITH {ACCESS}, p AS (
  SELECT q.qid, h.t AS since, h.role, p.policy, w.context, v.t AS gone, greatest(h.t, coalesce(v.t, h.t)) AS latest
  FROM requests q JOIN has_role h ON h.user = q.user JOIN grants g ON g.role = h.role AND g.resource = q.resource
  JOIN governed_by p ON p.resource = q.resource JOIN valid_in w ON w.policy = p.policy LEFT JOIN revoked v ON v.role = h.role)
SELECT p.qid, since, role, policy, p.context, CASE WHEN gone <= latest THEN 'revoked' WHEN c.context IS NOT NULL AND c.context <> p.context THEN 'inactive context' END AS reason
FROM p LEFT JOIN schedule c ON c.t = p.latest""")
def check_access_path(spark: SparkSession, d: str) -> DataFrame:
    """C-6: the access rules on every path of a request."""
    kg = derived.access_kg(spark, d)
    p = access_paths(spark, d).withColumn("latest", F.array_max(F.transform("steps", lambda x: x["ts"])))
    p = p.join(kg["schedule"].select(F.col("t").alias("latest"), F.col("context").alias("active")).hint("merge"), "latest", "left")
    return p.select("qid", "since", "role", "policy", "context", C.access_reason(F.col("steps"), F.col("active")).alias("reason"))


@query(f"""{DECIDED}, yes AS (
  SELECT DISTINCT q.qid FROM requests q JOIN has_role h ON h.user = q.user JOIN grants g ON g.role = h.role AND g.resource = q.resource
  LEFT JOIN revoked v ON v.role = h.role WHERE v.t IS NULL)
SELECT d.qid, CASE WHEN y.qid IS NULL THEN '0' ELSE '1' END AS prediction, CASE WHEN d.allowed THEN '1' ELSE '0' END AS gold
FROM decided d LEFT JOIN yes y ON y.qid = d.qid""")
def answer_yes_no(spark: SparkSession, d: str) -> DataFrame:
    """E-20: yes if a valid path leads from the user to the resource."""
    kg = derived.access_kg(spark, d)
    paths = access_paths(spark, d).withColumn("steps", F.filter("steps", lambda x: ~x["r"].isin("governed_by", "valid_in")))
    ok = paths.where(C.access_reason(F.col("steps"), F.lit(None).cast("string"), strict=False).isNull()).select("qid").distinct().withColumn("yes", F.lit("1"))
    decided = access.access_decisions(kg, kg["requests"])
    return decided.join(ok.hint("merge"), "qid", "left").select("qid", F.coalesce("yes", F.lit("0")).alias("prediction"), F.when(F.col("allowed"), "1").otherwise("0").alias("gold"))
