"""Access decisions over roles, revocations, grants and policies, at a point in time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stored, within_intervals


def role_intervals(kg: Mapping[str, DataFrame]) -> DataFrame:
    """``(user, role, from, to)``: a role is held from its first assignment until it is revoked, if it ever is (null)."""
    since = kg["has_role"].groupBy("user", "role").agg(F.min("t").alias("from"))
    gone = kg["revoked"].groupBy("role").agg(F.min("t").alias("to"))
    return since.join(gone.hint("merge"), "role", "left").where("to is null or to > from").select("user", "role", "from", "to")


def live_roles(kg: Mapping[str, DataFrame], times: DataFrame) -> DataFrame:
    """``(t, user, role)``: roles assigned by t and not revoked by t; a role that was revoked once is lost for good."""
    return within_intervals(times.select("t").distinct(), "t", role_intervals(kg)).select("t", "user", "role")


def role_sets(kg: Mapping[str, DataFrame]) -> DataFrame:
    """``(user, roles, from, to)``: the sorted roles that a user holds between two changes; stretches without any are left out."""
    held = role_intervals(kg).groupBy("user").agg(F.collect_list(F.struct("from", "to", "role")).alias("held"))
    changes = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("held", lambda x: x["from"]), F.transform("held", lambda x: x["to"])))))
    x = held.withColumn("at", changes)
    at = x.select("user", "held", F.explode(F.transform("at", lambda p, i: F.struct(p.alias("from"), F.get("at", i + 1).alias("to")))).alias("at")).select("user", "held", "at.from", "at.to")
    now = F.filter("held", lambda h: (h["from"] <= F.col("from")) & (h["to"].isNull() | (h["to"] > F.col("from"))))
    return at.select("user", F.array_sort(F.transform(now, lambda h: h["role"])).alias("roles"), "from", "to").where(F.size("roles") > 0)


def open_resources(kg: Mapping[str, DataFrame]) -> DataFrame:
    """``(context, resource)``: a policy that governs the resource is valid in the context."""
    return kg["governed_by"].join(kg["valid_in"].hint("merge"), "policy").select("context", "resource").distinct()


def access_decisions(kg: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """``requests(qid, user, resource, t)`` with ``allowed``: a live role grants the resource, and a policy of it is
    valid in the context active at t."""
    r = requests.select("qid", "user", "resource", "t")
    roles = role_intervals(kg)
    granted = r.join(roles.hint("merge"), "user").where("from <= t and (to is null or to > t)").join(kg["grants"].hint("merge"), ["role", "resource"], "left_semi").select("qid").distinct()
    valid = r.join(kg["schedule"].hint("merge"), "t").join(open_resources(kg).hint("merge"), ["context", "resource"], "left_semi").select("qid").distinct()
    yes = granted.join(valid.hint("merge"), "qid", "left_semi").withColumn("yes", F.lit(True))
    return r.join(yes.hint("merge"), "qid", "left").select("qid", "user", "resource", "t", F.coalesce("yes", F.lit(False)).alias("allowed"))


def grantable_pairs(kg: Mapping[str, DataFrame], times: DataFrame) -> DataFrame:
    """All ``(t, user, resource)`` that a request at t would get, for every t of ``times(t)``."""
    valid = times.join(kg["schedule"].hint("merge"), "t").join(open_resources(kg).hint("merge"), "context").select("t", "resource")
    return live_roles(kg, times).join(kg["grants"].hint("merge"), "role").join(valid.hint("merge"), ["t", "resource"], "left_semi").select("t", "user", "resource").distinct()


def resource_classes(kg: Mapping[str, DataFrame]) -> DataFrame:
    """``(class, roles, contexts, n, first)``: resources that the same roles grant and that are open in the same contexts."""
    roles = kg["grants"].groupBy("resource").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    contexts = open_resources(kg).groupBy("resource").agg(F.array_sort(F.collect_set("context")).alias("contexts"))
    both = roles.join(contexts.hint("merge"), "resource")
    return both.groupBy("roles", "contexts").agg(F.count("*").alias("n"), F.min("resource").alias("first")).withColumn("class", F.md5(F.to_json(F.struct("roles", "contexts"))))


def grantable_counts(kg: Mapping[str, DataFrame], times: DataFrame) -> DataFrame:
    """``(t, user, n_resources, first_resource)``: how many resources a user would get at t, for every t of ``times(t)``.

    Resources are counted once for each set of roles and context, not for each user and time: users meet sets of roles,
    and sets of roles meet classes of resources.
    """
    sets = stored(role_sets(kg).withColumn("set", F.md5(F.to_json("roles"))))
    classes = stored(resource_classes(kg))
    by_role = classes.select("class", F.explode("roles").alias("role"))
    met = sets.select("set", "roles").distinct().select("set", F.explode("roles").alias("role")).join(by_role.hint("merge"), "role").select("set", "class").distinct()
    open_in = classes.select("class", "n", "first", F.explode("contexts").alias("context"))
    counts = met.join(open_in.hint("merge"), "class").groupBy("set", "context").agg(F.sum("n").alias("n_resources"), F.min("first").alias("first_resource"))
    held = within_intervals(times.select("t").distinct(), "t", sets.select("user", "set", "from", "to"))
    return held.join(small(stored(kg["schedule"])), "t").join(counts.hint("merge"), ["set", "context"]).select("t", "user", "n_resources", "first_resource")
