"""Graphs, requests and predictions derived from the star schema, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def days(ts: str) -> Column:
    return F.unix_date(F.to_date(F.col(ts))).cast("long")


def draw(x: Column) -> Column:
    """A number from 0 to 2^32 - 1 that only the text ``x`` decides."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


#: Columns of an edge table.
EDGE = ["edge_id", "s", "r", "o", "s_type", "o_type", "ts", "conf", "age", "trust"]


def star_triples(spark: SparkSession, d: str, by_part: bool = False) -> DataFrame:
    """``(s, r, o, ts, conf, last)``: what of the star schema's graph has to be gathered; all distinct. ``by_part``: what is
    supplied lies together by part, so that a part's first edges are found where they are."""
    t = lambda name: table(spark, d, name)
    none, one = F.lit(None).cast("long").alias("ts"), F.lit(1.0).alias("conf")

    def triple(df: DataFrame, s: Column, r: str, o: Column, ts: Column = none, conf: Column = one) -> DataFrame:
        return df.select(s.alias("s"), F.lit(r).alias("r"), o.alias("o"), ts.alias("ts"), conf.alias("conf"))

    orders, lineitem = t("orders"), t("lineitem")
    contains = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_shipdate").alias("at"), F.min("l_discount").alias("disc"))
    supplied = (lineitem.select("l_partkey", "l_suppkey", "l_discount").repartition("l_partkey") if by_part else lineitem).groupBy("l_partkey", "l_suppkey").agg(F.min("l_discount").alias("disc"))
    parts = [
        triple(t("customer"), entity("customer", "c_custkey"), "from_nation", entity("nation", "c_nationkey")),
        triple(t("supplier"), entity("supplier", "s_suppkey"), "from_nation", entity("nation", "s_nationkey")),
        triple(t("nation"), entity("nation", "n_nationkey"), "in_region", entity("region", "n_regionkey")),
        triple(t("part"), entity("part", "p_partkey"), "of_brand", F.concat(F.lit("brand:"), F.col("p_brand"))),
        triple(orders, entity("order", "o_orderkey"), "placed_by", entity("customer", "o_custkey"), days("o_orderdate")),
        triple(contains, entity("order", "l_orderkey"), "contains", entity("part", "l_partkey"), days("at"), 1 - F.col("disc")),
        triple(supplied, entity("part", "l_partkey"), "supplied_by", entity("supplier", "l_suppkey"), conf=1 - F.col("disc")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    last = orders.agg(F.max(days("o_orderdate")).alias("last"))  # one row
    return out.crossJoin(F.broadcast(last))


def star_follows() -> dict[str, Column]:
    """What of an edge follows from its triple: it needn't be stored or moved, ids are most of a stored edge."""
    return {
        "edge_id": F.md5(F.concat_ws("|", "s", "r", "o")),
        "s_type": F.initcap(F.substring_index("s", ":", 1)),
        "o_type": F.initcap(F.substring_index("o", ":", 1)),
        "age": F.coalesce((F.col("last") - F.col("ts")).cast("double"), F.lit(0.0)),
        "trust": F.when(F.col("r") == "contains", 0.5).otherwise(1.0),
    }


def star_edges(triples: DataFrame) -> DataFrame:
    """Typed edges with ids and provenance, of ``star_triples`` alone."""
    return triples.withColumns(star_follows()).select(*EDGE)


def star_kg(spark: SparkSession, d: str) -> DataFrame:
    """Typed, timed triples with provenance from the star schema; all distinct."""
    return star_edges(star_triples(spark, d))


def star_entities(spark: SparkSession, d: str, *but: str) -> DataFrame:
    """``(node)``: the entities of ``star_triples``, but for some kinds. They are made distinct as the tables' keys, which are
    fewer and shorter than the ends of all edges."""
    t = lambda name: table(spark, d, name)
    keys = {
        "customer": [("customer", "c_custkey"), ("orders", "o_custkey")],
        "supplier": [("supplier", "s_suppkey"), ("lineitem", "l_suppkey")],
        "nation": [("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")],
        "region": [("nation", "n_regionkey")],
        "part": [("part", "p_partkey"), ("lineitem", "l_partkey")],
        "order": [("orders", "o_orderkey"), ("lineitem", "l_orderkey")],
        "brand": [("part", "p_brand")],
    }
    out = None
    for kind, places in keys.items():
        if kind not in but:
            parts = [t(name).select(F.col(c).alias("key")) for name, c in places]
            rows = reduce(DataFrame.union, parts).where("key is not null").distinct().select(entity(kind, "key").alias("node"))
            out = rows if out is None else out.union(rows)
    return out


STAR = """
raw AS (
  SELECT 'customer:' || c_custkey AS s, 'from_nation' AS r, 'nation:' || c_nationkey AS o, NULL::BIGINT AS ts, 1.0::DOUBLE AS conf FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'from_nation', 'nation:' || s_nationkey, NULL, 1.0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey, NULL, 1.0 FROM nation
  UNION ALL SELECT 'part:' || p_partkey, 'of_brand', 'brand:' || p_brand, NULL, 1.0 FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE), 1.0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, date_diff('day', DATE '1970-01-01', min(l_shipdate)::DATE), 1 - min(l_discount) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, NULL, 1 - min(l_discount) FROM lineitem GROUP BY l_partkey, l_suppkey),
last AS (SELECT max(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) AS last FROM orders),
star AS (
  SELECT md5(s || '|' || r || '|' || o) AS edge_id, s, r, o,
         upper(s[1]) || split_part(substr(s, 2), ':', 1) AS s_type, upper(o[1]) || split_part(substr(o, 2), ':', 1) AS o_type,
         ts, conf, coalesce((last - ts)::DOUBLE, 0.0) AS age, CASE WHEN r = 'contains' THEN 0.5 ELSE 1.0 END AS trust
  FROM raw, last)
"""


def star_queries(spark: SparkSession, d: str) -> DataFrame:
    """``(qid, question, anchor)``: every part and customer whose key is divisible by 50 is asked about."""
    part = table(spark, d, "part").where("p_partkey % 50 = 0").select(entity("part", "p_partkey").alias("anchor"), F.lit("which brand of part is it and who supplied it").alias("question"))
    customer = table(spark, d, "customer").where("c_custkey % 50 = 0").select(entity("customer", "c_custkey").alias("anchor"), F.lit("from what nation is the customer and what was placed").alias("question"))
    return part.unionByName(customer).select(F.col("anchor").alias("qid"), "question", "anchor")


STAR_QUERIES = """
questions AS (
  SELECT 'part:' || p_partkey AS qid, 'which brand of part is it and who supplied it' AS question, 'part:' || p_partkey AS anchor FROM part WHERE p_partkey % 50 = 0
  UNION ALL SELECT 'customer:' || c_custkey, 'from what nation is the customer and what was placed', 'customer:' || c_custkey FROM customer WHERE c_custkey % 50 = 0)
"""


def event_time(ts: str = "ts") -> Column:
    return (F.unix_date(F.to_date(F.col(ts))) - F.unix_date(F.lit("2024-01-01").cast("date")) + 1).cast("long")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def access_kg(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Roles, revocations, grants, policies, contexts, the schedule and requests, from events and parts."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", event_time().alias("t"), prop_k().alias("k"))
    part = table(spark, d, "part")
    role, user = F.concat(F.lit("role:"), (F.col("k") % 12).cast("string")), entity("u", "user_id")
    grants = part.select(F.explode(F.array(F.col("p_partkey") % 12, F.col("p_partkey") * 7 % 12)).alias("n"), entity("part", "p_partkey").alias("resource"))
    policies = part.select((F.col("p_size") % 10).alias("i")).distinct()
    times = events.select("t").distinct()
    resources = part.agg(F.count("*").alias("n"))  # one row
    requests = events.where("event_type = 'view'").crossJoin(F.broadcast(resources))
    return {
        "has_role": events.where("event_type = 'signup'").select(user.alias("user"), role.alias("role"), "t").distinct(),
        "revoked": events.where("event_type = 'error' and event_id % 400 = 0").groupBy(role.alias("role")).agg(F.min("t").alias("t")),
        "grants": grants.select(F.concat(F.lit("role:"), F.col("n").cast("string")).alias("role"), "resource").distinct(),
        "governed_by": part.select(entity("part", "p_partkey").alias("resource"), F.concat(F.lit("pol:"), (F.col("p_size") % 10).cast("string")).alias("policy")),
        "valid_in": policies.select("i", F.explode(F.array(3 * F.col("i") % 8, (F.col("i") + 5) % 8)).alias("c")).select(F.concat(F.lit("pol:"), F.col("i").cast("string")).alias("policy"), F.concat(F.lit("ctx:"), F.col("c").cast("string")).alias("context")).distinct(),
        "schedule": times.select("t", F.concat(F.lit("ctx:"), (F.col("t") % 8).cast("string")).alias("context")),
        "requests": requests.select(F.col("event_id").alias("qid"), user.alias("user"), F.concat(F.lit("part:"), ((2 * F.col("k") + 1) % F.col("n")).cast("string")).alias("resource"), "t"),
    }


ACCESS = """
ev AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS t, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
has_role AS (SELECT DISTINCT 'u:' || user_id AS user, 'role:' || (k % 12) AS role, t FROM ev WHERE event_type = 'signup'),
revoked AS (SELECT 'role:' || (k % 12) AS role, min(t) AS t FROM ev WHERE event_type = 'error' AND event_id % 400 = 0 GROUP BY ALL),
grants AS (SELECT DISTINCT 'role:' || unnest([p_partkey % 12, p_partkey * 7 % 12]) AS role, 'part:' || p_partkey AS resource FROM part),
governed_by AS (SELECT 'part:' || p_partkey AS resource, 'pol:' || (p_size % 10) AS policy FROM part),
valid_in AS (SELECT DISTINCT 'pol:' || i AS policy, 'ctx:' || unnest([3 * i % 8, (i + 5) % 8]) AS context FROM (SELECT DISTINCT p_size % 10 AS i FROM part)),
schedule AS (SELECT DISTINCT t, 'ctx:' || (t % 8) AS context FROM ev),
requests AS (SELECT event_id AS qid, 'u:' || user_id AS user, 'part:' || ((2 * k + 1) % (SELECT count(*) FROM part)) AS resource, t FROM ev WHERE event_type = 'view')
"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as predictions with a confidence, a method and a data set."""
    docs = table(spark, d, "documents").drop("text")
    p = table(spark, d, "labels").join(docs, "doc_id").withColumn("confidence", (F.col("n_chars") % 1000) / 1000.0)
    p = p.withColumn("pred", (F.col("confidence") > 0.3).cast("int"))
    return p.select(
        F.col("doc_id").alias("qid"),
        F.col("source").alias("method"),
        F.col("lang").alias("dataset"),
        "confidence",
        F.col("quality").cast("int").alias("gold"),
        "pred",
        (F.col("pred") == F.col("quality")).cast("int").alias("em"),
        F.greatest((F.col("pred") == F.col("quality")).cast("double"), F.col("n_chars") % 7 / 10.0).alias("f1"),
        (F.col("n_chars") / 100.0).alias("latency_ms"),
        (F.col("n_chars") % 12).cast("int").alias("rank"),
        (F.col("n_chars") % 20 == 0).alias("abstained"),
    )


PRED = """
pred AS (
  SELECT doc_id AS qid, source AS method, lang AS dataset, (n_chars % 1000) / 1000.0::DOUBLE AS confidence, quality::INT AS gold,
         CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE > 0.3 THEN 1 ELSE 0 END AS pred,
         (CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE > 0.3 THEN 1 ELSE 0 END = quality)::INT AS em,
         greatest((CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE > 0.3 THEN 1 ELSE 0 END = quality)::INT::DOUBLE, (n_chars % 7) / 10.0::DOUBLE) AS f1,
         n_chars / 100.0::DOUBLE AS latency_ms, (n_chars % 12)::INT AS rank, n_chars % 20 = 0 AS abstained
  FROM labels JOIN documents USING (doc_id))
"""


def pair_ids() -> dict[str, Column]:
    """The ids of the edges of ``pair_kg``, which follow from their triples; an edge of the copy has its original's."""
    plain = lambda c: F.substring(c, 3, 1 << 30)
    return {"k1": star_follows()["edge_id"], "k2": F.md5(F.concat_ws("|", plain("s"), "r", plain("o")))}


def pair_kg(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two graphs to align: parts and suppliers with brands and nations, and a thinned copy with other names."""
    kg = star_edges(star_triples(spark, d, by_part=True)).where("r in ('of_brand', 'supplied_by') or (r = 'from_nation' and s like 'supplier:%')")
    k1 = kg.select("s", "r", "o", "edge_id")
    k2 = k1.where(~F.substring(F.md5(F.concat(F.lit("2"), F.col("edge_id"))), 1, 1).isin("0", "1", "2")).select(F.concat(F.lit("x:"), F.col("s")).alias("s"), "r", F.concat(F.lit("x:"), F.col("o")).alias("o"), "edge_id")
    names = table(spark, d, "part").select(entity("part", "p_partkey").alias("e"), F.col("p_name").alias("label"), F.col("p_partkey").alias("n"))
    names = names.unionByName(table(spark, d, "supplier").select(entity("supplier", "s_suppkey").alias("e"), F.col("s_name").alias("label"), F.col("s_suppkey").alias("n")))
    flipped = F.array_join(F.reverse(F.split("label", " ")), " ")
    ent2 = names.select(F.concat(F.lit("x:"), F.col("e")).alias("e"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("Q"), F.col("n").cast("string"))).otherwise(flipped).alias("label"))
    pairs = names.select(F.col("e").alias("e1"), F.concat(F.lit("x:"), F.col("e")).alias("e2"), F.when(F.col("n") % 10 < 3, "seed").otherwise("test").alias("split"))
    return {"k1": k1, "k2": k2, "ent1": names.select("e", "label"), "ent2": ent2, "pairs": pairs}


PAIR = (
    STAR
    + """,
k1 AS (SELECT s, r, o, edge_id FROM star WHERE r IN ('of_brand', 'supplied_by') OR (r = 'from_nation' AND s LIKE 'supplier:%')),
k2 AS (SELECT 'x:' || s AS s, r, 'x:' || o AS o, edge_id FROM k1 WHERE substr(md5('2' || edge_id), 1, 1) NOT IN ('0', '1', '2')),
names AS (SELECT 'part:' || p_partkey AS e, p_name AS label, p_partkey AS n FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_suppkey FROM supplier),
ent1 AS (SELECT e, label FROM names),
ent2 AS (SELECT 'x:' || e AS e, CASE WHEN n % 3 = 0 THEN 'Q' || n ELSE array_to_string(list_reverse(string_split(label, ' ')), ' ') END AS label FROM names),
pairs AS (SELECT e AS e1, 'x:' || e AS e2, CASE WHEN n % 10 < 3 THEN 'seed' ELSE 'test' END AS split FROM names)
"""
)
