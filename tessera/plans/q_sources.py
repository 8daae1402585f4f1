"""Queries on sources: derived tables are written in a data set's file format and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import derived, files
from ..sources.derived import ACCESS, PAIR, PRED, table
from ..streaming import resume
from .q_graph import EVENTS, event_kg
from .registry import query


@query("""WITH x AS (SELECT o_orderkey AS id, 'order:' || o_orderkey AS s, 'placed_by' AS r, 'customer:' || o_custkey AS o FROM orders UNION ALL SELECT o_orderkey, 'customer:' || c_custkey, 'from_nation', 'nation:' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT s, r, o, min(id) AS first_id, count(DISTINCT id) AS n_queries FROM x GROUP BY s, r, o""")
def qa_source(spark: SparkSession, d: str) -> DataFrame:
    """A-1, A-2, H-3: one example for each order, as JSON in two splits, of which the test split is read."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("n"))
    o = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    customer = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    graph = F.array(
        F.array(derived.entity("order", "o_orderkey"), F.lit("placed_by"), customer),
        F.array(customer, F.lit("from_nation"), F.concat(F.lit("nation:"), "n")),
        F.array(F.lit("too"), F.lit("short")),
    )
    e = o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.lit("whose order is it").alias("question"), F.array(derived.entity("order", "o_orderkey")).alias("q_entity"), F.array(customer).alias("a_entity"), F.array().cast("array<string>").alias("answer"), graph.alias("graph"))
    path = files.scratch(spark, "qa")
    e.withColumn("split", F.explode(F.array(F.lit("test"), F.lit("train")))).write.partitionBy("split").json(path)
    back = files.choose_split(spark.read.schema("pos long, id string, question string, q_entity array<string>, a_entity array<string>, answer array<string>, graph array<array<string>>, split string").json(path))
    edges, _, members = files.qa_source(back)
    n = members.groupBy("edge_id").agg(F.count("*").alias("n_queries"))
    return edges.join(n.hint("merge"), "edge_id").select("s", "r", "o", F.col("pos.doc_pos").alias("first_id"), "n_queries")


@query("""SELECT o_orderkey::VARCHAR AS qid, 'whose order is it' AS question, 'order:' || o_orderkey AS entity,
  CASE o_orderkey % 4 WHEN 0 THEN 'customer:' || o_custkey WHEN 1 THEN 'no ' || o_custkey WHEN 2 THEN 'nation:' || c_nationkey END AS answer,
  CASE o_orderkey % 4 WHEN 0 THEN 'customer:' || o_custkey || ' also ' || o_custkey WHEN 1 THEN 'no ' || o_custkey WHEN 2 THEN 'nation:' || c_nationkey END AS all_answers FROM orders JOIN customer ON c_custkey = o_custkey""")
def qa_answers(spark: SparkSession, d: str) -> DataFrame:
    """A-1: the questions of JSON examples with their answer and all answers, taken from ``answer``, else ``answers``, else
    ``a_entity``; each of them is null or empty in some examples, and in a quarter all are."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("n"))
    o = table(spark, d, "orders").join(c.hint("merge"), F.col("c_custkey") == F.col("o_custkey"))
    kind, key = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    strings = lambda *x: F.array(*x).cast("array<string>")
    e = o.select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit("whose order is it").alias("question"),
        F.array(derived.entity("order", "o_orderkey")).alias("q_entity"),
        F.when(kind == 0, strings(F.concat(F.lit("customer:"), key), F.concat(F.lit("also "), key))).when(kind == 1, strings()).alias("answer"),
        F.when(kind == 1, strings(F.concat(F.lit("no "), key))).when(kind == 3, strings()).alias("answers"),
        F.when(kind != 3, strings(F.concat(F.lit("nation:"), "n"))).alias("a_entity"),
        F.array().cast("array<array<string>>").alias("graph"),
    )
    path = files.scratch(spark, "qa")
    e.write.json(path)
    back = spark.read.schema("pos long, id string, question string, q_entity array<string>, a_entity array<string>, answer array<string>, answers array<string>, graph array<array<string>>").json(path)
    q = files.qa_source(back)[1]
    return q.select("qid", "question", F.get("q_entity", F.lit(0)).alias("entity"), "answer", F.array_join("all_answers", " ").alias("all_answers"))


@query(f"WITH {EVENTS} SELECT split_part(s, ':', 2)::BIGINT AS head, length(r)::BIGINT AS rel, split_part(o, ':', 2)::BIGINT AS tail, ts FROM ek")
def temporal_source(spark: SparkSession, d: str) -> DataFrame:
    """A-3, H-1: facts and queries from text files of four numbers a line."""
    e = event_kg(spark, d)
    line = F.concat_ws("\t", F.split_part("s", F.lit(":"), F.lit(2)), F.length("r").cast("string"), F.concat(F.split_part("o", F.lit(":"), F.lit(2)), F.lit(" ")), F.col("ts").cast("string"))
    path = files.scratch(spark, "temporal")
    e.select(line.alias("value"), F.when(F.col("event_id") % 10 < 8, "train").when(F.col("event_id") % 10 == 8, "valid").otherwise("test").alias("split")).write.partitionBy("split").text(path)
    read = lambda split: files.temporal_source(spark.read.text(f"{path}/split={split}"))
    return read("train").unionByName(read("valid")).unionByName(read("test"))


@query(f"WITH {EVENTS}, q AS (SELECT split_part(s, ':', 2)::BIGINT AS h, length(r)::BIGINT AS rel, split_part(o, ':', 2)::BIGINT AS o, ts FROM ek WHERE event_id % 10 = 9) SELECT '(head=' || h || ', rel=' || rel || ', ?, ts=' || ts || ')' AS question, h::VARCHAR AS head, rel::VARCHAR AS rel, o::VARCHAR AS answer, ts FROM q")
def temporal_questions(spark: SparkSession, d: str) -> DataFrame:
    """A-3: the test facts as questions for their tails."""
    e = event_kg(spark, d).where("event_id % 10 = 9")
    line = F.concat_ws(" ", F.split_part("s", F.lit(":"), F.lit(2)), F.length("r").cast("string"), F.split_part("o", F.lit(":"), F.lit(2)), F.col("ts").cast("string"))
    path = files.scratch(spark, "temporal")
    e.select(line.alias("value")).write.text(path)
    return files.temporal_queries(files.temporal_source(spark.read.text(path)))


@query(f"""WITH {ACCESS}, x AS (SELECT user AS s, 'has_role' AS r, role AS o, t AS ts FROM has_role UNION ALL SELECT role, 'revoked_at', role, t FROM revoked UNION ALL SELECT role, 'grants', resource, NULL FROM grants
UNION ALL SELECT resource, 'governed_by', policy, NULL FROM governed_by UNION ALL SELECT policy, 'valid_in', context, NULL FROM valid_in)
SELECT r, count(*) AS n, count(DISTINCT s) AS n_subjects, count(ts) AS n_timed, min(ts) AS first_ts, max(o) AS last_object, 1.0::DOUBLE AS trust FROM x GROUP BY r""")
def access_triples(spark: SparkSession, d: str) -> DataFrame:
    """A-4: the graph of roles, grants and policies as one JSON file of triples, with times as text or without."""
    kg = derived.access_kg(spark, d)
    none, c = F.lit(None).cast("string"), F.col
    parts = [
        kg["has_role"].select(c("user").alias("s"), F.lit("has_role").alias("r"), c("role").alias("o"), c("t").cast("string").alias("t")),
        kg["revoked"].select(c("role").alias("s"), F.lit("revoked_at").alias("r"), c("role").alias("o"), c("t").cast("string").alias("t")),
        kg["grants"].select(c("role").alias("s"), F.lit("grants").alias("r"), c("resource").alias("o"), none.alias("t")),
        kg["governed_by"].select(c("resource").alias("s"), F.lit("governed_by").alias("r"), c("policy").alias("o"), F.lit("none").alias("t")),
        kg["valid_in"].select(c("policy").alias("s"), F.lit("valid_in").alias("r"), c("context").alias("o"), none.alias("t")),
    ]
    path = files.scratch(spark, "triples")
    for p in parts:
        p.write.mode("append").json(path)
    x = files.access_triples(spark.read.schema("s string, r string, o string, t string").json(path))
    return x.groupBy("r").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"), F.count("ts").alias("n_timed"), F.min("ts").alias("first_ts"), F.max("o").alias("last_object"), F.min("trust").alias("trust"))


@query(f"WITH {ACCESS} SELECT q.qid, q.user, q.resource, q.t, s.context, c.n AS n_contexts FROM requests q JOIN schedule s ON s.t = q.t, (SELECT max(t) AS n FROM schedule) c")
def access_source(spark: SparkSession, d: str) -> DataFrame:
    """A-4: requests and the schedule as JSON; a time is an index into the schedule from 1."""
    kg = derived.access_kg(spark, d)
    path = files.scratch(spark, "access")
    kg["requests"].withColumn("timestamp", F.col("t").cast("string")).drop("t").write.json(f"{path}/requests")
    contexts = kg["schedule"].agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "context"))), lambda x: x["context"]).alias("contexts"))  # one row, as long as the time span
    contexts.write.json(f"{path}/schedule")
    schedule = files.schedule_source(spark.read.schema("contexts array<string>").json(f"{path}/schedule"))
    requests = spark.read.schema("qid long, user string, resource string, timestamp string").json(f"{path}/requests").withColumn("t", files.safe_int(F.col("timestamp")).cast("long"))
    n = schedule.agg(F.max("t").alias("n_contexts"))
    return requests.join(schedule.hint("merge"), "t").crossJoin(F.broadcast(n)).select("qid", "user", "resource", "t", "context", "n_contexts")


@query(f"WITH {PRED}, k AS (SELECT qid, gold, row_number() OVER (PARTITION BY gold ORDER BY qid) AS k FROM pred) SELECT qid, gold, row_number() OVER (ORDER BY k * 2 - gold) AS place FROM k")
def balanced_interleave(spark: SparkSession, d: str) -> DataFrame:
    """A-5."""
    return files.balanced_interleave(derived.predictions(spark, d).select("qid", "gold"), "gold", "qid")


@query("SELECT s_suppkey AS ent, s_name AS label FROM supplier")
def attr_labels(spark: SparkSession, d: str) -> DataFrame:
    """A-10: quoted, typed and tagged values of attributes, of which the first with a name counts."""
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("ent"), F.posexplode(F.array(
        F.struct(F.lit("acctbal").alias("attr"), F.col("s_acctbal").cast("string").alias("val")),
        F.struct(F.lit("rdfs#Label").alias("attr"), F.lit('""@en').alias("val")),
        F.struct(F.lit("foaf:name").alias("attr"), F.concat(F.lit('"'), "s_name", F.lit('"@en')).alias("val")),
        F.struct(F.lit("altName").alias("attr"), F.lit('"other"^^<http://string>').alias("val")),
    )).alias("pos", "x"))
    path = files.scratch(spark, "attributes")
    rows.select("ent", "x.attr", "x.val", "pos").write.parquet(path)
    return files.attribute_labels(spark.read.parquet(path))


@query(f"WITH {PAIR}, p AS (SELECT n AS pos, e1, e2 FROM pairs JOIN names ON names.e = e1 WHERE e1 LIKE 'part:%'), c AS (SELECT count(*) AS n FROM part), known AS (SELECT s AS e FROM k2 UNION SELECT o FROM k2) SELECT pos, e1, e2, CASE WHEN pos < 0.3 * n THEN 'seed' ELSE 'test' END AS split FROM p, c WHERE e2 IN (SELECT e FROM known)")
def pair_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A-7, A-8, A-9: tab-separated pairs, split by position, those with unknown members dropped."""
    b = derived.pair_kg(spark, d)
    path = files.scratch(spark, "pairs")
    n = F.split_part("e1", F.lit(":"), F.lit(2))
    b["pairs"].where("e1 like 'part:%'").select(F.concat_ws("\t", n, n).alias("value")).write.text(path)
    pairs = files.tab_numbers(spark.read.text(path), "pos", "other").select("pos", F.concat(F.lit("part:"), "pos").alias("e1"), F.concat(F.lit("x:part:"), "other").alias("e2"))
    split = files.positional_split(pairs)
    known2 = b["k2"].select(F.col("s").alias("e")).union(b["k2"].select("o")).distinct()
    return files.known_pairs(split, b["ent1"], known2).select("pos", "e1", "e2", "split")


def lines_of(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``(pos, value)``: ``rows(pos, value)`` or ``rows(value)`` written as text files and read again; ``pos`` is a line's
    place in the files, nothing that was written."""
    path = files.scratch(spark, name)
    files.write_lines(rows, path)
    return files.numbered_lines(spark, path).select("pos", "value")


NUMBERED = f"{PAIR}, n1 AS (SELECT *, row_number() OVER (ORDER BY edge_id) - 1 AS pos FROM k1)"


@query(f"""WITH {NUMBERED}, l AS (SELECT 'part:' || p_partkey AS e, p_name AS label FROM part UNION ALL SELECT 'supplier:' || s_suppkey, split_part(s_name, '#', 2) FROM supplier)
SELECT pos, a.label AS head, n1.r AS relation, b.label AS tail, (SELECT count(*) FROM pairs WHERE split = 'seed') AS n_seed, (SELECT count(*) FROM pairs WHERE split = 'test') AS n_test FROM n1 JOIN l a ON a.e = n1.s JOIN l b ON b.e = n1.o""")
def numbered_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A-7, A-8: two graphs as files of numbers - ids with labels, triples, seed and test pairs - read as one bundle."""
    from ..operators.shared import numbered, stored

    b = derived.pair_kg(spark, d)
    number = lambda e: F.element_at(F.split(e, ":"), -1).try_cast("long") + 1
    key = lambda e: F.when(e.contains("supplier:"), -number(e)).when(e.contains("part:"), number(e)).otherwise(F.lit(10**12) + F.coalesce(number(e), F.lit(0)))
    relation = lambda r: F.when(r == "of_brand", 0).when(r == "supplied_by", 1).otherwise(2)
    line = lambda *x: F.concat_ws("\t", *[c.cast("string") for c in x])
    c = F.col
    named = {}
    for k, kg, ents in ((1, b["k1"], b["ent1"]), (2, b["k2"], b["ent2"])):
        edges = numbered(kg, c("edge_id"))
        named[f"triples_{k}"] = edges.select((c("position") - 1).alias("pos"), line(key(c("s")), relation(c("r")), key(c("o"))).alias("value"))
        named[f"ent_ids_{k}"] = ents.select(line(key(c("e")), c("label")).alias("value"))
        named[f"rel_ids_{k}"] = kg.select("r").distinct().select(line(relation(c("r")), F.concat(F.lit("http://x/"), "r")).alias("value"))
    for file, split in (("sup_ent_ids", "seed"), ("ref_ent_ids", "test")):
        named[file] = b["pairs"].where(c("split") == split).select(line(key(c("e1")), key(c("e2"))).alias("value"))
    found = files.numbered_bundle(lambda name: lines_of(spark, named[name], name))
    label = lambda t, name: found[t].select(c("id").alias(name), c("label").alias(f"{name}_label")).hint("merge")
    t = found["triples1"].join(label("ent1", "s"), "s").join(label("ent1", "o"), "o").join(label("rel1", "r"), "r")
    n = stored(found["seed"].agg(F.count("*").alias("n_seed")).crossJoin(found["test"].agg(F.count("*").alias("n_test"))))  # one row
    return t.crossJoin(F.broadcast(n)).select("pos", c("s_label").alias("head"), F.translate("r_label", " ", "_").alias("relation"), c("o_label").alias("tail"), "n_seed", "n_test")


@query(f"""WITH {NUMBERED}, e AS (SELECT DISTINCT e FROM (SELECT s AS e FROM k1 UNION ALL SELECT o FROM k1)), ids AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM e), rels AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS id FROM (SELECT DISTINCT r FROM k1)),
f2 AS (SELECT DISTINCT e FROM (SELECT s AS e FROM k2 UNION ALL SELECT o FROM k2)), p AS (SELECT e1, n FROM pairs JOIN names ON names.e = e1 JOIN f2 ON f2.e = e2 WHERE e1 LIKE 'part:%' AND e1 IN (SELECT e FROM e)), parts AS (SELECT count(*) AS n FROM part),
seeds AS (SELECT e1 FROM p, parts WHERE p.n < 0.3 * parts.n)
SELECT pos, a.id AS s, r.id AS r, b.id AS o, CASE WHEN l.s_name IS NULL THEN n1.s ELSE l.s_name END AS label, n1.s IN (SELECT e1 FROM seeds) AS seed
FROM n1 JOIN ids a ON a.e = n1.s JOIN ids b ON b.e = n1.o JOIN rels r ON r.r = n1.r LEFT JOIN supplier l ON 'supplier:' || l.s_suppkey = n1.s""")
def named_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A-9: two graphs of names, encoded in the order of the names, with labels from attributes and pairs split by position."""
    from ..operators.shared import numbered

    b = derived.pair_kg(spark, d)
    triples = {k: lines_triples(spark, numbered(b[f"k{k}"], F.col("edge_id")).select((F.col("position") - 1).alias("pos"), "s", "r", "o")) for k in (1, 2)}
    s = table(spark, d, "supplier")
    attributes = {k: s.select(F.concat(F.lit(p), derived.entity("supplier", "s_suppkey")).alias("ent"), F.lit("rdfs#Label").alias("attr"), F.concat(F.lit('"'), "s_name", F.lit('"@en')).alias("val"), F.lit(0).alias("pos")) for k, p in ((1, ""), (2, "x:"))}
    key = F.split_part("e1", F.lit(":"), F.lit(2)).cast("long")
    found = files.named_bundle(triples, attributes, b["pairs"].where("e1 like 'part:%'").select(key.alias("pos"), "e1", "e2"))
    seed = found["seed"].select(F.col("e1").alias("s"), F.lit(True).alias("seed"))
    t = found["triples1"].join(found["ent1"].select(F.col("id").alias("s"), "label").hint("merge"), "s").join(seed.hint("merge"), "s", "left")
    return t.select("pos", "s", "r", "o", "label", F.coalesce("seed", F.lit(False)).alias("seed"))


@query(f"""WITH {NUMBERED}, e AS (SELECT DISTINCT e FROM (SELECT s AS e FROM k1 UNION ALL SELECT o FROM k1)), ids AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM e),
f AS (SELECT DISTINCT e FROM (SELECT s AS e FROM k2 UNION ALL SELECT o FROM k2)), ids2 AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM f)
SELECT a.id AS e1, b.id AS e2, split FROM pairs JOIN ids a ON a.e = e1 JOIN ids2 b ON b.e = e2""")
def fold_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A-9 with fold files: seed and test pairs are read from files of their own, names and all; unknown ones are dropped."""
    from ..operators.shared import numbered

    b = derived.pair_kg(spark, d)
    triples = {k: lines_triples(spark, numbered(b[f"k{k}"], F.col("edge_id")).select((F.col("position") - 1).alias("pos"), "s", "r", "o")) for k in (1, 2)}
    none = spark.createDataFrame([], "ent string, attr string, val string, pos int")
    f = F.split("value", "\t")

    def fold(split: str) -> DataFrame:
        lines = lines_of(spark, b["pairs"].where(F.col("split") == split).select(F.concat_ws("\t", "e1", "e2").alias("value")), split)
        return lines.select(f[0].alias("e1"), f[1].alias("e2"))

    found = files.named_bundle(triples, {1: none, 2: none}, folds=(fold("seed"), fold("test")))
    return found["seed"].withColumn("split", F.lit("seed")).unionByName(found["test"].withColumn("split", F.lit("test")))


def lines_triples(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Triples of names as tab-separated lines, and read again."""
    f = F.split("value", "\t")
    return lines_of(spark, rows.select("pos", F.concat_ws("\t", "s", "r", "o").alias("value")), "names").select("pos", f[0].alias("s"), f[1].alias("r"), f[2].alias("o"))


@query(f"WITH {PRED} SELECT qid, em, abstained AS x_abstained, latency_ms AS x_latency, (SELECT round(avg(em), 6) FROM pred) AS exact_match, (SELECT count(*) FROM pred) AS n FROM pred")
def results_sink(spark: SparkSession, d: str) -> DataFrame:
    """A-12: one CSV line for each query, with what is extra flattened, and the summary as JSON."""
    p = derived.predictions(spark, d)
    path = files.scratch(spark, "run")
    rows = p.select("qid", "em", F.struct("abstained", F.col("latency_ms").alias("latency")).alias("extra"))
    files.write_run(rows, p.agg(F.round(F.avg("em"), 6).alias("exact_match"), F.count("*").alias("n")), path)
    back = spark.read.option("header", True).schema("qid long, em int, x_abstained boolean, x_latency double").csv(f"{path}/rows")
    return back.crossJoin(F.broadcast(spark.read.schema("exact_match double, n long").json(f"{path}/summary")))


@query("SELECT doc_id AS pos, lang FROM documents WHERE doc_id < 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """F-12: the first hundred places."""
    return files.first_rows(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "lang"), 100)


@query(f"WITH {PAIR} SELECT e1, e2 FROM pairs WHERE split = 'test' ORDER BY md5('sample-1:' || e1), e1 LIMIT 500")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """F-13: five hundred test pairs without replacement."""
    return files.seeded_sample(derived.pair_kg(spark, d)["pairs"].where("split = 'test'").select("e1", "e2"), 500, "e1")


@query("SELECT page_id AS id, trim(replace(regexp_extract(trim(coalesce(url, '')), '[^/#]+$'), '_', ' ')) AS label FROM pages")
def id_label_file(spark: SparkSession, d: str) -> DataFrame:
    """A-6."""
    path = files.scratch(spark, "ids")
    table(spark, d, "pages").select(F.concat_ws("\t", F.col("page_id").cast("string"), "url").alias("value")).write.text(path)
    return files.id_labels(spark.read.text(path))


@query(f"WITH {PRED} SELECT 'm-' || method AS method, dataset, 'local__seed0' AS tag, count(*) AS n, round(avg(em), 6) AS em FROM pred GROUP BY ALL")
def results_source(spark: SparkSession, d: str) -> DataFrame:
    """A-13: result files whose names say method, data set and tag."""
    path = files.scratch(spark, "results")
    p = derived.predictions(spark, d).withColumn("file", F.concat(F.lit("m-"), "method", F.lit("__"), "dataset", F.lit("__local__seed0.csv")))
    p.select("qid", "em", "file").write.partitionBy("file").option("header", True).csv(path)
    rows = spark.read.option("header", True).schema("qid long, em int, file string").csv(path)
    return rows.select("em", files.parsed_name(F.col("file")).alias("f")).groupBy("f.method", "f.dataset", "f.tag").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"))


# ---------------------------------------------------------------- resumable runs


def turns(rows: DataFrame) -> DataFrame:
    """What stands for answering: the number of words of a turn."""
    return rows.select("conv_id", "turn", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\s]+"), lambda w: w != "")).cast("long").alias("n_words"))


ANSWERS = "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s]+'), lambda w: w <> '')) AS n_words FROM conversations"


@query(ANSWERS)
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """I-1, I-2: a run that was broken off half way, and then resumed twice."""
    q, path = table(spark, d, "conversations"), files.scratch(spark, "answers")
    turns(q.where("conv_id % 2 = 0")).write.parquet(path)
    resume.resume(q, path, turns, "conv_id", "turn")
    return resume.resume(q, path, turns, "conv_id", "turn")


@query(ANSWERS)
def resume_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """I-1 with chunks: a run that fails in its third chunk, and is then taken up again."""
    q, path = table(spark, d, "conversations"), files.scratch(spark, "chunks")
    every, begun = max(1, -(-q.count() // 6)), []

    def failing(rows: DataFrame) -> DataFrame:
        begun.append(rows)
        if len(begun) == 3:
            raise InterruptedError("the third chunk fails")
        return turns(rows)

    try:
        resume.in_chunks(q, path, failing, every, "conv_id", "turn")
    except InterruptedError:
        pass
    return resume.in_chunks(q, path, turns, every, "conv_id", "turn")


@query(ANSWERS)
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """I-3: the same as a stream of files, run twice with one checkpoint."""
    path, at = files.scratch(spark, "stream"), files.scratch(spark, "checkpoint")
    source = f"{d}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    resume.stream_answers(spark, source, schema, path, at, turns, "conv_id", "turn")
    return resume.stream_answers(spark, source, schema, path, at, turns, "conv_id", "turn")
