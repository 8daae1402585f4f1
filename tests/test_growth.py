"""What larger tables need: filters of keys, hubs, equal vectors from batches, paths that read alike."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import align, answer, graph, search, shared
from tessera.plans import registry
from tessera.sources import derived


def test_filter_of_keys_loses_none(spark):
    rows, keys = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("k")), spark.range(0, 4000, 40).select(F.concat(F.lit("n"), "id").alias("k"))
    kept = {r["k"] for r in shared.perhaps_among(rows, keys, "k").collect()}
    assert {r["k"] for r in keys.collect()} <= kept and len(kept) < 110


def test_hubs(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit("hub")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert [r["k"] for r in shared.hubs_of(rows, "k", "id").collect()] == ["hub"]


def test_vectors_of_batches(spark):
    texts = ["part:1 of_brand brand:Brand#12", "", None, "  ", "A b\tA  Äß", "x\x1cy", "w " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for dim in (16, 20, 8):
        got = rows.select(T.hash_vector(F.col("t"), dim).alias("a"), T.hash_vectors(F.col("t"), dim).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got) and len(got[0]["b"]) == dim


def test_paths_that_read_alike_are_scored_by_themselves(spark):
    step = lambda e: F.struct(F.lit(e).alias("edge_id"), F.lit("a").alias("s"), F.lit("r").alias("r"), F.lit("b").alias("o"))
    paths = spark.range(1).select(F.lit("q").alias("qid"), F.lit("a|r|b").alias("path"), F.explode(F.array(F.array(step("1")), F.array(step("2")))).alias("steps"))
    found = spark.createDataFrame([("q", "1"), ("q", "2")], "qid string, edge_id string")
    states = spark.createDataFrame([("q", "a", 2.0, 1.0), ("q", "b", 1.0, 1.0)], "qid string, node string, pos double, neg double")
    attention = spark.createDataFrame([("q", "a", "b", 0.5)], "qid string, src string, dst string, attn double")
    got = [r["score"] for r in graph.score_paths(paths, found, states, attention).collect()]
    assert got == [round(2 / 5 * 1 / 4 * 0.5, 9)] * 2


def test_counts_and_firsts_without_rounding_all():
    rng = np.random.default_rng(3)
    sims = np.round(rng.random((40, 300)), 2) + rng.choice([0, 4.9e-10, 5.1e-10, -4.9e-10], (40, 300))
    ids, own = pd.Series([f"c{x}" for x in rng.permutation(300)]), np.round(rng.random(40), 2)
    exact = np.round(sims, 9)
    assert (search.more_similar(sims, own) == (exact > own[:, None]).sum(1)).all()
    place, top = search.first_of(sims, ids)
    i, j = search.largest(exact, ids, 1)
    assert (place[i] == j).all() and (top == exact.max(1)).all()


def test_few_queries_in_many_cells_are_compared_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(search, "CELL", 30)
    monkeypatch.setattr(search, "CANDIDATE_ROWS", 40)
    q, c = rng.random((25, 16)), rng.random((300, 16))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, embedding array<double>")
    candidates = spark.createDataFrame([(f"c{j}", v.tolist()) for j, v in enumerate(c)], "cand string, embedding array<double>")
    g = search.grid(queries, candidates)
    together, pairs = search.merged(g, np.ones(g.most.shape, bool))
    assert (g.rows_q > 0).sum() > 4 and together.most.shape[0] == 1 and together.tiles()[pairs].sum() < g.tiles().sum() / 2
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 9)
    want = {(i, f"c{j}", r) for i in range(25) for r, j in enumerate(sorted(range(300), key=lambda j: (-sims[i, j], f"c{j}"))[:5], 1)}
    assert {(r["qid"], r["cand"], r["rank"]) for r in search.nearest(queries, candidates, 5).collect()} == want


def test_candidates_that_cells_do_not_part_are_few_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(search, "CELL", 30)
    monkeypatch.setattr(search, "CANDIDATE_ROWS", 20)
    q, c = rng.random((9, 16)), rng.random((400, 16))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, embedding array<double>")
    candidates = spark.createDataFrame([(f"c{j}", v.tolist()) for j, v in enumerate(c)], "cand string, embedding array<double>")
    rows, compare = [], search.compare

    def counted(g, *a, **b):
        out = shared.stored(compare(g, *a, **b))
        rows.append(out.count())
        return out

    monkeypatch.setattr(search, "compare", counted)
    got = {(r["qid"], r["cand"], r["rank"]) for r in search.nearest(queries, candidates, 20).collect()}
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 9)
    assert got == {(i, f"c{j}", r) for i in range(9) for r, j in enumerate(sorted(range(400), key=lambda j: (-sims[i, j], f"c{j}"))[:20], 1)}
    assert rows[-1] <= 9 * 20 * search.SHARES  # before, 20 for each query and tile of 20


def test_fusion_of_lists_is_that_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(align, "LIST", 3)
    edge = "s string, r string, o string, edge_id string"
    k1 = spark.createDataFrame([(f"a{i}", "r", f"h{j}", f"{i}{j}") for i in range(6) for j in range(4) if (i + j) % 3], edge)
    k2 = spark.createDataFrame([(f"x:a{i}", "r", f"x:h{j}", f"{i}{j}") for i in range(25) for j in range(4) if i * j % 4], edge)
    seeds = spark.createDataFrame([(f"h{j}", f"x:h{j}") for j in range(4)], "e1 string, e2 string")
    gold = spark.createDataFrame([(f"a{i}", f"x:a{i}") for i in range(6)], "e1 string, e2 string")
    rng = np.random.default_rng(7)
    a = spark.createDataFrame([(f"a{i}", v.tolist()) for i, v in enumerate(rng.random((6, 16)))], "e1 string, embedding array<double>")
    b = spark.createDataFrame([(f"x:a{i}", v.tolist()) for i, v in enumerate(rng.random((25, 16)))], "e2 string, embedding array<double>")
    lists = align.structural_lists(k1, k2, seeds, gold)
    assert lists.agg(F.max(F.size("cands"))).first()[0] < 20  # parts of a hub's neighbours
    pairs = align.structural_scores(k1, k2, seeds, gold)
    rows = lambda df: {(r["e1"], r["e2"]): r["score"] for r in df.collect()}
    got, rb, ra = rows(align.rank_fusion(a, b, lists, most=5)), align.ranked(pairs, "shared").collect(), search.nearest(a, b, 5, "e1", "e2").collect()
    by_text, by_structure = {(r["e1"], r["e2"]): r["rank"] for r in ra}, {(r["e1"], r["e2"]): r["rank"] for r in rb}
    assert got == {p: round(1 / (60 + by_text.get(p, 1000)) + 1 / (60 + by_structure.get(p, 1000)), 9) for p in by_text.keys() | by_structure.keys()}
    assert got == rows(align.rank_fusion(a, b, pairs, most=5))


def test_best_edges_of_hubs_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE_EDGES", 150)
    monkeypatch.setattr(graph, "TILE_TEXTS", 8)
    monkeypatch.setattr(graph, "SCORES", 500)
    edges = [(f"e{k:03}", f"u{k % 150}", "has_role", "hub", "U", "R", None, 1.0, k % 7 * 100.0, 1.0) for k in range(200)]
    edges += [(f"f{k:03}", "hub", "grants part", f"p{k}", "R", "P", None, 0.5, 0.0, 1.0) for k in range(300)]
    ends = spark.createDataFrame(edges, "edge_id string, s string, r string, o string, s_type string, o_type string, ts long, conf double, age double, trust double")
    ends = ends.withColumn("_back", F.col("o") == "hub").withColumn("node", F.lit("hub"))
    texts = spark.createDataFrame([(f"{i}", f"what role grants u{i} the p{i}", 0.4 * (i % 3)) for i in range(20)], "asked string, text string, relation_bias double")
    features = texts.select("asked", "relation_bias", T.content_tokens(F.col("text")).alias("q_tokens"), T.hash_vector(F.col("text"), graph.DIM).alias("q_vec"))
    nodes = texts.groupBy(F.lit("hub").alias("node")).agg(F.collect_set("asked").alias("asked"), F.collect_set(F.when(F.col("asked") > "15", F.col("asked"))).alias("back"))
    score = lambda c: graph.with_score(c, relation_bias=F.col("relation_bias"))
    some = graph.perhaps_best(ends, nodes, features, 10, (0.4, 0.3, 0.3), None)
    assert some.count() < 20 * 14  # of 300 or 500 edges for each text
    every = graph.with_features(ends).join(nodes.select("node", F.explode("asked").alias("asked"), "back"), "node").where("not _back or array_contains(back, asked)")
    best = lambda c: {(r["asked"], r["edge_id"], r["rank"], r["score"]) for r in search.top_k(score(c.join(features, "asked")), ["asked"], F.col("score"), ["edge_id"], 10).collect()}
    got = best(some.drop("at"))
    assert len(got) == 200 and got == best(every)


def test_paths_grow_where_the_edges_of_their_query_are(spark):
    rows = [("q1", f"n{a}", f"r{k}", f"n{(a * k + 1) % 7}", k) for a in range(6) for k in range(3)] + [("q2", "n1", "r", "n1", 5)]
    found = spark.createDataFrame(rows, "qid string, s string, r string, o string, ts long").selectExpr("*", "'A' AS s_type", "'B' AS o_type")
    anchors = spark.createDataFrame([("q1", "n1"), ("q1", "n2"), ("q2", "n1"), ("q3", "n1")], "qid string, node string")
    paths = graph.enumerate_paths(found, anchors, 3, 40, F.col("qid") == "q1")
    assert "Exchange" not in paths._jdf.queryExecution().executedPlan().toString()  # nothing is moved once they are together
    expected = set()
    for q, starts in (("q1", ("n1", "n2")), ("q2", ("n1",))):
        walk = [(s, r, o) for x, s, r, o, _ in rows if x == q] + [(o, "~" + r, s) for x, s, r, o, _ in rows if x == q == "q1"]
        now = sorted(((f"{s}|{r}|{o}", o) for s, r, o in walk if s in starts), key=lambda p: p[0].encode())[:40]
        every = list(now)
        for _ in range(2):
            now = sorted(((f"{p}|{r}|{o}", o) for p, at in now for s, r, o in walk if s == at), key=lambda p: p[0].encode())[:40]
            every += now
        expected |= {(q, p) for p, _ in every[:40]}
    got = paths.collect()
    assert {(r["qid"], r["path"]) for r in got} == expected and len(got) == 43
    assert all(r["path"] == "|".join([r["steps"][0]["s"], *[x for s in r["steps"] for x in (s["r"], s["o"])]]) for r in got)


def test_ids_survive_being_packed(spark):
    ids = ["00ff", "abc", "ABCD", "", None, "x1", "d41d8cd98f00b204e9800998ecf8427e", "Äß"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", shared.packed(F.col("x")).alias("b")).select("i", F.length("b").alias("n"), shared.unpacked(F.col("b")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == ids and got[6]["n"] == 17


def test_entities_that_nobody_names_are_not_moved(spark, monkeypatch):
    kg = spark.range(500).select(F.concat(F.lit("s"), "id").alias("s"), F.concat(F.lit("o"), "id").alias("o"))
    q = spark.createDataFrame([("a", "s7"), ("b", "o9"), ("c", "none"), ("d", None)], "qid string, anchor string")
    for most in (10, 1):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        assert {tuple(r) for r in graph.exact_anchors(q, kg, ["anchor"]).collect()} == {("a", "s7"), ("b", "o9")}


def test_candidates_of_two_hops_are_counted_without_pairs(spark):
    rng = np.random.default_rng(11)
    edge = lambda p, x, k: [(f"{p}n{a}", "r", f"{p}n{b}", str(i)) for i, (a, b) in enumerate(zip(rng.integers(0, x, k), rng.integers(0, x, k) % 23, strict=True))]
    k1, k2 = (spark.createDataFrame(edge(p, 60, 110), "s string, r string, o string, edge_id string") for p in ("", "x:"))
    seeds = spark.createDataFrame([(f"n{i}", f"x:n{j}") for i in range(0, 60, 3) for j in {i, (i * 7) % 60}], "e1 string, e2 string")
    anchors = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 2)], "e1 string")
    pairs = align.structural_scores(k1, k2, seeds, anchors, hops=2).groupBy("e1").agg(F.count("*").alias("n"), F.sum("shared").alias("total"))
    expected = {tuple(r) for r in pairs.collect()}
    assert len(expected) > 20
    for many, costly in ((1, 0), (2, 40), (4, 1_000_000), (1000, 0)):
        got = align.structural_counts(k1, k2, seeds, anchors, many=many, costly=costly)
        assert {tuple(r) for r in got.collect()} == expected, (many, costly)


def test_what_follows_from_an_edge_is_not_moved(spark, monkeypatch):
    rows = [(f"n{a}", f"rel {k}", f"n{(a * k + 1) % 30}", 0.5 + k / 10) for a in range(30) for k in range(4)] + [(f"n{a}", "at", "hub", 1.0) for a in range(30)]
    thin = spark.createDataFrame(rows, "s string, r string, o string, conf double").withColumn("ts", F.lit(None).cast("long"))
    follows = {"edge_id": F.md5(F.concat_ws("|", "s", "r", "o")), "s_type": F.lit("A"), "o_type": F.lit("B"), "age": F.lit(0.0), "trust": F.lit(1.0)}
    q = spark.createDataFrame([(f"q{i}", f"which rel {i % 3} at n{i}") for i in range(8)], "qid string, question string")
    a = spark.createDataFrame([(f"q{i}", f"n{3 * i}") for i in range(8)], "qid string, node string")
    whole = {tuple(r) for r in graph.retrieve(q, a, thin.withColumns(follows), top_k=4)[1].collect()}
    moved, perhaps_among = [], shared.perhaps_among
    monkeypatch.setattr(graph, "perhaps_among", lambda rows, *x: moved.append(rows.columns) or perhaps_among(rows, *x))
    for most, many in ((1000, 256), (1, 256), (1, 2)):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        monkeypatch.setattr(graph, "MANY_TEXTS", many)
        monkeypatch.setattr(graph, "hubs_of", lambda rows, *x: rows.sparkSession.createDataFrame([("hub",)], "node string"))
        assert {tuple(r) for r in graph.retrieve(q, a, thin, top_k=4, follows=follows)[1].collect()} == whole
    assert len(whole) > 40 and moved and not any("edge_id" in c or "s_type" in c for c in moved)


def test_paths_are_weighed_once_for_each_end(spark, monkeypatch):
    step = lambda s, r, o: F.struct(F.lit(s).alias("s"), F.lit(r).alias("r"), F.lit(o).alias("o"))
    paths = spark.range(400).select(F.lit("q").alias("qid"), F.col("id").cast("string").alias("path"), F.array(F.when(F.col("id") % 2 == 0, step("a", "r1", "tail one")).otherwise(step("a", "type.object.type", "tail one"))).alias("steps"), F.lit(0.5).alias("score"))
    features = graph.question_features(spark.createDataFrame([("q", "what is one")], "qid string, question string"))
    anchors, kept, stored = spark.createDataFrame([("q", "a")], "qid string, node string"), [], answer.stored
    monkeypatch.setattr(answer, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    got = {(int(r["path"]) % 2, r["score"]) for r in answer.rescore(paths, features, anchors).collect()}
    assert len(got) == 2 and kept[0].columns == ["qid", "end", "factor"] and kept[0].count() == 2


def test_edges_of_paths_are_moved_once(spark):
    found = spark.createDataFrame([("q", "a", "r", "b", None), ("q", "a", "s", "b", None), ("q", "b", "t", "c", 3)], "qid string, s string, r string, o string, ts long").selectExpr("*", "'A' AS s_type", "'B' AS o_type")
    walk = graph.steps(found)
    assert walk._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = walk.first()["walk"]
    assert {k: sorted(x["r"] for x in v) for k, v in got.items()} == {"a": ["r", "s"], "b": ["t", "~r", "~s"], "c": ["~t"]}


def test_paths_end_at_the_length_of_their_query(spark):
    rows = [(f"{k}", f"n{a}", "r", f"n{b}", None) for k in (1, 2, 4) for a in range(4) for b in range(4) if (a + b) % 3]
    found = spark.createDataFrame(rows, "qid string, s string, r string, o string, ts long").selectExpr("*", "'A' AS s_type", "'B' AS o_type")
    anchors = spark.createDataFrame([(k, "n0") for k in "124"], "qid string, node string")
    for cap in (2, 7, 30, 5000):
        every = graph.enumerate_paths(found, anchors, 4, 5000).select("qid", "path", F.size("steps").alias("n")).where("n <= cast(qid AS int)").collect()
        expected = {k: sorted(((r["n"], r["path"]) for r in every if r["qid"] == k))[:cap] for k in "124"}
        if cap < 5000:  # the cap holds after each step
            step = lambda k, n: [p for m, p in sorted((r["n"], r["path"]) for r in every if r["qid"] == k) if m == n]
            for k in "124":
                kept, out = step(k, 1)[:cap], []
                for n in range(1, int(k) + 1):
                    out += [(n, p) for p in kept]
                    kept = [p for p in step(k, n + 1) if any(p.startswith(f"{x}|") for x in kept)][:cap]
                expected[k] = out[:cap]
        got = graph.enumerate_paths(found, anchors, 4, cap, own_length=F.col("qid").cast("int")).select("qid", "path", F.size("steps").alias("n")).collect()
        assert {k: sorted((r["n"], r["path"]) for r in got if r["qid"] == k) for k in "124"} == expected


def test_long_lists_are_not_broadcast_for_being_few(spark, monkeypatch):
    lists = spark.range(40).select(F.col("id").cast("string").alias("asked"), F.lit("n").alias("at"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct(F.concat("id", F.lit("-"), k).alias("edge_id"), (k / 10).alias("score"))).alias("edges"))
    at = spark.range(60).select(F.col("id").alias("qid"), (F.col("id") % 50).cast("string").alias("asked"), F.lit("n").alias("at"))
    expected = {(q, f"{q % 50}-{k}") for q in range(60) if q % 50 < 40 for k in range(1, 6)}
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(shared.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    for most, whole in ((400, True), (100, False)):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        sent.clear()
        got = {(r["qid"], r["edge_id"]) for r in graph.from_lists(at, lists, None).collect()}
        assert got == expected
        assert any(df.count() == 40 for df in sent if "edges" in df.columns) == whole


def test_own_graphs_come_with_their_edges(spark, monkeypatch):
    rows = [(f"n{a}", f"rel {k}", f"n{(a * k + 1) % 30}", 0.5 + k / 10) for a in range(30) for k in range(4)]
    thin = spark.createDataFrame(rows, "s string, r string, o string, conf double").withColumn("ts", F.lit(None).cast("long"))
    follows = {"edge_id": F.md5(F.concat_ws("|", "s", "r", "o")), "s_type": F.lit("A"), "o_type": F.lit("B"), "age": F.lit(0.0), "trust": F.lit(1.0)}
    q = spark.createDataFrame([(f"q{i}", f"which rel {i % 3} at n{i}") for i in range(8)], "qid string, question string")
    a = spark.createDataFrame([(f"q{i}", f"n{3 * i}") for i in range(8)], "qid string, node string")
    own = thin.crossJoin(q.select("qid")).where("crc32(concat(qid, s, r, o)) % 3 > 0")
    ids = own.withColumns(follows).select("qid", "edge_id")
    for most in (1000, 1):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        monkeypatch.setattr(shared.small, "__defaults__", (most,))
        for both in (True, False):
            whole = {tuple(r) for r in graph.retrieve(q, a, thin.withColumns(follows), top_k=4, bidirectional=both, allowed=ids)[1].collect()}
            got = graph.retrieve(q, a, thin.limit(0), top_k=4, bidirectional=both, allowed=own, follows=follows)[1]  # the graph isn't read
            assert {tuple(r) for r in got.collect()} == whole and len(whole) > 20
        near = lambda: {(r["qid"], r["s"], r["r"], r["o"]) for r in graph.adjacent(a, thin).collect()}
        assert near() == {(f"q{i}", s, r, o) for i in range(8) for s, r, o, _ in rows if f"n{3 * i}" in (s, o)}
    assert {tuple(r) for r in graph.own_nodes(thin, own).collect()} == {tuple(r) for r in graph.own_nodes(thin.withColumns(follows), ids).collect()}


def test_queries_of_equal_vectors_are_looked_up_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    c = rng.random((300, 16)) - 0.3
    vectors = spark.createDataFrame([(f"n{j}", v.tolist()) for j, v in enumerate(c)] + [("none", None)], "node string, vector array<double>")
    for kinds in (2, 20):  # few go to where the candidates are, more meet them in tiles
        q = rng.random((kinds, 16)) - 0.3
        queries = spark.createDataFrame([(i, q[i % kinds].tolist()) for i in range(40)] + [(40, None)], "qid int, vector array<double>")
        seen, nearest = [], search.nearest
        monkeypatch.setattr(graph, "nearest", lambda x, *a, **b: seen.append(x.count()) or nearest(x, *a, **b))
        sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 9)
        got = {(r["qid"], r["node"]) for r in graph.semantic_anchors(queries, vectors, 5).collect()}
        assert got == {(i, f"n{j}") for i in range(40) for j in sorted(range(300), key=lambda j: (-sims[i % kinds, j], f"n{j}"))[:5]}
        assert seen == [kinds + 1]  # and the one without a vector


def test_entities_from_keys(spark, tmp_path):
    t = {"customer": "1L c_custkey, 2 c_nationkey", "supplier": "5L s_suppkey, 3 s_nationkey", "nation": "2 n_nationkey, 0 n_regionkey", "part": "7L p_partkey, 'B#1' p_brand"}
    t |= {"orders": "9L o_orderkey, 4L o_custkey, timestamp'2024-01-01' o_orderdate", "lineitem": "8L l_orderkey, cast(null AS long) l_partkey, 6L l_suppkey, 0.1D l_discount, timestamp'2024-01-01' l_shipdate"}
    for name, columns in t.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    nodes = {r["node"] for r in graph.entities(derived.star_kg(spark, str(tmp_path))).collect()} - {None}
    assert {r["node"] for r in derived.star_entities(spark, str(tmp_path)).collect()} == nodes and "order:8" in nodes
    assert {r["node"] for r in derived.star_entities(spark, str(tmp_path), "order").collect()} == {x for x in nodes if not x.startswith("order:")}


def test_own_graphs_are_whole(spark, tmp_path):
    t = {"customer": "id c_custkey, 2 c_nationkey", "supplier": "id s_suppkey, 3 s_nationkey", "nation": "id n_nationkey, 0 n_regionkey", "part": "id * 50 p_partkey, 'B#1' p_brand"}
    t |= {"orders": "id o_orderkey, id % 4 * 50 o_custkey, timestamp'2024-01-01' o_orderdate", "lineitem": "id % 20 l_orderkey, id % 3 * 50 l_partkey, id % 7 l_suppkey, 0.1D l_discount, timestamp'2024-01-01' l_shipdate"}
    for name, columns in t.items():
        spark.range(20 if name != "lineitem" else 60).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    _, _, own, _ = registry.q_graph.own_graphs(spark, str(tmp_path))
    edges = {(r["s"], r["r"], r["o"]) for r in derived.star_kg(spark, str(tmp_path)).collect()}
    expected = set()
    for q in {f"part:{k * 50}" for k in range(20)} | {"customer:0"}:
        near = {q} | {x for s, _, o in edges if q in (s, o) for x in (s, o)}
        expected |= {(q, *e) for e in edges if e[0] in near}
    got = [(r["qid"], r["s"], r["r"], r["o"]) for r in own.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert "md5(qid" not in registry.q_graph.OWN_WHOLE and "LIKE 'order:%'" not in registry.q_graph.OWN_WHOLE


def test_ranks_by_threshold_are_those_by_score(spark):
    rng = np.random.default_rng(12)
    v, w = np.round(rng.random((30, 4)) - 0.2, 1), np.round(rng.random((200, 4)) - 0.2, 1)  # many ties
    w[0] = 0
    a = spark.createDataFrame([(f"a{i}", x.tolist()) for i, x in enumerate(v)], "e1 string, embedding array<double>")
    b = spark.createDataFrame([(f"b{j}", x.tolist()) for j, x in enumerate(w)], "e2 string, embedding array<double>")
    gold = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(30)], "e1 string, e2 string")
    parts = {(i, j): float(rng.integers(1, 5)) / 4 for i in range(30) for j in rng.integers(0, 200, 12)}
    some = spark.createDataFrame([(f"a{i}", f"b{j}", x) for (i, j), x in parts.items()], "e1 string, e2 string, part double")
    n = lambda x: np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
    sims = np.round(n(v) @ n(w).T, 9)
    part = np.array([[parts.get((i, j), 0.0) for j in range(200)] for i in range(30)])
    for alpha in (0.5, 0.25):
        score = np.floor((alpha * (sims + 1) / 2 + (1 - alpha) * part) * 1e9 + 0.5) / 1e9
        expected = {(f"a{i}", 1 + int((score[i] > score[i, i]).sum()), min(f"b{j}" for j in np.nonzero(score[i] == score[i].max())[0])) for i in range(30)}
        got = align.gold_rank(a, b, gold, some, alpha)
        assert {(r["e1"], r["rank"], r["top"]) for r in got.collect()} == expected


def test_signatures_of_some_and_of_hubs(spark, monkeypatch):
    edges = [(f"n{k % 60}", f"r{k % 3}", f"hub{k % 2}", f"{k * 2654435761 % (1 << 32):08x}") for k in range(600)]
    kg = spark.createDataFrame(edges, "s string, r string, o string, edge_id string")
    labels = spark.createDataFrame([(f"n{k}", f"name {k}") for k in range(59)] + [("hub0", "H"), ("hub1", "I"), ("lone", "L")], "e string, label string")
    name = {r["e"]: r["label"] for r in labels.collect()}
    line = lambda rows, say: [say(*x[:3]) for x in sorted(rows, key=lambda x: x[3])[:8]]
    expected = {e: " | ".join([n, *line([x for x in edges if x[0] == e], lambda s, r, o: f"{r} {name.get(o, '?')}"), *line([x for x in edges if x[2] == e], lambda s, r, o: f"{name.get(s, '?')} {r}")]) for e, n in name.items()}
    moved, perhaps_among = [], shared.perhaps_among
    monkeypatch.setattr(align, "perhaps_among", lambda *x: moved.append(x[2]) or perhaps_among(*x))
    some = spark.createDataFrame([("n3",), ("hub1",), ("lone",), ("n3",)], "e string")
    for most in (1000, 1):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        assert {r["e"]: r["signature"] for r in align.signatures(kg, labels).collect()} == expected
        got = align.signatures(kg, labels, of=some).collect()
        assert {r["e"]: r["signature"] for r in got} == {e: expected[e] for e in ("n3", "hub1", "lone")} and len(got) == 3
    assert moved == ["e", "e"]
    low = align.first_edges(kg.select(F.col("o").alias("e"), "edge_id"), 8)
    assert {(r["e"], r["edge_id"], r["k"]) for r in low.collect()} == {(o, x[3], k) for o in ("hub0", "hub1") for k, x in enumerate(sorted((x for x in edges if x[2] == o), key=lambda x: x[3])[:8], 1)}
