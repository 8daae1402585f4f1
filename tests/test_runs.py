"""Generators that fail, runs in chunks that break off, and streams that run a batch again."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import generate, search
from tessera.streaming import resume


def test_a_failing_prompt_fails_alone(spark):
    def load():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("bad prompt")
            return [p.upper() for p in prompts] if "short" not in prompts else []

        return run

    rows = [(i, "bad one" if i == 3 else "short" if i == 5 else None if i == 7 else f"p{i}", "x") for i in range(20)]
    got = {r["qid"]: r for r in generate.generated(spark.createDataFrame(rows, "qid long, prompt string, other string").repartition(2), load, batch=6).collect()}
    assert len(got) == 20 and {i for i, r in got.items() if r["raw"] is None} == {3, 5, 7}
    assert got[3]["error"] == "ValueError: bad prompt" and got[5]["error"] == "0 results for 1 items" and got[7]["error"] is None
    assert got[4]["raw"] == "P4" and got[4]["error"] is None and got[4]["other"] == "x"
    assert generate.generated(spark.createDataFrame([], "qid long, prompt string"), load).count() == 0


def test_a_text_that_cannot_be_encoded_has_no_vector(spark):
    def encode(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", None, "a"])], "id long, text string")
    got = {r["id"]: r["vector"] for r in search.encode_distinct(rows, "text", encode).collect()}
    assert got == {0: [1.0], 1: None, 2: [3.0], 3: None, 4: [1.0]}


def test_chunks_are_done_once(spark, tmp_path):
    """It fails in the third chunk, goes on from there, and takes in what comes later."""
    q = spark.range(100).withColumnRenamed("id", "qid")
    asked = []

    def answer(rows):
        asked.append(sorted(r["qid"] for r in rows.collect()))
        if len(asked) == 3:
            raise InterruptedError
        return rows.select("qid", (F.col("qid") * 2).alias("twice"))

    path = f"file://{tmp_path}/run"
    with pytest.raises(InterruptedError):
        resume.in_chunks(q, path, answer, 20, "qid")
    first, broken = asked[:2], asked[2]
    assert sorted(r["qid"] for r in resume.in_chunks(q, path, answer, 20, "qid").collect()) == list(range(100))
    assert asked[3] == broken and all(x not in asked[3:] for x in first) and sum(map(len, asked)) == 100 + len(broken)
    n = len(asked)
    more = spark.range(110).withColumnRenamed("id", "qid")
    got = resume.in_chunks(more, path, answer, 20, "qid").collect()
    assert sorted((r["qid"], r["twice"]) for r in got) == [(i, 2 * i) for i in range(110)]
    assert sorted(x for a in asked[n:] for x in a) == list(range(100, 110))
    assert resume.in_chunks(more, path, answer, 20, "qid").count() == 110 and len(asked) == n + 1
    assert resume.in_chunks(q.limit(0), f"{path}-none", answer, 20, "qid").count() == 0


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    source, path, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "at"))
    q = spark.range(40).withColumnRenamed("id", "qid").repartition(4)
    q.write.parquet(source)
    static, tries = spark.createDataFrame([(i, i * i) for i in range(40)], "qid long, square long"), []

    def answer(rows):
        tries.append(rows)
        out = rows.join(static, "qid")
        if len(tries) == 2:
            resume_path = f"{path}/batch=000000001"
            out.limit(3).write.mode("overwrite").parquet(resume_path)  # a batch that was written in part
            raise RuntimeError("lost")
        return out

    with pytest.raises(Exception, match="lost"):
        resume.stream_batches(spark, source, q.schema, path, at, answer, 1)
    got = resume.stream_batches(spark, source, q.schema, path, at, answer, 1).collect()
    assert sorted((r["qid"], r["square"]) for r in got) == [(i, i * i) for i in range(40)]
    spark.range(40, 45).withColumnRenamed("id", "qid").coalesce(1).write.mode("append").parquet(source)
    static = spark.createDataFrame([(i, i * i) for i in range(50)], "qid long, square long")
    assert resume.stream_batches(spark, source, q.schema, path, at, answer, 1).count() == 45
