"""Readers and writers of question, temporal, access and alignment data sets and of results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``); a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tessera"
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to ``scratch``; tables that were read from there can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x").rpartition("/")[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qa_source(examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, queries, query_graph)`` from ``examples(pos, id, question, q_entity, a_entity, answer, graph)``.

    Edges are distinct (h, r, t) with ``pos``, the first place that they were seen at; triples of fewer than three
    fields are dropped. Answers fall back from ``answer`` to ``answers``, if there is such a column, to ``a_entity``.
    """
    seen = examples.select("id", F.col("pos").alias("doc_pos"), F.posexplode("graph").alias("k", "x")).where(F.size("x") >= 3)
    seen = seen.select("id", "doc_pos", "k", F.col("x")[0].alias("s"), F.col("x")[1].alias("r"), F.col("x")[2].alias("o")).withColumn("edge_id", F.md5(F.concat_ws("|", "s", "r", "o")))
    edges = seen.groupBy("edge_id", "s", "r", "o").agg(F.min(F.struct("doc_pos", "k")).alias("pos"))
    answers = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in ("answer", "answers", "a_entity") if c in examples.columns])
    queries = examples.select(F.col("id").alias("qid"), "question", "q_entity", F.get(answers, F.lit(0)).alias("answer"), answers.alias("all_answers"))
    return edges, queries, seen.select(F.col("id").alias("qid"), "edge_id").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, pos, value)`` of the text files at ``path``: a line's number in its file, from 1, and its place among
    all lines, from 0, with files in the order of their names.

    A large file is read in blocks by many tasks. A task numbers what it reads in order, so a line's place within its block
    is its number less the block's first one; the blocks' sums, one row each, give the rest.
    """
    from ..operators.shared import small, stored

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_m"), "value")
    rows = stored(rows)  # so that numbers stay as they are
    blocks = rows.groupBy("file", "_start").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "_start", "_first", upto(Window.partitionBy("file").orderBy("_start")).alias("_in_file"), upto(Window.orderBy("file", "_start")).alias("_in_all"))
    within = F.col("_m") - F.col("_first")
    return rows.join(small(stored(offsets)), ["file", "_start"]).select("file", (within + F.col("_in_file") + 1).alias("line"), (within + F.col("_in_all")).alias("pos"), "value")


def write_lines(rows: DataFrame, path: str) -> None:
    """``rows(pos, value)`` as text files whose lines, file by file, are in the order of ``pos``; without ``pos`` in any order."""
    if "pos" in rows.columns:
        rows = rows.repartitionByRange("pos").sortWithinPartitions("pos")
    rows.select("value").write.text(path)


def choose_split(rows: DataFrame, column: str = "split", order: tuple[str, ...] = ("test", "validation", "train")) -> DataFrame:
    """The rows of the first split of ``order`` that there are any of."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    first = rows.where(place > 0).agg(F.min(place).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).where(place == F.col("_first")).drop("_first")


def temporal_source(lines: DataFrame) -> DataFrame:
    """``(head, rel, tail, ts)`` from ``lines(value)`` of four fields parted by white space; shorter lines are dropped."""
    f = F.split(F.trim("value"), "\\s+")
    return lines.where(F.size(f) >= 4).select(*[f[k].cast("long").alias(n) for k, n in enumerate(("head", "rel", "tail", "ts"))])


def temporal_queries(facts: DataFrame) -> DataFrame:
    """``facts(head, rel, tail, ts)`` as questions for the tail: ``(question, head, rel, answer, ts)``, all but ts as text."""
    text = {c: F.col(c).cast("string") for c in ("head", "rel", "tail")}
    question = F.format_string("(head=%d, rel=%d, ?, ts=%d)", "head", "rel", "ts")
    return facts.select(question.alias("question"), text["head"].alias("head"), text["rel"].alias("rel"), text["tail"].alias("answer"), "ts")


def access_triples(rows: DataFrame) -> DataFrame:
    """``(s, r, o, ts, conf, trust, age)`` from ``rows(s, r, o, t)``, whose time is text, and null where it is no number."""
    one = F.lit(1.0)
    return rows.select("s", "r", "o", safe_int(F.col("t")).cast("long").alias("ts"), one.alias("conf"), one.alias("trust"), F.lit(0.0).alias("age"))


def schedule_source(contexts: DataFrame) -> DataFrame:
    """``(t, context)`` from ``contexts(contexts)``, an array whose first element is time 1."""
    return contexts.select(F.posexplode("contexts").alias("k", "context")).select((F.col("k") + 1).cast("long").alias("t"), "context")


def safe_int(x: Column) -> Column:
    return x.try_cast("int")


def balanced_interleave(rows: DataFrame, label: str = "label", order: str = "pos") -> DataFrame:
    """``place``, from 1: positive (label 1), negative, positive, ... in the order of ``order`` for each, and then what is
    left of one of them. Labels are numbered by ranges of the order, not each in one task."""
    from ..operators.shared import numbered

    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    r = numbered(rows.withColumn("_positive", positive), F.desc("_positive"), F.col(order))  # positive ones come first
    n = rows.agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))  # one row
    r = r.crossJoin(F.broadcast(n)).withColumn("_k", F.col("position") - F.when(F.col("_positive"), 0).otherwise(F.col("_p")))
    short = F.least("_p", "_q")
    place = F.when(F.col("_k") <= short, F.col("_k") * 2 - F.col("_positive").cast("int")).otherwise(F.col("_k") + short)
    return r.withColumn("place", place.cast("long")).drop("_positive", "_p", "_q", "_k", "position")


def id_labels(lines: DataFrame) -> DataFrame:
    """``(id, label)`` from ``lines(value)`` of an id, a tab and a label or URI."""
    from ..functions.text import uri_name

    f = F.split("value", "\t")
    return lines.where(F.trim("value") != "").select(f[0].cast("long").alias("id"), uri_name(F.get(f, F.lit(1))).alias("label"))


def tab_numbers(lines: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Integer columns from tab-separated ``lines(value)``, and the columns ``keep`` as they are."""
    f = F.split("value", "\t")
    return lines.where(F.trim("value") != "").select(*keep, *[f[k].cast("long").alias(n) for k, n in enumerate(names)])


def integer_triples(lines: DataFrame) -> DataFrame:
    """``(pos, s, r, o)`` from ``lines(pos, value)`` of three numbers a line; the order of the lines counts."""
    return tab_numbers(lines, "s", "r", "o", keep=("pos",))


def numbered_bundle(read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Two graphs with numbers for names: ``read(name)`` gives the lines ``(pos, value)`` of the files of ids and labels,
    triples, seed pairs and test pairs."""
    ids = {f"{kind}{k}": id_labels(read(f"{file}_ids_{k}")) for kind, file in (("ent", "ent"), ("rel", "rel")) for k in (1, 2)}
    triples = {f"triples{k}": integer_triples(read(f"triples_{k}")) for k in (1, 2)}
    pairs = {name: tab_numbers(read(file), "e1", "e2") for name, file in (("seed", "sup_ent_ids"), ("test", "ref_ent_ids"))}
    return ids | triples | pairs


def dictionary(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(name, id)`` of the entities and of the relations of ``triples(s, r, o)``: numbers from 0 in the order of the names."""
    from ..operators.shared import numbered

    def ids(names: DataFrame) -> DataFrame:
        return numbered(names.distinct(), F.col("name")).select("name", (F.col("position") - 1).alias("id"))

    entities = triples.select(F.col("s").alias("name")).union(triples.select("o"))
    return ids(entities), ids(triples.select(F.col("r").alias("name")))


def named_bundle(triples: dict[int, DataFrame], attributes: dict[int, DataFrame], links: DataFrame | None = None, folds: tuple[DataFrame, DataFrame] | None = None, share: float = 0.3) -> dict[str, DataFrame]:
    """Two graphs of ``triples(pos, s, r, o)`` with URIs, dictionary-encoded.

    ``entK(id, name, label)``: the label is that of ``attributes(ent, attr, val, pos)``, else the URI's last part;
    ``triplesK(pos, s, r, o)`` are numbers. Seed and test pairs are those of ``folds``, two tables ``(e1, e2)``, or else
    ``links(pos, e1, e2)`` split by position; pairs with an unknown member are dropped.
    """
    from ..functions.text import uri_name

    out: dict[str, DataFrame] = {}
    for k, t in triples.items():
        entities, relations = dictionary(t)
        labels = attribute_labels(attributes[k]).withColumnRenamed("ent", "name")
        out[f"ent{k}"] = entities.join(labels.hint("merge"), "name", "left").select("id", "name", F.coalesce("label", uri_name(F.col("name"))).alias("label"))
        out[f"rel{k}"] = relations.select("id", uri_name(F.col("name")).alias("label"))
        end = lambda c, e=entities: e.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")).hint("merge")
        r = relations.select(F.col("name").alias("r"), F.col("id").alias("r_id")).hint("merge")
        out[f"triples{k}"] = t.join(end("s"), "s").join(end("o"), "o").join(r, "r").select("pos", F.col("s_id").alias("s"), F.col("r_id").alias("r"), F.col("o_id").alias("o"))
    if folds is None:
        split = positional_split(links, share)
        folds = split.where("split = 'seed'"), split.where("split = 'test'")
    e1, e2 = (out[f"ent{k}"].select(F.col("name").alias(f"e{k}"), F.col("id").alias(f"id{k}")).hint("merge") for k in (1, 2))
    for name, pairs in zip(("seed", "test"), folds, strict=True):
        out[name] = pairs.select("e1", "e2").join(e1, "e1").join(e2, "e2").select(F.col("id1").alias("e1"), F.col("id2").alias("e2"))
    return out


def attribute_labels(triples: DataFrame) -> DataFrame:
    """``(ent, label)``: the first non-empty value, by ``pos``, of an attribute whose name has "label" or "name" in it,
    without quotes, language tag and type."""
    value = F.trim(F.regexp_replace(F.regexp_replace(F.split("val", "\\^\\^")[0], "@[a-zA-Z-]+$", ""), '^"+|"+$', ""))
    t = triples.where(F.lower("attr").rlike("label|name")).select("ent", "pos", value.alias("label")).where("label <> ''")
    return t.groupBy("ent").agg(F.min_by("label", "pos").alias("label"))


def known_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``(e1, e2)`` whose members are both known."""
    return pairs.join(left.select(F.col("e").alias("e1")), "e1", "left_semi").join(right.select(F.col("e").alias("e2")), "e2", "left_semi")


def positional_split(pairs: DataFrame, share: float = 0.3) -> DataFrame:
    """``split``: seed for the first ``share`` of the pairs by ``pos`` (0 .. n - 1), test for the others."""
    n = pairs.agg(F.count("*").alias("_n"))
    return pairs.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("pos") < share * F.col("_n"), "seed").otherwise("test")).drop("_n")


def summary(edges: DataFrame, queries: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("n_triples"), F.countDistinct("r").alias("n_relations"))
    return e.crossJoin(queries.agg(F.count("*").alias("n_queries")))


def write_results(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.partitionBy("dataset").parquet(path)
    return path


def flattened(rows: DataFrame, column: str = "extra") -> DataFrame:
    """``rows`` with the fields of the struct ``column`` as columns ``x_field``."""
    names = rows.schema[column].dataType.names
    return rows.select(*[c for c in rows.columns if c != column], *[F.col(f"{column}.{n}").alias(f"x_{n}") for n in names])


def write_run(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A run's results as CSV with a header, one line for each query and ``extra`` flattened, and its summary as JSON."""
    flattened(rows).write.option("header", True).csv(f"{path}/rows")
    summary.write.json(f"{path}/summary")


def first_rows(rows: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The rows at the places 0 to n - 1; a place is a column's value, not the order in which rows are read."""
    return rows.where(F.col(order) < n)


def seeded_sample(rows: DataFrame, n: int, *key: str, seed: str = "sample-1") -> DataFrame:
    """``n`` rows without replacement: those whose digest of seed and ``key`` comes first, whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(digest, *key).limit(n)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("dataset", F.col("dataset").cast("string"))


def append_snapshot(metrics: DataFrame, path: str, snapshot_id: str) -> None:
    metrics.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(path)


def parsed_name(file: Column) -> Column:
    """``struct(method, dataset, tag)`` from a file name of the form ``method__dataset__tag.csv``."""
    base = F.split(F.regexp_replace(F.element_at(F.split(file, "/"), -1), "\\.[a-z]+$", ""), "__")
    return F.struct(F.get(base, F.lit(0)).alias("method"), F.get(base, F.lit(1)).alias("dataset"), F.array_join(F.slice(base, 3, 9), "__").alias("tag"))
