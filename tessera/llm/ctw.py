"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions (from the highest bit); each decision has a node of its own, and each node a context
tree over the bytes before it, of depth ``DEPTH``. Every node of the tree counts the zeros and ones seen in its context
and has their Krichevsky-Trofimov estimate; weighting mixes, from the deepest context up, a node's own estimate with
the product of its children's:  Pw = 1/2 Pkt + 1/2 prod Pw(children),  and Pw = Pkt at full depth.

The probability of a decision is, from full depth up, w Pkt + (1 - w) P(child), with w = Pkt / (2 Pw), and w = 1 at full
depth. A context that was never seen has no counts, and its estimate and mixture are one half.

**No context is left out**, however many there are, and no task or driver holds them all. Texts are dealt into parts of
``PART`` bytes; a part's distinct grams (a byte and the DEPTH bytes before it) go, in packed arrays, to buckets hashed
from the two latest bytes of context, so that a bucket holds every node of depth 2 and more below its contexts. A
bucket sums its grams, gives the nodes of depth 1 their share (65,280 sums, the only collected table, of that size for
any corpus), gets the mixture of depths 0 and 1 back, carries it down to every gram, and sends each part the
probabilities of its own grams. A part then reads its texts with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, release_memory, stored

DEPTH = 5
HALF = float(np.log(0.5))
#: Bytes of text of one part, about, and grams that one array may hold before it is summed or written.
PART, LIMIT = 24_000_000, 2_000_000
#: Words whose counts every task gets; the others are looked up in a shuffled join.
HEAD_WORDS = 65_536
FOLDS, HELD_OUT = 5, 1
END = b"\x00"
#: Bytes that are handled at once.
BATCH = 1 << 20


def give_back() -> None:
    """What ``release_memory`` does, for Arrow's own memory too."""
    pa.default_memory_pool().release_unused()
    release_memory()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another as bytes, each after DEPTH zero bytes of context and with an end byte, and their lengths."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() + END for t in texts]
    return np.frombuffer(b"".join(END * DEPTH + p for p in parts), np.uint8), np.array([len(p) for p in parts])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and their ends one number: the DEPTH bytes before it, the latest highest, and the byte."""
    data, lengths = stream(texts)
    n = len(data) - DEPTH
    g = np.zeros(n, np.int64)
    for k in range(1, DEPTH + 1):
        g = (g << 8) | data[DEPTH - k : DEPTH - k + n]
    g = (g << 8) | data[DEPTH:]
    keep = np.ones(len(data), bool)
    starts = np.concatenate(([0], np.cumsum(lengths + DEPTH)[:-1]))
    for k in range(DEPTH):
        keep[starts + k] = False  # bytes of context only
    return g[keep[DEPTH:]], lengths


def batches(texts: pd.Series) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def packed(x: np.ndarray) -> bytes:
    """Integers as bytes, those of equal place together."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


def summed(g: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and the sums of their counts."""
    g, n = np.concatenate(g), np.concatenate(n)
    order = np.argsort(g, kind="stable")
    g = g[order]
    starts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1)) if len(g) else np.zeros(0, np.int64)
    return g[starts], np.add.reduceat(n[order], starts) if len(g) else n


def in_parts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a number each, ``row``, so that rows with equal ids stay apart, and the number of their ``part``."""
    task = TaskContext.get().partitionId()
    row, part, size = task << 33, task << 20, 0
    for batch in found:
        ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        parts = part + ends // PART
        rows = np.arange(row, row + len(parts))
        if len(parts):
            row, size = row + len(parts), int(ends[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(parts, pa.int64())], names=[*batch.schema.names, "row", "part"])
    give_back()


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each gram by its two latest bytes of context, which a multiplier spreads."""
    return ((((g >> 32) * 40503) & 0xFFFF) * buckets) >> 16


def count_grams(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """``(bucket, part, g, n)``: the distinct grams of a part's texts, and how often the training texts have them."""
    part, held, size = None, [], 0

    def out() -> Iterator[pd.DataFrame]:
        g, n = summed([x[0] for x in held], [x[1] for x in held])
        at = bucket_of(g, buckets)
        order = np.argsort(at, kind="stable")
        g, n, at = g[order], n[order], at[order]
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(g)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        yield pd.DataFrame({"bucket": [int(at[a]) for a, _ in spans], "part": part, "g": [packed(g[a:b]) for a, b in spans], "n": [packed(n[a:b]) for a, b in spans]})

    for frame in frames:
        for p, rows in frame.groupby("part", sort=False):
            if held and p != part:
                yield from out()
                held, size = [], 0
            part, at = p, 0
            for texts in batches(rows["text"]):
                g, lengths = grams(texts)
                learned = np.repeat(~rows["held_out"].iloc[at : at + len(texts)].to_numpy(bool), lengths)
                at += len(texts)
                held.append(np.unique(g[learned], return_counts=True))
                other = np.unique(g[~learned])
                held.append((other, np.zeros(len(other), np.int64)))
                size += len(held[-1][0]) + len(held[-2][0])
                if size > LIMIT and size > 2 * len(held[0][0]):
                    held = [summed([x[0] for x in held], [x[1] for x in held])]
                    size = len(held[0][0])
    if held:
        yield from out()
    del held
    give_back()


def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of the texts with their counts; ``None`` stands for the ends."""
    total: dict[bytes, int] = {}
    ends = 0
    for frame in frames:
        for t in frame["text"]:
            ends += 1
            for w in words(t):
                total[w] = total.get(w, 0) + 1
            if len(total) > 500_000:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = {}
    yield pd.DataFrame({"word": [*total, None], "n": [*total.values(), ends]})
    del total
    give_back()


def levels(g: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """By depth, from DEPTH to 2: distinct grams with that much context, their counts, and where they are one depth above."""
    out: dict = {}
    for depth in range(DEPTH, 1, -1):
        up = None
        if depth > 2:
            above, up = np.unique(((g >> 16) << 8) | (g & 255), return_inverse=True)
        out[depth] = g, n, up
        if depth > 2:
            g, n = above, np.bincount(up, n, len(above))
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones, G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1)), as its log."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln G(x) for x >= 1/2, by Stirling's series at x + 6."""
    y = x + 6
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


class Nodes:
    """The nodes of one decision ``k`` at one depth: ``of`` says which one a gram meets, ``first`` is a gram of each."""

    def __init__(self, g: np.ndarray, n: np.ndarray, k: int):
        prefix = g >> (8 - k)
        change = prefix[1:] != prefix[:-1]
        self.first = np.concatenate(([0], np.flatnonzero(change) + 1))
        self.of = np.concatenate(([0], np.cumsum(change)))
        self.bit = (g >> (7 - k)) & 1
        self.b = np.bincount(self.of, n * self.bit, len(self.first))
        self.a = np.bincount(self.of, n, len(self.first)) - self.b
        self.weigh(None)

    def weigh(self, below: np.ndarray | None) -> None:
        kt = log_kt(self.a, self.b)
        self.pw = kt if below is None else HALF + np.logaddexp(kt, below)
        self.w = np.exp(kt + HALF - self.pw)


def weighted(by_depth: dict, k: int) -> tuple[dict[int, Nodes], dict[int, np.ndarray]]:
    """The nodes of a decision by depth, with their weights, and each node's parent."""
    nodes, parent = {}, {}
    for depth in range(DEPTH, 1, -1):
        nodes[depth] = x = Nodes(by_depth[depth][0], by_depth[depth][1], k)
        if depth < DEPTH:
            below = nodes[depth + 1]
            parent[depth + 1] = x.of[by_depth[depth + 1][2][below.first]]
            x.weigh(np.bincount(parent[depth + 1], below.pw, len(x.first)))
    return nodes, parent


def top_node(g: np.ndarray, k: int) -> np.ndarray:
    """The node of depth 1 (latest byte and decision) above grams with two bytes of context."""
    return ((g >> 16) << 8) + (1 << k) + ((g & 255) >> (8 - k))


def sum_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(bucket, g, n, node, a, b, below)``: each bucket's distinct grams, and a task's sums for the nodes of depth 1."""
    sums = np.zeros((3, 1 << 16))

    def out(bucket: int, held: list) -> Iterator[pd.DataFrame]:
        g, n = summed([x[0] for x in held], [x[1] for x in held])
        by_depth = levels(g, n)
        for k in range(8):
            x = weighted(by_depth, k)[0][2]
            at = top_node(by_depth[2][0][x.first], k)
            for row, values in zip(sums, (x.a, x.b, x.pw), strict=True):
                row += np.bincount(at, values, 1 << 16)
        for c in range(0, len(g), LIMIT):
            yield pd.DataFrame({"bucket": [bucket], "g": [packed(g[c : c + LIMIT])], "n": [packed(n[c : c + LIMIT])], "node": -1, "a": 0.0, "b": 0.0, "below": 0.0})

    bucket, held, size = None, [], 0
    for frame in frames:
        for b, g, n in zip(frame["bucket"], frame["g"], frame["n"], strict=True):
            if b != bucket and held:
                yield from out(bucket, held)
                held, size = [], 0
            bucket = b
            held.append((unpacked(g), unpacked(n)))
            size += len(held[-1][0])
            if size > 2 * LIMIT and size > 2 * len(held[0][0]):  # memory stays in proportion to what is distinct
                held = [summed([x[0] for x in held], [x[1] for x in held])]
                size = len(held[0][0])
    if held:
        yield from out(bucket, held)
    at = np.flatnonzero(sums[0] + sums[1])
    yield pd.DataFrame({"bucket": -1, "g": None, "n": None, "node": at, "a": sums[0][at], "b": sums[1][at], "below": sums[2][at]})
    del held
    give_back()


def top_mixture(node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each node of depth 1 what depths 0 and 1 add to the mixture, and the share that they leave to what is below."""
    sums = np.zeros((3, 256, 256))
    sums[:, node >> 8, node & 255] = a, b, below
    a, b, below = sums
    kt = log_kt(a, b)
    pw = HALF + np.logaddexp(kt, below)
    known = a + b > 0
    w, own = np.where(known, np.exp(kt + HALF - pw), 0.0), (b + 0.5) / (a + b + 1)
    a0, b0 = a.sum(0), b.sum(0)
    kt0 = log_kt(a0, b0)
    w0, own0 = np.exp(kt0 - np.logaddexp(kt0, np.where(known, pw, 0).sum(0))), (b0 + 0.5) / (a0 + b0 + 1)
    left = 1 - w0
    return np.stack([w0 * own0 + left * w * own, left * (1 - w)]).reshape(2, -1)


def log10_probabilities(g: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context, for all grams of a bucket."""
    by_depth, total = levels(g, n), np.zeros(len(g))
    for k in range(8):
        nodes, parent = weighted(by_depth, k)
        mixed, left = top[:, top_node(by_depth[2][0][nodes[2].first], k)]
        for depth in range(2, DEPTH + 1):
            x = nodes[depth]
            if depth > 2:
                mixed, left = mixed[parent[depth]], left[parent[depth]]
            known = x.a + x.b > 0
            w, own = np.where(known, x.w if depth < DEPTH else 1.0, 0.0), (x.b + 0.5) / (x.a + x.b + 1)
            mixed, left = mixed + left * w * own, left * (1 - w)
        p1 = mixed + left / 2  # what is left over is an unseen context's
        total += np.log10(np.where(x.bit == 1, p1[x.of], 1 - p1[x.of]))
    return total


def price_grams(frames: Iterator[pd.DataFrame], top: np.ndarray) -> Iterator[pd.DataFrame]:
    """``(part, g, p)``: for the grams of each part the log10 of their probabilities. A bucket's own grams come first."""
    bucket, held, table, logs = None, [], None, None
    for frame in frames:
        parts, priced = [], []
        for b, part, g, n in zip(frame["bucket"], frame["part"], frame["g"], frame["n"], strict=True):
            if b != bucket:
                bucket, held, table, logs = b, [], None, None
            if part < 0:
                held.append((unpacked(g), unpacked(n)))
                continue
            if table is None:
                table, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                held = []
                logs = log10_probabilities(table, n, top).astype(np.float32)
            parts.append((part, g))
            priced.append(logs[np.searchsorted(table, unpacked(g))].tobytes())
        yield pd.DataFrame({"part": [x[0] for x in parts], "g": [x[1] for x in parts], "p": priced})
    del held, table, logs
    give_back()


def gram_probabilities(held: DataFrame) -> DataFrame:
    """``(part, g, p)``: packed grams of each part of ``held(part, text, held_out)`` and the float log10 of their probabilities."""
    spark = held.sparkSession
    parts = held.agg(F.countDistinct("part")).first()[0]
    buckets = min(4096, max(64, 4 * parts))
    found = stored(held.select("part", "text", "held_out").mapInPandas(lambda x: count_grams(x, buckets), "bucket int, part long, g binary, n binary"))
    by_bucket = found.select("bucket", "g", "n").repartition("bucket").sortWithinPartitions("bucket")
    whole = stored(by_bucket.mapInPandas(sum_buckets, "bucket int, g binary, n binary, node int, a double, b double, below double"))
    tops = whole.where("node >= 0").groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    top = spark.sparkContext.broadcast(top_mixture(*[tops[c].to_numpy() for c in ("node", "a", "b", "below")]))
    every = whole.where("node < 0").select("bucket", F.lit(-1).cast("long").alias("part"), "g", "n").unionByName(found.withColumn("n", F.lit(None).cast("binary")))
    return every.repartition("bucket").sortWithinPartitions("bucket", "part").mapInPandas(lambda x: price_grams(x, top.value), "part long, g binary, p binary")


def ctw_scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, head_words: int = HEAD_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)`` for every row.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` are scored but not learned from; rows with a null id
    are learned from. ``score`` is the tree's log10 probability of the lower-cased text's bytes and of its end;
    ``base_score`` that of its words under their training counts. A null text is empty: it has the end alone. Repeated
    rows count and come back as often as they occur. Without training rows all counts are 0. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"))
    id_type = dict(docs.dtypes)["doc_id"]
    # written, as the numbers of rows and parts must not be made twice
    docs = stored(docs.mapInArrow(in_parts, f"doc_id {id_type}, text string, held_out boolean, row long, part long"))
    train = docs.where("not held_out").select("text")
    priced = gram_probabilities(docs)

    vocabulary = stored(train.mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    all_n, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unseen = float(np.log10(0.5 / (all_n + 0.5 * (distinct + 1))))
    top = vocabulary.where("word is not null").orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    head = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    ends = vocabulary.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log = lambda c: float(np.log10((c + 0.5) / (all_n + 0.5 * (distinct + 1))))
    known_words = spark.sparkContext.broadcast({w: log(c) for w, c in head.items()})
    end_score = log(ends) if ends else unseen

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (word null) with what the frequent words and the tree say, and one for each rare word.

        A part's grams come before its documents (null ``g``).
        """
        look = known_words.value.get
        names, part, held, table, logs = [f.split()[0] for f in schema.split(", ")], None, [], None, None
        for batch in found:
            parts, is_doc = batch["part"].to_numpy(), np.asarray(batch["g"].is_null())
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != part:
                    part, held, table, logs = parts[a], [], None, None
                if not is_doc[a]:
                    held += [(unpacked(g), np.frombuffer(p, np.float32)) for g, p in zip(batch["g"][a:b].to_pylist(), batch["p"][a:b].to_pylist(), strict=True)]
                    continue
                if table is None:
                    table = np.concatenate([x[0] for x in held])
                    order = np.argsort(table, kind="stable")
                    table, logs = table[order], np.concatenate([x[1] for x in held])[order]
                    held = []
                at = a
                for texts in batches(batch["text"][a:b].to_pylist()):
                    row, doc, out = (batch[c][at : at + len(texts)] for c in ("row", "doc_id", "held_out"))
                    at += len(texts)
                    g, lengths = grams(texts)
                    kinds, where = np.unique(g, return_inverse=True)
                    ends_at = np.cumsum(lengths)
                    sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(table, kinds)].astype(np.float64)[where])))
                    tree_score = sums[ends_at] - sums[ends_at - lengths]
                    rare_ids, rare_words, rare_n, base, n_tokens, n_known = [], [], [], [], [], []
                    for number, t in zip(row.to_pylist(), texts, strict=True):
                        ws = words(t)
                        scores = [look(w) for w in ws]
                        sure = [x for x in scores if x is not None]
                        base.append(sum(sure) + end_score)
                        n_tokens.append(len(ws) + 1)
                        n_known.append(len(sure) + (ends > 0))
                        if len(sure) < len(ws):
                            rare: dict[bytes, int] = {}
                            for w, x in zip(ws, scores, strict=True):
                                if x is None:
                                    rare[w] = rare.get(w, 0) + 1
                            rare_ids += [number] * len(rare)
                            rare_words += rare
                            rare_n += rare.values()
                    k, r = len(texts), len(rare_ids)
                    none, zero = pa.nulls(k, pa.binary()), pa.array(np.zeros(max(k, r), np.int64))
                    yield pa.RecordBatch.from_arrays([row, doc, out, none, zero[:k], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(tree_score), pa.array(lengths, pa.int64())], names=names)
                    if r:
                        none = [pa.nulls(r, doc.type), pa.nulls(r, pa.bool_())]
                        yield pa.RecordBatch.from_arrays([pa.array(rare_ids, pa.int64()), *none, pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64()), zero[:r], zero[:r], pa.array(np.zeros(r)), pa.array(np.zeros(r)), zero[:r]], names=names)
        del held, table, logs
        give_back()

    schema = f"row long, doc_id {id_type}, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, score double, n_bytes long"
    nothing = F.lit(None).cast("binary")
    both = docs.withColumns({"g": nothing, "p": nothing}).unionByName(priced, allowMissingColumns=True)
    scored = stored(both.repartition("part").sortWithinPartitions("part", F.col("g").isNull()).mapInArrow(score, schema))
    known_words.destroy()  # the scores are written
    rare = scored.where("word is not null").select("row", "word", "n")
    tail = rare.join(vocabulary.where("word is not null").withColumnRenamed("n", "c").hint("merge"), "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.col("n") * F.when(F.col("c").isNotNull(), F.log10((F.col("c") + 0.5) / F.lit(all_n + 0.5 * (distinct + 1)))).otherwise(F.lit(unseen))).alias("rare_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    out = scored.where("word is null").join(tail.hint("merge"), "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(all_n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
