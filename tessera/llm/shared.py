"""What several operators need: shared storage, connected components, bounded groups of hot keys."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stored
from ..sources.derived import table

__all__ = ["stored", "table"]

#: Rows that one chunk of a hot key may hold; a task sees two chunks at a time at most.
CHUNK = 2048
#: A key of more than HUB rows, and of more than one in HEADS of all rows, is a hub: its rows are joined where they are.
HUB, HEADS = 256, 50_000


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: Python workers outlive their tasks."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, or with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(column: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def below(bounds: Column, n: Column, bits: int, x: Column, equal: bool = False) -> Column:
    """How many of the ``n`` (fewer than 2^bits) sorted ``bounds`` are less than ``x`` (or equal to it), by bisection."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        at = F.get(bounds, middle)
        before = (at <= x) if equal else (at < x)
        go = s["low"] < s["high"]
        return F.struct(F.when(go & before, middle + 1).otherwise(s["low"]).alias("low"), F.when(go & ~before, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), F.struct(F.lit(0).alias("low"), n.alias("high")), step)["low"]


def crc_mod(key: Column, modulus: int) -> Column:
    return F.crc32(key.cast("string")) % modulus


# ---------------------------------------------------------------- hubs and components


def joined_by_size(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined on ``key`` with ``sizes(key, _n, ...)``, where ``_n`` is how many of the ``total`` rows a key has.

    Hubs are broadcast: there are fewer than HEADS of them, as each has more than total / HEADS rows. What is left meets
    in a shuffled join, where no key has more than that many rows.
    """
    hub = F.col("_n") > max(HUB, total // HEADS)
    hubs = F.broadcast(sizes.where(hub))
    rest = rows.join(hubs, key, "left_anti").join(sizes.where(~hub).hint("merge"), key)
    return rows.join(hubs, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps: each node links its larger neighbours, then its smaller ones, to
    the smallest of them. A step is a partial aggregation and a join that leaves the links of hubs where they are, and
    rounds grow with the logarithm of a component's diameter. No edges give no rows; nulls and loops are ignored.
    """
    edges = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(e: DataFrame, n: int, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        met = joined_by_size(near, least, "a", 2 * n if large else n)
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(edges)
    while was[0]:
        middle = stored(star(edges, was[0], large=True))  # has no more links than before
        edges = stored(star(middle, was[0], large=False))
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by pairs (i, j), the smallest index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows of ``node`` linked by index pairs (i, j), the smallest node of each row's group."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), int)
    rank[order] = np.arange(len(node))
    return node[order][local_roots(len(node), rank[i], rank[j])][rank]


# ---------------------------------------------------------------- bounded groups


def tiles(rows: DataFrame, key: str, row_id: str, total: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of keys that occur at least twice, dealt so that no group of ``(key, lo, hi)`` exceeds two chunks.

    A key of n rows is cut into ceil(n / chunk) hashed chunks and its rows are copied to the tiles ``(lo, hi)`` of
    chunk pairs. Each pair of rows of one key meets in exactly one tile if rows of one chunk are paired in the tile
    ``lo = hi`` and rows of two chunks in the other tiles (``side`` is the row's chunk). ``total`` is the number of rows.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = joined_by_size(rows, n, key, total)
    rows = rows.withColumn("_parts", F.ceil(F.col("_n") / chunk).cast("int")).withColumn("side", F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other")).drop("_n", "_parts", "_other")


def per_tile(dealt: DataFrame, key: str) -> DataFrame:
    """``tiles`` with each tile's rows together, in one partition; as many partitions as shuffles have, since a tile's
    work is not in proportion to its bytes."""
    many = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(many, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def starts_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where runs of equal ``keys`` begin."""
    change = np.ones(len(frame), bool)
    change[1:] = False
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames sorted by ``keys`` cut anew so that none parts a group, each with the starts of its groups."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        if len(held) > 1 and all(held[0].iloc[0][k] == frame.iloc[-1][k] for k in keys):
            continue  # one group so far
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else frame.reset_index(drop=True)
        starts = starts_of(whole, keys)
        if len(starts) > 1:
            yield whole.iloc[: starts[-1]], starts[:-1]
        held = [whole.iloc[starts[-1] :].reset_index(drop=True)]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, starts_of(whole, keys)
