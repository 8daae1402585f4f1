"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors u, v have cosine >= c exactly if |u - v|^2 <= 2 - 2c. The vectors are rotated and split into blocks. If
the squared distances of all blocks exceeded their share of that budget (in proportion to their dimensions), the sum
would exceed the budget: so every pair to find is within the share of at least one block.

**Rotation.** Onto the principal axes of a bounded sample (``SAMPLE`` vectors), dealt to the blocks in turn, so that each
block begins with axes along which vectors differ most. Any rotation gives the same pairs; a good one parts them sooner.

**Range join of a block.** A grid with cells as wide as the block's radius lies over up to ``GRID`` of its first
coordinates. A vector is at home in one cell and a guest in the neighbouring cells that come before it in order; two
vectors within the radius are in the same or in neighbouring cells, so they meet exactly once, at the home of the one
that comes first. Block distances come from a matrix product; a candidate that an earlier block already has is left to
that block, and what is left is verified by its cosine in double precision.

**When nothing can be parted.** Along an axis with the standard deviation s a band of one radius either way holds the
share erf(radius / 2s) of all vectors; for 64 equally spread dimensions and cosine 0.95 that is 0.63 in a block of 16, and
cells hold more. A coordinate for which the sample says that ``WIDE`` or more of all pairs share neighbouring cells is
left out of the grid, and if a block is left without any, a grid would copy vectors and save nothing: then all vectors of
that dimension share one cell, in which all blocks are joined at once, and each pair is looked at once.

A task returns counts and a forest of links, never pairs. Equal vectors are one class that is joined once. Cells with
many vectors are cut into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, forest, joined_by_size, per_tile, stored, tiles, whole_groups

COSINE = 0.95
BLOCKS = 4
GRID = 2
#: Share of all pairs in neighbouring cells from which on a coordinate is not worth a grid.
WIDE = 0.7
#: Vectors that the rotation is taken from.
SAMPLE = 4096
#: Vectors that one chunk of a cell may hold.
CHUNK = 16384
#: Slack for rounding, in squared distance, that keeps the pigeonhole bound safe; the final test has none.
SLACK = 1e-9
#: Bits of a cell's number along one coordinate.
BITS = 20


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Space(NamedTuple):
    """How vectors of one dimension are rotated (``axes``), split (``blocks``) and laid out (``grid``: coordinates of each
    block; ``None`` if all vectors share a cell). ``share`` is a block's squared radius."""

    axes: np.ndarray
    blocks: list[slice]
    grid: list[list[int]] | None
    share: list[float]


def space(dim: int, sample: np.ndarray, cosine: float) -> Space:
    """``sample``: unit vectors, as rows; without any the axes stay as they are."""
    n = min(BLOCKS, dim)
    axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))[1][:, ::-1] if len(sample) > 1 else np.eye(dim)
    order = [k for b in range(n) for k in range(b, dim, n)]
    sizes = [len(range(b, dim, n)) for b in range(n)]
    ends = np.cumsum(sizes).tolist()
    blocks = [slice(e - k, e) for e, k in zip(ends, sizes, strict=True)]
    share = [(2 - 2 * cosine + SLACK) * k / dim for k in sizes]
    rotated, grid = sample @ axes[:, order], []
    for block, s in zip(blocks, share, strict=True):
        chosen = []
        for k in range(block.start, min(block.stop, block.start + 2 * GRID)):
            cells = np.floor(rotated[:, k] / np.sqrt(s)).astype(np.int64) if len(sample) else np.zeros(1, np.int64)
            p = np.bincount(cells - cells.min()) / len(cells)
            if (p * p).sum() + 2 * (p[1:] * p[:-1]).sum() < WIDE and len(chosen) < GRID:
                chosen.append(k)
        grid.append(chosen)
    return Space(axes[:, order], blocks, grid if all(grid) else None, share)


class Spaces(dict):
    """Spaces by dimension; one that the sample has no vector of shares a cell."""

    def __init__(self, sample: pd.DataFrame, cosine: float):
        super().__init__()
        self.cosine = cosine
        for dim, part in sample.groupby(sample["embedding"].map(len).to_numpy()):
            self[dim] = space(dim, unit(np.stack(part["embedding"].to_numpy())), cosine)

    def __missing__(self, dim: int) -> Space:
        self[dim] = space(dim, np.zeros((0, dim)), self.cosine)
        return self[dim]


def deal(frames: Iterator[pd.DataFrame], spaces: Spaces) -> Iterator[pd.DataFrame]:
    """Each vector at home in one cell of every block's grid, and as a guest in the neighbouring cells before it."""
    for frame in frames:
        sizes = frame["embedding"].map(len)
        for dim, part in frame.groupby(sizes.to_numpy()):
            s, high = spaces[dim], np.int64(dim) << 44
            part = part[["cls", "size", "embedding"]]
            if s.grid is None:
                yield part.assign(key=high, home=True)
                continue
            v = unit(np.stack(part["embedding"].to_numpy())) @ s.axes
            for b, coordinates in enumerate(s.grid):
                cell = np.floor(v[:, coordinates] / np.sqrt(s.share[b])).astype(np.int64) + (1 << (BITS - 1))
                for step in product((-1, 0, 1), repeat=len(coordinates)):
                    if step <= (0,) * len(step):
                        key = high + (np.int64(b) << 40)
                        for k in range(len(step)):
                            key = key + ((cell[:, k] + step[k]) << (BITS * k))
                        yield part.assign(key=key, home=not any(step))


def join_tile(g: pd.DataFrame, spaces: Spaces, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile that are linked and not an earlier block's."""
    key, lo, hi = int(g["key"].iloc[0]), int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    s, b = spaces[key >> 44], (key >> 40) & 15
    u = unit(np.stack(g["embedding"].to_numpy()))
    v = u @ s.axes
    here = range(len(s.blocks)) if s.grid is None else [b]
    # (x, 1, -x^2/2) times (y, -y^2/2, 1) is -|x - y|^2 / 2
    left, right = [], []
    for k in here:
        x = v[:, s.blocks[k]].astype(np.float32)
        half, one = -(x * x).sum(1, keepdims=True) / 2, np.ones((len(x), 1), np.float32)
        left.append(np.concatenate([x, one, half], 1))
        right.append(np.concatenate([x, half, one], 1))
    side, home = g["side"].to_numpy(), g["home"].to_numpy(bool)
    rows, cols = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    right = [x[cols].T.copy() for x in right]
    out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
    for at in range(0, len(rows), 256):
        r = rows[at : at + 256]
        near = np.zeros((len(r), len(cols)), bool)
        for k, x, y in zip(here, left, right, strict=True):
            near |= x[r] @ y >= -(s.share[k] + 1e-5) / 2
        i, j = np.nonzero(near)
        i, j = r[i], cols[j]
        ok = home[i] | home[j]
        if lo == hi:
            ok &= i < j
        i, j = i[ok], j[ok]
        for start in range(0, len(i), 1 << 16):
            p, q = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            if s.grid is not None:
                gap = (v[p] - v[q]) ** 2
                ok = gap[:, s.blocks[b]].sum(1) <= s.share[b]
                for earlier in range(b):
                    ok &= gap[:, s.blocks[earlier]].sum(1) > s.share[earlier]
                p, q = p[ok], q[ok]
            ok = (u[p] * u[q]).sum(1) >= cosine
            out_i.append(p[ok])
            out_j.append(q[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty or zero or that hold null or non-finite components link with nothing, as do vectors of
    different lengths and rows with a null vec_id. Repeated rows are linked with each other; rows that share a vec_id
    but not the vector have links of their own. An empty table gives no rows; other columns are ignored.
    """
    e = F.col("embedding")
    ok = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(ok, e).alias("embedding"))
    # two 64-bit hashes stand for the vector as a key
    rows = rows.select("vec_id", "embedding", F.when(ok, F.xxhash64(e)).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), e)).alias("h2"))
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.min("embedding").alias("embedding"))
    # numbered and written, so that a number is one class's for good
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    n_rows = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    spaces = Spaces(classes.orderBy(F.xxhash64("h1"), "cls").limit(SAMPLE).select("embedding").toPandas(), cosine)
    shared = vectors.sparkSession.sparkContext.broadcast(spaces)
    schema = f"key long, cls long, size long, embedding {dict(classes.dtypes)['embedding']}, home boolean"
    dealt = stored(classes.select("cls", "size", "embedding").mapInPandas(lambda f: (x[["key", "cls", "size", "embedding", "home"]] for x in deal(f, shared.value)), schema))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, starts in whole_groups(frames, ["key", "lo", "hi"]):
            for a, z in zip(starts, [*starts[1:], len(whole)], strict=True):
                g = whole.iloc[a:z]
                i, j = join_tile(g, shared.value, cosine)
                if len(i):
                    cls, size = g["cls"].to_numpy(), g["size"].to_numpy()
                    n = np.bincount(i, size[j], len(cls)) + np.bincount(j, size[i], len(cls))
                    yield pd.DataFrame({"a": cls, "b": forest(cls, i, j), "n": n.astype(np.int64)})[n > 0]

    met = stored(per_tile(tiles(dealt, "key", "cls", dealt.count(), CHUNK), "key").mapInPandas(verify, "a long, b long, n long"))
    counts = met.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    members = components(met.select("a", "b")).withColumnRenamed("node", "cls").join(classes.select("cls", "node").hint("merge"), "cls")
    least = members.groupBy("component").agg(F.min("node").alias("c"), F.count("*").alias("_n"))
    groups = joined_by_size(stored(members.select("cls", "component")), least, "component", n_rows).select("cls", "c")
    found = classes.select("h1", "h2", "cls", "node", "size").join(counts.hint("merge"), "cls", "left").join(groups.hint("merge"), "cls", "left")
    found = stored(found.select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("c", "node").alias("component_id"), F.col("size").alias("_n")))
    # copies of a vector are a hub of the join back to the rows
    keyed = rows.select("vec_id", F.struct("h1", "h2").alias("key"), F.col("h1").isNotNull().alias("ok"))
    met_again = joined_by_size(keyed.where("ok"), found.select(F.struct("h1", "h2").alias("key"), "n_links", "component_id", "_n"), "key", n_rows).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met_again.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
