"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint has a bit set if more than half of its 4-word shingles' hashes have it set. Two fingerprints
that differ in at most ``max_bits`` bits are linked; linked documents form groups.

**Pivot distance tables.** Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints
once, and they travel with it. Two fingerprints f, g and a pivot p satisfy \\|d(f,p) - d(g,p)\\| <= d(f,g), so a pair whose
largest coordinate difference exceeds the limit is discarded without a look at the fingerprints; survivors are verified
by their exact distance.

**Which pairs are looked at.** A distance to a pivot of 64 random bits has a standard deviation of 4, and a band of
``max_bits`` = 4 either way holds 57 % of all others: a join on bands (or on cells with a margin) of such distances would
copy rows faster than it parts them. So the join is on short references: on a block of the bits, the distances to its
zero pattern and one-bit patterns say which bits are set, and equal coordinates mean equal blocks. With ``max_bits``
differing bits spread over ``max_bits + 2`` blocks at least two blocks agree; pairs that agree in two blocks are the
candidates (an equi-join on the bits, without loss), and the stored table is what discards them.

Copies share a fingerprint, which is handled once. Keys with many fingerprints are cut into tiles of bounded size, so
neither one task nor the driver holds a whole group; a tile returns a forest of links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .shared import components, forest, joined_by_size, per_tile, stored, tiles, whole_groups

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words. Words: runs without ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(w) - words + 1
    for at in range(0, n, 65536):
        a, b = starts[at : min(at + 65536, n)].tolist(), ends[at + words - 1 : min(at + 65536, n) + words - 1].tolist()
        h = np.fromiter((digest(line[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


@pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def pivots(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def pivot_table() -> list[str]:
    """SQL expressions: the distances of a fingerprint ``fp`` to all pivots, 8 to a long, one byte each."""
    one = [f"cast(bit_count(fp ^ ({p}L)) as long)" for p in pivots().view(np.int64).tolist()]
    return [" | ".join(f"shiftleft({x}, {8 * k})" for k, x in enumerate(one[at : at + 8])) for at in range(0, PIVOTS, 8)]


TABLE = [f"p{k}" for k in range(PIVOTS // 8)]
#: Groups of up to so many rows are compared many at once.
FEW = 64


def survivors(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs that the pivots do not discard and whose distance is ``max_bits`` or less."""
    out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
    for at in range(0, len(i), 1 << 18):
        a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        for k in range(0, PIVOTS, 4):
            ok = np.abs(table[a, k : k + 4] - table[b, k : k + 4]).max(1) <= max_bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        out_i.append(a[ok])
        out_j.append(b[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def links(fp: np.ndarray, table: np.ndarray, max_bits: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at ``max_bits`` or fewer of one tile; with ``left``, only between rows inside and outside of it."""
    rows = np.arange(len(fp)) if left is None else np.flatnonzero(left)
    cols = np.arange(len(fp)) if left is None else np.flatnonzero(~left)
    found_i, found_j = [np.empty(0, int)], [np.empty(0, int)]
    for at in range(0, len(rows), 512):
        r = rows[at : at + 512]
        near = np.abs(table[r, 0][:, None] - table[cols, 0][None, :]) <= max_bits
        near &= np.abs(table[r, 1][:, None] - table[cols, 1][None, :]) <= max_bits
        if left is None:
            near &= r[:, None] < cols[None, :]
        i, j = np.nonzero(near)
        i, j = survivors(fp, table, r[i], cols[j], max_bits)
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def links_of_groups(g: pd.DataFrame, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the tiles in a frame: the small ones at once, shifted against themselves, the others one by one."""
    fp = g["fp"].to_numpy().view(np.uint64)
    table = np.ascontiguousarray(g[TABLE].to_numpy()).view(np.uint8).reshape(len(g), PIVOTS).astype(np.int16)
    lo, hi, side = (g[c].to_numpy() for c in ("lo", "hi", "side"))
    sizes = np.diff(np.append(starts, len(g)))
    group = np.repeat(np.arange(len(starts)), sizes)
    few = np.repeat(sizes <= FEW, sizes)
    out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
    for shift in range(1, min(FEW, int(sizes.max()))):
        i = np.flatnonzero(few[:-shift] & (group[:-shift] == group[shift:]) & ((lo == hi)[:-shift] | (side[:-shift] != side[shift:])))
        i, j = survivors(fp, table, i, i + shift, max_bits)
        out_i.append(i)
        out_j.append(j)
    for k in np.flatnonzero(sizes > FEW).tolist():
        a, b = starts[k], starts[k] + sizes[k]
        i, j = links(fp[a:b], table[a:b], max_bits, None if lo[a] == hi[a] else side[a:b] == lo[a])
        out_i.append(i + a)
        out_j.append(j + a)
    return np.concatenate(out_i), np.concatenate(out_j)


def block_keys(max_bits: int) -> list[str]:
    """SQL expressions: for every two of the blocks of a fingerprint ``fp``, a key that says which two and their bits."""
    n = max_bits + 2
    edges = [64 * k // n for k in range(n + 1)]
    bits = [f"(shiftrightunsigned(fp, {a}) & {2 ** (b - a) - 1}L)" for a, b in zip(edges, edges[1:], strict=False)]
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    return [f"(shiftleft({k}L, {2 * width}) | shiftleft({bits[x]}, {width}) | {bits[y]})" for k, (x, y) in enumerate(combinations(range(n), 2))]


def fingerprint_groups(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, node, component)`` for every distinct fingerprint of ``found(doc_id, fp)``: its smallest document, and the
    smallest document reachable by links. Documents with a null doc_id get the group of their fingerprint, or null."""
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", "node", *[F.expr(x).alias(c) for x, c in zip(pivot_table(), TABLE, strict=True)])
    nodes = stored(nodes)
    keys = block_keys(max_bits)
    keyed = nodes.where("node is not null").select("fp", "node", *TABLE, F.explode(F.array(*map(F.expr, keys))).alias("key"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in whole_groups(frames, ["key", "lo", "hi"]):
            i, j = links_of_groups(g, starts, max_bits)
            node = g["node"].to_numpy()
            root = forest(node, i, j)
            yield pd.DataFrame({"a": node, "b": root})[node != root]

    edges = per_tile(tiles(keyed, "key", "fp", nodes.count() * len(keys)), "key").mapInPandas(verify, "a long, b long")
    return nodes.join(components(edges).hint("merge"), "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def simhash_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    A null or empty text, and one without words, has fingerprint 0 and links like any other. Repeated rows come back
    as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    found = stored(docs.select("doc_id", fingerprints(F.coalesce("text", F.lit(""))).alias("fp")))
    groups = fingerprint_groups(found, max_bits).select("fp", "component").join(found.groupBy("fp").agg(F.count("*").alias("_n")).hint("merge"), "fp")
    out = joined_by_size(found, stored(groups), "fp", found.count())
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
