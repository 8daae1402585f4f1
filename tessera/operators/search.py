"""Similarity search: cosines, top-k per group, ranks of a gold candidate, encoding of distinct texts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .generate import each_or_none
from .shared import perhaps_among, small, stored

#: Rows of the two sides of a tile, and numbers that one matrix of similarities may hold.
QUERY_ROWS, CANDIDATE_ROWS, MATRIX = 4096, 16_384, 4_000_000
#: Tiles that all candidates make when they are not told apart by cells, and the most candidates of one of these.
SHARES, MOST_CANDIDATES = 8, 262_144
#: Candidates of a cell, about, and the most cells there may be.
CELL, CELLS = 4096, 64
#: Queries that are few enough to go to where the candidates are.
FEW = 8
#: More than what rounding makes of an angle or a cosine.
SLACK = 1e-6

log = logging.getLogger(__name__)


def encode_distinct(rows: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """``rows`` with ``vector``: ``encode`` sees each distinct text once, in batches; a text that it can't encode, alone
    too, has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[column].tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in each_or_none(encode, texts[k : k + batch])[0]]
            yield pd.DataFrame({column: texts, "vector": pd.Series(vectors, dtype=object)})

    encoded = rows.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, vector array<double>")
    return rows.join(encoded.hint("merge"), column, "left")


@dataclass(frozen=True)
class Grid:
    """Queries and candidates, stored, each with the ``_cell`` of its nearest pivot and a ``_row`` number. Of a query cell i
    and a candidate cell j, no pair is more similar than ``most[i, j]``; the sides' cells have ``rows_q`` and ``rows_c`` rows."""

    queries: DataFrame
    candidates: DataFrame
    column: str
    most: np.ndarray
    rows_q: np.ndarray
    rows_c: np.ndarray
    tile: tuple[int, int] | None = None

    def sides(self) -> tuple[int, int]:
        """Rows of the two sides of a tile."""
        return self.tile or (QUERY_ROWS, CANDIDATE_ROWS)

    def tiles(self) -> np.ndarray:
        """How many tiles the cells' pairs are cut into."""
        m, n = self.sides()
        return -(-self.rows_q[:, None] // m) * -(-self.rows_c[None, :] // n)


def grid(queries: DataFrame, candidates: DataFrame, column: str = "embedding") -> Grid:
    """Vectors by their nearest pivot; what two cells may have in common follows from the angle between their pivots and
    the largest angles within them. Pivots are up to ``CELLS`` candidates, so the tables of cells are bounded; null vectors
    are left out, and vectors without length have a cell of their own."""
    q, c = queries.where(F.col(column).isNotNull()), candidates.where(F.col(column).isNotNull())
    many = min(CELLS, c.count() // CELL)
    pivots = np.zeros((0, 0))
    if many > 1:
        some = c.select(column).orderBy(F.xxhash64(*c.columns)).limit(4 * many).toPandas()  # bounded
        u = np.unique(rows_of_length_one(some[column]), axis=0)
        u = u[u.any(axis=1)]
        pivots = u[np.linspace(0, len(u) - 1, min(many, len(u))).astype(int)]
    k = len(pivots)

    def placed(rows: DataFrame) -> DataFrame:
        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                u = rows_of_length_one(f[column])
                sims = u @ pivots.T if k > 1 else np.ones((len(u), 1))
                best = sims.argmax(1)
                angle = np.arccos(np.clip(sims[np.arange(len(u)), best], -1, 1))
                zero = ~u.any(axis=1)
                yield f.assign(_cell=np.where(zero, max(k, 1), best).astype(np.int32), _angle=np.where(zero, 0.0, angle))

        out = rows.mapInPandas(place, f"{typed(rows, without='')}, _cell int, _angle double")
        return stored(out.withColumn("_row", F.monotonically_increasing_id()))  # numbers stay as they are once written

    q, c = placed(q), placed(c)
    width = max(k, 1) + 1  # the last one is that of vectors without length
    rows, radius = [np.zeros(width, np.int64) for _ in "qc"], [np.zeros(width) for _ in "qc"]
    for side, t in enumerate((q, c)):
        for cell, n, r in t.groupBy("_cell").agg(F.count("*"), F.max("_angle")).collect():  # at most one row a cell
            rows[side][cell], radius[side][cell] = n, r
    most = np.ones((width, width))
    if k > 1:
        between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
        most[:k, :k] = np.cos(np.clip(between - radius[0][:k, None] - radius[1][None, :k] - SLACK, 0, np.pi))
    most[-1, :] = most[:, -1] = 0.0
    return Grid(q, c, column, most, *rows)


def compare(g: Grid, work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, pairs: np.ndarray | None = None, exact: bool = False) -> DataFrame:
    """``work(some queries, some candidates, their similarities)`` for the pairs of cells in ``pairs`` (all of them by default).

    Cells are cut into parts by row number, and each pair of parts is a tile that one task compares: rows are copied to
    their tiles, no more often than the other side has parts. Similarities are cosines rounded to 9 places, one row for a
    query; a vector without length has cosine 0. What ``work`` returns is all that leaves a tile. ``exact``: cosines are
    not rounded, as ``work`` does it where it matters.
    """
    pairs = np.ones(g.most.shape, bool) if pairs is None else pairs
    pairs = pairs & (g.rows_q[:, None] > 0) & (g.rows_c[None, :] > 0)
    tiles = g.tiles()
    log.info("%d of %d tiles compared", tiles[pairs].sum(), tiles.sum())
    m, n = g.sides()
    table = [(int(i), int(j), int(-(-g.rows_q[i] // m)), int(-(-g.rows_c[j] // n))) for i, j in zip(*np.nonzero(pairs), strict=True)]

    def plan() -> DataFrame:
        return F.broadcast(g.queries.sparkSession.createDataFrame(table, "_i int, _j int, _parts int, _across int"))  # at most (CELLS + 1)^2 rows

    tile = ["_i", "_j", "_part", "_other"]
    q = g.queries.join(plan(), F.col("_cell") == F.col("_i")).withColumn("_part", F.pmod("_row", "_parts").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_across") - 1)))
    c = g.candidates.join(plan(), F.col("_cell") == F.col("_j")).withColumn("_other", F.pmod("_row", "_across").cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = ["_cell", "_angle", "_row", "_parts", "_across", *tile]
    column, names = g.column, [x.split()[0].strip("`") for x in schema.split(", ")]

    def sims(a: np.ndarray, w: np.ndarray) -> np.ndarray:
        return a @ w.T if exact else np.round(a @ w.T, 9)

    def one_tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        a, w = rows_of_length_one(left[column]), rows_of_length_one(right[column])
        left, right = left.drop(columns=[column, *own]), right.drop(columns=[column, *own])
        step = max(1, MATRIX // len(right))
        return pd.concat([work(left.iloc[k : k + step].reset_index(drop=True), right, sims(a[k : k + step], w)) for k in range(0, len(left), step)], ignore_index=True)

    return q.groupBy(*tile).cogroup(c.groupBy(*tile)).applyInPandas(one_tile, schema)


def merged(g: Grid, pairs: np.ndarray) -> tuple[Grid, np.ndarray]:
    """The grid with query cells put together up to ``QUERY_ROWS`` rows, and their pairs, if this compares at most half as
    much again: then a candidate is copied to few tiles, however many cells the queries lie in."""
    group, at, rows = np.zeros(len(g.rows_q), int), 0, 0
    for i, n in enumerate(g.rows_q):
        if rows and rows + n > QUERY_ROWS:
            at, rows = at + 1, 0
        group[i], rows = at, rows + n
    pairs = pairs & (g.rows_q[:, None] > 0) & (g.rows_c[None, :] > 0)
    member = group[None, :] == np.arange(at + 1)[:, None]
    together, rows_q = (member[:, :, None] & pairs[None, :, :]).any(1), member @ g.rows_q
    if (rows_q[:, None] * g.rows_c[None, :])[together].sum() > 1.5 * (g.rows_q[:, None] * g.rows_c[None, :])[pairs].sum():
        return g, pairs
    table = g.queries.sparkSession.createDataFrame([(int(i), int(k)) for i, k in enumerate(group)], "_cell int, _group int")
    queries = g.queries.join(F.broadcast(table), "_cell").drop("_cell").withColumnRenamed("_group", "_cell").select(*g.queries.columns)
    return Grid(queries, g.candidates, g.column, (member[:, :, None] * g.most[None, :, :] + ~member[:, :, None] * -1.0).max(1), rows_q, g.rows_c), together


def whole(g: Grid) -> Grid:
    """The grid as one cell. Its candidates are cut into ``SHARES`` tiles, into more only beyond ``MOST_CANDIDATES`` each: what
    a query gets from every tile grows no faster than the queries do, until there are that many candidates."""
    one = lambda rows: rows.withColumn("_cell", F.lit(0))
    n = int(g.rows_c.sum())
    tile = 4 * QUERY_ROWS, int(min(max(CANDIDATE_ROWS, -(-n // SHARES)), MOST_CANDIDATES))
    return Grid(one(g.queries), one(g.candidates), g.column, np.ones((1, 1)), np.array([g.rows_q.sum()]), np.array([n]), tile)


def reaching(g: Grid, least: DataFrame) -> np.ndarray:
    """The pairs of cells in which a similarity may be as large as the smallest of ``least(_cell, least)`` of the query's cell;
    a null stands for any similarity."""
    bound = np.full(len(g.rows_q), -np.inf)
    for cell, n, low in least.groupBy("_cell").agg(F.count_if(F.col("least").isNull()), F.min("least")).collect():  # at most one row a cell
        bound[cell] = -np.inf if n or low is None else low
    return g.most >= bound[:, None] - SLACK


def typed(*frames: DataFrame, without: str = "embedding") -> str:
    return ", ".join(f"`{c}` {t}" for f in frames for c, t in f.dtypes if c != without)


def largest(scores: np.ndarray, ids: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` largest of each row, ties by the smaller id; columns of -inf are none."""
    order = np.argsort(ids.to_numpy(), kind="stable")
    s = scores[:, order]
    if k < s.shape[1]:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        over, tie = s > kth, s == kth
        keep = over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(1, keepdims=True)))
    else:
        keep = np.ones(s.shape, bool)
    i, j = np.nonzero(keep & (s > -np.inf))
    return i, order[j]


def more_similar(sims: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of each row's similarities are more than ``own`` once they are rounded to 9 places, as ``own`` is. What is
    half a unit or more away from the edge needs no rounding."""
    sure = (sims > (own + 0.6e-9)[:, None]).sum(1)
    perhaps = (sims > (own + 0.4e-9)[:, None]).sum(1)
    for i in np.nonzero(perhaps != sure)[0]:
        sure[i] = (np.round(sims[i], 9) > own[i]).sum()
    return sure


def first_of(sims: np.ndarray, ids: pd.Series, score: Callable[[np.ndarray], np.ndarray] = lambda x: np.round(x, 9), near: float = 1.1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The column of each row's largest similarity, of equal ones (to 9 places, or by a rising ``score`` that is the same for
    no two that are more than ``near`` apart) that of the smallest id, and its value."""
    most = sims.max(1)
    top = score(most)
    place = np.zeros(len(sims), int)
    i, j = np.nonzero(sims >= (most - near)[:, None])
    same = score(sims[i, j]) == top[i]
    i, j = i[same], j[same]
    order = np.lexsort((np.unique(ids.to_numpy()[j], return_inverse=True)[1], i))
    rows, at = np.unique(i[order], return_index=True)
    place[rows] = j[order][at]
    return place, top


def nearest(queries: DataFrame, candidates: DataFrame, k: int, qid: str = "qid", cand: str | None = None, over: float | None = None, but_self: bool = False, used: str | None = None) -> DataFrame:
    """The ``k`` most similar candidates of each query, with ``sim`` and ``rank`` from 1; ties go to the smaller ``cand``.

    Each batch of candidates keeps its ``k`` best before anything is shuffled. ``over``: only what is more similar than
    that; ``but_self``: not the candidate of the query's own id; ``used``: a column of the queries, an array of candidates
    to leave out. Both sides keep their other columns, but for ``used``.
    """
    cand = cand or next(c for c in candidates.columns if c != "embedding")

    def work(left: pd.DataFrame, some: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        if over is not None:
            close = np.abs(sims - over) < 1e-9
            sims = np.where(np.where(close, np.round(sims, 9), sims) > over, sims, -np.inf)
        ids = some[cand].to_numpy()
        if but_self:
            sims = np.where(left[qid].to_numpy()[:, None] == ids[None, :], -np.inf, sims)
        if used is not None:
            place = {c: j for j, c in enumerate(ids)}
            for i, gone in enumerate(left[used]):
                sims[i, [place[c] for c in gone if c in place]] = -np.inf
        if k < sims.shape[1]:  # only what can be among the k best is rounded and put in order
            kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            i, j = np.nonzero((sims > -np.inf) & (sims >= (kth - 1.1e-9)[:, None]))
        else:
            i, j = np.nonzero(sims > -np.inf)
        value = np.round(sims[i, j], 9)
        order = np.lexsort((np.unique(ids[j], return_inverse=True)[1], -value, i))
        i, j, value = i[order], j[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, value = i[place < k], j[place < k], value[place < k]
        rest = left.drop(columns=used or []).iloc[i].reset_index(drop=True)
        return pd.concat([rest, some.iloc[j].reset_index(drop=True)], axis=1).assign(sim=value)

    schema = f"{typed(queries.drop(used) if used else queries, candidates)}, sim double"
    if queries.select(F.lit(1)).limit(FEW + 1).count() <= FEW:  # candidates stay where they are
        few = queries.where("embedding is not null").toPandas()
        few, lines = few.drop(columns="embedding"), rows_of_length_one(few["embedding"]) if len(few) else None

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(few) and len(f):
                    yield work(few, f.drop(columns="embedding").reset_index(drop=True), lines @ rows_of_length_one(f["embedding"]).T)

        return top_k(candidates.where("embedding is not null").mapInPandas(batches, schema), [qid], F.col("sim"), [cand], k)
    g = grid(queries, candidates)
    # the cells nearest to a query's own give k candidates; what they leave to beat rules most of the others out
    order = np.argsort(-g.most, axis=1, kind="stable")
    before = np.cumsum(g.rows_c[order], axis=1) - g.rows_c[order]
    first = np.zeros(g.most.shape, bool)
    np.put_along_axis(first, order, before < k + but_self, axis=1)
    if (first | (g.rows_c == 0)[None, :])[g.rows_q > 0].all():
        return top_k(compare(g, work, schema, exact=True), [qid], F.col("sim"), [cand], k)
    found = stored(top_k(compare(g, work, schema, first, exact=True), [qid], F.col("sim"), [cand], k).drop("rank"))
    kth = found.groupBy(qid).agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
    low = F.col("least") if over is None else F.coalesce(F.greatest(F.col("least"), F.lit(over)), F.lit(over))
    rest = reaching(g, g.queries.select(qid, "_cell").join(kth.hint("merge"), qid, "left").select("_cell", low.alias("least"))) & ~first
    area = g.rows_q[:, None] * g.rows_c[None, :]
    if area[rest | first].sum() > area.sum() / 2:  # cells rule little out, and every cell would give k rows for each query
        return top_k(compare(whole(g), work, schema, exact=True), [qid], F.col("sim"), [cand], k)
    together, pairs = merged(g, rest | first)
    if together is not g and together.tiles()[pairs].sum() < g.tiles()[rest & (area > 0)].sum():
        return top_k(compare(together, work, schema, pairs, exact=True), [qid], F.col("sim"), [cand], k)  # the first cells once more
    return top_k(found.unionByName(compare(g, work, schema, rest, exact=True)), [qid], F.col("sim"), [cand], k)


def nearest_among(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int, qid: str = "qid", cand: str = "cand", over: float | None = None) -> DataFrame:
    """``nearest``, but only among each query's own candidates, ``pairs(qid, cand)``: vectors meet along the pairs, and each
    partition keeps its ``k`` best of a query before they are shuffled by query. Pairs of no query, and candidates of no
    pair, are not moved."""
    queries = small(stored(queries.withColumnRenamed("embedding", "_v")))
    own = stored(pairs.select(qid, cand).join(queries.select(qid), qid, "left_semi").distinct())
    met = own.join(perhaps_among(candidates.withColumnRenamed("embedding", "_w"), own.select(cand), cand).hint("merge"), cand).join(queries, qid)
    met = met.withColumn("sim", F.round(V.cosine(F.col("_v"), F.col("_w")), 9)).where(F.col("sim").isNotNull()).drop("_v", "_w")
    return top_k(met if over is None else met.where(F.col("sim") > over), [qid], F.col("sim"), [cand], k)


def similarity_stats(queries: DataFrame, candidates: DataFrame, qid: str = "qid", cand: str = "cand") -> DataFrame:
    """``(qid, n, mean, most, least)`` of each query's similarities to all candidates but its own id."""

    def work(left: pd.DataFrame, some: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        other = left[qid].to_numpy()[:, None] != some[cand].to_numpy()[None, :]
        return pd.DataFrame({qid: left[qid], "n": other.sum(1), "total": (sims * other).sum(1), "most": np.where(other, sims, -np.inf).max(1), "least": np.where(other, sims, np.inf).min(1)})[other.any(1)]

    part = compare(grid(queries.select(qid, "embedding"), candidates.select(cand, "embedding")), work, f"{typed(queries.select(qid))}, n long, total double, most double, least double")
    return part.groupBy(qid).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"), F.min("least").alias("least"))


def with_own(queries: DataFrame, candidates: DataFrame, gold: DataFrame, qid: str = "qid", cand: str = "cand") -> DataFrame:
    """``queries`` with ``gold`` and its similarity ``own``, from ``gold(qid, cand)``; queries without a gold candidate are dropped."""
    vectors = candidates.select(F.col(cand).alias("gold"), F.col("embedding").alias("_gold"))
    q = queries.join(gold.select(qid, F.col(cand).alias("gold")).hint("merge"), qid).join(vectors.hint("merge"), "gold")

    def similarity(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(own=np.round((rows_of_length_one(f["embedding"]) * rows_of_length_one(f["_gold"])).sum(1), 9)).drop(columns="_gold")

    return q.where("embedding is not null and _gold is not null").mapInPandas(similarity, f"{typed(q.drop('_gold'), without='')}, own double")


def gold_ranks(queries: DataFrame, candidates: DataFrame, gold: DataFrame, but_self: bool = False, ties: bool = False) -> DataFrame:
    """``(qid, rank)``: 1 and the number of ``candidates(cand, embedding)`` that are more similar than the gold one - with
    ``ties`` also of those that are as similar and have a smaller id. Counted inside of each tile; tiles that can hold none
    are left out."""

    def work(left: pd.DataFrame, some: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        own, ids = left["own"].to_numpy()[:, None], some["cand"].to_numpy()[None, :]
        before = sims > own
        if ties:
            before |= (sims == own) & (ids < left["gold"].to_numpy()[:, None])
        before &= ids != left["gold"].to_numpy()[:, None]
        if but_self:
            before &= ids != left["qid"].to_numpy()[:, None]
        return pd.DataFrame({"qid": left["qid"], "n": before.sum(1)})

    q = with_own(queries.select("qid", "embedding"), candidates, gold.select("qid", F.col("gold").alias("cand")))
    g = grid(q, candidates.select("cand", "embedding"))
    part = compare(g, work, f"{typed(queries.select('qid'))}, n long", reaching(g, g.queries.select("_cell", F.col("own").alias("least"))))
    n = part.groupBy("qid").agg(F.sum("n").alias("n"))
    return g.queries.select("qid").distinct().join(n.hint("merge"), "qid", "left").select("qid", (1 + F.coalesce("n", F.lit(0))).alias("rank"))


def rows_of_length_one(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_k(rows: DataFrame, keys: list[str], score: Column, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows of the highest score for each key, with ``rank``; ties go to the smaller ids."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_retrieval(queries: DataFrame, candidates: DataFrame, k: int = 8, but_self: bool = False) -> DataFrame:
    """``(qid, confidence, evidence)``: the nearest candidates in order, and their mean similarity cut to 0..1."""
    top = nearest(queries, candidates, k, but_self=but_self)
    g = top.groupBy("qid").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("sim"))).alias("confidence"), F.sort_array(F.collect_list(F.struct("rank", "cand"))).alias("e"))
    return g.select("qid", "confidence", F.transform("e", lambda x: x["cand"]).alias("evidence"))
