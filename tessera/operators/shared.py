"""Storage between rounds and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000
#: Keys that may be hubs.
HUBS = 2_000
#: Bits of a filter of keys, and of one row of it.
FILTER_BITS, ROW_BITS = 1 << 27, 1 << 15
#: One row in so many is counted to find hubs.
COUNTED = 64


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a loop's lineage ends and lost executors cost nothing."""
    path = scratch(df.sparkSession, "round")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> bool:
    """Whether ``df`` is counted to have at most ``BROADCAST_ROWS`` rows."""
    return df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side that is counted to have at most ``most`` rows; a larger one takes part in a shuffled join."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(most + 1).count() <= most else df.hint("merge")


def met_at_hubs(rows: DataFrame, others: DataFrame, *keys: str, each: Column | None = None) -> DataFrame:
    """``rows`` joined with ``others`` on ``keys``, of which ``others`` has few rows each and ``rows`` may have any number.

    A side ``others`` of counted size is broadcast; ``each`` says how many rows one of its rows counts for, as a list does
    for as many as it has. A larger one is shuffled, but for what belongs to the hubs: fewer than
    ``HUBS`` keys can have more than one in ``HUBS`` of all ``rows``, and those are joined where they are.
    """
    if few(others) and (each is None or (others.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_ROWS):
        return rows.join(F.broadcast(others), list(keys))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hubs = stored(sizes.where(F.col("_n") > max(256, rows.count() // HUBS)).select(*keys))
    of_hubs = others.join(F.broadcast(hubs), list(keys), "left_semi")
    rest = others.join(F.broadcast(hubs), list(keys), "left_anti")
    return rows.join(F.broadcast(of_hubs), list(keys)).unionByName(rows.join(F.broadcast(hubs), list(keys), "left_anti").join(rest.hint("merge"), list(keys)))


def packed(text: Column) -> Column:
    """``text`` as bytes, hex digits two to a byte: what is moved of hashes is halved."""
    return F.when(text.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(data: Column) -> Column:
    rest = F.substring(data, 2, (1 << 31) - 1)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``keys``, however many these are: hashes are looked up in a
    bitmap of at most ``FILTER_BITS``, so that a shuffled join that follows moves little that finds no partner."""
    hash_of = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))
    bits = keys.select(hash_of(key).alias("_h")).distinct().withColumn("_row", F.floor(F.col("_h") / ROW_BITS)).repartition(partitions(rows), "_row")
    bits = bits.groupBy("_row").agg(F.bitmap_construct_agg(F.col("_h") % ROW_BITS).alias("_bits"))
    place = F.col("_h") % ROW_BITS
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_h", hash_of(key)).withColumn("_row", F.floor(F.col("_h") / ROW_BITS)).join(F.broadcast(stored(bits)), "_row")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_h", "_row", "_bits")


def hubs_of(rows: DataFrame, key: str, by: str | Column, least: int = 4096) -> DataFrame:
    """``(key)`` of the fewer than ``HUBS`` values that have more than one in ``HUBS`` of all rows each, and ``least`` at
    least, counted on the rows that a hash of ``by`` picks: it decides how a join runs, not what it gives."""
    some = rows.where(F.pmod(F.xxhash64(by), F.lit(COUNTED)) == 0).groupBy(key).agg(F.count("*").alias("_n"))
    some = stored(some)
    n = some.agg(F.sum("_n")).first()[0] or 0
    return stored(some.where(F.col("_n") > max(least // COUNTED, n // HUBS)).select(key))


def met_in_lots(rows: DataFrame, others: DataFrame, key: str, by: str, other_by: str, broadcast_rows: int = BROADCAST_ROWS, least: int = 4096) -> DataFrame:
    """``rows`` joined with ``others`` on ``key``, of which both may have any number of rows for a value.

    A side ``others`` of counted size is broadcast. Otherwise values with more than one in ``HUBS`` of a side's rows, fewer
    than ``HUBS`` on either side, are cut into lots on both sides, by hashes of ``by`` and ``other_by``, and every lot of one
    side meets every lot of the other: no task gets more of a value than about a lot of each side. Both sides are to be
    stored tables, as they are counted first.
    """
    if others.select(F.lit(1)).limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(others), key)

    def hubs(side: DataFrame, lots: str) -> DataFrame:
        lot = max(least, side.count() // HUBS)
        return side.groupBy(key).agg(F.ceil(F.count("*") / lot).cast("int").alias(lots)).where(F.col(lots) > 1)

    def dealt(side: DataFrame, own: str, far: str, column: str) -> DataFrame:
        own_lots, far_lots = F.coalesce(own, F.lit(1)), F.coalesce(far, F.lit(1))
        met = side.join(F.broadcast(cut), key, "left").withColumn(f"{own}_lot", F.pmod(F.xxhash64(column), own_lots).cast("int"))
        return met.withColumn(f"{far}_lot", F.explode(F.sequence(F.lit(0), far_lots - 1))).drop("_a", "_b")

    cut = stored(hubs(rows, "_a").join(hubs(others, "_b").hint("merge"), key, "full"))
    return dealt(rows, "_a", "_b", by).join(dealt(others, "_b", "_a", other_by).hint("merge"), [key, "_a_lot", "_b_lot"]).drop("_a_lot", "_b_lot")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, *order: Column | str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``position``, from 1 over the whole table in that order, and ``sum_x`` up to there for each of ``sums``.

    Rows are dealt by ranges of the order, with bounds from a sample (equal values are parted where the order goes on),
    and numbered within their range; the ranges' totals, one row each, give the offsets. No task sorts more than a range.
    """
    cut = stored(rows.repartitionByRange(partitions(rows), *order).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)])
    w = Window.partitionBy("_range").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({"position": F.row_number().over(w)} | {f"sum_{c}": F.sum(c).over(so_far) for c in sums}).join(F.broadcast(offsets), "_range")
    return out.select(*rows.columns, (F.col("position") + F.col("_n")).alias("position"), *[(F.col(f"sum_{c}") + F.col(f"_{c}")).alias(f"sum_{c}") for c in sums])


def within_intervals(points: DataFrame, point: str, intervals: DataFrame, bins: int = 256) -> DataFrame:
    """``points`` joined with ``intervals(from, to, ..)`` where from <= point < to (an open ``to`` is null), both whole
    numbers: an equi-join on bins of the points' span, into which each interval falls at most ``bins`` + 1 times."""
    low, high = points.agg(F.min(point), F.max(point)).first()
    if low is None:
        low = high = 0
    width = (high - low) // bins + 1
    at = lambda x: F.floor((x - low) / width).cast("long")
    first, last = F.greatest(F.col("from"), F.lit(low)), F.least(F.coalesce(F.col("to"), F.lit(high + 1)), F.lit(high + 1)) - 1
    spread = intervals.where(first <= last).withColumn("_bin", F.explode(F.sequence(at(first), at(last))))
    p = small(stored(points.withColumn("_bin", at(F.col(point)))))
    met = spread.join(p, "_bin").where((F.col("from") <= F.col(point)) & (F.col("to").isNull() | (F.col("to") > F.col(point))))
    return met.drop("_bin", "from", "to")
