"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that shall make up the share w of the mix has the mean repetition rate  total * w / size  for each of its
documents. A document's number of copies is a Poisson variable with that mean: its distribution is inverted at a
uniform number hashed from the seed and the document, so that any run, on any partitioning, copies the same documents.
Copies are then put in an order hashed from seed, document and copy, over the whole mix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import below, fresh, quoted, stored

SEED = "mix-1"
#: Target shares by source; what they leave goes to the sources that are not named, in proportion to their size to the
#: power ``EXPONENT``: a hot source is held back, a small one raised.
SOURCE_WEIGHTS = {"src0": 0.1, "src1": 0.05}
EXPONENT = 0.5
#: The uniform number has 52 bits, so the distribution is cut where less than that is left.
TAIL = 12


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def distribution(rates: DataFrame, key: str) -> DataFrame:
    """``rates(key, rate)`` with ``cdf``: the Poisson distribution's cumulative probabilities for 0, 1, 2, ..., as a running
    sum over rows. Its length is that of the rate, and a key is one row of ``rates``."""
    top = F.ceil(F.col("rate") + TAIL * F.sqrt("rate") + 20).cast("int")
    k = rates.select(key, "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    so_far = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(so_far)
    log_power = F.when(F.col("k") > 0, F.col("k") * F.ln("rate")).otherwise(F.lit(0.0))
    p = k.select(key, "rate", "k", F.exp(-F.col("rate") + log_power - log_factorial).alias("p"))
    p = p.withColumn("c", F.sum(F.coalesce("p", F.lit(0.0))).over(so_far))
    return p.groupBy(key).agg(F.first("rate").alias("rate"), F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def poisson_replicas(docs: DataFrame, weights: Mapping[str, float] | None = None, by: str = "source", seed: str = SEED, exponent: float | None = EXPONENT) -> DataFrame:
    """``docs`` with ``copies``, the number of its replicas, and ``rate``, its source's mean repetition rate.

    With an ``exponent`` weights are shares of all rows, and sources without one (null too, which is a source of its own)
    share what they leave, at most 1, by their size to that power; where nothing is left over for them or there are none,
    all shares are scaled to sum to 1. With ``None`` sources without a weight keep the rate 1, and weights are shares
    among the named ones of the rows that these have. Rows with equal doc_id, null too, get equal numbers; texts, empty or
    long, are not looked at. Columns of the table that are named ``copies`` or ``rate`` give way to these, others stay,
    whatever their names. An empty table gives no rows.
    """
    weights = SOURCE_WEIGHTS if weights is None else weights
    docs = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in ("copies", "rate")])
    key, cdf = fresh("_mixed_by", docs.columns), fresh("_cdf", docs.columns)
    sizes = docs.groupBy(F.col(quoted(by)).alias(key)).agg(F.count("*").alias("size"))
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()])) if weights else F.create_map().cast("map<string,double>")
    sizes = sizes.withColumn("weight", F.when(F.col(key).isNotNull(), F.try_element_at(known, F.col(key).cast("string"))))
    if exponent is not None:
        part = F.when(F.col("weight").isNull(), F.pow(F.col("size").cast("double"), F.lit(float(exponent))))
        both = sizes.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(part), F.lit(0.0))).first()
        sizes = sizes.withColumn("weight", F.coalesce("weight", part * F.lit(max(0.0, 1 - both[0]) / (both[1] or 1.0))))
    # sums over the named sources: one row
    found = sizes.agg(F.sum(F.when(F.col("weight").isNotNull(), F.col("size"))).alias("rows"), F.sum("weight").alias("all")).first()
    rate = F.when(F.col("weight").isNotNull(), F.lit(float(found["rows"] or 0)) * F.col("weight") / F.lit(float(found["all"] or 1)) / F.col("size")).otherwise(F.lit(1.0))
    table = stored(distribution(sizes.select(key, rate.alias("rate")), key).withColumnRenamed("cdf", cdf))
    longest = table.agg(F.max(F.size(cdf))).first()[0] or 1
    met = docs.join(limited(table), docs[quoted(by)].eqNullSafe(table[key])).drop(key)
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return met.withColumn("copies", below(F.col(cdf), F.size(cdf), int(longest).bit_length() + 1, u)).drop(cdf)


def limited(table: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a stored table of at most ``most`` rows; leave a larger one to a shuffled join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, by: str = "source", seed: str = SEED, exponent: float | None = EXPONENT) -> DataFrame:
    """The rows of ``docs``, each ``copies`` times, with ``copy`` (from 0) and ``order_key``, in the order of that key.

    What ``poisson_replicas`` says of nulls, repeated rows and other columns holds here; ``copy`` and ``order_key`` give way
    too. Keys are digests, so the bounds of the partitions are known: nothing is sampled, and the rows are shuffled once.
    """
    docs = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in ("copy", "order_key")])
    out = poisson_replicas(docs, weights, by, seed, exponent).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") * many / 16**8).cast("int")
    return out.repartitionById(many, place).sortWithinPartitions("order_key", "doc_id", "copy")
