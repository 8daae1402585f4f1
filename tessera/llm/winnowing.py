"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is read as tokens, A-Z lower-cased: runs without ASCII white space of at most ``PIECE`` characters, and of longer
runs every ``PIECE`` characters in a row, from each character on, so that a token does not depend on where its run began.
A rolling window of ``k`` tokens gives one hash each (the k-grams); of every ``w`` consecutive hashes the smallest is
selected, the rightmost of equal ones, and kept with its position. Two texts that share a run of ``w + k - 1`` tokens
share a selected hash - in runs longer than ``PIECE`` those are ``w + k + PIECE - 2`` characters at any two offsets - and
texts that share no run of ``k`` tokens share none (but for hash collisions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import below

PIECE = 8
K = 4
W = 4
#: A selected hash and its position share a long: 37 bits of hash, 26 of (inverted) position.
POSITION = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of one stretch of the order by doc_id, about, and the most stretches there may be (more documents make
#: them longer, not more).
STRETCH, STRETCHES = 512, 4096


def tokens(text: Column) -> Column:
    ink = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(rf"(?=({ink}{{{PIECE}}}|(?<!{ink}){ink}{{1,{PIECE}}}(?!{ink}))){ink}"), F.lit(1))


def selected(text: Column) -> Column:
    """The winnowed (hash, position) pairs of a text, as longs ``hash * 2^26 + (2^26 - 1 - position)`` in order of position.

    Fewer tokens than k make one gram of all; fewer grams than w one window of all; a text without tokens has none.
    """
    hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
    # a new name for each array, so that it is computed once
    grams = F.transform(
        F.array(hashes),
        lambda h: F.when(
            F.size(h) >= K,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(K)]), 27) * POSITION + (POSITION - i)),
        )
        .when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 27) * POSITION + (POSITION - 1)))
        .otherwise(F.array().cast("array<long>")),
    )
    return F.element_at(
        F.transform(
            grams,
            lambda g: F.when(F.size(g) > W, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - (W - 1), F.lit(1))), lambda i: F.least(*[F.get(g, i + (j - 1)) for j in range(W)])))).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g),
        ),
        1,
    )


def hashes_of(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda x: F.shiftright(x, 26)))


def written(pairs: Column) -> Column:
    """``hash@position`` of every pair, blank-separated, hashes in hexadecimal."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.hex(F.shiftright(x, 26)), F.lit("@"), (F.lit(POSITION - 1) - x.bitwiseAND(F.lit(POSITION - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def in_stretches(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``tie``, a hash of the text, and ``stretch``: parts of about equal size of the order by
    doc_id. The bounds are quantiles, whatever the ids are; an id that fills several stretches is spread over them by
    its texts' hash, and so are null ids, which come before all others."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n, nameless = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    many = max(1, min(STRETCHES, n // STRETCH))
    stretch = F.lit(0)
    if many > 1 and n > nameless:
        at = F.percentile_approx("doc_id", [k / many for k in range(1, many)], 100 * many)
        bounds = docs.agg(at.alias("b")).first()["b"]  # many - 1 numbers
        table = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)")
        n_bounds, bits = F.lit(len(bounds)), len(bounds).bit_length() + 1
        low, high = below(table, n_bounds, bits, F.col("doc_id")), below(table, n_bounds, bits, F.col("doc_id"), equal=True)
        stretch = F.when(high > low, low + 1 + F.pmod("tie", high - low)).otherwise(low)
    before = max(1, min(STRETCHES, nameless // STRETCH))
    return docs.withColumn("stretch", F.when(F.col("doc_id").isNull(), -1 - F.pmod("tie", F.lit(before))).otherwise(stretch).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, tie, stretch, guest, next_text)``: each document's text beside the next one's in order of doc_id.

    The first document of a stretch is also a guest at the end of the stretch before (of the last one, for the very
    first), so that a stretch has all its neighbours. Tables of one row for a stretch are broadcast.
    """
    docs = in_stretches(docs)
    known = F.col("doc_id").isNotNull()
    heads = docs.groupBy("stretch").agg(F.min(F.struct(known.alias("known"), "doc_id", "tie")).alias("head"))
    order = Window.orderBy("stretch")  # at most 2 STRETCHES rows
    heads = heads.select("stretch", F.col("head.doc_id").alias("first"), F.col("head.tie").alias("first_tie"), F.coalesce(F.lag("stretch").over(order), F.max("stretch").over(Window.partitionBy())).alias("host"))
    met = docs.join(F.broadcast(heads), "stretch").where(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    guests = met.groupBy("host").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))  # copies of one row
    both = docs.withColumn("guest", F.lit(False)).unionByName(guests.withColumnRenamed("host", "stretch").withColumn("guest", F.lit(True)))
    return both.withColumn("next_text", F.lead("text").over(within()))


def within() -> Window:
    return Window.partitionBy("stretch").orderBy("guest", "doc_id", "tie")


def winnow(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many (or all) of the next
    document's; after the last document comes the first, and a sole document follows itself. A null text is empty; an
    empty text has an empty fingerprint. Null ids come before all others; rows that share an id follow one another by
    a hash of their texts. Positions count tokens and wrap beyond 2^26 of them. An empty table gives no rows; other
    columns are ignored.
    """
    d = with_next(docs)
    n = F.char_length("text")
    d = d.withColumn("n_chars", n).withColumn("edited", F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 4) as int))"), F.coalesce(F.expr("left(next_text, cast(floor(n_chars / 4) as int))"), F.lit(""))))
    d = d.select("doc_id", "tie", "stretch", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), selected(F.col("text")).alias("own"), selected(F.col("edited")).alias("changed"))
    d = d.withColumn("hashes", hashes_of(F.col("own"))).withColumn("next_hashes", F.lead("hashes").over(within())).where(~F.col("guest"))
    return d.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("changed"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
