"""Phrases whose words stay together, mined with counting quotient filters.

A task turns its texts into shards: the distinct words of some megabytes of one language, and the texts as places in
that list. Words that occur often enough in a language are numbered over all shards; each shard gets the numbers of its
own words, so no task needs the whole dictionary. Two or three numbers in a row are packed into one key, which a Feistel
network permutes; its leading bits are the quotient and the others, all kept, the remainder. A filter holds, in order, how
many remainders each quotient has, the remainders, and their counts: a lossless table of counts without keys. Filters
are cut at leading bits of the quotient, and those of all tasks are merged block by block. What is frequent is turned
back into words, and scored by joins on word pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import numbered
from .shared import joined_by_size, release_memory, stored

#: Least number of occurrences, share (in hundredths) of a longer phrase that makes a phrase part of it, rows of a language.
LEAST, SHARE, TOP = 10, 50, 2000
SCALE = 1_000_000
#: Bytes of text of a shard, and of all texts that a task holds.
SHARD, HELD = 2 << 20, 32 << 20
#: Entries of a filter that a task merges before it hands them on, and of a block of merged filters, about.
MERGED, BLOCK = 1_500_000, 500_000
ROUNDS = 4
#: Parts of a language that find their best phrases apart.
SALTS = 64

#: What a byte is: part of a word, a blank between words, or the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ENDS = tuple(bytes([k]) for k in np.flatnonzero(KIND == 2))
#: The bit of a token that begins a piece.
FIRST = np.uint32(1 << 31)


# ---------------------------------------------------------------- shards


def in_parts(text: bytes) -> Iterator[bytes]:
    """A text cut at ends of pieces into parts of about a shard; a longer piece stays whole."""
    while len(text) > SHARD:
        at = max(text.rfind(c, 0, SHARD) for c in ENDS)
        if at < 0:
            at = min((k for c in ENDS if (k := text.find(c, SHARD)) >= 0), default=-1)
            if at < 0:
                break
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def tokenised(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the words of the text as places in that list, with FIRST at a piece's start."""
    kind = KIND[data]
    word = kind == 0
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, lengths = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[word]])).dictionary_encode()
    codes = found.indices.to_numpy().astype(np.uint32)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    return found.dictionary, np.bincount(codes, minlength=len(found.dictionary)), codes | np.where(np.diff(piece, prepend=-1) != 0, FIRST, np.uint32(0))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    number = TaskContext.get().partitionId() << 32

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal number
        words, counts, tokens = tokenised(np.frombuffer(b"\n".join(held.pop(lang)), np.uint8))
        size.pop(lang)
        number += 1
        columns = [pa.array([number - 1]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())), pa.array([tokens.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "words", "counts", "tokens"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            for part in in_parts(text.as_py()):
                held[lang].append(part)
                size[lang] += len(part) + 1
                if size[lang] >= SHARD:
                    yield shard(lang)
                elif sum(size.values()) >= HELD:
                    yield shard(max(size, key=size.get))
    for lang in list(held):
        yield shard(lang)
    release_memory()


# ---------------------------------------------------------------- filters


class Keys(NamedTuple):
    """How word numbers of ``bits`` bits are packed: three of them in two halves of ``half`` bits each."""

    bits: int

    @property
    def half(self) -> int:
        return -(-3 * self.bits // 2)

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.half - self.bits
        a, b, c = (x.astype(np.uint64) for x in (a, b, c))
        return (a << np.uint64(self.bits - low)) | (b >> np.uint64(low)), ((b & np.uint64((1 << low) - 1)) << np.uint64(self.bits)) | c

    def unpack(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        low = self.half - self.bits
        b = ((left & np.uint64((1 << (self.bits - low)) - 1)) << np.uint64(low)) | (right >> np.uint64(self.bits))
        return tuple(x.astype(np.int64) for x in (left >> np.uint64(self.bits - low), b, right & np.uint64((1 << self.bits) - 1)))

    def mixed(self, x: np.ndarray, k: int) -> np.ndarray:
        """A round's function of one half: any will do, as the network is invertible whatever it is."""
        x = (x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(ROUNDS):
            left, right = right, left ^ self.mixed(right, k)
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(range(ROUNDS)):
            left, right = right ^ self.mixed(left, k), left
        return left, right


class Filter(NamedTuple):
    """Permuted keys in order, all different, and their counts."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray


def counted(left: np.ndarray, right: np.ndarray, count: np.ndarray | None, half: int) -> Filter:
    """A filter of keys in any order, each with its count or one occurrence."""
    if not len(left):
        return Filter(left, right, np.zeros(0, np.int64))
    if 2 * half <= 64:
        key = (left << np.uint64(half)) | right
        if count is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        left, right = key[at] >> np.uint64(half), key[at] & np.uint64((1 << half) - 1)
    else:
        order = np.lexsort((right, left))
        left, right, count = left[order], right[order], count[order] if count is not None else None
        at = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        left, right, n = left[at], right[at], len(order)
        return Filter(left, right, np.diff(np.append(at, n)) if count is None else np.add.reduceat(count, at))
    return Filter(left, right, np.diff(np.append(at, len(key))) if count is None else np.add.reduceat(count, at))


def merge(filters: list[Filter], half: int) -> Filter:
    if len(filters) == 1:
        return filters[0]
    return counted(*[np.concatenate(x) for x in zip(*filters, strict=True)], half)


def low_bytes(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def from_bytes(data: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if bits:
        out[:, : -(-bits // 8)] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.reshape(-1).view("<u8")


def encoded(f: Filter, half: int, block_bits: int) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """A filter as rows ``(block, quotient bits, runs, remainders, counts, large counts)``, one for each value of the leading bits."""
    block = (f.left >> np.uint64(half - block_bits)).astype(np.int64)
    bounds = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        left = f.left[x:y] & np.uint64((1 << (half - block_bits)) - 1)
        quotient = min(int(y - x).bit_length(), half - block_bits, 22)
        rest = half - block_bits - quotient
        runs = np.bincount((left >> np.uint64(rest)).astype(np.int64), minlength=1 << quotient)
        remainder = low_bytes(left & np.uint64((1 << rest) - 1), rest) + low_bytes(f.right[x:y], half)
        count = f.count[x:y]
        yield int(block[x]), quotient, runs.astype("<u4").tobytes() if runs.max() > 255 else runs.astype(np.uint8).tobytes(), remainder, np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<i8").tobytes()


def decoded(row: tuple[int, int, bytes, bytes, bytes, bytes], half: int, block_bits: int) -> Filter:
    block, quotient, runs, remainder, counts, large = row
    n, rest = len(counts), half - block_bits - quotient
    kind = np.uint8 if len(runs) == 1 << quotient else "<u4"
    q = np.repeat(np.arange(1 << quotient, dtype=np.uint64), np.frombuffer(runs, kind))
    cut = n * -(-rest // 8)
    left = (np.uint64(block) << np.uint64(half - block_bits)) | (q << np.uint64(rest)) | from_bytes(remainder[:cut], rest, n)
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(large, "<i8")
    return Filter(left, from_bytes(remainder[cut:], half, n), count)


ROW = "block int, quotient int, runs binary, remainders binary, counts binary, large binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def grams(tokens: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all runs of two words (the third is 0) and three words within pieces, none of them numbered 0."""
    g, first = number[tokens & ~FIRST], (tokens & FIRST) != 0
    two = (g[:-1] > 0) & (g[1:] > 0) & ~first[1:]
    three = two[:-1] & two[1:]
    i, j = np.flatnonzero(two), np.flatnonzero(three)
    return np.concatenate([g[i], g[j]]), np.concatenate([g[i + 1], g[j + 1]]), np.concatenate([np.zeros(len(i), np.int64), g[j + 2]])


def filters(batches: Iterator[pa.RecordBatch], keys: Keys, block_bits: int) -> Iterator[pa.RecordBatch]:
    """The filters of a task's shards, merged as long as they are small together, as rows."""
    held: list[Filter] = []

    def rows() -> pa.RecordBatch:
        out = list(encoded(merge(held, keys.half), keys.half, block_bits))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=NAMES)

    for batch in batches:
        for k in range(len(batch)):
            tokens = np.frombuffer(batch["tokens"][k].as_buffer(), np.uint32)
            place, word = batch["numbers"][k].values.flatten()
            number = np.zeros(int((tokens & ~FIRST).max(initial=0)) + 1, np.int64)
            number[place.to_numpy()] = word.to_numpy()
            f = counted(*keys.permute(*keys.pack(*grams(tokens, number))), None, keys.half)
            if len(f.count):
                held.append(f)
                if len(held) > 1 and sum(len(x.count) for x in held) > MERGED:
                    held[:] = [merge(held, keys.half)]
                    if len(held[0].count) > MERGED // 2:
                        yield rows()
    if held:
        yield rows()
    release_memory()


# ---------------------------------------------------------------- on tables


def attached(rows: DataFrame, others: DataFrame, *on: str) -> DataFrame:
    """``rows`` joined with ``others``, whose ``on`` are distinct; hot ones are joined where they are."""
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n")).join(others.hint("merge"), list(on))
    return joined_by_size(rows, sizes, list(on), rows.count()).drop("_n")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(`{a}` as decimal(15,0)) * cast(`{a}` as decimal(15,0))) div (cast(`{left}` as decimal(18,0)) * cast(`{right}` as decimal(18,0)))").cast("long")


def frequent_grams(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(langs(lang, n), words(id, lang, word, f), grams(a, b, c, f))``: all words of each language, those that occur
    ``least`` times or more with numbers from 1, and their runs of two (c is 0) and three that do so too."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = stored(texts.mapInArrow(shards, "shard long, lang string, words array<string>, counts array<long>, tokens binary"))
    langs = parts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    seen = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"), F.count("*").alias("in_shards"))
    words = stored(numbered(seen.where(F.col("f") >= least), "lang", "word").withColumnRenamed("position", "id"))
    many, in_shards, occurrences = words.agg(F.count("*"), F.sum("in_shards"), F.sum("f")).first()
    keys = Keys(max(2, int(many).bit_length()))
    block_bits = min(max(0, (2 * int(occurrences or 0) // BLOCK).bit_length()), keys.half - 1, 30)

    local = parts.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    named = joined_by_size(local, words.select("lang", "word", "id", F.col("in_shards").alias("_n")), ["lang", "word"], int(in_shards or 0))
    numbers = named.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("numbers"))  # no more than a shard's words
    dealt = parts.select("shard", "tokens").join(numbers.hint("merge"), "shard").select("tokens", "numbers")
    rows = dealt.mapInArrow(lambda b: filters(b, keys, block_bits), ROW)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        f = merge([decoded(r, keys.half, block_bits) for r in frame[NAMES].itertuples(index=False, name=None)], keys.half)
        keep = f.count >= least
        a, b, c = keys.unpack(*keys.restore(f.left[keep], f.right[keep]))
        return pd.DataFrame({"a": a, "b": b, "c": c, "f": f.count[keep]})

    return langs, words.select("id", "lang", "word", "f"), stored(rows.groupBy("block").applyInPandas(total, "a long, b long, c long, f long"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two or three words of ``docs(lang, text)``.

    A phrase that occurs a >= ``least`` times inside of pieces is cut where floor(10^6 a^2 / (l r)) is least, l and r the
    occurrences of its parts; it is left out if a longer one around it has ``share`` hundredths of its occurrences or
    more. n: all words of the language. Ties go to the phrase that occurs more often, then to the smaller one in bytes.
    A null text is empty, a null language is "und", and both that and texts without words give no rows. Texts of any
    length are read whole, and repeated rows count as often as they occur. An empty table gives no rows; other columns
    are ignored.
    """
    langs, words, runs = frequent_grams(docs, least)
    first = words.select(F.col("id").alias("a"), "lang", F.col("word").alias("w1"), F.col("f").alias("l"))
    second = words.select(F.col("id").alias("b"), F.col("word").alias("w2"), F.col("f").alias("r"))
    pairs = stored(attached(attached(runs.where("c = 0").select("a", "b", "f"), first, "a"), second, "b"))
    front = pairs.select("a", "b", "lang", F.concat_ws(" ", "w1", "w2").alias("front"), F.col("l").alias("l1"), F.col("f").alias("l2"))
    back = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w2").alias("w3"), F.col("f").alias("r1"), F.col("r").alias("r2"))
    triples = stored(attached(attached(runs.where("c > 0"), front, "a", "b"), back, "b", "c"))

    around = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    kept = pairs.join(around.hint("merge"), ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    twos = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "f", "l", "r", score_of("f", "l", "r").alias("score"))
    cut = triples.select("*", score_of("f", "l1", "r1").alias("s1"), score_of("f", "l2", "r2").alias("s2"))
    early = F.col("s1") <= F.col("s2")
    threes = cut.select("lang", F.concat_ws(" ", "front", "w3").alias("phrase"), "f", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    best, order = twos.unionByName(threes).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), (F.desc("score"), F.desc("f"), "phrase")
    for keys in (["lang", "_salt"], ["lang"]):  # so that no task gets more than SALTS times ``top`` phrases of a language
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(langs.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
