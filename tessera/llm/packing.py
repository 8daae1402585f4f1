"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A packing depends on lengths alone, and a length is at most the sequence's: so what is packed is the histogram of
lengths (4,096 rows at most, whatever the input). A bin is filled greedily, the longest piece that fits first; then its
smallest document is replaced by two unpacked ones if those fill the expanded gap more tightly. The bin's pattern is
used as often as the histogram allows, so the number of patterns is bounded by the number of lengths too.

Pieces then find their place without meeting: each is numbered within its length (numbers within hashed parts of a
length, plus the part's offset), and the pattern table says which sequence and offset that number has.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release_memory, stored

MAX_TOKENS = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a task keeps, twice at most.
WORDS_KEPT = 300_000
#: Bytes of text that are encoded at once, about; a longer text is one batch.
BATCH = 16 << 20
#: Rows of one part of a length, about.
PART_ROWS = 2_000


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What a word may be made of to be read piece by piece: runs of Latin letters, single digits and runs of ASCII marks
#: (but no apostrophe) are the tokenizer's own pieces, which it encodes apart and with letters in lower case.
PIECE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Bytes at which words are parted; 1 for a separator.
PARTED = np.zeros(256, bool)
PARTED[[0x20, 0x09, 0x0A, 0x0D]] = True


class WordEncoder:
    """Token ids as little-endian bytes. The tokenizer never joins what a blank or line break parts, so words between
    those are encoded once and looked up after that; what was not used for ``WORDS_KEPT`` new words is forgotten."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.last_of_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, k in self.tokenizer.get_vocab().items():
            self.last_of_word[k] = piece.endswith("</w>")

    def encoded(self, lines: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def learn_pieces(self, pieces: list[str]) -> None:
        """Runs of letters, encoded 64 to a line: each ends with the only id that ends a word."""
        for at in range(0, len(pieces), 4096):
            lines = [pieces[k : k + 64] for k in range(at, min(at + 4096, len(pieces)), 64)]
            for words, ids in zip(lines, self.encoded([" ".join(x) for x in lines]), strict=True):
                ends = ((np.flatnonzero(self.last_of_word[ids]) + 1) * 4).tolist()
                if len(ends) == len(words):
                    data = ids.tobytes()
                    self.known.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
                else:
                    self.known.update(zip(words, [x.tobytes() for x in self.encoded(words)], strict=True))

    def missing(self, words: Iterable[str]) -> set[str]:
        """The words that are not in ``known``, after those of before have been taken over."""
        new = set(words).difference(self.known)
        if self.before:
            again = new.intersection(self.before)
            self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
            new -= again
        return new

    def learn(self, words: Iterable[str]) -> None:
        """Have the ids of all words in ``known``."""
        split, whole = {}, []
        for w in self.missing(words):
            parts = PIECE.findall(w)
            if sum(map(len, parts)) == len(w):
                split[w] = [x.lower() for x in parts]
            else:
                whole.append(w)
        new = self.missing(x for parts in split.values() for x in parts)
        self.learn_pieces([x for x in new if x[0].isalpha()])
        whole += [x for x in new if not x[0].isalpha()]
        for at in range(0, len(whole), 4096):
            self.known.update(zip(whole[at : at + 4096], [x.tobytes() for x in self.encoded(whole[at : at + 4096])], strict=True))
        known = self.known
        for w, parts in split.items():
            known[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])

    def forget(self) -> None:
        """Words are kept for a task, not for as long as its Python worker lives."""
        self.known, self.before = {}, {}

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 bytes without nulls), one after another, and how many each text has.

        Words are cut where a separator stands, which stays at the front of its word; each distinct word of the texts
        is looked up once, and its ids are copied to all of its places.
        """
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        low = ends[0]
        data = np.frombuffer(text.buffers()[2], np.uint8)[low : ends[-1]] if ends[-1] > low else np.zeros(0, np.uint8)
        ends = ends - low
        is_cut = np.append(PARTED[data], False)
        is_cut[ends] = True
        cuts = np.flatnonzero(is_cut)
        words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        kinds = pc.utf8_ltrim(words.dictionary, " \t\r\n").to_pylist()
        self.learn(kinds)
        ids = list(map(self.known.__getitem__, kinds))
        if len(self.known) > WORDS_KEPT:
            self.known, self.before = {}, self.known
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        codes = words.indices.to_numpy()
        n = size[codes]
        done = np.concatenate(([0], np.cumsum(n)))
        table = np.frombuffer(b"".join(ids), "<u4")
        out = table[np.repeat(start[codes] - done[:-1], n) + np.arange(done[-1])]
        return out, np.diff(done[np.searchsorted(cuts, ends)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def in_batches(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts of about ``BATCH`` bytes."""
    sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, side="right")))
        yield at, to
        at = to


def cut(batches: Iterator[pa.RecordBatch], path: str, max_tokens: int) -> Iterator[pa.RecordBatch]:
    """The pieces of the texts; ``lot`` numbers a task's pieces, so that copies of a row can be told apart."""
    encode, lot = encoder(path), 0
    for batch in batches:
        for a, b in in_batches(batch["text"]):
            ids, n = encode(batch["text"][a:b].cast(pa.binary()))
            end = np.cumsum(n)
            ids = np.insert(ids, end, np.uint32(END_ID))
            n = n + 1
            first = np.cumsum(n) - n
            pieces = -(-n // max_tokens)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * max_tokens
            length = np.minimum(max_tokens, n[row] - start)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            from_ = (first[row] + start) * 4
            crc = np.fromiter((zlib.crc32(data[x:y]) for x, y in zip(from_.tolist(), (from_ + 4 * length).tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc), pa.array(np.arange(lot, lot + len(row)))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )
            lot += len(row)
    encode.forget()
    pa.default_memory_pool().release_unused()
    release_memory()


def plan(counts: np.ndarray, size: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals ``(length, first, sequences, copies, base, offset)`` for ``counts[length]`` pieces of each length.

    The pieces of that length numbered first, first + 1, ... fill the sequences base, base + 1, ..., ``copies`` side by
    side in each from ``offset`` on.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    lengths = np.flatnonzero(left)
    base, out = 0, []
    while len(lengths):
        room, bin_, free = size, [], left.copy()
        while room > 0:
            k = np.searchsorted(lengths, room, side="right")
            while k and free[lengths[k - 1]] == 0:
                k -= 1
            if not k:
                break
            length = int(lengths[k - 1])
            many = int(min(free[length], room // length))
            bin_ += [length] * many
            free[length] -= many
            room -= many * length
        if room > 0 and len(bin_) > 1:
            smallest = bin_[-1]
            gap = room + smallest
            ls = lengths[(free[lengths] > 0) & (lengths < gap)]
            if len(ls):
                k = np.searchsorted(ls, gap - ls, side="right") - 1  # the largest partner that fits
                same = (k >= 0) & (ls[k] == ls) & (free[ls] < 2)
                k = np.where(same, k - 1, k)
                both = np.where(k >= 0, ls + ls[k], 0)
                best = int(both.argmax())
                if both[best] > smallest:
                    bin_[-1:] = [int(ls[best]), int(ls[k[best]])]
        kinds, copies = np.unique(bin_, return_counts=True)
        times = int((left[kinds] // copies).min())
        offset = 0
        for length, c in zip(kinds.tolist(), copies.tolist(), strict=True):
            out.append((length, int(used[length]), times, c, base, offset))
            offset += length * c
        used[kinds] += times * copies
        left[kinds] -= times * copies
        base += times
        lengths = lengths[left[lengths] > 0]
    return out


def best_two_fit(docs: DataFrame, max_tokens: int = MAX_TOKENS, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of ``docs(doc_id, text)``.

    A document is its ids and then id 1; a null or empty text is that id alone. Only documents of more than
    ``max_tokens`` ids are cut. Repeated rows are packed as often as they occur; a null doc_id is kept. An empty table
    gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda f: cut(f, path, max_tokens), f"{schema}, lot long"))
    # one row for a length and part: at most max_tokens lengths, and parts of PART_ROWS rows of the commonest
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # bounded by max_tokens
        counts[length] = n
    parts = int(max(1, -(-counts.max() // PART_ROWS)))
    table = pd.DataFrame(plan(counts, max_tokens), columns=["length", "first", "sequences", "copies", "base", "offset"]).sort_values(["length", "first"])
    shared = docs.sparkSession.sparkContext.broadcast({k: table[k].to_numpy() for k in table})

    part = F.pmod(F.xxhash64("lot", "doc_id"), F.lit(parts))  # copies of one row are spread
    pieces = pieces.withColumn("part", part)
    offsets = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "lot")))
    numbered = numbered.join(offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("part", "before")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        stride = np.int64(1) << 44
        starts = t["length"] * stride + t["first"]
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            k = np.searchsorted(starts, length * stride + rank, side="right") - 1
            within = rank - t["first"][k]
            f["sequence_id"] = t["base"][k] + within // t["copies"][k]
            f["offset"] = t["offset"][k] + within % t["copies"][k] * length
            yield f.drop(columns="rank")

    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return numbered.mapInPandas(place, f"{schema}, sequence_id long, offset long") if len(table) else pieces.drop("part", "lot").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
