"""Vector bin packing of instruction data: sequences under limits on tokens, segments and loss-bearing tokens at once.

Every task packs its own stretches of text, of about ``BATCH`` bytes each, right where they are read: nothing is
shuffled, and what a task holds is bounded. A sequence is filled by the dot-product heuristic: of the examples that fit,
the one whose demands have the largest product with what is left of the limits. Where nothing fits whole, an example is
cut, so that the sequence is full; where a limit other than that on tokens stops a sequence, and at a stretch's end, it
is cut back to a power of two of tokens, which needs no padding either, and the rest goes to another sequence.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import in_batches, tokenizer_path
from .shared import release_memory

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 128, 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"


# ---------------------------------------------------------------- tokens

#: Texts for the tokenizer itself: with its special token, or a run of blanks that the quicker library can't read.
ODD = re.compile(r"<\|endoftext\|>|(?<!\s)\s{1000}")


class ByteEncoder:
    """Token ids of the tokenizer at ``path``, a byte-level vocabulary whose ids are the ranks of its merges: plain texts
    go through ``tiktoken``, which gives the same ids in less time."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # a vocabulary file writes a byte as a printable character: as itself, or else as the next one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in w): k for w, k in self.whole.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in w) and not ODD.search(w)}
        self.plain = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids if ODD.search(text) else self.plain.encode_ordinary(text)


_encoders: dict[str, ByteEncoder] = {}


def token_ids(texts: pa.Array, path: str) -> list[np.ndarray]:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    encode = _encoders[path]
    return [np.asarray(encode(t), "<u4") for t in texts.to_pylist()]


# ---------------------------------------------------------------- bins


class Pool:
    """Examples that are not packed yet, by their kind: tokens and loss-bearing tokens."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[int, int], int] = {}
        self.tokens, self.loss, self.many = (np.zeros(64, np.int64) for _ in range(3))
        self.of_kind: list[list[tuple[int, int]]] = []

    def add(self, doc: int, start: int, tokens: int, loss: int) -> None:
        k = self.kinds.setdefault((tokens, loss), len(self.kinds))
        if k == len(self.of_kind):
            self.of_kind.append([])
            if k == len(self.many):
                self.tokens, self.loss, self.many = (np.concatenate([a, np.zeros_like(a)]) for a in (self.tokens, self.loss, self.many))
            self.tokens[k], self.loss[k] = tokens, loss
        self.of_kind[k].append((doc, start))
        self.many[k] += 1

    def take(self, k: int) -> tuple[int, int]:
        self.many[k] -= 1
        return self.of_kind[k].pop()


def power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def pack(tokens: np.ndarray, loss_from: np.ndarray, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> list[tuple[int, int, int, int, int]]:
    """``(example, start, length, sequence, offset)`` of pieces that hold each of an example's ``tokens`` once; tokens
    from ``loss_from`` on bear loss. No sequence is padded: each is full or a power of two long."""

    def loss_of(doc: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, int(loss_from[doc])))

    def longest(doc: int, start: int, most: int, loss: int) -> int:
        """How many tokens from ``start`` on keep to both."""
        return min(most, max(0, int(loss_from[doc]) - start) + loss)

    pool, out, sequence = Pool(), [], 0
    for doc, n in enumerate(tokens.tolist()):
        start = 0
        while n - start > 0:
            length = min(n - start, longest(doc, start, max_tokens, max_loss))
            if length == max_tokens:  # full by itself
                out.append((doc, start, length, sequence, 0))
                sequence += 1
            else:
                pool.add(doc, start, length, loss_of(doc, start, length))
            start += length
    # demands count in proportion to what all examples ask for of each limit
    kinds = len(pool.kinds)
    left = pool.many[:kinds]
    total = np.array([(left * pool.tokens[:kinds]).sum() / max_tokens, left.sum() / max_segments, (left * pool.loss[:kinds]).sum() / max_loss])
    weight = total / (total.sum() or 1) / np.array([max_tokens, max_segments, max_loss], float) ** 2
    remaining = int(left.sum())
    while remaining:
        bin_: list[list[int]] = []
        room, segments, loss = max_tokens, max_segments, max_loss
        while room and segments and remaining:
            n = len(pool.kinds)
            t, q = pool.tokens[:n], pool.loss[:n]
            score = np.where(pool.many[:n] > 0, weight[0] * room * t + weight[1] * segments + weight[2] * loss * q, -1.0)
            whole = np.where((t <= room) & (q <= loss), score, -1.0)
            k = int(whole.argmax())
            if whole[k] >= 0:
                # of a kind that fits many times, half of what fits at once: the product changes as room does
                fits = min(int(pool.many[k]), room // int(t[k]), segments, loss // int(q[k]) if q[k] else segments)
                for _ in range((fits + 1) // 2):
                    bin_.append([*pool.take(k), int(t[k])])
                    remaining -= 1
                    room, segments, loss = room - int(t[k]), segments - 1, loss - int(q[k])
                continue
            k = int(score.argmax())
            doc, start = pool.take(k)
            length = min(int(t[k]), longest(doc, start, room, loss))
            remaining -= 1
            if length:
                bin_.append([doc, start, length])
                room, segments, loss = room - length, segments - 1, loss - loss_of(doc, start, length)
            if length < t[k]:
                pool.add(doc, start + length, int(t[k]) - length, loss_of(doc, start + length, int(t[k]) - length))
                remaining += 1
            if not length or room:
                break  # what bears loss is used up
        used = max_tokens - room
        excess = used - power_below(used) if room else 0
        while excess:
            doc, start, length = bin_.pop()
            back = min(length, excess)
            if length > back:
                bin_.append([doc, start, length - back])
            pool.add(doc, start + length - back, back, loss_of(doc, start + length - back, back))
            remaining += 1
            excess -= back
        offset = 0
        for doc, start, length in bin_:
            out.append((doc, start, length, sequence, offset))
            offset += length
        sequence += 1
    return merged(out)


def merged(pieces: Iterable[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Pieces of one example that follow one another in a sequence as one, by sequence and offset."""
    of_sequence: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for doc, start, length, sequence, _ in pieces:
        of_sequence[sequence].append((doc, start, length))
    out = []
    for sequence, parts in of_sequence.items():
        parts.sort()
        offset, last = 0, None
        for doc, start, length in parts:
            if last and last[0] == doc and last[1] + last[2] == start:
                last[2] += length
            else:
                last = [doc, start, length, sequence, offset]
                out.append(last)
            offset += length
    return [tuple(x) for x in out]


# ---------------------------------------------------------------- on tables


def packed(batches: Iterator[pa.RecordBatch], path: str, limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 40  # tasks number their own sequences
    end = np.array([END_ID], "<u4")
    for batch in batches:
        for a, b in in_batches(batch["text"]):
            parts = [x for ids in token_ids(batch["text"][a:b], path) for x in (ids, end)]
            prompt = np.ones(b - a, np.int64)
            if "prompt" in batch.schema.names:
                before = token_ids(batch["prompt"][a:b], path)
                prompt = np.maximum(np.fromiter(map(len, before), np.int64, b - a), 1)
                parts = [x for k, ids in enumerate(before) for x in (ids, parts[2 * k], end)]
            size = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(b - a, -1).sum(1)
            data = memoryview(np.concatenate(parts)).cast("B")
            rows = np.array(pack(size, prompt, *limits), np.int64).reshape(-1, 5)
            doc, start, length = rows[:, 0], rows[:, 1], rows[:, 2]
            at = ((np.cumsum(size) - size)[doc] + start) * 4
            crc = np.fromiter((zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(rows))
            loss = np.maximum(0, start + length - np.maximum(start, prompt[doc]))
            columns = [start, length, crc, size[doc], sequence + rows[:, 3], rows[:, 4], loss]
            yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b].take(pa.array(doc)), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            sequence += int(rows[:, 3].max(initial=-1)) + 1
    pa.default_memory_pool().release_unused()
    release_memory()


def vector_bins(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, path: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens)`` for every piece of
    ``docs(doc_id, text)``, or ``docs(doc_id, prompt, text)`` for instruction data.

    An example is its ids, those of the prompt first, and then id 1. Tokens of a prompt bear no loss, nor does an example's
    first one, as nothing predicts it. A sequence has at most ``max_tokens`` tokens, ``max_segments`` pieces and
    ``max_loss`` tokens that bear loss, and is full or a power of two long. Examples of any length are cut as needed; a
    null or empty text is its end alone. Repeated rows are packed as often as they occur, equal ones in any order; a
    null doc_id is kept. An empty table gives no rows; other columns are ignored.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be 1 or more")
    path = path or tokenizer_path(VOCABULARY)
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "text") if c in docs.columns]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return docs.select("doc_id", *texts).mapInArrow(lambda f: packed(f, path, (max_tokens, max_segments, max_loss)), schema)
