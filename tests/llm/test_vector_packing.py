"""Vector bin packing: round trips, limits and padding, and the tokenizer's own ids."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_packing
from tessera.llm.packing import tokenizer_path

ODD = ["a  b", "x  y 　z  q", "<|endoftext|> a <|endoftext|>b c<|endoftext|>", "\n\n a\n b \t c\r\n", "it's we'll 123  456 é è à b\u0085 c", "   ", "日本語 テスト \U0001f600", "\x0b a\x0c b\x1c c\x00 d", "café — “q” …", " " * 3000 + "x", "y" * 5000, "a" + "\n" * 1500]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(vector_packing.VOCABULARY))


def test_ids_are_the_tokenizers():
    encode, whole = vector_packing.ByteEncoder(tokenizer_path(vector_packing.VOCABULARY)), tokenizer()
    rng = random.Random(1)
    alphabet = "ab Z9\n\t'.-éü中\U0001f600 s"
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 64), (64, 64, 20), (50, 5, 7), (1, 1, 1)])
def test_pack_keeps_all_and_its_limits(limits):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 200, 150)
    prompt = np.minimum(n, rng.integers(1, 90, 150))
    for n, prompt in ((n, prompt), (np.full(300, 2), np.ones(300, int)), (np.array([5000]), np.array([1])), (np.array([700]), np.array([700])), (np.zeros(0, int), np.zeros(0, int))):
        rows = vector_packing.pack(n, prompt, *limits)
        places, pieces = {}, {}
        for doc, start, length, sequence, offset in rows:
            assert length > 0
            places.setdefault(sequence, []).append((offset, length, max(0, start + length - max(start, prompt[doc]))))
            pieces.setdefault(doc, []).append((start, length))
        for p in places.values():
            p.sort()
            used = sum(x for _, x, _ in p)
            assert p[0][0] == 0 and all(a + b == c for (a, b, _), (c, _, _) in zip(p, p[1:], strict=False))
            assert used <= limits[0] and len(p) <= limits[1] and sum(q for _, _, q in p) <= limits[2]
            assert used == limits[0] or used & (used - 1) == 0
        for doc, size in enumerate(n):
            p = sorted(pieces[doc])
            assert p[0][0] == 0 and p[-1][0] + p[-1][1] == size and all(a + b == c for (a, b), (c, _) in zip(p, p[1:], strict=False))


def test_documents_come_back(spark):
    texts = ODD + [" ".join(["word", "other", "thing"][i % 3] for i in range(k * 37 % 900)) for k in range(60)] + [None, "", "long " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("start", "length", "n", "sequence_id")})
    whole = tokenizer()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    got = vector_packing.vector_bins(d).collect()
    assert sum(r["length"] for r in got) == sum(len(x) for w in want.values() for x in w)
    sequences, starts = {}, {}
    for r in got:
        ids = want[r["doc_id"]]
        piece = np.array(ids[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(ids[0]) and r["ids_crc32"] == zlib.crc32(piece)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        starts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, s in starts.items():
        assert sorted(x for a, b in s for x in range(a, a + b)) == sorted([*range(len(want[i][0]))] * len(want[i]))
    for p in sequences.values():
        p.sort()
        used = sum(b for _, b in p)
        assert all(a + b == c for (a, b), (c, _) in zip(p, p[1:], strict=False)) and p[0][0] == 0 and used <= 2048 and (used == 2048 or used & (used - 1) == 0)


def test_instruction_data(spark):
    """Prompts bear no loss; three limits hold at once."""
    rows = [(i, "question " * (i % 40), "answer " * (i % 23)) for i in range(200)] + [(900, None, None), (901, "only a prompt", "")]
    got = vector_packing.vector_bins(spark.createDataFrame(rows, "doc_id long, prompt string, text string"), 256, 6, 90).collect()
    whole = tokenizer()
    size = {i: (len(whole.encode(p or "", add_special_tokens=False).ids), len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, p, t in rows}
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {i: a + b for i, (a, b) in size.items()}
    by = {}
    for r in got:
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], max(1, size[r["doc_id"]][0])))
        s = by.setdefault(r["sequence_id"], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r["length"], s[1] + 1, s[2] + r["loss_tokens"]
    assert all(a <= 256 and b <= 6 and c <= 90 for a, b, c in by.values())


def test_no_rows(spark):
    assert vector_packing.vector_bins(spark.createDataFrame([], "doc_id long, text string")).count() == 0
