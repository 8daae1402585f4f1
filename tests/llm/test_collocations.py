"""Collocations against plain counting, and the filters' round trips."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C


@pytest.mark.parametrize("bits", [2, 3, 7, 20, 21, 22, 31, 42])
def test_keys_and_filters_come_back(bits):
    rng, keys = np.random.default_rng(bits), C.Keys(bits)
    words = [rng.integers(0, 1 << bits, 500) for _ in range(3)]
    words = [np.concatenate([w, w[:200], [0, (1 << bits) - 1]]) for w in words]
    left, right = keys.permute(*keys.pack(*words))
    assert all((a == b).all() for a, b in zip(keys.unpack(*keys.restore(left, right)), words, strict=True))
    assert max(left.max(), right.max()) < 1 << keys.half
    want = Counter(zip(*(w.tolist() for w in words), strict=True))
    count = rng.integers(1, 400, len(left))
    for f, expected in ((C.counted(left.copy(), right.copy(), None, keys.half), want), (C.merge([C.counted(left[:300], right[:300], count[:300], keys.half), C.counted(left[300:], right[300:], count[300:], keys.half)], keys.half), Counter())):
        if not expected:
            for w, n in zip(zip(*(w.tolist() for w in words), strict=True), count.tolist(), strict=True):
                expected[w] += n
        for block_bits in {0, 1, min(5, keys.half - 1)}:
            parts = [C.decoded(r, keys.half, block_bits) for r in C.encoded(f, keys.half, block_bits)]
            got = C.Filter(*map(np.concatenate, zip(*parts, strict=True)))
            assert (got.left == f.left).all() and (got.right == f.right).all() and (got.count == f.count).all()
            assert dict(zip(zip(*(x.tolist() for x in keys.unpack(*keys.restore(got.left, got.right))), strict=True), got.count.tolist(), strict=True)) == expected


def plain(rows, least=10, share=50, top=2000):
    runs, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                runs.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for (lang, p), a in runs.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(100 * c >= share * a for (g, q), c in runs.items() if g == lang and len(q) == 3 and c >= least and p in (q[:2], q[1:])):
            continue
        score, k = min((10**6 * a * a // (runs[lang, p[:k]] * runs[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, runs[lang, p[:k]], runs[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, done = Counter(), []
    for lang, phrase, *rest in out:
        place[lang] += 1
        if place[lang] <= top:
            done.append((lang, place[lang], phrase, *rest))
    return done


def fixture():
    rng = random.Random(4)
    words = ["The", "of", "new", "york", "City", "état", "é", "a-b", "x y", "\U0001f600", "q"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60)))
        text += rng.choice(["", ". New York City", "; new york\tcity  of", "\nof the\x0bof the", " z" * 5])
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("fr", "only rare words"), ("en", "long words " * 3000), ("en", "w" * 5000)] + [("de", "same text again")] * 12


@pytest.mark.parametrize("top", [2000, 3])
def test_against_plain_counting(spark, top):
    rows = fixture()
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit("x") for c in ("words", "f", "id", "n", "shard", "_n", "rank")})
    got = sorted(tuple(r) for r in C.collocations(d, top=top).collect())
    assert got == sorted(plain(rows, top=top))


def test_small_shards_and_blocks(spark, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(C, "SHARD", 300)
    assert list(C.in_parts(b"ab, cd" * 200)) != [b"ab, cd" * 200] and b"".join(C.in_parts(b"ab, cd" * 200)) == b"ab, cd" * 200 and list(C.in_parts(b"x" * 900)) == [b"x" * 900]
    monkeypatch.setattr(C, "BLOCK", 500)
    monkeypatch.setattr(C, "MERGED", 50)
    got = sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(2)).collect())
    assert got == sorted(plain(rows))


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**14 + 1, 4 * 10**14 + 7, 10**17 - 3
    r = spark.createDataFrame([(a, left, right), (a, a, a), (10, 10**17, 10**17)], "f long, l long, r long").select(C.score_of("f", "l", "r").alias("s")).collect()
    assert [x["s"] for x in r] == [10**6 * a * a // (left * right), 10**6, 0]


def test_no_rows(spark):
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert C.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0
