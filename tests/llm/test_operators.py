"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ctw, embedding_dedup, html_density, mixing, packing, pii, quality_cnn, simhash_dedup, url_filter, winnowing

WORDS = [a + b for a in "th er on an re he in ed".split() for b in "nd ha at en es of or".split()]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=40, seed=1):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    out[3], out[4] = out[2], out[2] + " more"
    return out


def documents(spark, extra=()):
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t)) for i, t in enumerate(texts())]
    rows += [(100, None, None, None, None), (101, "", "fr", "src1", 0), (102, "x" * 30_000, "en", "src0", 30_000), (103, " \t\n", "en", None, 3), *extra]
    return spark.createDataFrame(rows, DOC)


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- op1


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.08, base[:5] * 3, base[:2]]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 0), (93, [None] * 16, 0), (94, [], 0), (95, [1.0] * 3, 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    root = components(len(u), zip(*np.nonzero(near), strict=True))
    for i in range(len(u)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(90, 96))
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_a_few_directions_are_parted_by_the_grid(spark):
    """Spread along few axes, with planted copies: all links, and far fewer pairs looked at than there are, the more so the more rows."""
    rng = np.random.default_rng(5)
    looked_at = []
    for n in (400, 1600):
        v = rng.normal(size=(n, 24)) * np.where(np.arange(24) < 6, 1.0, 0.05) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
        v[n // 2 : n // 2 + 40] = v[:40] + rng.normal(size=(40, 24)) * 0.004
        v = v.astype(np.float32)
        got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), 0.999).collect()}
        u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
        near = (u @ u.T >= 0.999) & ~np.eye(n, dtype=bool)
        root = components(n, zip(*np.nonzero(near), strict=True))
        assert near.sum() >= 80 and all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), root[i]) for i in range(n))
        frame = pd.DataFrame({"cls": range(n), "size": 1, "embedding": list(v)})
        spaces = embedding_dedup.Spaces(frame[["embedding"]], 0.999)
        assert spaces[24].grid is not None
        dealt = pd.concat(embedding_dedup.deal(iter([frame]), spaces))
        home = dealt.groupby("key")["home"].agg(["sum", "count"])
        pairs = (home["sum"] * (home["sum"] - 1) / 2 + home["sum"] * (home["count"] - home["sum"])).sum()
        looked_at.append(pairs / (n * (n - 1) / 2))
    print("pairs looked at, of all:", looked_at)
    assert max(looked_at) < 0.5


def test_vectors_that_share_an_id(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.001]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id is not null").select("vec_id", "n_links", "component_id").collect())
    assert got == [(3, 1, 3), (7, 1, 3), (7, 1, 7), (8, 1, 7)]


# ---------------------------------------------------------------- op2


def spark_hash(values):
    """xxhash64 as Spark has it: each value hashed with the hash of those before as seed, from 42 on."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def tokens_plain(text):
    p = winnowing.PIECE
    runs = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(winnowing.UPPER, winnowing.LOWER)))
    return [t for run in runs for t in ([run] if len(run) <= p else [run[i : i + p] for i in range(len(run) - p + 1)])]


def winnow_plain(text):
    """``(hash, position)`` of the rightmost smallest gram of each window."""
    k, w = winnowing.K, winnowing.W
    h = [spark_hash([t.encode()]) for t in tokens_plain(text)]
    grams = [(spark_hash(h[i : i + k]) % (1 << 64)) >> 27 for i in range(max(1, len(h) - k + 1))] if h else []
    out = []
    for at in range(max(1, len(grams) - w + 1) if grams else 0):
        g, i = min((g, -i) for i, g in enumerate(grams[at : at + w], at))
        if not out or out[-1] != (g, -i):
            out.append((g, -i))
    return out


def jaccard(a, b):
    a, b = {g for g, _ in a}, {g for g, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_plain(spark):
    docs = documents(spark, extra=[(110, "a a a a a a a a a a a a a b", "en", "s", 1), (110, "the same id", "en", "s", 1), (None, "another null id", "en", "s", 1), (111, texts()[5], "en", "s", 1), (112, texts()[5], "en", "s", 1)])
    rows = winnowing.winnow(docs.withColumns({"tie": F.lit(1), "stretch": F.lit("x"), "guest": F.lit(None)})).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, spark_hash([r[1].encode()])))
    got = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, [g for g in order if g[0] == r["doc_id"] and len(g[1]) == r["n_chars"]][0][1]))
    assert len(rows) == len(order)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    for k, (i, t) in enumerate(order):
        r, following = by[i, len(t)], order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        own, changed = winnow_plain(t), winnow_plain(edited)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{g:X}@{p}" for g, p in own)
        assert r["edited_fingerprint"] == " ".join(f"{g:X}@{p}" for g, p in changed)
        assert r["near_edited"] == pytest.approx(jaccard(own, changed)) and r["near_next"] == pytest.approx(jaccard(own, winnow_plain(following)))
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    assert winnowing.winnow(one).first()["near_next"] == 1
    assert winnowing.winnow(one.where("false")).count() == 0


def test_stretches_hold_their_share(spark):
    """A far-off id, a hot id and null ids: no stretch holds much more than its share, and they follow the ids."""
    ids = [*range(3000), 10**15, *[1500] * 3000, *[None] * 2000]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = winnowing.in_stretches(docs).collect()
    size = {}
    for r in rows:
        size[r["stretch"]] = size.get(r["stretch"], 0) + 1
    assert max(size.values()) < 3 * winnowing.STRETCH
    low, high = {}, {}
    for r in rows:
        if r["doc_id"] is not None:
            low[r["stretch"]] = min(low.get(r["stretch"], 10**16), r["doc_id"])
            high[r["stretch"]] = max(high.get(r["stretch"], 0), r["doc_id"])
    order = sorted(low)
    assert all(high[a] <= low[b] for a, b in zip(order, order[1:], strict=False)) and all(r["stretch"] < 0 for r in rows if r["doc_id"] is None)
    following = {r["text"]: r["next_text"] for r in winnowing.with_next(docs).where("not guest").collect()}
    assert len(set(following.values())) == len(ids)  # one round through all


def test_winnowing_finds_passages_at_any_offset(spark):
    rng = random.Random(12)
    passage = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    rows = [(k, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20 + k)) + passage + "end" * k) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{x.split("@")[0] for x in r["fingerprint"].split()} for r in winnowing.winnow(docs).orderBy("doc_id").collect()]
    assert all(a & b for a in found for b in found)
    assert all(r["near_next"] > 0 for r in winnowing.winnow(docs).collect())
    plain = "a bcd efgh ijklmnopqr\tn " + "\U0001f600" * 11
    got = spark.createDataFrame([(plain,)], "t string").select(winnowing.tokens(F.col("t")).alias("x")).first()["x"]
    assert got == tokens_plain(plain)


# ---------------------------------------------------------------- op3


def ctw_plain(train, text, depth):
    """The tree as dictionaries, weighted by recursion."""
    counts = {}

    def bits(data, p):
        for k in range(8):
            yield (1 << k) + (data[p] >> (8 - k)), (data[p] >> (7 - k)) & 1

    def stream(t):
        return b"\0" * depth + t.encode().lower() + b"\0"

    for t in train:
        d = stream(t)
        for p in range(depth, len(d)):
            for at, bit in bits(d, p):
                for n in range(depth + 1):
                    counts.setdefault((d[p - n : p], at), [0, 0])[bit] += 1

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(c) + 1)

    children = {}
    for context, at in counts:
        if context:
            children.setdefault((context[1:], at), []).append((context, at))

    def pw(node):
        own = kt(counts[node])
        if len(node[0]) == depth:
            return own
        below = sum(pw(c) for c in children.get(node, []))
        return np.logaddexp(own, below) + math.log(0.5)

    total, d = 0.0, stream(text)
    for p in range(depth, len(d)):
        for at, bit in bits(d, p):
            q = 0.5  # of a context without counts
            for n in range(depth, -1, -1):
                node = (d[p - n : p], at)
                if node in counts:
                    # the weighted probability of one more 1 after all that the node has seen, over that without it
                    c = counts[node]
                    if n == depth:
                        q = math.exp(kt([c[0], c[1] + 1]) - kt(c))
                    else:
                        product = sum(pw(x) for x in children.get(node, []))
                        q = math.exp(np.logaddexp(kt([c[0], c[1] + 1]), product + math.log(q)) - np.logaddexp(kt(c), product))
            total += math.log10(q if bit else 1 - q)
    return total


def test_ctw_against_a_plain_tree(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(12))] + [(50, None), (51, "unseen zzz")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ctw.ctw_scores(docs, head_words=5).collect()}
    known = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    train = [t for i, t in known.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for t in train:
        for w in [*t.lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in known.items():
        ws = [*t.lower().split(), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
    for i in (0, 1, 50, 51):
        assert rows[i]["score"] == pytest.approx(ctw_plain(train, known[i], ctw.DEPTH), rel=2e-3, abs=0.02)


def test_ctw_keeps_every_context(spark):
    """More contexts than 2^21 slots a depth could hold without loss; every gram has the probability that a plain tree gives."""
    rng = random.Random(31)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    train = ["".join(rng.choices(alphabet, k=50_000)) for _ in range(8)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:8]
    seen, fresh = train[0][:400], "".join(rng.choices(alphabet, k=300)) + "\u00e9"
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([*zip(ids, train, strict=True), (out[0], seen), (out[1], fresh), (out[2], None), (None, seen)], "doc_id long, text string").repartition(3)
    rows = ctw.ctw_scores(docs).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: r["score"] for r in rows}
    learned = b"".join(b"\0" * ctw.DEPTH + t.encode() + b"\0" for t in [*train, seen])
    # what the tree says of a text needs the nodes on its path and all of their children: Pw bottom-up over the whole data
    g = np.concatenate([ctw.grams([t])[0] for t in [*train, seen]])
    assert len(learned) - ctw.DEPTH * 9 == len(g)
    keys, n = np.unique(g, return_counts=True)
    assert len(keys) > 350_000
    tables = []
    for depth in range(ctw.DEPTH, -1, -1):
        nodes = {}
        for k in range(8):
            context = (keys >> 8) >> (8 * (ctw.DEPTH - depth))
            node = (context << 8) + (1 << k) + ((keys & 255) >> (8 - k))
            bit = (keys >> (7 - k)) & 1
            u, inverse = np.unique(node, return_inverse=True)
            a, b = np.bincount(inverse, n * (1 - bit)), np.bincount(inverse, n * bit)
            kt = np.array([math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a, b, strict=True)])
            pw = kt
            if tables:
                child, _, _, child_pw = tables[-1][k]
                above = (((child >> 8) >> 8) << 8) + (child & 255)
                pw = math.log(0.5) + np.logaddexp(kt, np.bincount(np.searchsorted(u, above), child_pw, len(u)))
            nodes[k] = (u, (b + 0.5) / (a + b + 1), np.exp(kt + math.log(0.5) - pw), pw)
        tables.append(nodes)
    for i, t in ((out[0], seen), (out[1], fresh), (out[2], "")):
        total = 0.0
        for x in ctw.grams([t])[0].tolist():
            for k in range(8):
                q = 0.5
                for depth, nodes in zip(range(ctw.DEPTH, -1, -1), tables, strict=True):
                    node = (((x >> 8) >> (8 * (ctw.DEPTH - depth))) << 8) + (1 << k) + ((x & 255) >> (8 - k))
                    u, own, w, _ = nodes[k]
                    at = np.searchsorted(u, node)
                    if at < len(u) and u[at] == node:
                        weight = w[at] if depth < ctw.DEPTH else 1.0
                        q = weight * own[at] + (1 - weight) * q
                total += math.log10(q if (x >> (7 - k)) & 1 else 1 - q)
        assert got[i] == pytest.approx(total, rel=1e-5)


# ---------------------------------------------------------------- op4


def test_url_filter(spark):
    urls = ["http://A.Org/x?y", "https://www.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1#a", "http://com/de/", "nourl", None, "http://spam-farm.example.net/en/1", "http://thering.example.net/en/9", "ftp://h", "http://notorg/"]
    rows = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [rows[i]["rule"] for i in range(12)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [rows[i]["verdict"] for i in range(6)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert rows[8]["verdict"] == "block" and rows[9]["verdict"] == "allow"
    assert (rows[0]["host"], rows[0]["path"]) == ("a.org", "/x") and (rows[7]["host"], rows[7]["path"]) == ("", "") and rows[10]["host"] == "h"


# ---------------------------------------------------------------- op5


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, extra=[(0, texts()[0], "en", "s", 1)])
    rows = [r.asDict() for r in packing.best_two_fit(docs, 256).collect()]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    pieces = sorted((i, n, k, len(ids[n : n + 256]), zlib.crc32(np.asarray(ids[n : n + 256], "<u4").tobytes())) for i, ids in want for k, n in enumerate(range(0, len(ids), 256)))
    assert sorted((r["doc_id"], r["start"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 256) + 1
    assert packing.best_two_fit(docs.where("false")).count() == 0


def test_plan_packs_every_piece_once():
    rng = np.random.default_rng(3)
    counts = np.zeros(101, np.int64)
    for n in rng.integers(1, 101, 400):
        counts[n] += int(rng.integers(1, 30))
    used, bins = np.zeros_like(counts), {}
    for length, first, times, copies, base, _ in packing.plan(counts, 100):
        assert first == used[length]
        used[length] += times * copies
        for b in range(base, base + times):
            bins[b] = bins.get(b, 0) + length * copies
    assert (used == counts).all() and max(bins.values()) <= 100
    assert len(bins) <= math.ceil((counts * np.arange(101)).sum() / 100) * 1.08


# ---------------------------------------------------------------- op6


def pii_plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def test_patterns_against_plain_regular_expressions():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-+ (9)é%") for _ in range(50))
        assert pii.base_spans(t) == pii_plain(t)


def test_field_adds_and_keeps(spark):
    rng = random.Random(5)
    some = [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now" for _ in range(60)] + [f"server {rng.randint(1, 255)}.{rng.randint(1, 255)}.0.{rng.randint(1, 255)} is up" for _ in range(30)] + [f"id {rng.randint(10**8, 10**9)} of 2024" for _ in range(30)]
    extra = [(300, "ring (555) 123-4567 today"), (301, "nothing 2024-01-15 here"), (302, None), (303, ""), (304, "5" * 20_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + extra, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(some):
        assert [tuple(s) for s in rows[i]["base"]] == pii_plain(t)
        assert set(map(tuple, rows[i]["base"])) <= set(map(tuple, rows[i]["spans"]))
    assert [tuple(s) for s in rows[300]["spans"]] == [("phone", 5, 19)]
    assert not rows[301]["spans"] and not rows[302]["spans"] and not rows[303]["spans"]
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert masked[300] == "ring [PHONE] today" and masked[302] is None and masked[301] == extra[1][1]


# ---------------------------------------------------------------- op7


def test_html(spark):
    story = "<p>First   long paragraph with a <a href=z>link</a> and text that goes on and on.<p>Second &amp; last paragraph, of some length as well, without doubt.</p>"
    pages = [
        f'<html><body><nav><a href=a>Menu</a></nav><div class="ad">Buy now, very cheap and good.</div><article><h1>Title</h1>{story}</article><footer>Foot</footer></body></html>',
        f'<body><div id="cookie-notice">We use cookies to make this page better for all of you.</div><div class="post"><h1>Title</h1><div>{story}</div></div><div class="comments"><p>Nice one, thank you very much for it.</p></div><script>var x = "<p>no</p>"</script>',
        None,
        "",
        "<p",
        "plain words",
        "<div>" * 3000 + "deep",
    ]
    got = {r["page_id"]: r for r in html_density.extract_main_text(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    want = "Title\nFirst long paragraph with a link and text that goes on and on.\nSecond & last paragraph, of some length as well, without doubt."
    assert got[0]["text"] == want and got[1]["text"] == want
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[5]["text"] == "plain words" and got[6]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_keeps_the_article_in_named_wrappers():
    story = "".join(f"<p>Paragraph {i} of the story, which is long enough to be the article of this page.</p>" for i in range(6))
    aside = "<div><p>Short note.</p></div>"
    for wrapper in ("class='content has-sidebar'", "class='no-sidebar'", "class='main-content comments-open'", "class='post-share-enabled'", "class='page-header-fixed'", "class='search-results'", "class='sidebar'", "id='legal-basis'", "id='social'"):
        for inner in (story, f"<article>{story}</article>"):
            assert html_density.main_text(f"<body><div {wrapper}>{inner}</div>{aside}</body>").count("Paragraph") == 6, (wrapper, inner[:9])
    assert html_density.main_text(f"<body><form action=x>{story}<select><option>one</select><button>Go</button></form>{aside}</body>").count("Paragraph") == 6
    page = f"<body><article>{story}<section id='discussion'><p>What we discuss here.</p></section><div class='share'>Share it</div></article><div class='sidebar'><p>Other.</p></div></body>"
    text = html_density.main_text(page)
    assert "What we discuss" in text and "Share it" not in text and "Other." not in text


# ---------------------------------------------------------------- op8


def test_quality_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        words = rng.choices(WORDS, k=rng.randint(30, 200))
        rows.append((i, " ".join(words if good else [w + rng.choice(["###", "$$$", "&&&"]) for w in words])))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_cnn.quality_classifier(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [i for i, _ in labels if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert len(held) > 30 and np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert 0 <= out[900]["score"] == out[901]["score"] <= 1


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 5000):
        t = "".join(chr(97 + i % 26) for i in range(n))
        seen = bytearray()
        for k, c in enumerate(quality_cnn.chunks(t)):
            at = k * (quality_cnn.CHUNK - quality_cnn.OVERLAP)
            assert at <= len(seen)
            seen[at:] = c
        assert bytes(seen) == t.encode()


# ---------------------------------------------------------------- op9


def test_poisson_replicas(spark):
    docs = documents(spark, extra=[(500 + i, "t", "es", "s", 1) for i in range(200)])
    rows = mixing.poisson_replicas(docs, {"en": 0.5, "de": 0.3, "es": 0.2}, "lang", exponent=None).collect()
    named = [r for r in rows if r["lang"] in ("en", "de", "es")]
    for lang, share in (("en", 0.5), ("de", 0.3), ("es", 0.2)):
        size = sum(r["lang"] == lang for r in named)
        rate = len(named) * share / size
        for r in named:
            if r["lang"] == lang:
                u = (int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                k, p = 0, math.exp(-rate)
                c = p
                while c < u:
                    k += 1
                    p *= rate / k
                    c += p
                assert r["copies"] == k and r["rate"] == pytest.approx(rate)
    assert all(r["rate"] == 1 for r in rows if r["lang"] not in ("en", "de", "es"))
    mixed = mixing.mix(docs).collect()  # in order
    assert [r["order_key"] for r in mixed] == sorted(r["order_key"] for r in mixed)


def test_sources_reach_their_shares(spark):
    """A hot source, many small ones, a null one: the pipeline's stage brings each to its target."""
    sizes = {"src0": 3000, "src1": 500, None: 100, **{f"s{i}": 40 + 20 * i for i in range(12)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, "t", "en", s, 1) for i, s in enumerate(names)], DOC)
    rows = mixing.poisson_replicas(docs, mixing.SOURCE_WEIGHTS, "source", exponent=0.5).collect()
    left = 1 - sum(mixing.SOURCE_WEIGHTS.values())
    roots = sum(n**0.5 for s, n in sizes.items() if s not in mixing.SOURCE_WEIGHTS)
    for s, n in sizes.items():
        share = mixing.SOURCE_WEIGHTS.get(s, left * n**0.5 / roots)
        assert {round(r["rate"], 9) for r in rows if r["source"] == s} == {round(len(names) * share / n, 9)}
    mixed = [r["source"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    for s, n in sizes.items():
        share = mixing.SOURCE_WEIGHTS.get(s, left * n**0.5 / roots)
        want = len(names) * share
        assert abs(mixed.count(s) - want) < 5 * want**0.5


# ---------------------------------------------------------------- op10


def simhash_plain(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(winnowing.UPPER, winnowing.LOWER))) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    base = " ".join(texts()[7].split() * 3)
    extra = [(200 + i, base + f" tail{i}", "en", "s", 1) for i in range(12)] + [(5, texts()[5], "en", "s", 1)]
    docs = documents(spark, extra)
    want = {r["doc_id"]: simhash_plain(r["text"]) for r in docs.collect()}
    ids = sorted(want)
    root = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (want[ids[i]] ^ want[ids[j]]).bit_count() <= 4])
    rows = simhash_dedup.simhash_dedup(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["fingerprint"] == f"{want[r['doc_id']]:016x}"
        assert r["component_id"] == ids[root[ids.index(r["doc_id"])]]
    assert simhash_dedup.simhash_dedup(docs.where("false")).count() == 0


def test_tiles_of_a_hot_key_lose_no_link(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64)]
    while len(fps) < 300:
        fps.append(fps[rng.randrange(len(fps))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in dict.fromkeys(fps)]
    found = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    was = simhash_dedup.tiles.__defaults__
    simhash_dedup.tiles.__defaults__ = (40,)  # chunks of 40 rows
    try:
        got = {r["fp"]: r["component"] for r in simhash_dedup.fingerprint_groups(found).collect()}
    finally:
        simhash_dedup.tiles.__defaults__ = was
    u = [f & (2**64 - 1) for f in fps]
    root = components(len(u), [(i, j) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4])
    assert [got[f] for f in fps] == root


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_fit_together(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "source_mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert 2 in kept and 3 not in kept
    assert "sequence_id" in corpus_pipeline.run(spark, str(tmp_path)).columns


def test_near_dedup_with_null_and_repeated_ids(spark):
    t = texts()
    rows = [(None, t[k], "en", "s", k) for k in (5, 6, 7, 8)] + [(None, t[20], "en", "s", 1), (None, t[20], "de", "s", 1)]
    rows += [(1, t[5], "en", "s", 1), (2, t[9], "en", "s", 1), (2, t[10], "en", "s", 1), (3, t[11], "en", "s", 1), (3, t[11], "en", "s", 1), (4, t[10], "en", "s", 1), (None, None, None, None, None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    fps = [simhash_plain(r[1]) for r in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for c in set(root):
        group = [r for r, k in zip(rows, root, strict=True) if k == c]
        here = [r for r in got if r in group]
        assert len(here) == 1
        assert here[0][0] == min((r[0] for r in group if r[0] is not None), default=None)
    assert len(got) == len(set(root))
