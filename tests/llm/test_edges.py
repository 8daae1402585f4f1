"""Every operator and stage on awkward tables: null values, empty and long texts, repeated rows, clashing columns, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ctw, embedding_dedup, html_density, mixing, packing, pii, quality_cnn, simhash_dedup, url_filter, winnowing

CLASH = "fp fingerprint component_id score held_out predicted base spans copies rate copy order_key cdf tie stretch guest row part lot _pii _cdf _mixed_by key node size cls h1 g p word n bucket rank length".split()
ROWS = [(1, "a text of a few words, twice"), (1, "a text of a few words, twice"), (1, "the same id"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "long " * 9000), (5, "ünïcödé \U0001f600 \x00 \t\n"), (6, "call +1 202 555 0142 or joe@example.org")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "en", None if i == 2 else f"src{(i or 0) % 3}", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("x") for c in CLASH} | {"odd `name.": F.lit(1)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, "x"), (4, 0, "x"), (4, 1, "x"), (5, None, "x"), (None, 1, "x"), (6, 0, "x")], "doc_id long, quality int, score string")


def test_operators_that_keep_rows(docs, labels):
    field = pii.train_field([])
    for out, n in (
        (winnowing.winnow(docs), len(ROWS)),
        (ctw.ctw_scores(docs), len(ROWS)),
        (simhash_dedup.simhash_dedup(docs), len(ROWS)),
        (pii.find_pii(docs, field), len(ROWS)),
        (pii.mask_pii(docs, field), len(ROWS)),
        (quality_cnn.quality_classifier(docs, labels), len(ROWS)),
    ):
        rows = out.collect()
        assert len(rows) == n and len(set(out.columns)) == len(out.columns)
        ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
        assert ids == sorted(-1 if i is None else i for i, _ in ROWS)


def test_columns_that_stay(docs, labels):
    found = pii.find_pii(docs, pii.train_field([])).where("doc_id = 6").first()
    assert found["_pii"] == "x" and found["odd `name."] == 1 and len(found["base"]) == 2
    judged = quality_cnn.quality_classifier(docs, labels).first()
    assert judged["base"] == "x" and 0 <= judged["score"] <= 1
    mixed = mixing.mix(docs, {"src0": 0.5}).collect()
    assert all(r["cdf"] == "x" and r["_cdf"] == "x" and isinstance(r["copies"], int) for r in mixed)
    same = {}
    for r in mixing.poisson_replicas(docs).collect():
        assert same.setdefault((r["doc_id"], r["source"]), r["copies"]) == r["copies"]


def test_a_large_rate_is_drawn_whole(spark):
    d = spark.createDataFrame([(i, "big" if i < 20_000 else "small") for i in range(20_005)], "doc_id long, source string")
    rows = mixing.poisson_replicas(d, {"big": 0.1, "small": 0.9}).where("source = 'small'").collect()
    rate = 20_005 * 0.9 / 5
    assert all(r["rate"] == pytest.approx(rate) and abs(r["copies"] - rate) < 6 * rate**0.5 for r in rows)


def test_packing_repeated_and_clashing_rows(docs):
    rows = packing.best_two_fit(docs, 512).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert all(a + b == c for (a, b), (c, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and sum(b for _, b in p) <= 512


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>words</p>")] * 2 + [(None, None, None), (2, "http://a.org/x", "")], "page_id long, url string, html string")
    pages = pages.withColumns({"text": F.lit("x"), "host": F.lit("y"), "n_chars": F.lit(0), "score": F.lit(0)})
    assert sorted(r["text"] for r in html_density.extract_main_text(pages).collect()) == ["", "", "words", "words"]
    assert [r["rule"] for r in url_filter.url_filter(pages).where("page_id = 1").collect()] == ["org/", "org/"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>").withColumns({"cls": F.lit("x"), "node": F.lit("x"), "kept": F.lit("x")})
    assert sorted((r["vec_id"], r["n_links"]) for r in embedding_dedup.embedding_dedup(v).where("vec_id is not null").collect()) == [(1, 1), (1, 1), (2, 0)]


def test_tables_without_rows(spark, docs, labels, tmp_path):
    none, pages = docs.where("false"), spark.createDataFrame([], "page_id long, url string, html string")
    for out in (ctw.ctw_scores(none), pii.find_pii(none), quality_cnn.quality_classifier(none, labels.where("false")), mixing.mix(none), html_density.extract_main_text(pages)):
        assert out.count() == 0
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("false").select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_plain_versions(spark, docs, labels, tmp_path):
    """What each stage keeps and changes, from its own input: scores above the threshold, one row of a group, masked spans,
    as many copies as the hash draws, all ids packed."""
    labels.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    texts, quality = quality_cnn.sample(docs, labels)
    net = quality_cnn.Network()
    net.train(texts, quality)
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()
    want = [t for (_, t), s in zip(ROWS, net.scores([t for _, t in ROWS]), strict=True) if s >= quality_cnn.THRESHOLD]
    assert sorted(str(r["text"]) for r in kept) == sorted(map(str, want))

    fps = [simhash_dedup.fingerprint(t) for _, t in ROWS]
    groups = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    groups[i] = groups[j] = min(groups[i], groups[j])
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len(set(groups))

    field = pii.learn(docs.select("doc_id", "text"))
    masked = corpus_pipeline.mask_personal_data(spark, docs, "").collect()
    assert sorted(str(r["text"]) for r in masked) == sorted(str(pii.mask(t, pii.spans_of(t, field)[1]) if t else t) for _, t in ROWS)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in masked)

    copies = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.poisson_replicas(docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert len(mixed) == sum(copies[r] for r in ROWS)
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == len(ROWS) and len({r["sequence_id"] for r in packed}) >= -(-sum(r["length"] for r in packed) // packing.MAX_TOKENS)
    assert np.isfinite([r["offset"] for r in packed]).all()
