"""Very long texts, and columns of other tables whose names clash with the operators' own."""

from __future__ import annotations

import random

from seqspark.llm import langid, media, packing, pieces, pii, quality, simhash, suffixes, toxicity, urls

from .conftest import words


def long_docs(spark):
    rng = random.Random(17)
    text = words(rng, 2000) + "\n"
    big = text * 160  # about 3 MB
    rows = [(1, big, "en", "a"), (2, "x" * 2_000_000, "en", "a"), (3, "9" * 1_000_000 + " z@town.example", "de", "b"), (4, words(rng, 50), "en", "b"), (5, words(rng, 50), "de", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_texts_of_several_megabytes(spark):
    docs = long_docs(spark)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 6)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    n = {r.doc_id: len(r.text) for r in docs.collect()}
    assert n[1] > 2_000_000
    assert {r.doc_id for r in langid.identify(docs).collect()} == set(n)
    assert {r.doc_id for r in toxicity.toxicity(docs, labels).collect()} == set(n)
    found = {r.doc_id: r.base for r in pii.find_pii(docs).collect()}
    assert set(found) == set(n) and found[3] == ["email:1000001:1000015"]
    assert {r.doc_id: r.n_words for r in quality.judge(docs, labels).collect()}[1] == 320_000
    assert {r.doc_id for r in simhash.simhash_components(docs).collect()} == set(n)
    assert {r.doc_id: r.n_bytes for r in suffixes.dedup(docs).collect()} == n
    media_rows = media.media_sequences(docs).where("kind = 'media'").select("doc_id", "n_bytes").collect()
    assert {r.doc_id: r.n_bytes for r in media_rows} == n
    held = {r.doc_id: r.s for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "s").collect()}
    assert set(held) == set(n) and held[1] > 320_000
    some = docs.where("doc_id IN (3, 4)")
    assert {r.doc_id for r in pieces.piece_digests(some).collect()} == {3, 4}


def test_other_tables_with_clashing_names(spark):
    docs = long_docs(spark).where("doc_id > 3")
    labels = spark.createDataFrame([(k, 1, (k or 0) % 2, "x", 7, 0.1, None) for k in (4, 4, 5, None)], "doc_id long, quality int, toxic int, text string, n long, y double, term string")
    assert toxicity.toxicity(docs, labels).count() == 2 and quality.judge(docs, labels).count() == 2
    pages = spark.createDataFrame([(1, "http://a.com/b", "<p>t", "h", "r", 0.5, "w")], "page_id long, url string, html string, host string, rule string, score double, weight string")
    got = urls.judge(pages).first()
    assert (got.host, got.path, got.rule) == ("a.com", "/b", None)
    assert [i["text"] for i in media.parse_interleaved(pages, "page_id", "html").first()["items"]] == ["t"]
