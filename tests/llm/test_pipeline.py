from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seqspark.llm import langid, packing, pii
from seqspark.llm.common import write_table

from .test_neardup import brute_keepers, near_rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s1" if (i or 0) % 2 else None, len(t or "")) for i, t in near_rows()] + [(950, "12 34", "en", "s1", 5), (951, "mail me@here.example " * 3 + "now", "en", "s1", 66)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.dtypes
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "personal_data", "packed"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        assert name == "packed" or docs.dtypes == columns
    alive = [(r.doc_id, r.text) for r in seen["language"].collect()]
    assert sorted(alive, key=repr) == sorted(((i, t) for i, t, *_ in rows if langid.has_letter(t)), key=repr)
    assert sorted((r.doc_id for r in seen["near_copies"].collect()), key=repr) == brute_keepers(alive)
    from .test_suffixes import brute

    near = [(r.doc_id, r.text) for r in seen["near_copies"].collect()]
    lengths = {r.doc_id: len(r.text.encode()) for r in seen["repeats"].collect()}
    assert lengths == {i: n - gone for i, n, gone, _, _ in brute(near)}
    before = {r.doc_id: r.text for r in seen["repeats"].collect()}
    after = {r.doc_id: r.text for r in seen["personal_data"].collect()}
    assert after == {i: pii.redact(t, pii.base_spans(t)) for i, t in before.items()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    assert {r.doc_id: r.n for r in seen["packed"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(want.values())
    assert np.all([r.length > 0 for r in seen["packed"].collect()])
