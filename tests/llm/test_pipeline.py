"""The stages of the pipeline, each against what it should keep of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.common import corpus, documents
from tests.llm.test_operators import brute_links, duck
from quillon.llm import quality, substring_dedup

SF = "/root/testdata/sf0.01"


def test_stages_are_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_quality_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = {r.quality: r.kept / r.n for r in labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.count("k").alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    assert share[1] > 0.97 and share[0] < 0.5


def test_dedup_stages(spark):
    docs = documents(spark, corpus(6), extra=[(None, "without an id"), (700, None)])
    lines = corpus_pipeline.line_dedup(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert {(r.doc_id, r.n_chars) for r in lines.collect()} == {(r.doc_id, None if r.text is None else len(r.text)) for r in lines.collect()}
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()]
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.where("doc_id IS NOT NULL").collect()) == [d for d, low, _ in brute_links(rows) if d == low]
    assert near.where("doc_id IS NULL").count() == 1
    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    want, columns = duck(substring_dedup.ORACLE_SQL, docs.where("doc_id IS NOT NULL"))
    removed = {r[columns.index("doc_id")] for r in want if r[columns.index("n_removed")]}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in cut.collect() if r.text != before[r.doc_id]} == removed


def test_run_is_the_stages_by_brute_force(spark):
    """run() over a whole table against plain Python, from the classifier's decisions on."""
    import zlib
    from collections import defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in quality.with_quality(docs, model).where("score >= 0.3").collect())
    assert 0 < len(rows) < docs.count()
    places = defaultdict(list)
    for doc, text in rows:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            places[tuple(lines[i : i + 3])].append((doc, i))
    after = []
    for doc, text in rows:
        lines = text.split("\n")
        gone = {j for i in range(len(lines) - 2) if places[tuple(lines[i : i + 3])][0] != (doc, i) for j in range(i, i + 3)}
        after.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    kept = {d for d, low, _ in brute_links(after) if d == low}
    after = [(d, t) for d, t in after if d in kept]
    low = {}
    for doc, text in after:
        w = text.encode().split()
        for i in range(len(w) - 12):
            low.setdefault(tuple(w[i : i + 13]), doc)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for doc, text in after:
        w = text.encode().split()
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < doc for j in range(i, i + 13)}
        if gone:
            text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want.append((doc, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)


def test_stages_keep_columns_of_any_name(spark):
    docs = documents(spark, corpus(3, 10)).selectExpr("doc_id", "text", "score", "score + 1 AS predicted", "n_chars AS n_lines", "kept AS n_removed", "lang AS __other", "n_chars")
    for stage in (corpus_pipeline.quality, corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.substring_dedup):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r.score, r.predicted, r.n_removed) for r in out.collect()} <= {(0.5, 1.5, "k")}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
