"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tillroll.llm import decontam, ngram_join, quality
from tillroll.llm.shared import stored

from .test_operators import brute_links

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test-pipeline")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "quality classifier":
            scores = quality.score_quality(docs, labels).filter(F.col("score") >= quality.CUT).collect()
            assert after.keys() == {r["doc_id"] for r in scores}
            assert all(after[k] == before[k] for k in after)
        if name == "n-gram Jaccard join":
            want = {low for _, low, _ in brute_links(before.items())}
            assert after.keys() == want
        if name == "benchmark decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            hit = {r["doc_id"] for r in decontam.find_hits(docs, items).filter("size(items) > 0").collect()}
            assert all(after.get(k) == before[k] for k in before.keys() - hit)
        docs = out
        seen.append(name)
    assert len(seen) == 5 and docs.filter("taken > 0").count() == docs.count() > 0


def test_texts_without_an_id_or_with_a_shared_id_are_documents(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text("b") + " end"
    rows = [(10, text("a")), (33, text("a")), (33, text("b")), (50, near), (None, text("c")), (None, text("d")), (None, text("c")), (None, text("e")), (60, text("e"))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(10, text("a")), (33, text("b")), (None, text("c")), (None, text("d")), (None, text("e"))])
    # each row has its own text's class
    joined = Counter((r["text"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs, columns=["text"]).collect())
    assert joined[(text("a"), 10, 1)] == 2 and joined[(text("b"), 33, 1)] == 1 and joined[(near, 33, 1)] == 1 and joined[(text("d"), None, 0)] == 1
    line = "a line of boilerplate that five of the texts without an id all hold"
    docs = spark.createDataFrame([(None, f"{text(k)}\n{line}", 1) for k in range(5)], "doc_id long, text string, n_chars long")
    assert sum(line in r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()) == 1
