"""Corpus cleaning pipeline: five stages of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``documents``. The last
stage returns one row for each time the mix takes a document, with the columns
``size``, ``source_size``, ``target``, ``taken`` and ``epoch`` besides. ``n_chars`` follows
the text where a stage changes it.

Line dedup and the near-duplicate stage take a row's id and text together as
its document, so that texts without an id, or with the id of another text, are
judged by themselves; equal rows are one document. ORACLE_SQL is None:
the classifier and the near-duplicate classes can't be expressed in SQL; the
stages are tested against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.llm import decontam, lines, mixing, ngram_join, quality
from tillroll.llm.shared import documents, id_of, named, stored, without

ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, so that none is called like an
    operator's, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(docs: DataFrame, names: dict[str, str], text: Column, before: Column) -> list[Column]:
    """docs' columns under their names again: this text, and its length where the
    text is not as long as before."""
    values = {"text": text}
    if "n_chars" in docs.columns:
        points = F.length(F.coalesce(text, F.lit("")))
        old = F.col(names["n_chars"])
        values["n_chars"] = F.when(points == before, old).otherwise(points.cast(docs.schema["n_chars"].dataType))
    return [values.get(c, F.col(k)).alias(c) for c, k in names.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score >= CUT)."""
    rows, names = _plain(docs)
    labels = documents(spark, sf_dir, "labels").select(F.col("doc_id").alias(names["doc_id"]), "quality")
    scored = quality.score_quality(rows, labels, names["text"], names["doc_id"], keep=rows.columns)
    return scored.filter(F.col("score") >= quality.CUT).select(*[F.col(k).alias(c) for c, k in names.items()])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of at least five documents stay in one of them only."""
    rows, names = _plain(docs)
    changed = lines.line_dedup(rows, names["text"], names["doc_id"], by_text=True)
    old = F.col(names["text"])
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(old)
    return changed.select(*_back(docs, names, text, F.length(F.coalesce(old, F.lit("")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts one row: the smallest id's, of that
    id's texts in the class one (the longest row of equal words). A null id is
    the smallest; rows without an id are told apart by their words."""
    found = ngram_join.text_classes(docs)
    first = F.struct("id", "node").eqNullSafe(F.col("low"))
    stays = stored(found.filter(first).select(F.col("id").alias("_id"), F.col("digest").alias("_of"), F.col("node").alias("_node")), "pipeline-stays")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), id_of("doc_id").alias("_doc"), ngram_join.digest_of("text").alias("_digest"))
    kept = rows.join(stays, (F.col("_doc") == F.col("_id")) & (F.col("_digest") == F.col("_of")))
    # an aggregate, so that repeated rows are combined before the shuffle
    order = F.struct(F.coalesce(-F.length("_row.text"), F.lit(1)), F.col("_digest"))
    one = kept.groupBy("_doc", "_node").agg(F.min_by("_row", order).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; mostly covered documents go whole."""
    rows, names = _plain(docs)
    rows = rows.withColumn("before", F.length(F.coalesce(names["text"], F.lit(""))))
    clean = decontam.decontaminate(rows, documents(spark, sf_dir, "benchmark"), names["text"])
    return clean.select(*_back(docs, names, F.col(names["text"]), F.col("before")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, sources at their target weights; input columns called
    like a column of the mix are replaced."""
    docs = without(docs, [*mixing.COLUMNS, "epoch"])
    rows, names = _plain(docs)
    rows = rows.withColumn("before", F.length(F.coalesce(names["text"], F.lit(""))))
    mixed = mixing.mixture(rows, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"])
    return mixed.select(*_back(docs, names, F.col(names["text"]), F.col("before")), *mixing.COLUMNS, "epoch")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmarks),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
