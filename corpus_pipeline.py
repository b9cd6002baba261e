"""A corpus pipeline over documents: language, quality, near-duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again. All stages but the last return the columns of documents.

Defined results: null and empty texts go in the first stage; rows of one doc_id are one document, of
which the row with the smallest text stays, and so are rows without doc_id that have one text (such a
document stays only if none of its group has a doc_id); null sources mix as one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm import langid, mergedropout, mixing, neardup, weaklabel
from isobar.llm.common import fold_is, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a text's letters that one language must have.
MIN_LANGUAGE_SHARE = 0.3
#: Shingle length of the deduplication.
SHINGLE_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is identified: letters, and no scatter over many languages."""
    model = langid.fit(docs.filter(~fold_is("doc_id", 3, 1)))
    labelled = langid.label(docs.select(*COLUMNS), model, COLUMNS)
    return labelled.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the weakly supervised scorer calls good."""
    return weaklabel.score(docs.select(*COLUMNS), weaklabel.fit(docs), COLUMNS).filter("kept_").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    kept = neardup.groups(docs, SHINGLE_WORDS).filter("node = component").select(F.col("node").alias("node_")).distinct()
    rows = docs.select(*COLUMNS).withColumn("node_", neardup.node_of()).join(kept, "node_", "left_semi")
    return rows.groupBy("node_").agg(F.min(F.struct(*COLUMNS)).alias("row_")).select("row_.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut the sources' documents to their target weights."""
    rows = mixing.prepare(docs, COLUMNS)
    return mixing.realise(rows, mixing.plan(rows)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every copy of a text with its own merge dropout and decode it again; lengths, digest and the round trip."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")  # copies are alike, so any order does
    return mergedropout.digest(mergedropout.encode(docs.withColumn("copy_", F.row_number().over(same)), check=True, copy="copy_"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{k}") if k + 1 < len(STAGES) else out
    return docs


#: Trained models and hashed orders decide the rows, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None
