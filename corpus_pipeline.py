"""Corpus cleaning: each stage works on all that its predecessor kept.

All stages but the last return the columns they are given, whatever these are named.
What a stage does with odd rows is that of its operator and said with each; an empty
table stays empty.  Columns besides doc_id and text are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import bpe, decontam, minhash, quality, toxicity
from verdex.llm.common import Scratch, if_small, limit_batches, materialize, remove, table
from verdex.llm.queries import labelled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a significant toxic passage.

    Null and empty texts have none and stay; texts are read whole; rows that repeat are
    judged alike and all go or stay; a score equal to the threshold goes.
    """
    limit_batches(spark)
    model = toxicity.train(labelled(spark, docs, sf_dir, "toxic", 3, 1), "text", "label", "doc_id")
    scored = toxicity.score(docs, model, score="toxic_score", predicted="toxic_predicted", passages="toxic_passages")
    return scored.where("toxic_predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the score of the bias alone and are judged by it; texts
    are read whole; rows that repeat all go or stay; a score equal to the threshold stays.
    """
    limit_batches(spark)
    model = quality.train(labelled(spark, docs, sf_dir, "quality", 4, 2), "text", "label", "doc_id")
    scored = quality.score(docs, model, score="quality_score", predicted="quality_predicted")
    return scored.where("quality_predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows that with the smallest doc_id, null ids last.

    Null and blank texts have no copies but exact repeats of their row's id and text, of
    which one stays.  Rows that share an id and differ in text are documents of their own.
    """
    limit_batches(spark)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        groups = minhash.near_duplicates(docs)
        gone = materialize(groups.where("not kept").select(F.col("doc_id").alias("gone")), "gone")
        return docs.join(if_small(gone), F.col("doc_id") == F.col("gone"), "left_anti")
    # Ids do not tell the rows apart, so each row is a document of its own.
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, doc_id="__row").withColumnRenamed("doc_id", "__row")
    blank = F.col("n_shingles") == 0
    again = F.when(blank, F.col("doc_id"))  # blank texts link with nothing: only the same id and text repeat
    ranked = rows.select("__row", "doc_id", F.xxhash64("text").alias("hash"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("rank")).join(groups, "__row")
    ranked = ranked.select("__row", "rank", again.alias("again"), F.when(again.isNotNull(), F.col("hash")).otherwise(F.col("component_id")).alias("group"))
    kept = materialize(ranked.groupBy("again", "group").agg(F.min("rank").alias("rank")).select(F.col("rank.__row").alias("__row")), "kept")
    gone = materialize(ranked.select("__row").join(if_small(kept), "__row", "left_anti"), "gone")
    return rows.join(if_small(gone), "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and blank texts match nothing and stay; texts are read whole; rows that repeat
    all go or stay; a similarity equal to the threshold goes.
    """
    limit_batches(spark)
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), out="benchmark_matches")
    return found.where(F.size("benchmark_matches") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and the bytes they decode to: (doc_id, n_tokens, ids, decoded), a row a row.

    Null and empty texts have no ids and no bytes.
    """
    limit_batches(spark)
    return bpe.encode(docs, keep=["doc_id"], decoded="decoded").select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("minhash", drop_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: No SQL: two stages are trained classifiers, one is a tokenizer.  tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that all stages keep; a stage's table goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, before)
        before = scratch.kept
    return STAGES[-1][1](spark, docs, sf_dir)
