"""A training corpus from raw documents: quality, lines, near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. `run` writes each stage as Parquet in the cluster's shared folder and reads it again
as the next one's docs, so that a lost executor never costs more than a stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rugosa.llm.common import checkpoint_dir, cut, sent_if_small
from rugosa.llm.line_dedup import dedup_lines
from rugosa.llm.mixing import mix_sources, nth_by_uid
from rugosa.llm.ngram_join import ngram_join
from rugosa.llm.packing import pack_documents
from rugosa.llm.quality import scored


def held(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, key): each row as a struct, away from working columns, its id and a hash of its text."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null texts are scored as empty ones, ties alike, repeated rows each; no documents give none.
    Other columns pass, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, keep=tuple(docs.columns)).where("predicted = 1").select("kept.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that occur, or nearly so, in another place; n_chars follows.

    Null texts stay null; of repeated rows each loses the same lines. Other columns pass.
    """
    done = dedup_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return done.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word 5-grams link: that of the least id.

    Documents without an id stay; null texts count as empty, and equal ones are copies. Rows that
    repeat both id and text stay or go together. Other columns pass.
    """
    gone = ngram_join(docs).where(~F.col("kept")).select("doc_id", F.col("text_key").alias("key")).distinct()
    return held(docs).join(gone, ["doc_id", "key"], "left_anti").select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and no copies but certain ones; a null source is a source. Of
    rows that repeat id, text and source, where the mix takes some once more than others, any may be
    those. Other columns pass.
    """
    sized = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    mix = mix_sources(sized, keep=("doc_id", "key")).groupBy("doc_id", "key", "source")
    mix = mix.agg(F.min("copies").alias("low"), F.max("copies").alias("copies"), F.sum("copies").alias("sum"), F.count("*").alias("n"))
    mix = mix.where("copies > 0").select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), F.col("source").alias("m_source"), "low", "copies", (F.col("sum") - F.col("low") * F.col("n")).alias("k"))
    mix = cut(mix.withColumn("of", F.monotonically_increasing_id()))
    same = (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("doc.source").eqNullSafe(F.col("m_source"))
    alike = held(docs).join(mix.where("low = copies"), same).select("doc", "copies")
    # rows alike of which only some are taken once more: the first k of them, as they are stored
    unlike = cut(held(docs).join(sent_if_small(mix.where("low < copies"), 64), same).select("doc", "of", "low", "k", F.monotonically_increasing_id().alias("uid")))
    upto = nth_by_uid(unlike).withColumnRenamed("of", "in_")
    unlike = unlike.join(upto, F.col("of") == F.col("in_")).select("doc", (F.col("low") + F.when(F.col("uid") <= F.col("upto"), 1).otherwise(0)).alias("copies"))
    taken = alike.unionByName(unlike).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed: the rows of op2."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]
ORACLE_SQL = None  # learned filters, hashing and best-fit have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
            if k:  # the stage before isn't read again
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}-{STAGES[k - 1][0]}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return docs
