"""A training-corpus pipeline of five operators, each stage written and read again before the next.

A stage is a function ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.decontaminate import decontaminate
from meterline.llm.jaccard_join import jaccard_components
from meterline.llm.language_id import fit_language, predict_language
from meterline.llm.mixing import mix_sources, word_count
from meterline.llm.tables import col, materialize
from meterline.llm.token_output import token_output

#: A document whose language is less certain than this goes.
LEAST_LANGUAGE_SCORE = 0.35


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` and, in one struct, all other columns, whose names can't clash with those of a stage."""
    own = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    others = [col(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias("other_columns"))


def whole(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents with the columns that they had before :func:`carried`."""
    return docs.select(*[c if c in ("doc_id", "text", "source") else F.col("other_columns")[c].alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the corpus's languages; ``lang`` stays as it came."""
    found = predict_language(docs, fit_language(docs), keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of near-equal texts; documents without id stay.

    Where an id has several texts, each text is a document of its own: a component keeps one, of the smallest id and
    then of the smallest hash of its text. Rows of equal id and text are one document. Only where ids repeat does the plan
    carry the hashes along and remove such rows; the result is the same rule.
    """
    hashed = F.xxhash64("text")
    columns = docs.columns
    docs = carried(docs)
    unequal = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a != b")
    if unequal.isEmpty():
        gone = jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct()
        kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    else:
        key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", hashed.alias("hash"))).alias("key")
        gone = jaccard_components(docs.select(key, "text"), doc_id="key").where("doc_id != component_id").select(F.col("doc_id").alias("key")).distinct()
        kept = docs.select("*", key).join(gone.hint("shuffle_hash"), "key", "left_anti").drop("key")
    again = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return whole(kept, columns)
    repeated = kept.join(again, "doc_id", "left_semi")
    return whole(kept.join(again, "doc_id", "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "text"])), columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not contaminated by a benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where(~F.col("contaminated")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of equal id, source and number of words as often as the most taken of them."""
    key = ["doc_id", "source", "size"]
    columns = docs.columns
    docs = carried(docs)
    taken = mix_sources(docs).where("copies > 0").groupBy(*key).agg(F.max("copies").alias("copies"))
    taken = taken.withColumnsRenamed({c: f"taken_{c}" for c in key})
    sized = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": word_count(F.col("text"))}
    same = [c.eqNullSafe(F.col(f"taken_{n}")) for n, c in sized.items()]
    copies = docs.join(taken.hint("shuffle_hash"), same[0] & same[1] & same[2])
    return whole(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    return token_output(docs, with_ids=False).drop("ids")


STAGES = [("language_id", language_id), ("jaccard_join", near_duplicates), ("decontamination", benchmark_decontamination), ("mixing", mixing), ("token_output", token_ids)]

#: Language identification and tokens are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
