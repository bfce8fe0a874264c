"""The corpus pipeline: stages over `documents`, each written as Parquet and read
again as the next one's input.

1. language_id drops documents that are in no language: without letters, or with
   no language that most of their letters are in.
2. line_dedup takes lines that many documents share out of all but one of them.
3. jaccard_join keeps of each group of near copies the document of the least id.
4. decontaminate drops documents that hold a window of a benchmark item.
5. pack cuts what is left into token sequences.

Documents without id pass stages 2 and 3 unchanged, and rows that repeat an id
are one document to them: stage 3 keeps the one of the least text, then of the least
other columns.  Other columns pass through to stage 4.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import quoted, removed, shared_folder, table
from larkspur.llm.decontamination import decontaminate
from larkspur.llm.jaccard_join import jaccard_classes
from larkspur.llm.language_id import fit, held_out, predict
from larkspur.llm.line_dedup import line_dedup
from larkspur.llm.packing import pack

#: A document whose best language has a smaller share of its letters is of no language.
LEAST_SHARE = 0.4


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.where(~held_out()))
    found = predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*map(quoted, docs.columns))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length).select(*map(quoted, docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard_classes(docs)
    stay = classes.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("stay_id")).agg(F.count(F.lit(1)).alias("stay_rows"))
    mine = docs["doc_id"] == F.col("stay_id")
    once = docs.join(stay.where("stay_rows = 1"), mine, "left_semi")
    # Of the rows of one id the least by text, then by the other columns that can be compared.
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    several = docs.join(stay.where("stay_rows > 1").select("stay_id"), mine).drop("stay_id")
    least = several.groupBy("doc_id").agg(F.min_by(F.struct(*map(quoted, docs.columns)), F.struct("text", *map(quoted, rest))).alias("row"))
    return once.unionByName(least.select("row.*")).unionByName(docs.where(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*map(quoted, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_shared_lines),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language scores and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what lies between is in the shared folder until the stage after it is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            removed(docs)
        docs = spark.read.parquet(path)
    return docs
