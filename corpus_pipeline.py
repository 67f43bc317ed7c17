"""A corpus from raw documents to packed sequences: five stages, each an operator of plumbline.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents.

1. language_id: documents without a letter, or without a language that makes up LEAST_SHARE of them, go; where no document has a
   label to learn from, only those without a letter.
2. exact_dedup: of equal texts the row with the largest id stays.
3. near_dedup: of texts that link at similarity 0.8 or more on 5-word shingles, one of each component stays, that of the least id.
4. mixing: a prefix of each leaf of domain, language and source, up to its budget; every document once at most.
5. packing: sequences of 2048 tokens; a row per piece with its ids.

Nulls: a null text has no letter and goes at stage 1; a null language or source is a node of its own at stage 4; null ids are ids
like others, the last to be kept at stage 3 and the first to go at stage 2. Columns beyond those of documents pass up to stage 4,
under any name. Equal rows are copies, of which stage 2 leaves one. Texts of any length are read whole. An empty table gives an empty
one at every stage. Each run deletes its own intermediate tables and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, language_id, minhash, mixing, packing
from plumbline.llm.common import fresh_path, remove, same, scratch, table

LEAST_SHARE = 0.4
WEIGHTS = mixing.WEIGHTS
TOTAL = (3, 4)
SEED = 23
#: The stages can't all be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, F.when(~language_id.held_out(), F.col("lang")))
    if not model.languages:  # no label to learn from is no reason to reject a text
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.identify(docs, model)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)).select(*same(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs).filter("kept").select(*same(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, rule=minhash.Rule(5, 80)).select(*same(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, total=TOTAL, weights=WEIGHTS, max_epochs=1, seed=SEED, domains=mixing.domain_table(spark)).filter("epochs > 0").select(*same(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, payload={"ids": lambda ids: ids, "ids_crc32": F.crc32})


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch() as made:
            docs = table(stage(spark, docs, sf_dir), name, path)
        remove(spark, *made, *before)  # once a stage is written, nothing needs what it or the one before it wrote
        before = [path]
    return docs


QUERIES = {"pipeline": run}
