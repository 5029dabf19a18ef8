"""A corpus made ready for training: quality rules, exact dedup, near-duplicate join, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage as Parquet and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.dropping import drop_linked
from evidentia.llm.exact_dedup import drop_copies
from evidentia.llm.jaccard_join import jaccard_components
from evidentia.llm.packing import pack
from evidentia.llm.quality_rules import drop_rejected, train
from evidentia.llm.queries import tokenizer_path
from evidentia.llm.store import scratch
from evidentia.llm.substring_dedup import substring_dedup

#: The end id and the vocabulary of the packed sequences.
END_ID, VOCABULARY = 2, "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or the trees go."""
    return drop_rejected(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the one with the largest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays.

    A row is a document of its own, told apart by (id, text): a null id is larger than any other and stands for
    no other row, and rows of a repeated id are judged by their own texts. Texts without words link with nothing.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = jaccard_components(rows, "__row").filter("n_shingles > 0").select("__row", "component_id")
    return drop_linked(rows, found, "__row")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that start earlier elsewhere are cut out; n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup(docs, carry=rest).select(F.col("id").alias("doc_id"), "text", *(F.col(f"rest.`{c}`").alias(c) for c in rest))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens."""
    return pack(docs, tokenizer_path(VOCABULARY), END_ID)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substring", substring), ("packing", packing)]

#: Trained trees, tokenizers and packing aren't expressible in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
