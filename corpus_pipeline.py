"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, suffix-array dedup, best-fit packing.

Every stage takes all its predecessor kept. A row with a null doc_id passes the two stages that drop duplicates,
as it cannot be named in their decisions; the suffix-array stage cuts it like any other. Where a doc_id repeats with different texts, exact dedup decides on each text by
itself; SimHash takes them for one document, so all go if one of them is a near copy of a smaller doc_id. All stages but the last return the columns of documents as they came in; the
suffix-array stage replaces text by what is left of it and n_chars by its length in characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from codelode.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; labels come from the labels table."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(docs, model)(F.col("text")) < model.threshold)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id; other texts under a doc_id that loses stay."""
    gone = exact_dedup.exact_dedup(docs).where("NOT kept").select("doc_id", F.col("digest").alias("_digest"))
    return docs.withColumn("_digest", exact_dedup.text_digest()).join(gone, ["doc_id", "_digest"], "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the smallest doc_id."""
    gone = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings; cuts inside a character leave a replacement character."""
    left = suffix_dedup.remove_repeats(docs.withColumn("_null", F.col("text").isNull()), carry=True)
    text = F.when(~F.col("carried._null"), F.make_valid_utf8(F.col("kept").cast("string")))
    chars = F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length(text).cast("long"))
    made = {"text": text, "n_chars": chars}
    return left.select(*[made.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    import public_tokenizers as tok

    return packing.pack(docs, tok.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
#: A trained classifier and a tokenizer have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = table(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
