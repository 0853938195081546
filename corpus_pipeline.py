"""A training corpus from documents: toxic texts and near copies go, benchmark leaks go, secrets are masked, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows that it is given; all but the last return the columns of docs.
Null ids and texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontamination, secret_scan, sentencepiece_codec, simhash_vptree, toxicity_chain
from tallymark.llm.common import table, written

ORACLE_SQL = None  # models, components and encodings are not for SQL; tests/llm/test_pipeline.py has a brute-force version


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts below the toxicity threshold."""
    chain = toxicity_chain.chain_for(docs, table(spark, sf_dir, "labels"))
    return toxicity_chain.scored(docs, chain, keep=True).filter(F.col("p_toxic") < toxicity_chain.TOXIC).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the least id; of rows alike in id and text one."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keyed = docs.withColumn("__key", key)
    found = simhash_vptree.near_duplicates(keyed.select("__key", "text"), id_col="__key")
    kept = written(found.filter("__key = component_id").groupBy("__key").agg(F.count("*").alias("n")), "kept")
    out = keyed.join(kept.select("__key"), "__key", "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["__key"])
    return out.select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def with_masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, with secrets replaced by a mask and n_chars as the text has them then."""
    found = secret_scan.scan(docs, keep=True)
    text = secret_scan.redacted(F.col("text"), F.col("secrets"))
    size = {"n_chars": F.when(F.size("secrets") == 0, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return found.withColumns({"text": text, **size}).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: (doc_id, lang, source, n_tokens, ids_le, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    coded = sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True)
    return coded.select("doc_id", "lang", "source", F.size("starts").cast("long").alias("n_tokens"), "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("decontamination", without_leaks),
    ("secrets", with_masked_secrets),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
