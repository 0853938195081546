"""Where matches come from: source fingerprints, samples and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_fingerprints(matches: DataFrame, bank_prints: DataFrame, settled_prints: DataFrame) -> DataFrame:
    """matches with fingerprints: the credit's, then each settlement's in order; what is missing is skipped."""
    members = matches.select("run_id", "bank_txn_id", "rule_id", F.posexplode("settlement_ids").alias("pos", "settlement_id"))
    held = members.join(settled_prints.select("run_id", "settlement_id", "row_sha256"), ["run_id", "settlement_id"])
    listed = held.groupBy("run_id", "bank_txn_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_sha256"))), lambda x: x["row_sha256"]).alias("theirs"))
    ours = bank_prints.select("run_id", "bank_txn_id", F.col("row_sha256").alias("own"))
    rows = matches.join(ours, ["run_id", "bank_txn_id"], "left").join(listed, ["run_id", "bank_txn_id", "rule_id"], "left")
    prints = F.concat(F.filter(F.array("own"), lambda x: x.isNotNull()), F.coalesce("theirs", F.array().cast("array<string>")))
    return rows.select(*matches.columns, prints.alias("fingerprints"))


def sample_by_tier(matches: DataFrame, each: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("run_id", "tier").orderBy("bank_txn_id", "rule_id"))
    return matches.withColumn("place", place).filter(F.col("place") <= each)


def run_summary(bank: DataFrame, matches: DataFrame, open_exceptions: DataFrame) -> DataFrame:
    rows = bank.groupBy("run_id").agg(F.count("*").alias("bank_rows"))
    rows = rows.join(matches.groupBy("run_id").agg(F.count("*").alias("matches"), F.count_if(F.col("tier") == 3).alias("llm_assisted")), "run_id", "left")
    rows = rows.join(open_exceptions.groupBy("run_id").agg(F.count("*").alias("open_exceptions"), F.sum("value_at_risk_paise").alias("value_at_risk_paise")), "run_id", "left")
    return rows.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bank_rows", "matches", "llm_assisted", "open_exceptions", "value_at_risk_paise")])


def recorded(matches: DataFrame, bank: DataFrame, settled: DataFrame, bank_prints: DataFrame, settled_prints: DataFrame, model: str | None = None, prompt_version: str | None = None) -> DataFrame:
    """matches as they are stored: evidence as JSON, fingerprints, and for tier 3 only the model and the prompt's version."""
    members = matches.select("run_id", "bank_txn_id", F.explode("settlement_ids").alias("settlement_id")).join(settled.select("run_id", "settlement_id", "net_amount_paise", "settled_on"), ["run_id", "settlement_id"])
    sums = members.groupBy("run_id", "bank_txn_id").agg(F.sum("net_amount_paise").alias("net_paise"), F.min("settled_on").alias("first_settled_on"), F.count("*").alias("members"))
    rows = matches.join(bank.select("run_id", "bank_txn_id", "credit_paise", "value_date"), ["run_id", "bank_txn_id"], "left").join(sums, ["run_id", "bank_txn_id"], "left")
    said = F.struct("rule_id", "credit_paise", "net_paise", (F.col("credit_paise") - F.col("net_paise")).alias("difference_paise"), F.col("value_date").cast("string").alias("value_date"), F.col("first_settled_on").cast("string").alias("first_settled_on"), "members")
    of_model = lambda x: F.when(F.col("tier") == 3, F.lit(x)).cast("string")
    rows = rows.select(*matches.columns, F.to_json(said).alias("evidence"), of_model(model).alias("model"), of_model(prompt_version).alias("prompt_version"))
    return source_fingerprints(rows, bank_prints, settled_prints)
