"""The three sources and the truth, derived from orders and customers by integer rules.

A run is 64 orders, a settlement is an order, a bank credit pays one to three settlements of a run. run_id is the key that all
stages share, so every derivation is local to a run.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.functions.calendar import business_days_after
from tallymark.functions.money import _div, breakdown
from tallymark.functions.references import joined

FIRST_DAY = date(2026, 9, 7)
RUN = 64
WORDS = ["RETAIL", "TEXTILES", "TRADERS", "LOGISTICS", "EXPORTS", "DIGITAL", "STORES", "MOTORS"]
METHODS = ["upi", "debit_card", "credit_card", "netbanking", "wallet"]
OPENING = 250_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    k = F.col("k")
    rows = orders.join(customers, "o_custkey", "left").select(
        "k",
        _div(k, RUN).alias("r"),
        (k % RUN).alias("i"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("own_gross"),
        F.element_at(F.array(*map(F.lit, METHODS)), F.substring("o_orderpriority", 1, 1).cast("int")).alias("own_method"),
        F.concat_ws(" ", "c_mktsegment", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("o_custkey") % 8 + 1).cast("int")), F.lit("PVT LTD")).alias("customer_name"),
    )
    decoy = (F.col("r") % 4 == 0) & (F.col("i") < 4)
    copied = decoy & (F.col("i") >= 2)
    by_run = W.partitionBy("r").orderBy("k").rangeBetween(-2, -2)
    rows = rows.withColumns({"two_gross": F.first("own_gross").over(by_run), "two_method": F.first("own_method").over(by_run), "decoy": decoy})
    gross = F.when(copied, F.coalesce("two_gross", "own_gross")).otherwise(F.col("own_gross"))
    method = F.when(copied, F.coalesce("two_method", "own_method")).otherwise(F.col("own_method"))
    off = F.when(F.col("decoy"), 5).otherwise((F.col("i") * 7) % F.when(F.col("r") % 10 == 9, 4).otherwise(20)).cast("int")
    # The n-th business day from FIRST_DAY, itself the 0th.
    days = F.filter(F.sequence(F.lit(FIRST_DAY), F.date_add(F.lit(FIRST_DAY), 45)), lambda d: (F.weekday(d) < 5) & ~d.isin(date(2026, 9, 17), date(2026, 10, 2)))
    status = F.when(F.col("decoy"), "captured").when(k % 41 == 7, "refunded").when(k % 43 == 9, "disputed").when(k % 20 == 11, "partial_refund").otherwise("captured")
    rows = rows.select("k", "r", "i", "decoy", "customer_name", gross.alias("gross_amount_paise"), method.alias("method"), F.element_at(days, off + 1).alias("captured_at"), F.element_at(days, off + 3).alias("settled_on"), status.alias("status"))
    parts = breakdown(F.col("gross_amount_paise"), F.col("method"))
    net = parts["net"] - F.when(F.col("status") == "partial_refund", _div(F.col("gross_amount_paise"), 8)).otherwise(F.lit(0))
    return rows.select(
        joined(F.lit("R"), F.lpad(F.col("r").cast("string"), 6, "0")).alias("run_id"),
        joined(F.lit("STL"), F.lpad(k.cast("string"), 8, "0")).alias("settlement_id"),
        joined(F.lit("INV"), F.lpad(k.cast("string"), 8, "0")).alias("invoice_ref"),
        "customer_name",
        "method",
        "gross_amount_paise",
        parts["fee"].alias("fee_paise"),
        parts["gst"].alias("gst_on_fee_paise"),
        parts["tds"].alias("tds_paise"),
        net.alias("net_amount_paise"),
        "captured_at",
        "settled_on",
        joined(F.lit("RZRPY"), (1_000_000 + (k * 7919) % 9_000_000).cast("string")).alias("utr"),
        "status",
        "k",
        "r",
        "i",
        "decoy",
    )


def grouped(rows: DataFrame) -> DataFrame:
    """Settlements with the credit that pays them."""
    paid = rows.filter(F.col("status").isin("captured", "partial_refund"))
    size = (F.col("r") + F.dayofyear("settled_on")) % 3 + 1
    place = F.row_number().over(W.partitionBy("run_id", "settled_on", "decoy").orderBy("k")) - 1
    part = F.when(F.col("decoy"), F.concat(F.lit("D"), _div(F.col("i"), 2).cast("string"))).otherwise(_div(place.cast("bigint"), size.cast("bigint")).cast("string"))
    lead = F.min("k").over(W.partitionBy("run_id", "settled_on", "part"))
    return paid.withColumn("part", part).withColumn("lead", lead).withColumn("bank_txn_id", joined(F.lit("BNK"), F.lpad(F.col("lead").cast("string"), 8, "0")))


def bank_and_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = credits(settlements(spark, sf_dir))
    return every.drop("settlement_ids"), every.select("run_id", "bank_txn_id", "settlement_ids")


def credits(rows: DataFrame) -> DataFrame:
    """The bank's rows for settlements as `settlements` gives them, each with the settlements that it pays."""
    paid = grouped(rows)
    lead, z = F.col("lead"), F.col("lead") % 10
    credit = paid.groupBy("run_id", "r", "bank_txn_id", "lead", "settled_on", "decoy").agg(
        F.sum("net_amount_paise").alias("net"), F.min_by("utr", "k").alias("utr"), F.min_by("customer_name", "k").alias("customer_name"), F.array_sort(F.collect_list("settlement_id")).alias("settlement_ids")
    )
    utr, name, city = F.col("utr"), F.col("customer_name"), F.lit("BLR")
    clean = F.concat_ws("/", F.lit("NEFT"), utr, name, city)
    narration = (
        F.when(z == 4, F.concat_ws("/", F.lit("NEFT"), F.expr("substring(utr, 1, length(utr) - 1)"), name, city))
        .when(z == 5, F.concat_ws("/", F.lit("NEFT"), F.expr("substring(utr, 1, length(utr) - 2)"), name, city))
        .when(z == 6, F.concat_ws("/", F.lit("NEFT"), joined(F.substring(utr, 1, 6), F.lit("-"), F.substring(utr, 7, 20)), name, city))
        .when(z == 7, F.concat_ws("/", F.lit("UPI/CR"), F.lower(utr), name, city))
        .when(z == 8, F.concat_ws("/", F.lit("NEFT-CR"), name, city))
        .when(z == 9, F.concat_ws("/", joined(F.lit("MMTCR"), utr), name, city))
        .otherwise(clean)
    )
    drift = F.when(z.isin(1, 4, 6) & ~F.col("decoy"), lead % 3 + 1).otherwise(F.lit(0))
    value = F.when(lead % 4 == 3, business_days_after(F.col("settled_on"), 1)).otherwise(F.col("settled_on"))
    paid_in = credit.select("run_id", "r", "bank_txn_id", value.alias("value_date"), narration.alias("narration"), (F.col("net") + drift).alias("credit_paise"), "settlement_ids")
    none = F.array().cast("array<string>")
    tail = lambda prefix: joined(F.lit(prefix), F.lpad(F.col("r").cast("string"), 6, "0"))
    first = paid_in.groupBy("run_id", "r").agg(F.min("value_date").alias("value_date"), F.min(F.struct("value_date", "bank_txn_id", "narration", "credit_paise")).alias("f"))
    orphans = first.select("run_id", "r", tail("BNKORPH").alias("bank_txn_id"), "value_date", F.lit("IMPS/UNKNOWN REMITTER/MUM").alias("narration"), (777_777 + 13 * F.col("r")).cast("bigint").alias("credit_paise"), none.alias("settlement_ids"))
    posted = first.filter("r % 3 = 0").select("run_id", "r", tail("BNKDUP").alias("bank_txn_id"), "value_date", "f.narration", "f.credit_paise", none.alias("settlement_ids"))
    every = paid_in.unionByName(orphans).unionByName(posted)
    seq = F.row_number().over(W.partitionBy("run_id").orderBy("value_date", "bank_txn_id"))
    balance = F.lit(OPENING) + F.sum("credit_paise").over(W.partitionBy("run_id").orderBy("file_seq").rowsBetween(W.unboundedPreceding, 0))
    return every.select("run_id", "bank_txn_id", "value_date", "narration", "credit_paise", F.lit(0).cast("bigint").alias("debit_paise"), seq.cast("bigint").alias("file_seq"), "settlement_ids").withColumn("balance_paise", balance.cast("bigint"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_and_truth(spark, sf_dir)[0]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_and_truth(spark, sf_dir)[1]


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settlements(spark, sf_dir)
    return s.select("run_id", F.col("invoice_ref").alias("invoice_id"), F.lit("MERCH001").alias("merchant_id"), "customer_name", F.col("gross_amount_paise").alias("invoice_amount_paise"), F.lit("INR").alias("currency"), F.col("captured_at").alias("issue_date"), F.col("captured_at").alias("due_date"), F.when(F.col("status") == "captured", "raised").otherwise(F.col("status")).alias("status"))


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bank, settlements) as the matching stages take them."""
    return bank(spark, sf_dir), settlements(spark, sf_dir).drop("k", "r", "i", "decoy")
