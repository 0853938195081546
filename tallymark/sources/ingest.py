"""Ingest of the three files: scan, fingerprint, skip what was seen, validate, quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.config import PRICES

MONEY, DAY, TEXT = "bigint", "date", "string"

#: Columns of the files with their types.
SHAPES: dict[str, dict[str, str]] = {
    "invoices": {"invoice_id": TEXT, "merchant_id": TEXT, "customer_id": TEXT, "customer_name": TEXT, "invoice_amount_paise": MONEY, "currency": TEXT, "issue_date": DAY, "due_date": DAY, "status": TEXT},
    "settlements": {"settlement_id": TEXT, "payment_id": TEXT, "order_id": TEXT, "invoice_ref": TEXT, "customer_name": TEXT, "method": TEXT, "gross_amount_paise": MONEY, "fee_paise": MONEY, "gst_on_fee_paise": MONEY, "tds_paise": MONEY, "net_amount_paise": MONEY, "captured_at": DAY, "settled_on": DAY, "utr": TEXT, "status": TEXT},
    "bank": {"bank_txn_id": TEXT, "value_date": DAY, "narration": TEXT, "credit_paise": MONEY, "debit_paise": MONEY, "balance_paise": MONEY},
}
NULLABLE = {"invoice_ref", "utr", "narration", "status", "customer_name"}
POSITIVE, NOT_NEGATIVE = {"invoice_amount_paise", "gross_amount_paise"}, {"fee_paise", "gst_on_fee_paise", "tds_paise", "credit_paise", "debit_paise"}
OWN = ("run_id", "file", "file_seq", "raw")
FILES = {"invoices": "ledger_invoices.csv", "settlements": "pg_settlements.csv", "bank": "bank_statement.csv"}


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of name and value pairs, names lower-cased and sorted, values stripped; the separators occur in no value pair by chance."""
    pairs = [F.concat(F.lit(c.strip().lower() + "\x1e"), stripped(F.col(f"`{c}`").cast("string"))) for c in sorted(columns, key=lambda c: c.strip().lower())]
    return F.sha2(F.concat_ws("\x1f", *pairs), 256)


def scan_csv(spark: SparkSession, path: str, columns: list[str], run_id: str) -> DataFrame:
    """All cells as text, with the file's order and the raw line; missing cells are empty, surplus cells are dropped.

    The header names the columns of the file; a column of the shape that it lacks is empty. Quoted cells may hold separators.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("file_seq"))
    head = lines.orderBy("file_seq").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = [h.strip() for h in next(iter(__import__("csv").reader([head["value"]])))]
    cells = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)), {"nullValue": "\0", "emptyValue": "", "mode": "PERMISSIVE"})
    rows = lines.filter((F.col("file_seq") != head["file_seq"]) & (F.col("value") != "")).withColumn("c", cells)
    every = [c for c in dict.fromkeys([*columns, *names]) if c not in OWN]  # a cell named like our own columns is not taken
    return rows.select(F.lit(run_id).alias("run_id"), "file", "file_seq", F.col("value").alias("raw"), *[(F.coalesce(F.col("c").getField(n), F.lit("")) if n in names else F.lit("")).alias(n) for n in every])


def errors(shape: dict[str, str]) -> Column:
    """What is wrong with a row of text cells, by column."""
    found = []
    for c, kind in shape.items():
        text = stripped(F.col(c))
        if kind == MONEY:
            ok = text.rlike(r"^-?[0-9]{1,18}$")
            value = F.when(ok, text.try_cast("bigint"))
            ok = ok & (value > 0) if c in POSITIVE else ok & (value >= 0) if c in NOT_NEGATIVE else ok
        elif kind == DAY:
            ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
        elif c == "method":
            ok = text.isin(*PRICES)
        else:
            ok = F.lit(True) if c in NULLABLE else text != ""
        found.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{c}: not valid")))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def deduplicated(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """rows with is_new: the first of its fingerprint in the run, and not in seen(run_id, row_sha256)."""
    place = F.row_number().over(W.partitionBy("run_id", "row_sha256").orderBy("file_seq"))
    rows = rows.withColumn("is_new", place == 1)
    if seen is None:
        return rows
    known = seen.select("run_id", "row_sha256", F.lit(True).alias("known")).distinct()
    return rows.join(known, ["run_id", "row_sha256"], "left").withColumn("is_new", F.col("is_new") & F.col("known").isNull()).drop("known")


def ingest(rows: DataFrame, kind: str, columns: list[str] | None = None, seen: DataFrame | None = None) -> dict[str, DataFrame]:
    """rows(run_id, file, file_seq, raw, cells...) to loaded, quarantine, report. Extra columns count for the fingerprint only."""
    shape = SHAPES[kind]
    cells = columns or [c for c in rows.columns if c not in OWN]
    marked = deduplicated(rows.withColumn("row_sha256", fingerprint(cells)), seen).withColumn("errors", errors(shape))
    good = F.size("errors") == 0
    values = [F.when(stripped(F.col(c)) != "", stripped(F.col(c)).try_cast(t)).alias(c) if t != TEXT else stripped(F.col(c)).alias(c) for c, t in shape.items()]
    fresh = marked.filter("is_new")
    report = marked.groupBy("run_id").agg(F.count_if(F.col("is_new") & good).alias("inserted"), F.count_if(~F.col("is_new")).alias("skipped"), F.count_if(F.col("is_new") & ~good).alias("quarantined"))
    return {
        "loaded": fresh.filter(good).select("run_id", "file_seq", *values, "row_sha256"),
        "quarantine": fresh.filter(~good).select("run_id", "file", "file_seq", "raw", F.array_join("errors", "; ").alias("error")),
        "report": report,
    }


def load_batch(spark: SparkSession, folder: str, run_id: str, seen: DataFrame | None = None) -> dict[str, dict[str, DataFrame]]:
    """The three files of a batch; the truth is never read here."""
    return {kind: ingest(scan_csv(spark, f"{folder}/{name}", list(SHAPES[kind]), run_id), kind, seen=seen) for kind, name in FILES.items()}


def write_csv(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """One file of these columns with header and LF, rows in a fixed order: for fixtures of bounded size."""
    df.repartitionByRange(1, *order).sortWithinPartitions(*order).select(*columns).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails where a key is there twice: what the store's primary keys forbid."""
    same = reduce(lambda a, b: a & b, [F.col("n") > 1])
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(same)
    if not bad.isEmpty():
        raise ValueError(f"repeated key in {keys}: {bad.first()}")
    return df
