"""Promoted rules as a YAML file: a list of mappings with kind and value."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("fee_override", "utr_prefix", "name_alias")
RULE = "kind string, value string"


def _lines(spark: SparkSession, path: str) -> list[str]:
    from pyspark.sql.utils import AnalysisException

    try:
        return [r["value"] for r in spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()]
    except AnalysisException:  # no file: no rules
        return []


def load(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value); a missing file has none, and kinds that are not known are skipped. Values are JSON strings or bare words."""
    found: list[dict[str, str]] = []
    for line in _lines(spark, path):
        text = line.strip()
        if text.startswith("- "):
            found.append({})
            text = text[2:]
        key, colon, value = text.partition(":")
        if found and colon and not text.startswith("#"):
            value = value.strip()
            found[-1][key.strip()] = json.loads(value) if value.startswith('"') else value
    rows = [(r["kind"], r["value"]) for r in found if r.get("kind") in KINDS and "value" in r]
    return spark.createDataFrame(rows, RULE).distinct()


def save(rules: DataFrame, path: str) -> None:
    """The rules as one file, in order of kind and value; people promote them one by one, so they are few."""
    said = F.concat(F.lit("- kind: "), "kind", F.lit("\n  value: "), F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2))
    rules.select("kind", "value").distinct().repartitionByRange(1, "kind", "value").sortWithinPartitions("kind", "value").select(said.alias("value")).write.mode("overwrite").text(path)
