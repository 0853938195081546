"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


SLICE_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one where the setting is unset and Spark runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
    return (found or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: df as a Parquet table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the maximal runs without a separator; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_key(doc_id: Column, text: Column) -> Column:
    """A key for a row that does not rely on doc_id being unique or set."""
    return F.struct(doc_id.alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))


SALTS = 16  # copies of a group's row where one group may hold a third of all rows
MAX_BROADCAST_GROUPS = 20_000


def group_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: list[str], few: bool | None = None) -> DataFrame:
    """rows left-joined with a table of one row a group: broadcast where it has few rows (counted, if few is not told), else each
    group's row goes to SALTS tasks, and the group's rows are dealt to them by a hash of the columns `by`."""
    if few is None:
        few = groups.count() <= MAX_BROADCAST_GROUPS
    if few:
        return rows.join(F.broadcast(groups), keys, "left")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "__salt"], "left").drop("__salt")


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text stands alone."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > most:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
