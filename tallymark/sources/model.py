"""The outside adjudicator: a protocol, a scripted stand-in, and a cache of answers read as a table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.adjudication import cache_key, key_of


class Adapter(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...


class Scripted:
    """Answers from a list, in order."""

    name = "scripted"

    def __init__(self, answers: list[str]):
        self.answers, self.asked = list(answers), []

    def complete(self, prompt: str) -> str:
        self.asked.append(prompt)
        return self.answers.pop(0)


class Unavailable(Exception):
    """The model cannot be reached, or its daily limit is used up."""


class Patient:
    """An adapter with spacing, retries that wait twice as long each time, and a daily limit."""

    def __init__(self, inner: Adapter, per_minute: int = 10, tries: int = 5, per_day: int = 500, retry: Callable[[Exception], bool] = lambda e: True, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.name = inner, inner.name
        self.gap, self.tries, self.left, self.retry, self.clock, self.sleep = 60 / per_minute, tries, per_day, retry, clock, sleep
        self.last: float | None = None

    def complete(self, prompt: str) -> str:
        for n in range(self.tries):
            if self.left <= 0:
                raise Unavailable("daily limit")
            if self.last is not None and (wait := self.last + self.gap - self.clock()) > 0:
                self.sleep(wait)
            self.last, self.left = self.clock(), self.left - 1
            try:
                return self.inner.complete(prompt)
            except Exception as e:
                if n + 1 == self.tries or not self.retry(e):
                    raise Unavailable(str(e)) from e
                self.sleep(2 * 2**n)
        raise Unavailable("no try left")


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(key, response) of a folder of JSON records; a folder that is not there has none."""
    from pyspark.sql.utils import AnalysisException

    try:
        spark.read.text(folder)
    except AnalysisException:
        return spark.createDataFrame([], "key string, response string")
    return spark.read.schema("key string, response string").option("multiLine", True).json(folder)


class HttpAdapter:
    """A provider behind an HTTP endpoint that takes {"model", "prompt"} and gives {"text"}; errors are OSErrors, which Patient retries."""

    def __init__(self, name: str, url: str, token: str = "", timeout: float = 60.0):
        self.name, self.url, self.token, self.timeout = name, url, token, timeout

    def complete(self, prompt: str) -> str:
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        body = json.dumps({"model": self.name, "prompt": prompt}).encode()
        with urlopen(Request(self.url, body, head), timeout=self.timeout) as r:
            return json.load(r)["text"]


def looked_up(prompts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): prompts with their cached response, and those without."""
    keyed = prompts.withColumn("key", cache_key(F.lit(model), F.col("prompt")))
    joined = keyed.join(cache.groupBy("key").agg(F.min("response").alias("response")), "key", "left")
    return joined.filter("response is not null"), joined.filter("response is null").drop("response")


def ask(misses: DataFrame, adapter: Adapter | None, folder: str) -> int:
    """Ask for each miss, one after the other, and store the answers; how many were asked. The adapter's limits bound the rows."""
    if adapter is None:
        return 0
    asked = 0
    spark = misses.sparkSession
    for row in misses.orderBy("run_id", "bank_txn_id").toLocalIterator():
        try:
            said = adapter.complete(row["prompt"])
        except Unavailable:
            break
        record = spark.createDataFrame([(key_of(adapter.name, row["prompt"]), said)], "key string, response string")
        record.coalesce(1).write.mode("append").json(folder)  # one file each, so that an answer is kept before the next is asked for
        asked += 1
    return asked
