"""Language by Bayesian fusion of evidence.

The text gives a likelihood for each language (hashed byte trigrams of the lower-cased text, markup removed), tempered so that a
long text counts for TEMPER trigrams at most. The declared language gives the share of rows of each language that declare it.
The host gives a prior: its rows' text posteriors, without the row's own, smoothed towards those of its address suffix, and
these towards all rows. Shares and priors are grouped aggregates over all rows; the trigram tables are fitted on `sample` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import group_join, table, written

SAMPLE = 2_000  # rows with a known language for the trigram tables, at most
SAMPLE_CHARS = 20_000_000  # of them together, at most; a text that does not fit in is not used
CELLS = 1 << 16
TEMPER = 150
PRIOR_WEIGHT = 10.0
MAX_LANGUAGES = 500  # more raise an error
MARKUP = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;|&#\d+;")


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64)


class Likelihood:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (language, text)."""
        self.languages = sorted({lang for lang, _ in rows})
        if len(self.languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.languages)} languages; the tables hold {MAX_LANGUAGES} at most")
        counts = np.full((len(self.languages), CELLS), 0.1)
        place = {lang: k for k, lang in enumerate(self.languages)}
        for lang, text in rows:
            counts[place[lang]] += np.bincount(trigrams(text), minlength=CELLS)
        self.log = np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def score(self, text: str) -> np.ndarray:
        """Tempered log likelihoods, less their greatest."""
        cells = trigrams(text)
        if not len(cells):
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for k in range(0, len(cells), 1 << 18):
            total += self.log[cells[k : k + (1 << 18)]].sum(axis=0, dtype=np.float64)
        total *= min(1.0, TEMPER / len(cells))
        return total - total.max()


def likelihood_from(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Likelihood:
    """Tables from `sample` rows of SAMPLE_CHARS characters, the least by a hash of id and text; rows without language or text
    are not used. Languages that have no row among them get a tenth as many rows of their own.

    Rows are chosen by hash and length, and only the chosen texts are read again and reach the driver.
    """
    known = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h")).filter("l is not null and t is not null and t <> ''")
    light = known.select("h", "l", F.length("t").alias("n"))
    counts = {r["l"]: r["rows"] for r in light.groupBy("l").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen, size = {}, 0
    for r in light.orderBy("h", "l", "n").limit(sample).collect():
        if r["h"] not in chosen and size + r["n"] <= SAMPLE_CHARS:
            size += r["n"]
            chosen[r["h"]] = r["l"]
    spark, each = docs.sparkSession, max(1, sample // 10)
    rest = sorted(counts.keys() - set(chosen.values()))
    room = SAMPLE_CHARS // max(1, len(rest))
    if rest:
        # A share of a language's rows that holds more than enough; hashes are spread evenly.
        cut = spark.createDataFrame([(x, int(-(2**63) + min(1.0, (2 * each + 40) / counts[x]) * (2**64 - 1) * (1 - 1e-12))) for x in rest], "l string, most bigint")
        some: dict[str, list[tuple[int, int]]] = {x: [] for x in rest}
        for r in light.join(F.broadcast(cut), "l").filter("h <= most").select("h", "l", "n").collect():
            some[r["l"]].append((r["h"], r["n"]))
        for x, held in some.items():
            used = 0
            for k, (h, n) in enumerate(sorted(held)[:each]):
                if k == 0 or used + n <= room:
                    used += min(n, room)
                    chosen[h] = x
    if not chosen:
        return Likelihood([])
    wanted = spark.createDataFrame([(h, x, SAMPLE_CHARS if x not in set(rest) else room) for h, x in chosen.items()], "h bigint, l string, room int")  # sample rows and a tenth for each language at most
    found = known.join(F.broadcast(wanted), ["h", "l"]).select("h", "l", F.expr("substring(t, 1, room)").alias("t")).dropDuplicates(["h", "l"])
    return Likelihood([(r["l"], r["t"]) for r in sorted(found.collect(), key=lambda r: (r["h"], r["l"]))])


def texts_scored(rows: DataFrame, model: Likelihood, markup: bool) -> DataFrame:
    """rows(id, text, declared, host, suffix) to the same without text, with ll array<double>."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ll = [model.score(MARKUP.sub(" ", t) if markup else t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([x.tolist() for x in ll], pa.list_(pa.float64()))], names=["id", "declared", "host", "suffix", "ll"])

    return rows.select("id", "text", "declared", "host", "suffix").mapInArrow(work, f"id {kind}, declared string, host string, suffix string, ll array<double>")


def fused(scored: DataFrame, languages: list[str]) -> DataFrame:
    """scored(id, declared, host, suffix, ll) to (id, lang, text_lang, posterior, declared).

    Null or empty text: the other evidence decides. A null declared language, host or suffix is a value of its own. Repeated rows
    each count. Ties go to the language that is first by name. Very long texts are read whole; they count for TEMPER trigrams.
    Other columns are not carried. An empty table gives an empty one.
    """
    n = len(languages)
    if not n:
        return scored.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("double").alias("posterior"), "declared")
    none = F.lit("\0")
    likely = [F.exp(F.col("ll")[k]) for k in range(n)]
    total = reduce(lambda a, b: a + b, likely)
    rows = scored.select("id", F.coalesce("declared", none).alias("d"), F.coalesce("host", none).alias("host"), F.coalesce("suffix", none).alias("suffix"), *[F.col("ll")[k].alias(f"ll_{k}") for k in range(n)], *[(likely[k] / total).alias(f"p_{k}") for k in range(n)])
    rows = written(rows, "likelihoods")
    sums = [F.sum(f"p_{k}") for k in range(n)]
    by_host = written(rows.groupBy("suffix", "host").agg(*[s.alias(f"h_{k}") for k, s in enumerate(sums)], F.count("*").alias("h")), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"h_{k}").alias(f"s_{k}") for k in range(n)], F.sum("h").alias("s"))
    every = by_suffix.agg(*[F.sum(f"s_{k}").alias(f"a_{k}") for k in range(n)], F.sum("s").alias("a")).first()
    total_rows = every["a"] or 0
    share = [((every[f"a_{k}"] or 0.0) + 1) / (total_rows + n) for k in range(n)]
    by_suffix = by_suffix.select("suffix", *[((F.col(f"s_{k}") + PRIOR_WEIGHT * share[k]) / (F.col("s") + PRIOR_WEIGHT)).alias(f"s_{k}") for k in range(n)])
    hosts = group_join(by_host, by_suffix, ["suffix"], ["host"]).select(F.concat_ws("\1", "suffix", "host").alias("place"), "h", *[f"h_{k}" for k in range(n)], *[f"s_{k}" for k in range(n)])
    declared = rows.groupBy("d").agg(*[s.alias(f"d_{k}") for k, s in enumerate(sums)])
    # P(declared | language): with a count of one spread over all values.
    declared = declared.select("d", *[F.log((F.col(f"d_{k}") + 1) / F.lit((every[f"a_{k}"] or 0.0) + n + 1)).alias(f"e_{k}") for k in range(n)])
    hosts, declared = written(hosts, "priors"), written(declared, "declared")
    at = rows.withColumn("place", F.concat_ws("\1", "suffix", "host"))
    near = group_join(group_join(at, hosts, ["place"], ["id", "ll_0"]), declared, ["d"], ["id", "ll_0"])

    def post(k: int) -> Column:
        prior = (F.greatest(F.col(f"h_{k}") - F.col(f"p_{k}"), F.lit(0.0)) + PRIOR_WEIGHT * F.col(f"s_{k}")) / (F.greatest(F.col("h") - 1, F.lit(0)) + PRIOR_WEIGHT)
        return F.col(f"ll_{k}") + F.col(f"e_{k}") + F.log(prior)

    scores = near.select("*", *[post(k).alias(f"f_{k}") for k in range(n)])
    best = F.greatest(*[f"f_{k}" for k in range(n)]) if n > 1 else F.col("f_0")
    top = F.greatest(*[f"ll_{k}" for k in range(n)]) if n > 1 else F.col("ll_0")
    pick = lambda prefix, most: F.coalesce(*[F.when(F.col(f"{prefix}_{k}") == most, F.lit(languages[k])) for k in range(n)])
    mass = reduce(lambda a, b: a + b, [F.exp(F.col(f"f_{k}") - best) for k in range(n)])
    return scores.select("id", pick("f", best).alias("lang"), pick("ll", top).alias("text_lang"), (1 / mass).alias("posterior"), F.nullif("d", none).alias("declared"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Of pages(page_id, url, html): the language that the html element declares, host, and the host's last label with the path's first segment where that is two letters."""
    rest = F.when(F.instr("url", "://") > 0, F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url"))).otherwise(F.lit(""))
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    element = F.regexp_extract("html", r"(?i)<html\b[^>]*", 0)  # the first one, wherever it begins
    declared = F.lower(F.regexp_extract(element, r"(?is)\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    suffix = F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), F.lower(F.regexp_extract(rest, r"^[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)))
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"), suffix.alias("suffix"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Of documents: lang is the declared language, and the source stands for the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def op6_language(spark, sf_dir: str) -> DataFrame:
    """All documents and all pages, each with its own kind's evidence."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = likelihood_from(docs)
    of_docs = fused(texts_scored(document_rows(docs), model, False), model.languages)
    of_pages = fused(texts_scored(page_rows(pages), model, True), model.languages)
    null = F.lit(None).cast("bigint")
    both = of_docs.select(F.col("id").alias("doc_id"), null.alias("page_id"), "lang", "text_lang", "declared", "posterior").union(of_pages.select(null.alias("doc_id"), F.col("id").alias("page_id"), "lang", "text_lang", "declared", "posterior"))
    return both.withColumn("posterior", F.round("posterior", 6)).withColumn("kept", F.lit(True) & F.col("lang").isNotNull())
