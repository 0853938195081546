"""Toxicity by a chain of linear classifiers.

Categories have an order. Each has a logistic model over the presence of words and of their beginnings; the model of a later
category also sees the probabilities of the earlier ones. In training those come from models that did not see the row (out of
folds), in use from the models of all rows.

The models are fitted on the driver from at most `sample` labelled rows, chosen by a hash of the id, so their cost does not grow
with the corpus; each text is then scored where it lies, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import table

SAMPLE = 5_000  # labelled rows used for fitting, at most
SAMPLE_CHARS = 60_000_000  # characters of them that go to the driver, at most
FEATURES = 1_500  # for each category
BUCKETS = 1 << 22  # numbers of features in training
LEAST_ROWS = 3  # with a feature
LEAST_CHI = 16.0  # its chi-square against the category
FOLDS = 3
ROUNDS = 120
L2 = 0.3
BEGINNINGS = (4, 5, 6, 7)
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"


def features(text: str) -> set[str]:
    """Words in lower case without outer punctuation, their beginnings (with a mark) and whether the text is all capitals."""
    words = {w.strip(EDGE) for w in set(text.lower().split())}
    words.discard("")
    out = set(words)
    for k in BEGINNINGS:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    if text.isupper():
        out.add("^upper")
    return out


def bucketed(text: str) -> np.ndarray:
    """The features' numbers; training counts by number, so that it holds no text of features."""
    return np.unique(np.fromiter((crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in features(text)), np.int64))


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))


class Linear:
    """Logistic regression over present features and dense columns."""

    def __init__(self, chosen: np.ndarray, weight: np.ndarray, dense: np.ndarray, bias: float):
        self.chosen, self.weight, self.dense, self.bias = chosen, weight, dense, bias  # chosen: numbers, ascending
        self.weights: dict[str, float] = {}

    @classmethod
    def fit(cls, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Linear:
        n, positive = len(rows), int(y.sum())
        none = np.zeros(0, np.int64)
        if positive in (0, n):
            return cls(none, np.zeros(0), np.zeros(dense.shape[1]), math.log((positive + 0.5) / (n - positive + 0.5)))
        cell, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
        both = np.bincount(cell, minlength=BUCKETS)
        only = np.bincount(cell[y[row] > 0], minlength=BUCKETS)
        # Features in LEAST_ROWS rows at least whose rate in the category is far from chance, farthest first.
        rate = positive / n
        held = np.flatnonzero(both >= LEAST_ROWS)
        score = (only[held] - rate * both[held]) ** 2 / (rate * (1 - rate) * both[held])
        held, score = held[score >= LEAST_CHI], score[score >= LEAST_CHI]
        chosen = np.sort(held[np.argsort(-score, kind="stable")[:FEATURES]])
        model = cls(chosen, np.zeros(len(chosen)), np.zeros(dense.shape[1]), math.log(rate / (1 - rate)))
        i, j = model._cells(cell, row)
        w, d, b = model.weight, model.dense, model.bias
        seen = np.zeros(len(chosen) + dense.shape[1] + 1)
        weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
        for _ in range(ROUNDS):  # full-batch steps with rates by coordinate
            z = np.bincount(i, weights=w[j], minlength=n) + dense @ d + b
            gap = weight * (probability(z) - y)
            grad = np.concatenate([np.bincount(j, weights=gap[i], minlength=len(w)) + L2 * w, gap @ dense + L2 * d, [gap.sum()]])
            seen += grad * grad
            step = 0.5 * grad / (np.sqrt(seen) + 1e-9)
            w, d, b = w - step[: len(w)], d - step[len(w) : -1], b - step[-1]
        model.weight, model.dense, model.bias = w, d, float(b)
        return model

    def _cells(self, cell: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in chosen) of the cells that are chosen."""
        if not len(self.chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, cell), len(self.chosen) - 1)
        hit = self.chosen[at] == cell
        return row[hit], at[hit]

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        i, j = self._cells(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        return probability(np.bincount(i, weights=self.weight[j], minlength=len(rows)) + dense @ self.dense + self.bias)

    def name(self, found: set[str]) -> None:
        """Give the weights of numbers to the features that had them in training."""
        weight = dict(zip(self.chosen.tolist(), self.weight.tolist()))
        self.weights = {f: weight[k] for f in found if (k := crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)) in weight}

    def logit(self, row: set[str], dense: list[float]) -> float:
        return self.bias + math.fsum(map(self.weights.__getitem__, sorted(row & self.weights.keys()))) + sum(a * b for a, b in zip(self.dense.tolist(), dense))


class Chain:
    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models

    @classmethod
    def fit(cls, texts: list[str], labels: dict[str, list[int]]) -> Chain:
        """labels: by category, in chain order."""
        rows = [bucketed(t) for t in texts]
        fold = np.arange(len(rows)) % FOLDS
        earlier, models = np.zeros((len(rows), 0)), []
        for told in labels.values():
            y = np.array(told, float)
            out = np.zeros(len(rows))
            for k in range(FOLDS):
                rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                if len(rest) and len(own):
                    part = Linear.fit([rows[r] for r in rest], earlier[rest], y[rest])
                    out[own] = part.predict([rows[r] for r in own], earlier[own])
            none = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), -30.0)
            models.append(Linear.fit(rows, earlier, y) if rows else none)
            earlier = np.column_stack([earlier, out])
        wanted = np.unique(np.concatenate([m.chosen for m in models])) if models else np.zeros(0, np.int64)
        held = set(wanted.tolist())
        found: set[str] = set()
        for text in texts:
            found |= {f for f in features(text) if crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) in held}
        for model in models:
            model.name(found)
        return cls(list(labels), models)

    def predict(self, text: str) -> list[float]:
        row, out = features(text), []
        for model in self.models:
            out.append(float(probability(model.logit(row, out))))
        return out


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain fitted on labelled rows; categories: for each a Boolean column over labels, in chain order.

    Rows without an id, text or label are not used, of repeated ids in labels the first by value, of repeated documents one.
    """
    named = [F.coalesce(c, F.lit(False)).cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]
    told = labels.select(F.col(id_col).alias("id"), F.struct(*named).alias("y")).filter("id is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t is not null").join(F.broadcast(chosen), "id")  # sample rows at most
    found = found.groupBy("id").agg(F.min(F.struct(F.length("t").alias("n"), F.col("t"))).alias("t"), F.first("y").alias("y"))
    rows, size, passed = [], 0, 0
    for r in found.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        if size + r["t"]["n"] > SAMPLE_CHARS:
            passed += 1
            continue
        size += r["t"]["n"]
        rows.append(r)
    if passed and not rows:
        raise ValueError(f"none of {passed} labelled texts has {SAMPLE_CHARS} characters at most")
    return Chain.fit([r["t"]["t"] for r in rows], {c: [r["y"][k] for r in rows] for k, c in enumerate(categories)})


def scored(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows with p_<category> of each category.

    keep: with all columns of df (but its own of these names), else with the id only. Null text is empty text. Repeated rows and
    null ids: each row for itself. An empty table gives an empty one.
    """
    new = [f"p_{c}" for c in chain.categories]
    held = [c for c in df.columns if c not in new] if keep else [id_col]
    rows = df.select(*[F.col(f"`{c}`") for c in held], F.col(text_col).cast("string").alias("__t"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"`{c}` double" for c in new])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([chain.predict(t or "") for t in batch.column(len(held)).to_pylist()]).reshape(-1, len(new))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(new)))], names=[*held, *new])

    return rows.mapInArrow(work, fields)


def chain_for(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of the labels table: poor text first, then toxic."""
    return labelled(docs, labels, {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


TOXIC = 0.3


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, chain_for(docs, table(spark, sf_dir, "labels")))
    toxic = F.col("p_toxic") >= TOXIC
    return found.select("doc_id", F.round("p_poor", 6).alias("p_poor"), F.round("p_toxic", 6).alias("p_toxic"), toxic.alias("toxic"), (~toxic).alias("kept"))
