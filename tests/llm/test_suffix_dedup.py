import hashlib
import random

import numpy as np

from tallymark.llm import suffix_dedup as sd


def check(spark, texts, ids=None, **more):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id bigint, text string, key string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.deduplicate(df, **more).collect())
    assert got == sorted((i is None, i or 0, *x) for i, x in zip(ids, sd.brute_force(texts, more.get("span", 200))))


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 260, 420, 700)]
    out = []
    for _ in range(60):
        out.append("".join(rnd.choice([rnd.choice(passages), text(rnd.randint(0, 300))]) for _ in range(rnd.randint(0, 5))))
    base = text(1500)
    for _ in range(12):  # near copies
        k = rnd.randrange(1400)
        out.append(base[:k] + "#" + base[k + 1 :])
    return [*out, out[3], out[3], "a" * 900, "ab" * 400, "xyz" * 66 + "q", None, "", base]


def test_equals_brute_force(spark):
    texts = corpus(1)
    check(spark, texts, ids=[*range(len(texts) - 2), None, 4])


def test_large_buckets_are_counted_by_names(spark):
    check(spark, corpus(2), hot=2)


def test_common_grams_are_salted_where_they_are_many(spark):
    check(spark, corpus(3), hot=2, max_broadcast=0)


def test_one_gram_in_every_text_and_texts_in_slices(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = text(120)
    texts = [text(rnd.randint(60, 200)) + passage + text(rnd.randint(60, 200)) for _ in range(80)]
    check(spark, [*texts, texts[0][30:] + texts[1]], hot=10, most=97)
    check(spark, ["a" * 3000, "ab" * 900 + text(300), *texts[:5]], most=256)


def test_a_very_long_text(spark):
    rng = np.random.default_rng(6)
    long = rng.integers(97, 123, 9_000_000, dtype=np.uint8)
    part = long[5_000_000:5_000_300].copy()
    long[8_000_000:8_000_300] = part
    df = spark.createDataFrame([(1, long.tobytes().decode()), (2, "x" * 50 + part.tobytes().decode())], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in sd.deduplicate(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {1: (9_000_000, 600, 2), 2: (350, 300, 1)}


def test_empty_table_and_a_row_twice(spark):
    check(spark, [])
    check(spark, ["p" * 10 + "".join(map(chr, range(65, 120))) * 5] * 2, ids=[1, 1])


def test_classes_of_suffixes_are_those_of_their_bytes():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 400, dtype=np.uint8)
    rows = [base.copy() for _ in range(40)]
    for r in rows:
        r[rng.integers(0, 400, 2)] = 120
    buf = np.concatenate(rows)
    at = np.concatenate([np.arange(201) + 400 * k for k in range(40)])
    kind = sd.equal_suffixes(buf, at)
    first = {}
    for a, k in zip(at.tolist(), kind.tolist()):
        first.setdefault(buf[a : a + 200].tobytes(), k)
        assert first[buf[a : a + 200].tobytes()] == k
    assert len(set(first.values())) == len(first)
