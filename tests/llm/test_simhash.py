import random

import numpy as np
import xxhash

from tallymark.llm import simhash_vptree as sv


def brute(rows, radius=4):
    def fp(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
        if not words:
            return 0
        sh = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    ids = [min([rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None], default=None) for i in range(len(rows))]
    return sorted((rows[i][0] is None, rows[i][0] or 0, fps[i], ids[i]) for i in range(len(rows)))


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in sv.near_duplicates(df, **more).collect())
    assert got == brute(rows)


def test_components_match_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(50)]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 60))) for _ in range(60)]
    rows = []
    for k in range(150):
        words = rnd.choice(base).split()
        if words and rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = "Changed"
        rows.append((k, " ".join(words)))
    rows += [(None, None), (None, ""), (7, rows[7][1]), (3000, "É ß Ä"), (3001, " \t\n"), (3002, "one two three")]
    check(spark, rows, shard=40)


def test_empty_table(spark):
    check(spark, [])


def test_one_group_of_copies_and_a_very_long_text(spark):
    check(spark, [(k, "same words here every time again") for k in range(40)] + [(99, "a b " * 50_000)])


def test_leaf_forest_matches_brute_force():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)]))
    home = rng.random(len(fp)) < 0.7
    old, sv.LEAF = sv.LEAF, 32
    try:
        a, b = sv.leaf_links(fp, home, 4)
    finally:
        sv.LEAF = old
    full, found = sv.Forest(len(fp)), sv.Forest(len(fp))
    i, j = np.nonzero((np.bitwise_count(fp[:, None] ^ fp[None]) <= 4) & (home[:, None] | home[None]))
    full.join(i, j)
    found.join(a, b)
    assert (full.label == found.label).all()


def met(found):
    leaves = {}
    for r in found:
        leaves.setdefault(r.leaf, {})[r.fp] = r.home
    return leaves


def test_shards_bring_every_linked_pair_together(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 62, 200, dtype=np.int64)
    flip = lambda n: np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 62, (n, 200)), axis=0)
    fp = np.unique(np.concatenate([centre ^ flip(n % 5) for n in range(8)]))
    low = np.unique(np.concatenate([fp, rng.integers(0, 1 << 40, 300, dtype=np.int64) << 13]))  # many with one value of the first block
    for points, shard, deep, radius in ((fp, 20, 1 << 20, 4), (low, 20, 60, 4), (fp, 30, 40, 2), (low, 16, 20, 9)):
        leaves = met(sv.shards(spark.createDataFrame([(int(x),) for x in points], "fp bigint"), radius, shard, deep).collect())
        assert len(leaves) > 8
        pairs = {(x, y) for held in leaves.values() for x in held for y in held if held[x] or held[y]}
        near = np.bitwise_count(points[:, None] ^ points[None]) <= radius
        for i, j in zip(*np.nonzero(near)):
            assert (int(points[i]), int(points[j])) in pairs


def test_visits_of_a_point_do_not_grow(spark):
    rng = np.random.default_rng(7)
    for n in (2_000, 32_000):
        fp = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64))
        points = spark.createDataFrame([(int(x),) for x in fp], "fp bigint")
        leaves = sv.shards(points, 4, shard=64).groupBy("leaf").count().collect()
        assert sum(r["count"] for r in leaves) == 5 * len(fp) and max(r["count"] for r in leaves) <= 64


