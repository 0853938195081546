"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

Fingerprints are made per document and collapsed to distinct ones first, so a group of copies is one point. The distance over a
block of bits is a lower bound of the whole distance, and two points within the radius differ by at most radius // blocks bits in
one of `blocks` disjoint blocks. So there is a vantage-point tree for each block, whose nodes split by the distance to a vantage
code over that block, and each searches with the small radius of a block (0 for 5 blocks and radius 4). By the triangle
inequality a point has to be sought on the other side of a split only if its distance to the vantage code is within that small
radius of the cut: with radius 0 never, so that each point visits as many leaves as there are blocks, however deep the trees are.
They are grown on the driver from counts of the blocks' values (8,192 at most for 13 bits). A leaf whose points all have one
value of the block, and still above DEEP points, is split on by whole distances with the whole radius, level by level from
histograms of distances; there a point's home is one leaf, and it also visits, as a guest, the outer side of each split that it
lies just inside of; guests then go to every side that they may reach. Each linked pair meets in the home leaf of one of the two
in one tree at least. Leaves are searched one at a time with trees of their own over whole distances, and give a spanning forest
of the links that they find, at most one edge for each point, never all pairs of a group. Components come from rounds of large
and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import table, written

BITS = 64
SEED = 42  # of the hash, as the fingerprint's definition has it
SHARD = 4_096  # points of a leaf, about, as far as the values of a block allow
DEEP = 65_536  # points of one value of a block beyond which a leaf is split by whole distances
LEAF = 1_024  # points below which a leaf compares all with all
BLOCK = 1 << 21  # comparisons held at once
MAX_DEPTH = 40


def fingerprints(texts: list[str], width: int = 4, seed: int = SEED) -> np.ndarray:
    """A-Z lower-cased, shingles of width words joined by spaces, repeats included; fewer words: all of them; none: 0."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        if len(words) <= width:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
        set_bits = np.zeros(BITS, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            h = np.array([digest(s, seed) for s in shingles[at : at + (1 << 16)]], "<u8")
            set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * set_bits > len(shingles), bitorder="little")
        out[k] = bits.view("<u8")[0]
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """df's columns (but any of this name) and the fingerprint as a bigint with the same bits; null text is empty text."""
    held = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`") for c in held], F.col(text_col).cast("string").alias("__fp_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(len(held)).to_pylist()]
            fp = pa.array(fingerprints(texts, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*held, name])

    return rows.mapInArrow(work, f"{fields}, `{name}` bigint")


def block_masks(radius: int) -> list[int]:
    """radius + 1 disjoint blocks of bits, but of no fewer than 12 bits each."""
    count = min(radius + 1, BITS // 12)
    edges = [BITS * k // count for k in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


class Tree:
    """Trees over blocks. Inner nodes by number (roots, children 2n and 2n + 1): the mask of the distance to the node's vantage
    code, the radius of the search, and the distance that goes inside at most."""

    def __init__(self, roots: int, cuts: dict[int, tuple[int, int, int]]):
        """cuts: node to (mask, radius, cut); roots: a power of two, so that no subtree runs into another."""
        self.roots, order = roots, sorted(cuts)
        self.nodes = np.array([*order, 1 << 62], np.int64)
        self.masks = np.array([*(cuts[n][0] for n in order), 0], np.uint64)
        self.radii = np.array([*(cuts[n][1] for n in order), 0], np.int64)
        self.cuts = np.array([*(cuts[n][2] for n in order), 0], np.int64)
        self.codes = np.array([self.vantage(n) for n in self.nodes.tolist()], np.uint64)

    @staticmethod
    def vantage(node: int) -> int:
        """A fixed pseudo-random code for each node."""
        return xxhash.xxh64_intdigest(node.to_bytes(8, "little"), SEED)

    def _at(self, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Is it an inner node, its cut and radius, and the distance to its code."""
        k = np.searchsorted(self.nodes, node)
        return self.nodes[k] == node, self.cuts[k], self.radii[k], np.bitwise_count((fp ^ self.codes[k]) & self.masks[k]).astype(np.int64)

    def visits(self, fp: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, leaf, home) of all leaves of all points: a home in each tree, and guest visits."""
        at = np.tile(np.arange(len(fp)), trees)
        node, home = np.repeat(np.arange(self.roots, self.roots + trees), len(fp)), np.ones(len(at), bool)
        while True:
            inner, cut, radius, d = self._at(node, fp[at])
            if not inner.any():
                return at, node, home
            inside = d <= cut
            own = np.where(inner, 2 * node + ~inside, node)
            out = np.flatnonzero(inner & inside & (d + radius > cut))
            back = np.flatnonzero(inner & ~inside & ~home & (d - radius <= cut))
            at = np.concatenate([at, at[out], at[back]])
            home = np.concatenate([home, np.zeros(len(out) + len(back), bool)])
            node = np.concatenate([own, 2 * node[out] + 1, 2 * node[back]])


def median_cut(counts: np.ndarray) -> int | None:
    """The distance that splits a histogram of distances about in half; None if all are equally far."""
    total = int(counts.sum())
    cut = int(np.searchsorted(np.cumsum(counts), total / 2))
    if counts[: cut + 1].sum() == total:  # the outer half is empty: cut below the farthest
        cut = int(np.flatnonzero(counts)[-1]) - 1
    return cut if 0 < counts[: cut + 1].sum() < total else None


def spread_bits(values: np.ndarray, low: int) -> np.ndarray:
    return values.astype(np.uint64) << np.uint64(low)


def grow(points: DataFrame, radius: int, shard: int, deep: int) -> tuple[Tree, int]:
    """The trees of all blocks, and how many there are."""
    masks = block_masks(radius)
    roots = 1 << (len(masks) - 1).bit_length()
    lows = [(m & -m).bit_length() - 1 for m in masks]
    small = radius // len(masks)
    values = [F.shiftrightunsigned("fp", low).bitwiseAND((m >> low)) for m, low in zip(masks, lows)]
    held = points.select(F.posexplode(F.array(*values)).alias("tree", "value")).groupBy("tree", "value").agg(F.count("*").alias("n"))
    # One row for each value of a block: 2 to the power of its bits at most, whatever the number of points.
    found = [(r["tree"], r["value"], r["n"]) for r in held.collect()]
    cuts: dict[int, tuple[int, int, int]] = {}
    left: list[int] = []  # leaves that their block can split no further, above deep points
    for t, mask in enumerate(masks):
        value = spread_bits(np.array([v for k, v, _ in found if k == t], np.int64), lows[t])
        count = np.array([n for k, _, n in found if k == t], np.int64)
        work = [(roots + t, np.arange(len(value)))]
        while work:
            node, rows = work.pop()
            total = int(count[rows].sum())
            if total <= shard:
                continue
            cut = None
            if len(rows) > 1 and node.bit_length() < MAX_DEPTH:
                d = np.bitwise_count((value[rows] ^ np.uint64(Tree.vantage(node))) & np.uint64(mask)).astype(np.int64)
                cut = median_cut(np.bincount(d, weights=count[rows], minlength=BITS + 1).astype(np.int64))
                if cut is None:  # several values, equally far: they go on whole to the next node's code
                    work.append((2 * node, rows))
                    cuts[node] = (mask, small, BITS)
                    continue
            if cut is None:
                if total > deep:
                    left.append(node)
                continue
            cuts[node] = (mask, small, cut)
            work += [(2 * node, rows[d <= cut]), (2 * node + 1, rows[d > cut])]
    return Tree(roots, _deepened(points, roots, len(masks), cuts, left, radius, deep)), len(masks)


def _deepened(points: DataFrame, roots: int, trees: int, cuts: dict, fresh: list[int], radius: int, deep: int) -> dict:
    """cuts with splits by whole distances below the leaves `fresh`, level by level; a histogram a leaf reaches the driver."""
    while fresh:
        tree, wanted = Tree(roots, cuts), np.array(sorted(fresh), np.int64)

        def seen(batches: Iterator[pa.RecordBatch], tree=tree, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                at, leaf, home = tree.visits(fp, trees)
                held = home & np.isin(leaf, wanted)
                leaf, fp = leaf[held], fp[at[held]]
                nodes, k = np.unique(leaf, return_inverse=True)
                codes = np.array([Tree.vantage(n) for n in nodes.tolist()], np.uint64)
                d = np.bitwise_count(fp ^ codes[k]).astype(np.int64) if len(fp) else np.zeros(0, np.int64)
                cell, count = np.unique(k * (BITS + 1) + d, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[cell // (BITS + 1)] if len(cell) else cell), pa.array((cell % (BITS + 1)).astype(np.int64)), pa.array(count.astype(np.int64))], names=["leaf", "d", "n"])

        found: dict[int, np.ndarray] = {}
        for r in points.mapInArrow(seen, "leaf bigint, d bigint, n bigint").groupBy("leaf", "d").agg(F.sum("n").alias("n")).collect():
            found.setdefault(r["leaf"], np.zeros(BITS + 1, np.int64))[r["d"]] += r["n"]
        fresh = []
        for n, counts in found.items():
            if counts.sum() > deep and n.bit_length() < MAX_DEPTH:
                cut = median_cut(counts)
                # All equally far from this code: the node passes them on whole, to the next node's code.
                cuts[n] = ((1 << BITS) - 1, radius, BITS if cut is None else cut)
                fresh += [2 * n] if cut is None else [2 * n, 2 * n + 1]
    return cuts


def shards(points: DataFrame, radius: int, shard: int = SHARD, deep: int = DEEP) -> DataFrame:
    """points(fp) to (leaf, fp, home): the home leaves of each, and the leaves it visits."""
    tree, trees = grow(points, radius, shard, deep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, leaf, home = tree.visits(fp.view(np.uint64), trees)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at]), pa.array(home)], names=["leaf", "fp", "home"])

    return points.select("fp").mapInArrow(work, "leaf bigint, fp bigint, home boolean")


class Forest:
    """Components of positions, as the smallest position of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in pairs.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = root(x)
        self.label = to[self.label]


def leaf_links(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions a, b) of the links within the radius that have a home point."""
    forest = Forest(len(fp))
    rng = np.random.default_rng(SEED)

    def compare(mine: np.ndarray, others: np.ndarray, same: bool) -> None:
        step = max(1, BLOCK // max(1, len(others)))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            near = np.bitwise_count(fp[rows, None] ^ fp[None, others]) <= radius
            if same:
                near &= others[None, :] > rows[:, None]
            i, j = np.nonzero(near)
            if len(i):
                forest.join(rows[i], others[j])

    def search(homes: np.ndarray, guests: np.ndarray, depth: int) -> None:
        if len(homes) <= LEAF or depth > MAX_DEPTH:
            compare(homes, homes, True)
            compare(homes, guests, False)
            return
        d_home = np.bitwise_count(fp[homes] ^ (code := fp[homes[rng.integers(len(homes))]]))
        d_guest = np.bitwise_count(fp[guests] ^ code)
        cut = int(np.median(d_home))
        if not (d_home > cut).any():
            cut -= 1
        inside = d_home <= cut
        if not inside.any():
            search(homes, guests, MAX_DEPTH + 1)
            return
        search(homes[inside], guests[d_guest.astype(int) - radius <= cut], depth + 1)
        search(homes[~inside], np.concatenate([guests[d_guest + radius > cut], homes[inside & (d_home + radius > cut)]]), depth + 1)

    search(np.flatnonzero(home), np.flatnonzero(~home), 0)
    held = np.flatnonzero(forest.label != np.arange(len(fp)))
    return held, forest.label[held]


def links(points: DataFrame, radius: int, shard: int = SHARD, deep: int = DEEP) -> DataFrame:
    """points(fp), distinct: edges (a, b) with a > b whose components are those of all links within the radius."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def found() -> Iterator[pa.RecordBatch]:
            fp, home = (np.concatenate(x) for x in zip(*held))
            a, b = leaf_links(fp.view(np.uint64), home, radius)
            a, b = np.maximum(fp[a], fp[b]), np.minimum(fp[a], fp[b])
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], names=["a", "b"])

        for batch in batches:  # in order of leaves: one is held at a time
            leaf, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if last is not None and leaf[a] != last:
                    yield from found()
                    held = []
                held.append((fp[a:b].copy(), home[a:b].astype(bool)))
                last = leaf[a]
        if held:
            yield from found()

    return shards(points, radius, shard, deep).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(work, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root), root the smallest node reached; by alternating large and small stars.

    Each round writes its edges to the shared folder, so a lost executor costs a round at most. A node's neighbours are
    never gathered: both stars need only the minimum of each node's neighbours, joined back.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.filter("a > b").distinct(), "links")
        # Done once each node has one edge, to a node that has none.
        odd = after.groupBy("a").count().filter("count > 1").select("a").union(after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi"))
        if odd.isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, shard: int = SHARD, deep: int = DEEP) -> DataFrame:
    """One row for each row of df: (id, fp bigint, component_id), component_id the smallest id that links reach.

    Null or empty text has fingerprint 0 and is linked like any other. Null ids: the row has a component, and its id does
    not count for the smallest (a component of null ids only has a null one). Repeated rows stay, each with the same result.
    Very long texts are
    hashed in parts of 65,536 shingles. Other columns are not carried. An empty table gives an empty one.
    """
    rows = written(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", width).select("id", "fp"), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "points")
    linked = components(links(points.select("fp"), radius, shard, deep)).withColumnRenamed("node", "fp")
    rooted = points.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_point = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(of_point, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
