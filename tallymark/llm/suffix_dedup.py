"""Removal of long byte strings that occur more than once, by blockwise sorting of bounded suffixes.

A suffix counts up to `span` bytes. Equal spans share the position of their least k-gram (of hashed k-grams, the leftmost), so
the suffixes fall into buckets by that gram, and equal suffixes into one bucket. Runs of suffixes with the same gram occurrence
are one row: (bucket, hash of the run's bytes, document, first suffix, how many). Rows alike in bytes are repeats as they are
(by 128 bits of hash, gram and run); buckets with one row are unique as they are; both need no bytes. Of the other rows, one of
each kind takes its bytes to its bucket. Buckets are sorted one block at a time, by content: ranks of all strings of 8 to 64
bytes by prefix doubling give the order by the first V bytes and by the last V, and ties go by ranks that were computed before
at the positions of a difference cover modulo V only: any two suffixes reach sampled positions by a common shift below V, where
the ranks of the rest tell them apart.

A gram that very many rows share is known before any row is shuffled by it (counts are summed map-side): its rows go by
(gram, run) and, as single suffixes, by (gram, name of the span), and never meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import table, text_key, written

SPAN = 200
GRAM = 64
SLICE_BYTES = 1 << 20
TEXT_BYTES = 4 << 20  # of a text whose runs are sought at once
BLOCK_BYTES = 2 << 20
HOT_ROWS = 4_096  # rows, and then kinds of rows, of a gram that is too common for one task
MAX_BROADCAST = 200_000  # such grams
SALTS = 64
V = 73
COVER = [0, 1, 3, 7, 15, 31, 36, 54, 63]  # fixed values: differences of these give each residue modulo 73


def cover_shift() -> np.ndarray:
    """shift[i, j] < V such that i + shift and j + shift are both in the cover modulo V."""
    held = np.zeros(V, bool)
    held[COVER] = True
    out = np.full((V, V), -1, np.int16)
    for s in range(V):
        both = np.roll(held, -s)[:, None] & np.roll(held, -s)[None, :]
        out[both & (out < 0)] = s
    if (out < 0).any():
        raise ValueError("not a difference cover")
    return out


SHIFT = cover_shift()
_rng = np.random.default_rng(20_240)
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Names:
    """Hashes of all strings of a length in a buffer, from one sum over powers modulo 2^64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power = np.full(n + 1, BASE)
        power[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[buf] * np.cumprod(power)[:n], out=self.sums[1:])
        power[1:] = BASE_INVERSE
        self.back = np.cumprod(power)

    def every(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[at + length] - self.sums[at]) * self.back[at])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of width values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size = -(-len(x) // width) * width
    grid = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(buf: np.ndarray, names: Names, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, first suffix, how many) of the runs of one text of at least span bytes."""
    g = names.every(gram)
    # Upper bits decide and the position breaks ties, in the same order in each equal string.
    key = (g >> np.uint64(24) << np.uint64(24)).view(np.int64) ^ np.int64(-(1 << 63))
    width = span - gram + 1
    spot = np.empty(len(buf) - span + 1, np.int64)
    step = (1 << 24) - width
    for a in range(0, len(spot), step):
        part = key[a : a + step + width - 1]
        spot[a : a + step] = (sliding_least(part | np.arange(len(part)), width) & 0xFFFFFF) + a
    first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
    count = np.diff(np.append(first, len(spot)))
    return g[spot[first]], names.of(first, count + span - 1) + (spot[first] - first).astype(np.uint64) * BASE, first, count


def find_runs(docs: DataFrame, span: int, gram: int, most: int = TEXT_BYTES) -> DataFrame:
    """docs(key, text) to rows of runs, at most so many bytes of a text at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            parts, owner, size = [], [], 0
            for k in range(len(texts)):
                data = np.frombuffer((texts[k].as_py() or "").encode(), np.uint8)
                for a in range(0, len(data) - span + 1, most):  # suffixes from a on; a run that is cut here is two rows
                    part = data[a : a + most + span - 1]
                    g, s, first, count = runs(part, Names(part), span, gram)
                    parts.append((g, s, first + a, count))
                    owner.append(np.full(len(g), k))
                    size += len(g)
                if parts and (size > 50_000 or k + 1 == len(texts)):
                    g, s, first, count = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(s.view(np.int64)), keys.take(pa.array(np.concatenate(owner))), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                        names=["g", "s", "key", "first", "count"],
                    )
                    parts, owner, size = [], [], 0

    return docs.mapInArrow(work, "g bigint, s bigint, key struct<i:bigint,h:bigint>, first int, count int")


def ranked(codes: np.ndarray) -> np.ndarray:
    """The place of each code among the distinct ones."""
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def ranks(buf: np.ndarray) -> np.ndarray:
    """The rank by content of the 64 bytes from each position on (fewer at the end), by doubling from 8 bytes."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + n]
    rank = ranked(words)
    for width in (8, 16, 32):
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        rank = ranked(rank * n + after)
    return rank


def equal_suffixes(buf: np.ndarray, at: np.ndarray, span: int = SPAN) -> np.ndarray:
    """A class for each suffix of the buffer at these positions, equal for equal spans: sorted by both ends, ties by cover ranks.

    Every position has span bytes, so the zeros beyond the buffer's end never count.
    """
    rank = ranks(buf)
    n, rest = len(buf), V - 64
    prefix, tail = rank[at] * n + rank[at + rest], rank[at + span - V] * n + rank[at + span - 64]
    middle = span - V  # after any shift below V it begins within the first V bytes and ends within the last V
    order = np.lexsort((tail, prefix))
    same = np.append(False, (prefix[order][1:] == prefix[order][:-1]) & (tail[order][1:] == tail[order][:-1]))
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(~same) - 1
    sampled = np.flatnonzero(np.isin(np.arange(len(buf) - middle + 1) % V, COVER))
    cover = np.full(len(buf), -1, np.int64)
    steps = [rank[sampled + k] for k in (*range(0, middle - 64, 64), middle - 64)]  # the cover sample's ranks
    held = steps[0]
    for part in steps[1:]:
        held = ranked(held * n + part)
    cover[sampled] = held
    out = np.full(len(at), -1, np.int64)
    todo, fresh = np.argsort(group, kind="stable"), 0
    while len(todo):  # each round settles one class of each tied group: those that agree with its first
        own = group[todo]
        lead = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(lead, len(todo)))
        first = np.repeat(todo[lead], size)
        shift = SHIFT[at[todo] % V, at[first] % V].astype(np.int64)
        agree = cover[at[todo] + shift] == cover[at[first] + shift]
        out[todo[agree]] = np.repeat(np.arange(fresh, fresh + len(lead)), size)[agree]
        fresh += len(lead)
        todo = todo[~agree]
    return out


def sort_block(rows: list[tuple], span: int) -> list[tuple]:
    """rows (g, s, n, bytes, count) of whole buckets: (g, s, offset, length) of the suffix runs that a single row shares with another."""
    sizes = np.array([len(r[3]) for r in rows])
    buf = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = np.array([r[4] for r in rows])
    owner = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    kind = equal_suffixes(buf, begin[owner] + offset, span)
    bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1][owner]
    _, inverse, many = np.unique(np.stack([kind, bucket]), axis=1, return_inverse=True, return_counts=True)
    hit = (many[inverse.ravel()] > 1) & (np.array([r[2] for r in rows])[owner] == 1)
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    start = np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0))
    head = np.flatnonzero(start)
    length = np.diff(np.append(head, len(at)))
    return [(rows[owner[at[h]]][0], rows[owner[at[h]]][1], int(offset[at[h]]), int(n)) for h, n in zip(head, length)]


def sorted_blocks(shipped: DataFrame, span: int) -> DataFrame:
    """shipped(g, s, n, count, bytes), in order of g within each partition, a block of whole buckets at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = sort_block(held, span)
            cols = list(zip(*found)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["g", "s", "offset", "length"])

        for batch in batches:
            for g, s, n, count, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK_BYTES and held[-1][0] != g:
                    yield flush()
                    held, size = [], 0
                held.append((g, s, n, data, count))
                size += len(data)
        if held:
            yield flush()

    return shipped.repartition("g").sortWithinPartitions("g").select("g", "s", "n", "count", "bytes").mapInArrow(work, "g bigint, s bigint, offset int, length int")


def with_hot(rows: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """rows with hot: is its gram one of hot(g). Many hot grams go out once for each salt, so that no gram's rows meet."""
    if few:
        return rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = hot.select("g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("s", *(c for c in ("first",) if c in rows.columns)), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["g", "salt"], "left").drop("salt").withColumn("hot", F.coalesce("hot", F.lit(False)))


def repeated_ranges(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT_ROWS, most: int = TEXT_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs(key, id, text) to (key, first, last): suffixes first to last - 1 of the document start somewhere else too.

    A bucket of more than hot rows is not sorted in one place: its suffixes go out as names, and are counted.
    """
    rows = written(find_runs(docs.select("key", "text"), span, gram, most), "runs")
    buckets = written(rows.groupBy("g").agg(F.count("*").alias("n"), (F.min("s") == F.max("s")).alias("alike")).filter("n > 1"), "buckets")
    common = buckets.filter(F.col("n") > hot).select("g")
    marked = with_hot(rows, common, common.count() <= max_broadcast)
    rare = marked.filter("not hot").join(buckets.select("g"), "g").select(*rows.columns, "hot")
    live = written(rare.unionByName(marked.filter("hot").select(*rows.columns, "hot")), "live")
    kinds = live.groupBy("g", "s", "hot").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "count")).alias("one"))
    alike = live.join(kinds.filter("n > 1").select("g", "s"), ["g", "s"], "left_semi").select("key", "first", (F.col("first") + F.col("count")).alias("last"))
    # A rare gram's kinds meet in one task (hot rows at most); those of a common one need no partner to be told.
    several = buckets.filter((F.col("n") <= hot) & ~F.col("alike")).select("g")
    # Of the common ones those with few kinds are sorted like the rare.
    wide = written(kinds.filter("hot"), "wide")
    many = written(wide.groupBy("g").agg(F.count("*").alias("k")).filter(F.col("k") > hot).select("g"), "many")
    wide = with_hot(wide.drop("hot"), many, many.count() <= max_broadcast).select(*kinds.columns)
    picked = kinds.filter("not hot").join(several, "g", "left_semi").unionByName(wide)
    sent = written(picked.select("g", "s", "n", "hot", "one.key", "one.first", "one.count"), "kinds")
    by_doc = sent.groupBy("key").agg(F.collect_list(F.struct("g", "s", "n", "first", "count", "hot")).alias("r"))
    schema = "g bigint, s bigint, n bigint, count int, bytes binary, offset int, name bigint"

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_of)], names=["g", "s", "n", "count", "bytes", "offset", "name"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, wanted in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                for r in wanted.as_py():
                    part = data[r["first"] : r["first"] + r["count"] + span - 1]
                    size += len(part)
                    if r["hot"]:
                        names = Names(np.frombuffer(part, np.uint8)).every(span).view(np.int64).tolist()
                        out += [(r["g"], r["s"], r["n"], 1, None, k, name) for k, name in enumerate(names)]
                    else:
                        out.append((r["g"], r["s"], r["n"], r["count"], part, 0, 0))
                if size > SLICE_BYTES:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    shipped = docs.join(by_doc, "key").select("id", "text", "r").mapInArrow(cut, schema)
    if sent.filter("hot").isEmpty():
        found = sorted_blocks(shipped, span)
    else:
        names = shipped.filter("bytes is null")
        again = names.groupBy("g", "name").agg(F.sum("n").alias("times")).filter("times > 1").select("g", "name")
        counted = names.filter("n = 1").join(again, ["g", "name"], "left_semi")
        # A kind has span - gram + 1 suffixes at most: those that follow each other are one range.
        at = counted.groupBy("g", "s").agg(F.array_sort(F.collect_set("offset")).alias("at"))
        heads = F.filter("at", lambda x: ~F.array_contains("at", x - 1))
        lasts = F.filter("at", lambda x: ~F.array_contains("at", x + 1))
        ranges = F.arrays_zip(heads.alias("a"), lasts.alias("b"))
        counted = at.select("g", "s", F.explode(ranges).alias("r")).select("g", "s", F.col("r.a").alias("offset"), (F.col("r.b") - F.col("r.a") + 1).alias("length"))
        found = sorted_blocks(shipped.filter("bytes is not null"), span).union(counted)
    at = F.col("first") + F.col("offset")
    partly = found.join(sent.filter("n = 1").select("g", "s", "key", "first"), ["g", "s"]).select("key", at.alias("first"), (at + F.col("length")).alias("last"))
    return alike.union(partly)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot: int = HOT_ROWS, most: int = TEXT_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Each row of df as (id, n_bytes, n_removed, n_spans, kept binary): without the bytes that a repeated span covers.

    Null or empty text: no bytes. Two rows alike in id and text are two texts: their spans repeat. Null ids are ids like any
    other. span must be 2 * 73 at least. Other columns are not carried. An empty table gives an empty one. Very long texts: runs are
    sought in slices of `most` bytes. Memory: a text and about 80 bytes for each byte of a slice, or a block of about 2 MB of
    suffix runs and one bucket, of which equal runs count once.
    """
    if span < 2 * V or gram >= span:
        raise ValueError(f"span must be at least {2 * V} and above gram")
    docs = df.select(text_key(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = repeated_ranges(docs, span, gram, hot, most, max_broadcast).distinct()
    by_doc = ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("r"))
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                rows = []
                for text, wanted in zip(part.column(1), part.column(2)):
                    data = (text.as_py() or "").encode()
                    kept, done, gone, n = [], 0, 0, 0
                    end = -1
                    for r in wanted.as_py() or []:
                        a, b = r["first"], r["last"] + span - 1
                        if a > end:
                            n += 1
                            kept.append(data[max(end, 0) : a])
                            gone += b - a
                            end = b
                        elif b > end:
                            gone += b - end
                            end = b
                    kept.append(data[max(end, 0) :])
                    rows.append((len(data), gone, n, b"".join(kept)))
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(by_doc, "key", "left").select("id", "text", "r")
    return joined.mapInArrow(work, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """What deduplicate gives, from a table of all spans; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
