"""Token counts by finite-state transducers.

Two deterministic transducers are compiled from a byte-level BPE file:

* the splitter reads character classes and emits 1 on each transition that begins a new word. Text is cut into
  chunks; the state map of every chunk is found for all start states at once, the maps compose through a parallel
  prefix scan, and a second pass from the then known states gives the emissions;
* the merger reads the bytes of a word on a complete automaton of the vocabulary. Its state also holds the last token of
  the encoding of each prefix: of the entries that end at a byte, exactly one agrees with the last token before it, and
  the transition emits the difference in token count that it makes. Which pairs of tokens agree is compiled from the
  merge ranks when first met; that table has a size limit and starts again beyond it, which costs time and never changes
  a count. Words end the merger's state, so the words of a chunk step through it together; a very long word, which none
  would accompany to its end, steps through the same transducer by itself.

Special strings split the text before both and count one each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SLICE_CHARS, slices, table
from tallymark.llm.int_table import IntTable

# White space of Unicode, and the endings that the published split pattern keeps together.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)  # SPACE is any white space but U+0020, which is BLANK
# Symbols of the splitter: a class, with what its decision needs from the next characters.
S_LETTER, S_NUMBER, S_OTHER, S_END1, S_END2, S_INNER, S_LAST, S_LAST_BLANK, S_RESET = range(9)
# Its states: nothing pending; a blank that the next word takes in; inside a run of a class; endings yet to pass.
FRESH, JOIN, IN_L, IN_N, IN_O, IN_SPACE, END_2, END_1 = range(8)
CHUNK = 64
MAX_PAIRS = 2_000_000
LONG_WORD = 2_000  # bytes from which a word is stepped through by itself


@cache
def char_classes() -> np.ndarray:
    """The class of each code point, as the regular expressions of the installed library have it (its Unicode version)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.full(0x110000, OTHER, np.uint8)
    for first, end in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, end)))
        for kind, pattern in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+")):
            for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
                out[first + a : first + b] = kind
    out[SPACES] = SPACE
    out[0x20] = BLANK
    return out


def splitter_table() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and emitted[symbol, state]."""
    step, emit = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    for state in range(8):
        if state in (END_2, END_1):  # the letters of an ending belong to its apostrophe
            step[:, state], emit[:, state] = (END_1 if state == END_2 else FRESH), 0
        else:
            for sym, run in ((S_LETTER, IN_L), (S_NUMBER, IN_N), (S_OTHER, IN_O)):
                step[sym, state], emit[sym, state] = run, state not in (run, JOIN)
            for sym, after in ((S_END1, END_1), (S_END2, END_2)):
                begins = state not in (IN_O, JOIN)
                step[sym, state], emit[sym, state] = (after if begins else IN_O), begins
            step[S_INNER, state], emit[S_INNER, state] = IN_SPACE, state != IN_SPACE
            step[S_LAST, state], emit[S_LAST, state] = FRESH, 1
            step[S_LAST_BLANK, state], emit[S_LAST_BLANK, state] = JOIN, 1
        step[S_RESET, state], emit[S_RESET, state] = FRESH, 1  # a separator between texts
    return step, emit


def symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The symbol of each code point. stops: positions of separators between texts."""
    kind = char_classes()[points]
    white = kind >= SPACE
    after = np.zeros(len(kind), bool)  # is the next character of the same text not white space
    after[:-1] = ~white[1:]
    after[stops[stops > 0] - 1] = False
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_INNER], np.uint8)[kind]
    out[white & after] = S_LAST
    out[(kind == BLANK) & after] = S_LAST_BLANK
    at = np.flatnonzero(points == 0x27)
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    for ending in ENDINGS:
        hit = np.ones(len(at), bool)
        for k, c in enumerate(ending[1:], 1):
            hit &= padded[at + k] == ord(c)
        out[at[hit]] = S_END1 if len(ending) == 2 else S_END2
    out[stops] = S_RESET
    return out


STEP, EMIT = splitter_table()


def compose(maps: np.ndarray) -> np.ndarray:
    """maps[chunk, state]; the composition of all maps before each chunk, by an exclusive parallel prefix scan."""
    n, states = maps.shape
    out = np.empty_like(maps)
    out[0], out[1:] = np.arange(states, dtype=maps.dtype), maps[:-1]
    shift = 1
    while shift < n:
        out[shift:] = np.take_along_axis(out[shift:], out[:-shift].copy(), 1)
        shift *= 2
    return out


def run_splitter(syms: np.ndarray) -> np.ndarray:
    """Whether a word begins at each symbol; the first state is FRESH."""
    n = len(syms)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, S_RESET, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = STEP.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, rows)).copy()
    for k in range(CHUNK):
        maps = flat[(grid[k] << np.uint8(3)) | maps]
    state = compose(np.ascontiguousarray(maps.T))[:, FRESH]
    out, told = np.empty((CHUNK, rows), bool), EMIT.ravel()
    for k in range(CHUNK):
        cell = (grid[k] << np.uint8(3)) | state
        out[k] = told[cell]
        state = flat[cell]
    return out.T.ravel()[:n]


class Pairs:
    """From (left, right) token pairs to whether right may follow left in an encoding; filled when first asked."""

    def __init__(self):
        self.table = IntTable(np.bool_)

    def get(self, keys: np.ndarray, find) -> np.ndarray:
        missing = ~self.table.has(keys)
        if missing.any():
            fresh = np.unique(keys[missing])
            if self.table.used + len(fresh) > MAX_PAIRS:  # starts again: costs time only
                self.table = IntTable(np.bool_)
                fresh = np.unique(keys)
            self.table.put(fresh, find(fresh))
        return self.table.get(keys, False)


class Merger:
    """The transducer over the bytes of a word: token ids here are ranks, single bytes first."""

    def __init__(self, singles: list[bytes], merges: list[tuple[bytes, bytes]]):
        """singles: the one-byte tokens; merges: pairs in order of rank."""
        if sorted(singles) != [bytes([b]) for b in range(256)]:
            raise ValueError("the vocabulary lacks a byte")
        words = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        ids = {w: i for i, w in enumerate(words)}
        if len(ids) != len(words):
            raise ValueError("two merges give one token")
        n = len(words)
        self.size = np.fromiter(map(len, words), np.int64, n)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        left[256:], right[256:] = [ids[a] for a, _ in merges], [ids[b] for _, b in merges]
        # The outer tokens of each token while it grows, from a byte up to itself; beyond that n, which never merges.
        self.left_edge, self.right_edge = self._edges(left, n), self._edges(right, n)
        order = np.argsort(left[256:] * n + right[256:])
        self.merge_keys, self.merge_ids = (left[256:] * n + right[256:])[order], order + 256
        self.n, self.pairs = n, Pairs()
        self.one_by_one: tuple | None = None
        reached = np.ones(n, bool)
        reached[256:] = self._first_merge(left[256:], right[256:]) == np.arange(256, n)
        self._automaton(words, reached)

    @staticmethod
    def _edges(part: np.ndarray, n: int) -> np.ndarray:
        depth = np.zeros(n, np.int64)
        for i in range(256, n):
            depth[i] = depth[part[i]] + 1
        out = np.full((n, int(depth.max()) + 2), n, np.int32)
        out[:256, 0] = np.arange(256)
        for i in range(256, n):
            out[i, : depth[i]] = out[part[i], : depth[i]]
            out[i, depth[i]] = i
        return out

    def _first_merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first merge across the border between two tokens that are being merged side by side; n if there is none.

        At any time one token touches the border from each side. The pair merges unless one of the two is taken by a
        merge of its own side before; of equal merges the one further left comes first.
        """
        n, out = self.n, np.full(len(left), self.n, np.int64)
        i, j, live = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.arange(len(left))
        while len(live):
            a, b = self.right_edge[left[live], i[live]].astype(np.int64), self.left_edge[right[live], j[live]].astype(np.int64)
            up_a, up_b = self.right_edge[left[live], i[live] + 1], self.left_edge[right[live], j[live] + 1]
            key = a * n + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            merged = np.where(self.merge_keys[at] == key, self.merge_ids[at], n) if len(self.merge_keys) else np.full(len(key), n)
            crosses = (merged < n) & (merged < up_a) & (merged <= up_b)
            out[live[crosses]] = merged[crosses]
            stay = ~crosses & (np.minimum(up_a, up_b) < n)
            take_a = stay & (up_a <= up_b)
            i[live[take_a]] += 1
            j[live[stay & ~take_a]] += 1
            live = live[stay]
        return out

    def _automaton(self, words: list[bytes], reached: np.ndarray) -> None:
        """Complete automaton over all entries: step[node, byte]; the longest entry that ends at a node; the next shorter one of an entry."""
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for i, word in enumerate(words):
            if not reached[i]:
                continue
            node = 0
            for b in word:
                to = child[node].get(b)
                if to is None:
                    to = child[node][b] = len(child)
                    child.append({})
                    token.append(-1)
                node = to
            token[node] = i
        step, best = np.zeros((len(child), 256), np.int32), np.full(len(child), -1, np.int32)
        self.shorter = np.full(len(words), -1, np.int32)
        fail = [0] * len(child)
        queue = [0]
        for node in queue:
            if node:
                step[node] = step[fail[node]]
                best[node] = best[fail[node]]
                if token[node] >= 0:
                    self.shorter[token[node]] = best[node]
                    best[node] = token[node]
            for b, to in child[node].items():
                fail[to] = int(step[node, b]) if node else 0
                step[node, b] = to
                queue.append(to)
        self.step, self.best = step.ravel(), best

    def _agree(self, keys: np.ndarray) -> np.ndarray:
        return self._first_merge(keys // self.n, keys % self.n) == self.n

    def _agree_one(self, left: int, right: int) -> bool:
        """The same for one pair, without arrays."""
        n, merged_of = self.n, self.one_by_one[3]
        mine, theirs = self.right_edge[left].tolist(), self.left_edge[right].tolist()
        i = j = 0
        while True:
            up_a, up_b = mine[i + 1], theirs[j + 1]
            merged = merged_of.get(mine[i] * n + theirs[j], n)
            if merged < n and merged < up_a and merged <= up_b:
                return False
            if up_a == n and up_b == n:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def count_long(self, word: bytes) -> int:
        """Tokens of one word, a byte at a time."""
        if self.one_by_one is None:
            self.one_by_one = self.best.tolist(), self.shorter.tolist(), self.size.tolist(), dict(zip(self.merge_keys.tolist(), self.merge_ids.tolist()))
        best, shorter, size, _ = self.one_by_one
        agree, n, step = self._agree_one, self.n, self.step
        known: dict[int, bool] = {}
        last, counts = [0] * len(word), [0] * len(word)
        node = 0
        for k, b in enumerate(word):
            node = int(step[node << 8 | b])
            t = best[node]
            while (before := k - size[t]) >= 0:
                key = last[before] * n + t
                fits = known.get(key)
                if fits is None:
                    if len(known) >= MAX_PAIRS:
                        known.clear()
                    known[key] = fits = agree(last[before], t)
                if fits:
                    break
                t = shorter[t]
            last[k] = t
            counts[k] = counts[before] + 1 if before >= 0 else 1
        return counts[-1]

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[start:end]."""
        long = ends - starts >= LONG_WORD
        if not long.any():
            return self._count_together(buf, starts, ends)
        out = np.empty(len(starts), np.int64)
        out[~long] = self._count_together(buf, starts[~long], ends[~long])
        out[long] = [self.count_long(buf[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        return out

    def _count_together(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[start:end].

        The encoding of a prefix ends with the one entry that agrees with the encoding before it; its count is that
        one's and 1. All words go forward by a byte at a time.
        """
        order = np.argsort(starts - ends, kind="stable")
        first, sizes = starts[order], (ends - starts)[order]
        falls = -sizes
        last, counts = np.empty(len(buf), np.int32), np.empty(len(buf), np.int32)
        node = np.zeros(len(order), np.int64)
        active, k = int(np.searchsorted(falls, 0)), 0
        while active:
            at = first[:active] + k
            node[:active] = self.step[(node[:active] << 8) | buf[at]]
            token = self.best[node[:active]]
            todo = np.arange(active)
            while len(todo):
                t, here = token[todo], at[todo]
                size = self.size[t]
                inner = size <= k
                before = here[inner] - size[inner]
                fits = np.ones(len(todo), bool)
                fits[inner] = self.pairs.get(last[before].astype(np.int64) * self.n + t[inner], self._agree)
                last[here[fits]] = t[fits]
                gone = fits & inner
                counts[here[fits]] = 1
                counts[here[gone]] = counts[here[gone] - size[gone]] + 1
                todo = todo[~fits]
                token[todo] = self.shorter[token[todo]]
            k += 1
            active = int(np.searchsorted(falls[:active], -k))
        return counts[ends - 1]


def from_file(path: str) -> tuple[Merger, list[str]]:
    """The merger and the special strings of a tokenizer file (byte-level BPE, no normaliser)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE file")
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(plain)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}
    raw = lambda w: bytes(alphabet[c] for c in w)
    special = [x["content"] for x in spec["added_tokens"]]
    singles = [raw(w) for w in spec["model"]["vocab"] if w not in special and len(w) == 1]
    merges = [tuple(map(raw, pair.split(" ") if isinstance(pair, str) else pair)) for pair in spec["model"]["merges"]]
    return Merger(singles, merges), special


@cache
def compiled(path: str) -> tuple[Merger, re.Pattern | None]:
    merger, special = from_file(path)
    longest = sorted(special, key=len, reverse=True)
    return merger, re.compile("|".join(map(re.escape, longest))) if longest else None


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    merger, special = compiled(path)
    total = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for k, text in enumerate(texts):
        parts = special.split(text) if special else [text]
        total[k] += len(parts) - 1
        for part in parts:
            if part:
                pieces.append(part)
                owner.append(k)
    if not pieces:
        return total
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(sizes + 1)[:-1] - 1
    joined = "\0".join(pieces)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    syms = symbols(points, stops)
    begins = run_splitter(syms)
    width = np.ones(len(points), np.int64)
    width += (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
    at = np.flatnonzero(begins)
    offset = np.cumsum(width) - width
    buf = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    starts = offset[at]
    ends = np.append(starts[1:], len(buf))
    real = syms[at] != S_RESET
    whose = np.searchsorted(stops, at[real], side="right")
    counts = merger.count(buf, starts[real], ends[real])
    per_piece = np.bincount(whose, weights=counts, minlength=len(pieces)).astype(np.int64)
    np.add.at(total, np.array(owner), per_piece)
    return total


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, in a single pass without a shuffle.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and null ids: each row is counted for itself. Extra columns are
    not carried, so their names cannot clash. An empty table gives an empty one. Very long texts and words: time in
    proportion to their length. Memory: one slice of texts (or one longer text) and the transducer's bounded table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {rows.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [count_texts(texts[a:b], path) for a, b in slices(texts)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            sizes = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(work, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
