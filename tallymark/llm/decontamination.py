"""Benchmark decontamination by templates.

Words become template tokens: numbers, units and names turn into typed placeholders whose words are the slot's values. The
windows of the items' templates are a table (hash, item), and those of the documents are joined with it on the hash; of windows
that very many items share, an item needs none as long as it has rarer ones, since a document in which the share `least` of an item's
windows are found by hash holds one of any subset of them that is large enough. Each pair of document and item that meets is then verified:
along each alignment that a window gives, all windows are compared word for word. There a slot value of the item must always
stand for the same value in the document, and two names never for one name, or the window does not count.

What a name is does not hang on lines, sentences or the document's case: a word that the item has capitalised within a sentence
is a name wherever it is capitalised there; a capitalised word that only begins lines or sentences can be one unless the item also
has it in lower case; in an item without two cases each word can be one where the document has it capitalised. Each of them
matches its own word in any case, or another word as a name. The less sure it is that a word is a name, the more of the window
must agree otherwise. A document that holds the share `least` of an item's windows is contaminated, also where the
question came back with other numbers, names or units.

An item shorter than a window, like an answer of one word, is no evidence inside a text: only a document that is that item and
nothing else holds it.

A document's windows are first held against the hashes of the items' windows, so only those that an item has are shuffled. These
hashes, and the items' words, are of a benchmark of block_bytes at most (one window for each two bytes at the very most, in three
forms); a larger one takes more passes over the documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import SALTS, table, written

WINDOW = 5
LEAST = 0.8
BLOCK_BYTES = 8 << 20
MAX_MEMO = 500_000
COMMON = 50  # places in the benchmark beyond which a window is left to rarer ones
MAX_BROADCAST_WINDOWS = 1_000_000
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"

# Words that stand for numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons gram grams kilogram kilograms ounce ounces pound pounds ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees metre metres meter meters kilometre kilometres kilometer kilometers watt watts volt volts mph kmh $ € £ %".split()

EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"
NUMBER = re.compile(r"[+-]?[0-9][0-9.,]*")
MEASURE = re.compile(r"([$€£]?)([+-]?[0-9][0-9.,]*)([^\W\d_]+|[%$€£]?)")
NUMBER_SET, UNIT_SET = set(NUMBER_WORDS), set(UNITS)


def template(word: str, opens: bool) -> tuple[str, str]:
    """(token, slot value) of a word; opens: it begins a line or sentence, where a capital says nothing."""
    letters = word.isalpha()
    core = word if letters else word.strip(EDGE)
    low = core.lower()
    if letters:  # no number in digits
        if low in NUMBER_SET:
            return NUM, low
        if low in UNIT_SET:
            return UNIT, low
        return (NAME, low) if not opens and len(core) > 1 and core[0].isupper() and core[1:].islower() else (low, "")
    if not core:
        return (UNIT, word) if word in UNIT_SET else (word, "")
    if NUMBER.fullmatch(core) or low in NUMBER_SET:
        m = MEASURE.fullmatch(word.strip("().,;:!?"))
        return (NUM + UNIT, low) if m and (m[1] or m[3]) else (NUM, low)
    m = MEASURE.fullmatch(core)
    if m and (m[1] or m[3].lower() in UNIT_SET):
        return NUM + UNIT, low
    if low in UNIT_SET:
        return UNIT, low
    if not opens and len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME, low
    return low, ""


def opening(text: str, words: list[str]) -> np.ndarray:
    """Which words begin a line, or follow the end of a sentence."""
    out = np.zeros(len(words) + 1, bool)
    n = 0
    for line in text.split("\n"):
        out[n] = True
        n += len(line.split())
    for k, w in enumerate(words):
        if w[-1] in ".!?:":
            out[k + 1] = True
    return out[:-1]


def capitalised(core: str) -> bool:
    return len(core) > 1 and core[0].isupper() and core[1:].islower()


def code(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


NAME_CODE = code(NAME)


def hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many codes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids ^ (ids >> np.uint64(29))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
    return out ^ (out >> np.uint64(32))


class Item:
    """An item's words: codes of literal tokens, slot values, and which words are names (sure) or can be (maybe)."""

    def __init__(self, item_id: int, text: str, window: int = WINDOW):
        words = text.split()
        self.id = item_id
        opens = opening(text, words)
        inner = [template(w, False) for w in words]
        names = {v for (t, v), o in zip(inner, opens) if t == NAME and not o}
        plain = {t for t, v in inner if not v}
        self.sure = np.array([t == NAME and v in names for t, v in inner])
        self.maybe = np.array([t == NAME and v not in names and v not in plain for t, v in inner])
        self.caseless = text.islower() or text.isupper()
        self.values = [v or t for t, v in inner]
        self.slot = [bool(v) and t != NAME for t, v in inner]
        self.literal = np.array([code(v if t == NAME else t) for t, v in inner], np.uint64)
        self.size = min(window, len(words))
        self.total = len(words) - self.size + 1
        self.short = len(words) < window
        # Windows (place, hash): names as their own words, sure ones as <name>, and possible ones too; a window keeps a word that is no name.
        found: dict[tuple[int, int], None] = {}
        for masked in (None, self.sure, self.sure | self.maybe):
            ids = self.literal if masked is None else np.where(masked, np.uint64(NAME_CODE), self.literal)
            for q, h in enumerate(hashes(ids, self.size).tolist()):
                if masked is None or not masked[q : q + self.size].all() or self.sure.all():
                    found[q, h] = None
        self.places = np.array([q for q, _ in found], np.int64)
        self.hashes = np.array([h for _, h in found], np.uint64)

    @property
    def names(self) -> set[int]:
        return {code(v) for v, s in zip(self.values, self.sure) if s}


class Coder(dict):
    """From words to the place of their codes, as themselves and as names, filled as words are met.

    A word that no item has can only be a name. vocabulary, names: codes of the items' words and sure names.
    """

    def __init__(self, vocabulary: np.ndarray, names: np.ndarray):
        super().__init__()
        self.vocabulary, self.names = set(vocabulary.tolist()), set(names.tolist())
        self.plain, self.named = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        token, value = template(word, False)
        own = code(value if token == NAME else token)
        if token != NAME and value:
            a = b = own
        else:
            a = own if own in self.vocabulary else NAME_CODE
            b = NAME_CODE if token == NAME or own in self.names else a
        self[word] = k = len(self.plain)
        self.plain.append(a)
        self.named.append(b)
        return k

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > MAX_MEMO:
            self.clear()
            self.plain, self.named = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.plain, np.uint64)[at], np.frombuffer(self.named, np.uint64)[at]

    def windows(self, text: str, window: int) -> np.ndarray:
        """Hashes of all windows of a text, of names both ways; of a text shorter than a window, of all of it."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        plain, named = self.codes(words)
        size = min(window, len(words))
        return np.concatenate([hashes(plain, size), hashes(named, size)])


class Matcher:
    """What items a text holds: every window of every item is sought in it."""

    def __init__(self, items: list[Item | tuple[int, str]], window: int = WINDOW, least: float = LEAST, coder: Coder | None = None):
        self.window, self.least = window, least
        self.items = [x if isinstance(x, Item) else Item(x[0], x[1], window) for x in items if isinstance(x, Item) or (x[1] or "").split()]
        if coder is None:
            known = {int(c) for x in self.items for c in x.literal}
            coder = Coder(np.array([*known], np.uint64), np.array([*{n for x in self.items for n in x.names}], np.uint64))
        self.coder = coder

    def find(self, text: str) -> list[tuple[int, float]]:
        """(item id, share of its windows) of the items that the text holds."""
        words = text.split()
        if not words or not self.items:
            return []
        plain, named = self.coder.codes(words)
        out, size = [], min(self.window, len(words))
        mine = np.concatenate([hashes(plain, size), hashes(named, size)])
        order = np.argsort(mine, kind="stable")
        ranked, at = mine[order], order % (len(words) - size + 1)
        for item in self.items:
            if item.size != size or item.short and len(item.literal) != len(words):
                continue
            low, high = np.searchsorted(ranked, item.hashes, "left"), np.searchsorted(ranked, item.hashes, "right")
            shifts = {p - q for q, a, b in zip(item.places.tolist(), low.tolist(), high.tolist()) for p in at[a:b].tolist()}
            fits = {shift: self.fitting(item, plain, named, shift, size) for shift in sorted(shifts)}
            if len(set().union(*fits.values())) < self.least * item.total:
                continue
            good: set[int] = set()
            for shift, qs in fits.items():
                good |= self.consistent(item, plain, words, shift, qs, size)
                if len(good) == item.total:
                    break
            if len(good) >= self.least * item.total:
                out.append((item.id, len(good) / item.total))
        return out

    @staticmethod
    def fitting(item: Item, plain: np.ndarray, named: np.ndarray, shift: int, size: int) -> list[int]:
        """The item's windows whose words all agree or can be names, along one alignment."""
        low, high = max(0, -shift), min(len(item.literal), len(plain) - shift)
        if high - low < size:
            return []
        said = plain[low + shift : high + shift]
        free = item.sure[low:high] | item.maybe[low:high]
        if item.caseless:
            free = free | (named[low + shift : high + shift] == np.uint64(NAME_CODE))
        wrong = np.concatenate([[0], np.cumsum((item.literal[low:high] != said) & ~free)])
        return (low + np.flatnonzero(wrong[size:] == wrong[:-size])).tolist()

    @staticmethod
    def consistent(item: Item, plain: np.ndarray, words: list[str], shift: int, qs: list[int], size: int) -> set[int]:
        """Of the windows at qs, those whose slots keep the values that earlier windows gave them, and that hold enough besides names."""
        said: dict[tuple[int, str], str] = {}
        names: dict[str, str] = {}
        found: dict[int, tuple[str, str, str]] = {}
        good = set()
        short = item.short
        for q in qs:
            new, back, fits, agree, need = {}, {}, True, 0, 0
            for k in range(q, q + size):
                same = item.literal[k] == plain[k + shift]
                agree += bool(same)
                name = item.sure[k] or item.maybe[k] or not same
                if not (name or item.slot[k]):
                    continue
                if k not in found:
                    word = words[k + shift]
                    token, value = template(word, False)
                    found[k] = token, value or token, word.strip(EDGE)
                token, value, core = found[k]
                own = item.values[k]
                slot = (0 if name else int(item.literal[k]), own)
                fits &= said.get(slot, new.setdefault(slot, value)) == value
                if name:
                    fits &= names.get(value, back.setdefault(value, own)) == own
                if not same:
                    fits &= token == NAME or (bool(core) and token == value)
                    clear = item.sure[k] and capitalised(core)
                    need = max(need, int(short) if clear else 3 if short else 2)
            if fits and agree >= need:
                said |= new
                names |= back
                good.add(q)
        return good


def item_table(items: DataFrame, window: int) -> DataFrame:
    """items(i, t) to (kind, i, ih, total, q, h): kind 0 a window at place q, 1 a word's code, 2 a sure name's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ih, t in zip(*(c.to_pylist() for c in batch.columns)):
                if not (t or "").split():
                    continue
                item = Item(i, t, window)
                words, names = np.unique(item.literal), np.array(sorted(item.names), np.uint64)
                n = len(item.hashes), len(words), len(names)
                h = np.concatenate([item.hashes, words, names]).view(np.int64)
                q = np.concatenate([item.places, np.zeros(n[1] + n[2], np.int64)])
                cols = [np.repeat(np.arange(3), n), np.full(len(h), i), np.full(len(h), ih), np.full(len(h), item.total), q, h]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "i", "ih", "total", "q", "h"])

    return items.select("i", F.xxhash64("t").alias("ih"), "t").mapInArrow(work, "kind bigint, i bigint, ih bigint, total bigint, q bigint, h bigint")


def chosen_windows(found: DataFrame, least: float) -> DataFrame:
    """(h, i, ih): of each item the windows that few places have, and as many more, rarest first, as any holder has one of."""
    places = found.filter("kind = 0").select("i", "ih", "total", "q", "h")
    often = places.groupBy("h").agg(F.count("*").alias("n"))
    rated = places.join(often, "h")
    by_place = rated.groupBy("i", "ih", "total", "q").agg(F.max("n").alias("most"))
    rank = F.row_number().over(W.partitionBy("i", "ih").orderBy("most", "q"))
    needed = F.col("total") - F.ceil(F.lit(least) * F.col("total")) + 1
    kept = by_place.withColumn("rank", rank).filter((F.col("most") <= COMMON) | (F.col("rank") <= needed))
    return places.join(kept.select("i", "ih", "q"), ["i", "ih", "q"], "left_semi").select("h", "i", "ih").distinct()


class Held:
    """Membership in a set of hashes: a bit for each value of their lowest bits lets few others through to a search."""

    def __init__(self, known: np.ndarray):
        """known: ascending."""
        self.known = known
        self.mask = np.uint64((1 << max(10, (16 * len(known)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) // 8 + 1, np.uint8)
        at = known & self.mask
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def those(self, h: np.ndarray) -> np.ndarray:
        """The distinct hashes that are known."""
        at = h & self.mask
        h = h[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        if not len(h) or not len(self.known):
            return h[:0]
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.unique(h[self.known[k] == h])


def _one_block(rows: DataFrame, items: DataFrame, window: int, least: float) -> DataFrame:
    """rows(held..., __t) with __i and __s: the items of this block that each row holds, and the largest share."""
    held = rows.columns[:-1]
    items = written(items, "items")
    found = written(item_table(items, window), "item-words")
    windows = written(chosen_windows(found, least), "windows")
    count = windows.count()
    of = lambda df: np.sort(df.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    known, vocabulary, names = of(windows), of(found.filter("kind = 1")), of(found.filter("kind = 2"))  # of block_bytes of text
    keyed = rows.withColumn("__rid", F.monotonically_increasing_id())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, items_have = Coder(vocabulary, names), Held(known)
        for batch in batches:
            texts = batch.column(len(held))
            hits = [items_have.those(coder.windows(t.as_py() or "", window)).view(np.int64) for t in texts]
            some = pa.array([len(h) > 0 for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.compute.if_else(some, texts, pa.scalar(None, texts.type)), batch.columns[-1], pa.array(hits, pa.list_(pa.int64()))], names=[*batch.schema.names, "__h"])

    probed = written(keyed.mapInArrow(probe, ", ".join([*fields, "__h array<bigint>"])), "probed")
    quiet = probed.filter("size(__h) = 0").select(*[F.col(f"`{c}`") for c in held], F.array().cast("array<bigint>").alias("__i"), F.lit(0.0).alias("__s"))
    loud = probed.filter("size(__h) > 0")
    hits = loud.select("__rid", F.explode("__h").alias("h"))
    if count <= MAX_BROADCAST_WINDOWS:
        met = hits.join(F.broadcast(windows), "h")
    else:  # a window of very many documents meets its items in several tasks
        spread = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod("__rid", F.lit(SALTS)).cast("int")).join(spread, ["h", "salt"])
    pairs = met.select("__rid", "i", "ih").distinct()
    # Of each document the items to verify: their texts are those of a part of the benchmark that it shares a rare window with.
    told = pairs.join(items.withColumn("ih", F.xxhash64("t")).distinct(), ["i", "ih"]).groupBy("__rid").agg(F.collect_list(F.struct("i", "t")).alias("__c"))
    checked = loud.select(*[F.col(f"`{c}`") for c in held], "__t", "__rid").join(told, "__rid", "left").select(*[F.col(f"`{c}`") for c in held], "__t", "__c")
    out = quiet.schema

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, names)
        known: dict[tuple[int, str], Item] = {}
        for batch in batches:
            ids, shares = [], []
            for text, some in zip(batch.column(len(held)), batch.column(len(held) + 1)):
                mine = []
                for c in some.as_py() or []:
                    key = c["i"], c["t"]
                    if key not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[key] = Item(*key, window)
                    mine.append(known[key])
                got = Matcher(mine, window, least, coder).find(text.as_py() or "") if mine else []
                ids.append(sorted({i for i, _ in got}))
                shares.append(max([0.0, *(s for _, s in got)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64())], names=[*batch.schema.names[:-2], "__i", "__s"])

    return quiet.union(checked.mapInArrow(verify, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields)))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least: float = LEAST, keep: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with items (ids of the benchmark items held, ascending), share (the largest) and contaminated.

    keep: with all columns of df (but its own of these names), else with the id only. Null or empty texts hold nothing; null or
    empty items, and those without an id, are in no document; items shorter than a window are held only by a document that is
    nothing else. Very long texts: one at a time, about 100 bytes for each word. Repeated rows: each for itself; repeated items
    count once. A share of exactly `least` is contaminated. An empty benchmark: no document is. An empty table gives an empty one.
    Shuffled: windows that the benchmark has too, and texts that share one of them with it.
    """
    new = ["items", "share"]
    held = [c for c in df.columns if c not in (*new, "contaminated")] if keep else [id_col]
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = df.select(*[F.col(f"`{c}`") for c in held], F.col(text_col).cast("string").alias("__t"))
    ids, share = F.array().cast("array<bigint>"), F.lit(0.0)
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        done = _one_block(out.select(*[F.col(f"`{c}`") for c in out.columns if c != "__t"], *(["__t"] if b + 1 == blocks else [F.col("__t").alias(f"__t{b}"), "__t"])), block, window, least)
        out = done.withColumnsRenamed({"__i": f"__i{b}", "__s": f"__s{b}", f"__t{b}": "__t"})
        ids, share = F.array_union(ids, F.col(f"__i{b}")), F.greatest(share, F.col(f"__s{b}"))
    return out.select(*[F.col(f"`{c}`") for c in held], F.array_sort(ids).alias("items"), share.alias("share"), (F.size(ids) > 0).alias("contaminated"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.round("share", 6).alias("share"), (~F.col("contaminated")).alias("kept"))
