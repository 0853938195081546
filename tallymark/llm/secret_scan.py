"""Secret scans over a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: a text that matches holds, of some alternative, all
trigrams. The index has a posting (trigram, document) for each trigram that a query names. The postings of an alternative
intersect where a document has all of its trigrams; only such candidates are searched with the expression. A rule without a
mandatory trigram is searched in every text. Case is folded on both sides, which only adds candidates.

Every query is asked over all documents, so a document's postings are kept with its row, and the intersection is taken there: a
posting that is not sent to the trigram's place need not come back with the text, and nothing is shuffled. `postings` and
`candidates` are the same index by trigram, for queries over texts that lie elsewhere. Everything runs in DataFrame functions;
the rules are read on the driver.
"""

from __future__ import annotations

from functools import reduce
from re import _parser as sre  # Python's own reader of regular expressions

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import table

# The base rules as their contract has them; then the rules that this operator adds.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
ADDED = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "forge_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "map_key": r"AIza[A-Za-z0-9_-]{35}",
}
#: Least code points of a match; for assign, of its second group.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A search that gives the same long matches as the base rule and does not stop at the short ones: both take whole runs.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
KINDS = [*BASE, *ADDED]
MOST_STRINGS = 64  # strings followed side by side while a query is derived
MOST_CHARS, MOST_REPEATS = 8, 40  # of a class whose letters are followed one by one; of a repeat that is written out


class Known:
    """What is known of all strings that an expression matches: either each of them (`whole`), or with which strings they can
    begin (`heads`) and end (`tails`), and clauses, one of which holds in full (None: no demand)."""

    def __init__(self, whole=None, heads=None, tails=None, clauses=None):
        self.whole, self.clauses = whole, clauses
        self.heads, self.tails = (whole, whole) if whole is not None else (heads or {""}, tails or {""})

    def opened(self) -> Known:
        """The same with only its ends and clauses known."""
        if self.whole is None:
            return self
        return Known(None, {w[:2] for w in self.whole}, {w[-2:] for w in self.whole}, _and(self.clauses, _held(self.whole)))

    def then(self, other: Known) -> Known:
        if self.whole is not None and other.whole is not None and len(self.whole) * len(other.whole) <= MOST_STRINGS:
            return Known({a + b for a in self.whole for b in other.whole})
        # Each match has a border: the end of the left part and the beginning of the right one, as far as they are known.
        left, right = self, other
        middle = {a + b for a in left.tails for b in right.heads} if len(left.tails) * len(right.heads) <= MOST_STRINGS else {""}
        clauses = _and(_and(left.opened().clauses, right.opened().clauses), _held(middle))
        heads = {a + b for a in left.whole for b in right.heads} if left.whole is not None else left.heads
        tails = {a + b for a in left.tails for b in right.whole} if right.whole is not None else right.tails
        return Known(None, _few({h[:2] for h in heads}), _few({t[-2:] for t in tails}), clauses)

    def either(self, other: Known) -> Known:
        if self.whole is not None and other.whole is not None and len(self.whole | other.whole) <= MOST_STRINGS:
            return Known(self.whole | other.whole)
        a, b = self.opened(), other.opened()
        clauses = None if a.clauses is None or b.clauses is None else a.clauses + b.clauses
        return Known(None, _few(a.heads | b.heads), _few(a.tails | b.tails), clauses)


def _few(strings: set[str]) -> set[str]:
    return strings if len(strings) <= MOST_STRINGS else {""}


def _held(strings: set[str]) -> list[frozenset[str]] | None:
    """The demand that one of these strings is there; none if one of them is too short to have a trigram."""
    found = [_trigrams(s) for s in strings]
    return found if found and all(found) else None


def alternatives(pattern: str) -> list[frozenset[str]] | None:
    """The trigram query of an expression: sets of lower-case trigrams, one of which must be there in full; None: no demand."""
    found = _known(sre.parse(pattern)).opened().clauses
    if found is None or any(not c for c in found):
        return None
    return [c for c in dict.fromkeys(found) if not any(o < c for o in found)]


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


def _and(a, b):
    """Both demands; where there would be too many clauses, the one with fewer alone, which asks for less."""
    if a is None or b is None:
        return a if b is None else b
    both = list(dict.fromkeys(x | y for x in a for y in b))
    return both if len(both) <= MOST_STRINGS else min((a, b), key=len)


def _known(node) -> Known:
    """What the parts of an expression tell, one after the other; any part that is not understood can be any string."""
    out = Known({""})
    for op, value in node:
        name, part = str(op), Known()
        if name == "LITERAL":
            part = Known({chr(value).lower()})
        elif name == "SUBPATTERN":
            part = _known(value[-1])
        elif name == "ATOMIC_GROUP":
            part = _known(value)
        elif name == "BRANCH":
            part = reduce(Known.either, map(_known, value[1]))
        elif name == "IN":
            chars = {chr(v).lower() for k, v in value if str(k) == "LITERAL"}
            part = Known(chars) if all(str(k) == "LITERAL" for k, _ in value) and len(value) <= MOST_CHARS else Known()
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            once = _known(body)
            if low == 0 and high == 1:
                part = once.either(Known({""}))
            elif low > 0:
                part = reduce(Known.then, [once] * min(int(low), MOST_REPEATS))
                if high != low or low > MOST_REPEATS:  # more of it may follow; what it ends with is what one of them does
                    more = once.opened()
                    part = Known(None, part.opened().heads, more.tails, part.opened().clauses)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = Known({""})
        out = out.then(part)
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """docs(id, text) to (trigram, id), for the trigrams that queries name."""
    low = F.lower(F.col("text"))
    held = docs.select("id", low.alias("low"))
    found = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return held.select("id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """(id, kinds array) of the documents that a rule's query selects, and the rules that have none."""
    queries = {k: alternatives(p) for k, p in rules.items()}
    clauses = [(k, n, c) for k, q in queries.items() if q is not None for n, c in enumerate(q)]
    open_rules = [k for k, q in queries.items() if q is None]
    if not clauses:
        return None, open_rules
    index = postings(docs, sorted({t for _, _, c in clauses for t in c}))
    # The clauses of each trigram, as a literal: the rules' size, not the data's.
    of = F.create_map(*[x for t in sorted({t for _, _, c in clauses for t in c}) for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("clause"), F.lit(len(c)).alias("size")) for k, n, c in clauses if t in c]))])
    wanted = index.select("id", F.explode(F.element_at(of, F.col("trigram"))).alias("c")).select("id", "c.*")
    met = wanted.groupBy("id", "kind", "clause", "size").agg(F.count("*").alias("n")).filter("n >= size")  # >=: ids may repeat
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds")), open_rules


def spans(text: Column, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start,rank,kind,end>> of the leftmost, non-overlapping matches: their places follow from what lies between."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, lambda x: F.length(x))
    long = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else sizes
    cells = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), long.alias("long"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"].isNotNull() & (x["long"] >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    many = F.aggregate(cells, start, add, lambda acc: acc["out"])
    return F.when(F.size(F.split(text, pattern, 2)) < 2, empty).otherwise(many)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def held_kinds(low: Column, queries: dict[str, list[frozenset[str]]]) -> Column:
    """The rules whose query a lower-case text meets: its postings intersected by alternative, each only as far as the last had one."""

    def meets(query: list[frozenset[str]]) -> Column:
        every = [reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in sorted(c, key=lambda t: (t.isalpha(), t))]) for c in query]
        return reduce(lambda a, b: a | b, every)

    if not queries:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(meets(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows with secrets, array<struct<start,rank,kind,end>> by start and then rule, code points, end exclusive.

    keep: with all columns of df (but its own of this name), else with the id only. Null text is empty text. Repeated rows and
    null ids: each row for itself. Spans of different rules that start together go in the rules' order. Very long texts are
    searched whole, in linear time for these rules; memory is one text and its spans. An empty table gives an empty one. No
    shuffle.
    """
    held = [c for c in df.columns if c != "secrets"] if keep else [id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    queries = {k: alternatives(p) for k, p in (BASE | ADDED).items()}
    kinds = held_kinds(F.col("__low"), {k: q for k, q in queries.items() if q is not None})
    docs = df.select(*[F.col(f"`{c}`") for c in held], text.alias("__t"))
    docs = docs.select("*", F.lower("__t").alias("__low"))  # a column of its own, so that it is made once for all trigrams
    docs = docs.select(*[F.col(f"`{c}`") for c in held], "__t", kinds.alias("__kinds"))
    parts = []
    for kind, pattern in (BASE | ADDED).items():
        all_of = spans(F.col("__t"), kind, LONG_ONLY.get(kind, pattern), 0 if kind in LONG_ONLY else LEAST.get(kind, 0), 2 if kind == "assign" else 0)
        empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        parts.append(all_of if queries[kind] is None else F.when(F.array_contains("__kinds", kind), all_of).otherwise(empty))
    return docs.select(*[F.col(f"`{c}`") for c in held], F.array_sort(F.concat(*parts)).alias("secrets"))


def redacted(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        said = F.when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), said.alias("out"))

    return F.when(F.size(secrets) == 0, text).otherwise(F.aggregate(secrets, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
