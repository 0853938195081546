"""The matching tiers. Each takes residual bank rows and settlements and gives matches and, where it declines, exceptions.

Matches: run_id, bank_txn_id, settlement_ids (sorted), tier, rule_id, confidence (ten-thousandths).
Exceptions: run_id, bank_txn_id, code, value_at_risk_paise, detail, raised_by.
Claims couple credits only inside a run, so what is sequential goes run by run through `by_run`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.config import DEFAULT_CONFIG, DEFAULT_FEES, FeeModel, MatchConfig
from tallymark.functions import references
from tallymark.functions.calendar import window_days
from tallymark.functions.money import apply_rate, breakdown, within_tolerance
from tallymark.functions.similarity import name_similarity
from tallymark.operators.subsets import find_subsets

MATCH = "run_id string, bank_txn_id string, settlement_ids array<string>, tier int, rule_id string, confidence int"
EXCEPTION = "run_id string, bank_txn_id string, code string, value_at_risk_paise bigint, detail string, raised_by string"


def as_matches(pairs: DataFrame, tier: int, rule: str, confidence: Column | int) -> DataFrame:
    return pairs.select("run_id", "bank_txn_id", F.array("settlement_id").alias("settlement_ids"), F.lit(tier).alias("tier"), F.lit(rule).alias("rule_id"), (F.lit(confidence) if isinstance(confidence, int) else confidence).cast("int").alias("confidence"))


def unique_by(rows: DataFrame, keys: list[str], id_col: str, *more: str) -> DataFrame:
    """Keys that lead to exactly one id, with that id and more of its row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (id_col, *more)]).filter("n = 1").drop("n")


Keep = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, tag: str) -> DataFrame:
    """A Keep that holds nothing. Others write what several later steps read, under the tag, so that it is made once."""
    return df


def by_run(rows: DataFrame, order: tuple[str, ...], decide: Callable[[str, Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """decide(run_id, its rows in order) over each run. The first column is run_id; a task's runs stream through one worker.

    A grouped map hands over each run by itself, which costs more than most runs do; here rows come in Arrow batches, and no
    more of them are held than decide holds.
    """
    kinds = [(f.strip().split(" ")[0], f.strip().split(" ")[1]) for f in schema.split(",")]

    def stream(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        known = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
        shape = pa.schema([(n, known[k]) for n, k in kinds])

        def plain(column: pa.Array) -> list:
            return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

        every = (row for b in batches for row in zip(*map(plain, b.columns)))
        out: list[tuple] = []
        for run, part in groupby(every, itemgetter(0)):
            out += decide(run, part)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return rows.repartition("run_id").sortWithinPartitions("run_id", *order).mapInArrow(stream, schema)


def residual(bank: DataFrame, settled: DataFrame, matches: DataFrame, closed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that no match claims; closed: exceptions whose credits no later tier may take."""
    credits = matches.select("run_id", "bank_txn_id")
    if closed is not None:
        credits = credits.union(closed.select("run_id", "bank_txn_id"))
    claimed = matches.select("run_id", F.explode("settlement_ids").alias("settlement_id"))
    return bank.join(credits, ["run_id", "bank_txn_id"], "left_anti"), settled.join(claimed, ["run_id", "settlement_id"], "left_anti")


# Tier 0


def bank_tokens(bank: DataFrame, learned: tuple[str, ...] = ()) -> DataFrame:
    return bank.filter("credit_paise > 0").select("run_id", "bank_txn_id", "credit_paise", F.explode(references.candidates(F.col("narration"), learned)).alias("token"))


def tier0_reference(bank: DataFrame, settled: DataFrame, learned: tuple[str, ...] = ()) -> DataFrame:
    """Credits and settlements that share a reference found once on each side, with equal amounts."""
    tokens = bank_tokens(bank, learned)
    ours = unique_by(tokens, ["run_id", "token"], "bank_txn_id", "credit_paise")
    refs = settled.select("run_id", "settlement_id", "net_amount_paise", references.normalise(F.coalesce("utr", F.lit("")), learned).alias("token")).filter("token <> ''")
    theirs = unique_by(refs, ["run_id", "token"], "settlement_id", "net_amount_paise")
    return as_matches(ours.join(theirs, ["run_id", "token"]).filter("credit_paise = net_amount_paise"), 0, "T0-UTR-EXACT", 10_000)


def tier0_amount_date(bank: DataFrame, settled: DataFrame) -> DataFrame:
    """Of what is left: an amount on a day found once on each side."""
    ours = unique_by(bank.filter("credit_paise > 0").withColumnsRenamed({"credit_paise": "amount", "value_date": "day"}), ["run_id", "amount", "day"], "bank_txn_id")
    theirs = unique_by(settled.withColumnsRenamed({"net_amount_paise": "amount", "settled_on": "day"}), ["run_id", "amount", "day"], "settlement_id")
    return as_matches(ours.join(theirs, ["run_id", "amount", "day"]), 0, "T0-AMOUNT-DATE-UNIQUE", 10_000)


def tier0(bank: DataFrame, settled: DataFrame, learned: tuple[str, ...] = (), keep: Keep = as_is) -> DataFrame:
    by_reference = keep(tier0_reference(bank, settled, learned), "references")
    return by_reference.unionByName(tier0_amount_date(*residual(bank, settled, by_reference)))


# Tier 1


def expected_net(settled: DataFrame, drifts: DataFrame | None = None, fees: FeeModel = DEFAULT_FEES) -> DataFrame:
    """settled with expected_net, recomputed from gross; drifts(customer_name, drift_bps) adds to a customer's rates."""
    if drifts is None:
        return settled.withColumn("expected_net", breakdown(F.col("gross_amount_paise"), F.col("method"), fees)["net"])
    named = drifts.select(F.upper(F.trim("customer_name")).alias("customer"), "drift_bps")
    rows = settled.withColumn("customer", F.upper(F.trim("customer_name"))).join(named, "customer", "left").drop("customer")
    net = breakdown(F.col("gross_amount_paise"), F.col("method"), fees, F.coalesce("drift_bps", F.lit(0)))["net"]
    return rows.withColumn("expected_net", net).drop("drift_bps")


def in_window(bank: DataFrame, settled: DataFrame, config: MatchConfig = DEFAULT_CONFIG, fees: FeeModel = DEFAULT_FEES) -> DataFrame:
    """Pairs whose value date lies in the settlement's window: an equi-join on each day of the window."""
    days = settled.withColumn("value_date", F.explode(window_days(F.col("settled_on"), config.slack_days, fees)))
    return bank.join(days, ["run_id", "value_date"])


def tier1_candidates(bank: DataFrame, settled: DataFrame, drifts: DataFrame | None = None, config: MatchConfig = DEFAULT_CONFIG, fees: FeeModel = DEFAULT_FEES) -> DataFrame:
    """Pairs that pass both gates, with the distance of their references."""
    right = expected_net(settled, drifts, fees).select("run_id", "settlement_id", "expected_net", "settled_on", "utr", "customer_name")
    pairs = in_window(bank.filter("credit_paise > 0").select("run_id", "bank_txn_id", "value_date", "credit_paise", "narration"), right, config, fees)
    pairs = pairs.filter(within_tolerance(F.col("credit_paise"), F.col("expected_net"), config.amount_tolerance, config.amount_tolerance_bps))
    return pairs.select("run_id", "bank_txn_id", "settlement_id", "credit_paise", "expected_net", "narration", "customer_name", references.distance(F.col("narration"), F.col("utr")).alias("distance"))


def tier1_scored(pairs: DataFrame, with_names: bool = True, config: MatchConfig = DEFAULT_CONFIG) -> DataFrame:
    """Pairs with their score, of those that can reach the posting score at all: a near reference is needed for that."""
    near = F.coalesce(F.col("distance") <= config.max_distance, F.lit(False))
    score = F.lit(config.score_gates) + F.when(near, config.score_reference).otherwise(0)
    best_other = config.score_name if with_names else 0
    rows = pairs.withColumn("score", score).filter(F.col("score") + best_other >= config.post_score)
    if with_names:
        rows = rows.withColumn("similarity", name_similarity(F.col("customer_name"), F.col("narration")))
        rows = rows.withColumn("score", F.col("score") + F.when(F.col("similarity") >= config.name_floor, config.score_name).otherwise(0)).drop("similarity")
    return rows.filter(F.col("score") >= config.post_score).select("run_id", "bank_txn_id", "settlement_id", "score")


def tier1_assign(scored: DataFrame) -> DataFrame:
    """One to one: credits in order of their best score and id take their best free settlement; a tie among the free is declined.

    Credits none of whose settlements another credit wants are settled by grouped aggregates; the others go by run.
    """
    wanted = scored.groupBy("run_id", "settlement_id").agg(F.count("*").alias("wanted"))
    marked = scored.join(wanted, ["run_id", "settlement_id"])
    alone = marked.groupBy("run_id", "bank_txn_id").agg((F.max("wanted") == 1).alias("alone"), F.max("score").alias("score"))
    tops = alone.filter("alone").join(scored, ["run_id", "bank_txn_id", "score"]).groupBy("run_id", "bank_txn_id", "score").agg(F.count("*").alias("n"), F.first("settlement_id").alias("settlement_id"))
    free = tops.filter("n = 1").select("run_id", "bank_txn_id", "settlement_id", "score")

    def greedy(run: str, rows: Iterable[tuple]) -> Iterator[tuple]:
        options: dict[str, list[tuple[int, str]]] = {}
        for _, b, s, score in rows:
            options.setdefault(b, []).append((-score, s))
        taken = set()
        for b in sorted(options, key=lambda x: (min(options[x])[0], x)):
            left = sorted(o for o in options[b] if o[1] not in taken)
            if not left or len(left) > 1 and left[0][0] == left[1][0]:
                continue
            taken.add(left[0][1])
            yield run, b, left[0][1], -left[0][0]

    contested = scored.join(alone.filter("not alone").select("run_id", "bank_txn_id"), ["run_id", "bank_txn_id"], "left_semi")
    fought = by_run(contested.select("run_id", "bank_txn_id", "settlement_id", "score"), (), greedy, "run_id string, bank_txn_id string, settlement_id string, score int")
    return as_matches(free.unionByName(fought), 1, "T1-TOLERANT", F.col("score"))


def tier1(bank: DataFrame, settled: DataFrame, drifts: DataFrame | None = None, with_names: bool = True, keep: Keep = as_is) -> DataFrame:
    return tier1_assign(keep(tier1_scored(tier1_candidates(bank, settled, drifts), with_names), "scored"))


# Tier 2


def subset_tolerance(credit: Column, config: MatchConfig = DEFAULT_CONFIG) -> Column:
    return F.greatest(F.lit(config.amount_tolerance).cast("bigint"), apply_rate(credit, config.subset_tolerance_bps))


def pool(bank: DataFrame, settled: DataFrame, config: MatchConfig = DEFAULT_CONFIG, fees: FeeModel = DEFAULT_FEES, ours: tuple = ("narration",), theirs: tuple = ("utr", "customer_name")) -> DataFrame:
    """Settlements that may be part of a credit: in its window, and not above it; ours and theirs: more columns of either side."""
    pairs = in_window(bank.select("run_id", "bank_txn_id", "value_date", "credit_paise", "file_seq", *ours), settled.select("run_id", "settlement_id", "net_amount_paise", "settled_on", *theirs), config, fees)
    return pairs.filter(F.col("net_amount_paise") <= F.col("credit_paise") + subset_tolerance(F.col("credit_paise"), config))


def tier2_decided(bank: DataFrame, settled: DataFrame, config: MatchConfig = DEFAULT_CONFIG) -> DataFrame:
    """The subset search, credit by credit in file order; a match takes its settlements out of later pools."""
    edges = pool(bank.filter("credit_paise > 0"), settled, config, ours=(), theirs=()).withColumn("band", subset_tolerance(F.col("credit_paise"), config))
    edges = edges.select("run_id", "bank_txn_id", "file_seq", "credit_paise", "band", "settlement_id", "net_amount_paise")

    def decide(run: str, rows: Iterable[tuple]) -> Iterator[tuple]:
        taken: set[str] = set()
        for (_, b), group in groupby(rows, itemgetter(2, 1)):
            part = list(group)
            credit, band = part[0][3:5]
            left = [(s, n) for *_, s, n in part if s not in taken]
            if not left:
                continue
            if len(left) > config.pool_cap:
                yield run, b, credit, "POOL_TOO_LARGE", [], [], len(left)
                continue
            solutions, complete = find_subsets(left, credit, band, config.max_members, config.node_budget)
            if not complete:
                yield run, b, credit, "POOL_TOO_LARGE", [], [], len(left)
            elif len(solutions) > 1:
                yield run, b, credit, "AMBIGUOUS_SUBSET", list(solutions[0]), list(solutions[1]), len(left)
            elif solutions:
                taken |= set(solutions[0])
                yield run, b, credit, None, list(solutions[0]), [], len(left)

    return by_run(edges, ("file_seq", "bank_txn_id"), decide, "run_id string, bank_txn_id string, credit_paise bigint, code string, one array<string>, two array<string>, pool_size int")


def tier2(bank: DataFrame, settled: DataFrame, config: MatchConfig = DEFAULT_CONFIG, keep: Keep = as_is) -> tuple[DataFrame, DataFrame]:
    """(matches, exceptions) of the subset search; keep holds what was decided, so that both do not decide it again."""
    found = keep(tier2_decided(bank, settled, config), "tier2")
    matches = found.filter("code is null").select("run_id", "bank_txn_id", F.col("one").alias("settlement_ids"), F.lit(2).alias("tier"), F.lit("T2-SUBSET-SUM").alias("rule_id"), F.lit(9_500).alias("confidence"))
    detail = F.when(F.col("code") == "AMBIGUOUS_SUBSET", F.to_json(F.struct(F.col("one").alias("first"), F.col("two").alias("second")))).otherwise(F.to_json(F.struct("pool_size")))
    exceptions = found.filter("code is not null").select("run_id", "bank_txn_id", "code", F.col("credit_paise").alias("value_at_risk_paise"), detail.alias("detail"), F.lit("tier2").alias("raised_by"))
    return matches, exceptions


# What is left


def sweep(bank: DataFrame, settled: DataFrame, open_bank: DataFrame, raised: DataFrame) -> DataFrame:
    """A code for each open credit without an exception: is there any settlement in its window, claimed or not."""
    silent = open_bank.filter("credit_paise > 0").join(raised.select("run_id", "bank_txn_id"), ["run_id", "bank_txn_id"], "left_anti")
    sizes = pool(silent, settled).groupBy("run_id", "bank_txn_id").agg(F.count("*").alias("pool_size"))
    rows = silent.join(sizes, ["run_id", "bank_txn_id"], "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
    code = F.when(F.col("pool_size") > 0, "NO_CANDIDATE").otherwise("ORPHAN_CREDIT")
    return rows.select("run_id", "bank_txn_id", code.alias("code"), F.col("credit_paise").alias("value_at_risk_paise"), F.to_json(F.struct("pool_size", "narration")).alias("detail"), F.lit("sweep").alias("raised_by"))


def suspected_duplicates(bank: DataFrame) -> DataFrame:
    """Credits alike in amount, day and narration to an earlier row of the run."""
    from pyspark.sql import Window as W

    same = W.partitionBy("run_id", "credit_paise", "value_date", "narration").orderBy("file_seq")
    rows = bank.filter("credit_paise > 0").withColumns({"place": F.row_number().over(same), "first_id": F.first("bank_txn_id").over(same)})
    return rows.filter("place > 1").select("run_id", "bank_txn_id", F.lit("DUPLICATE_SUSPECTED").alias("code"), F.col("credit_paise").alias("value_at_risk_paise"), F.to_json(F.struct(F.col("first_id").alias("duplicates_bank_txn_id"))).alias("detail"), F.lit("ingest").alias("raised_by"))
