"""The cascade over runs, and what it reports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.config import CODES
from tallymark.operators import exceptions as queueing
from tallymark.operators import tiers
from tallymark.sources.store import current_exceptions, with_ids


def shared(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage between tiers: a table in the folder of spark.checkpoint.dir, or a local one where it is unset and Spark runs in this process."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parse_tiers(text: str) -> tuple[int, ...]:
    """"0,1,2" to tiers in order; blanks are ignored, anything but 0 to 3 or nothing at all is an error."""
    found = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part not in ("0", "1", "2", "3"):
            raise ValueError(f"no such tier: {part}")
        found.add(int(part))
    if not found:
        raise ValueError("no tier given")
    return tuple(sorted(found))


@dataclass(frozen=True)
class Outcome:
    bank: DataFrame
    settled: DataFrame
    matches: DataFrame
    exceptions: DataFrame

    def resolutions(self) -> DataFrame:
        """Exceptions of an earlier tier whose credit a later one matched, of the codes that a match may close."""
        return queueing.superseded(with_ids(self.exceptions), self.matches)

    def open_exceptions(self) -> DataFrame:
        """The exceptions, with their ids, that no match supersedes."""
        return current_exceptions(with_ids(self.exceptions), self.resolutions())


def closing(exceptions: DataFrame) -> DataFrame:
    """Those after which no later tier may take the credit."""
    return exceptions.filter(F.col("code").isin(*[c for c, x in CODES.items() if x.terminal]))


def advance(bank: DataFrame, settled: DataFrame, tier: int, matches: DataFrame, exceptions: DataFrame, prefixes: tuple[str, ...] = (), drifts: DataFrame | None = None, proposals: DataFrame | None = None, with_names: bool = True, keep: tiers.Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, exceptions) with those of one more tier, which sees what they leave."""
    from tallymark.operators import adjudication

    keep = keep or shared
    left, free = tiers.residual(bank, settled, matches, closing(exceptions))
    raised = None
    if tier == 0:
        new = keep(tiers.tier0(left, free, prefixes, keep), "tier0")
    elif tier == 1:
        new = keep(tiers.tier1(left, free, drifts, with_names, keep), "tier1")
    elif tier == 2:
        new, raised = tiers.tier2(left, free, keep=keep)
    else:
        new, raised = adjudication.tier3(left, free, proposals, keep=keep)
    return matches.unionByName(new), exceptions if raised is None else exceptions.unionByName(raised)


def unmatched(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, exceptions) before any tier."""
    return bank.sparkSession.createDataFrame([], tiers.MATCH), tiers.suspected_duplicates(bank)


def reconcile(bank: DataFrame, settled: DataFrame, which: tuple[int, ...] = (0, 1, 2), prefixes: tuple[str, ...] = (), drifts: DataFrame | None = None, proposals: DataFrame | None = None, with_names: bool = True, cut: bool = True) -> Outcome:
    """Run tiers in order, each on what earlier ones left, then sweep.

    proposals(run_id, bank_txn_id, response): cached answers for tier 3; without them its credits are MODEL_UNAVAILABLE.
    """
    matches, exceptions = unmatched(bank)
    for tier in sorted(which):
        matches, exceptions = advance(bank, settled, tier, matches, exceptions, prefixes, drifts, proposals, with_names, shared if cut else tiers.as_is)
    # Matched or closed credits are not swept; those with an exception have had their say.
    left, _ = tiers.residual(bank, settled, matches, closing(exceptions))
    return Outcome(bank, settled, matches, exceptions.unionByName(tiers.sweep(bank, settled, left, exceptions)))


def tier_outcomes(out: Outcome) -> DataFrame:
    """By run and tier: credits and settlements matched, and exceptions raised."""
    won = out.matches.groupBy("run_id", "tier").agg(F.count("*").alias("matched_credits"), F.sum(F.size("settlement_ids")).alias("matched_settlements"))
    tier = F.regexp_extract("raised_by", "^tier([0-3])$", 1).try_cast("int")
    raised = out.exceptions.filter(tier.isNotNull()).groupBy("run_id", tier.alias("tier")).agg(F.count("*").alias("exceptions_raised"), F.count_if(F.col("code") == "MODEL_UNAVAILABLE").alias("model_unavailable"))
    rows = won.join(raised, ["run_id", "tier"], "full_outer")
    return rows.select("run_id", "tier", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched_credits", "matched_settlements", "exceptions_raised", "model_unavailable")])


def run_report(out: Outcome) -> DataFrame:
    """By run: credits, matched, exceptions and what is left; a credit closed by an exception is not counted as left."""
    closed = out.exceptions.filter(F.col("code").isin(*[c for c, x in CODES.items() if x.terminal]))
    left, free = tiers.residual(out.bank, out.settled, out.matches, closed)
    parts = [
        out.bank.groupBy("run_id").agg(F.count("*").alias("bank_rows")),
        out.matches.groupBy("run_id").agg(F.count("*").alias("matches")),
        out.open_exceptions().groupBy("run_id").agg(F.count("*").alias("exceptions"), F.count_if(F.col("code") == "MODEL_UNAVAILABLE").alias("unanswered")),
        left.groupBy("run_id").agg(F.count("*").alias("unmatched_bank")),
        free.groupBy("run_id").agg(F.count("*").alias("unmatched_settlements")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.join(part, "run_id", "left")
    return rows.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bank_rows", "matches", "exceptions", "unmatched_bank", "unmatched_settlements")], (F.coalesce("unanswered", F.lit(0)) > 0).alias("degraded"))


ARMS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (3,))


def ablation(bank: DataFrame, settled: DataFrame, truth: DataFrame, arms: tuple[tuple[int, ...], ...] = ARMS, proposals: DataFrame | None = None, with_names: bool = True) -> DataFrame:
    """The scores of each set of tiers over the same ledger; an arm with a credit that no model answered is not measured: its figures are null.

    Arms that begin with the same tiers share what these left, so each tier runs once after the same others.
    """
    from functools import reduce

    from tallymark.operators.scoring import score

    states = {(): unmatched(bank)}
    rows = []
    for arm in map(tuple, map(sorted, arms)):
        for k in range(len(arm)):
            if arm[: k + 1] not in states:
                states[arm[: k + 1]] = advance(bank, settled, arm[k], *states[arm[:k]], proposals=proposals, with_names=with_names)
        matches, exceptions = states[arm]
        missing = exceptions.filter("code = 'MODEL_UNAVAILABLE'").agg((F.count("*") == 0).alias("measured"))
        scored = score(matches, truth, bank).crossJoin(missing)  # one row each
        figures = [F.when(F.col("measured"), F.col(c)).alias(c) for c in scored.columns if c != "measured"]
        rows.append(scored.select(F.lit("T" + "+T".join(map(str, arm))).alias("arm"), *figures, "measured"))
    return reduce(DataFrame.unionByName, rows)
