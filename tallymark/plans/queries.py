"""One query for each operator, over the ledger derived from sf_dir. Dates and lists come out as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import money, references
from tallymark.functions.calendar import business_days_after
from tallymark.functions.similarity import name_similarity
from tallymark.operators import adjudication, exceptions, provenance, rules, scoring, tiers
from tallymark.plans import cascade, learning
from tallymark.sources import ingest, ledger

Query = Callable[[SparkSession, str], DataFrame]


def text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, arrays of text joined by commas, integers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((c.cast("string") if kind == "date" else F.array_join(c, ",") if kind == "array<string>" else c.cast("bigint") if kind == "int" else c).alias(name))
    return df.select(*out)


def one(matches: DataFrame) -> DataFrame:
    return matches.select("run_id", "bank_txn_id", F.get("settlement_ids", F.lit(0)).alias("settlement_id"), "rule_id")


_loaded: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(credits with their truth, settlements) as tables in the shared folder, derived once for each session and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _loaded:
        settled = cascade.shared(ledger.settlements(spark, d), "settlements")
        _loaded[key] = (cascade.shared(ledger.credits(settled), "bank"), settled)
    return _loaded[key]


def loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(bank, settlements) as the matching stages take them."""
    credits, settled = tables(spark, d)
    return credits.drop("settlement_ids"), settled.drop("k", "r", "i", "decoy")


def known_truth(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[0].select("run_id", "bank_txn_id", "settlement_ids")


def on_ledger(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: text(f(*loaded(spark, d)))


def on_residual(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """After tier 0, whose matches are cut off from their lineage as in the cascade."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        bank, settled = loaded(spark, d)
        return text(f(*tiers.residual(bank, settled, cascade.shared(tiers.tier0(bank, settled), "tier0"))))

    return query


def with_t0(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    return on_ledger(lambda b, s: f(b, s, tiers.tier0(b, s)))


def exception_log(bank: DataFrame) -> DataFrame:
    """Open exceptions by formula, up to three for a credit."""
    codes = F.array(*map(F.lit, ["POOL_TOO_LARGE", "AMOUNT_BEYOND_TOLERANCE", "NO_CANDIDATE", "LLM_INVALID_OUTPUT", "AMBIGUOUS_SUBSET"]))
    rows = bank.withColumn("j", F.explode(F.array(*map(F.lit, range(3))))).filter("j <= file_seq % 3")
    return rows.select(
        "run_id", "bank_txn_id", F.col("credit_paise").alias("value_at_risk_paise"), (F.col("file_seq") * 10 + F.col("j")).alias("exc_seq"), F.concat_ws("-", "run_id", "bank_txn_id", F.col("j").cast("string")).alias("exception_id"),
        F.get(codes, ((F.col("file_seq") + F.col("j")) % 5).cast("int")).alias("code"), F.when(F.col("j") == 1, "tier3").otherwise("tier2").alias("raised_by"),
    )


def raw_bank(bank: DataFrame) -> DataFrame:
    """Text rows with faults by formula; every fifth row twice."""
    n = F.col("file_seq")
    rows = bank.withColumn("z", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("z") == 0) | (n % 5 == 0))
    credit = F.col("credit_paise").cast("string")
    cells = rows.select(
        "run_id", F.lit("bank_statement.csv").alias("file"), (2 * n + F.col("z")).alias("file_seq"), "bank_txn_id", F.when(n % 11 == 3, "soon").otherwise(F.col("value_date").cast("string")).alias("value_date"), "narration",
        F.when(n % 13 == 5, F.concat(F.lit("-"), credit)).otherwise(F.concat(F.lit(" "), credit)).alias("credit_paise"), F.when(n % 17 == 7, "1.5").otherwise("0").alias("debit_paise"), F.lit("0").alias("balance_paise"),
    )
    return cells.withColumn("raw", F.concat_ws(",", "bank_txn_id", "value_date", "narration", "credit_paise", "debit_paise", "balance_paise"))


def scripted(bank: DataFrame, settled: DataFrame) -> DataFrame:
    """(answers, offered): responses by formula about the first member of each pool."""
    pool = tiers.pool(bank, settled)
    first = pool.groupBy("run_id", "bank_txn_id", "file_seq").agg(F.min("settlement_id").alias("s"))
    kind = F.col("file_seq") % 8
    proof = F.lit('[{"field_name":"amount","bank_value":"x","settlement_value":"y","reasoning":"equal"}]')
    answer = lambda sure: F.concat(F.lit('{"decision":"MATCH","matched_settlement_ids":["'), F.col("s"), F.lit('"],"evidence":'), proof, F.lit(f',"confidence":{sure},"unresolved_reason":null}}'))
    response = (
        F.when(kind == 1, "not json")
        .when(kind == 2, F.lit('{"decision":"MATCH","matched_settlement_ids":[],"evidence":[],"confidence":0.9,"unresolved_reason":null}'))
        .when(kind == 3, F.concat(F.lit('{"decision":"MATCH","matched_settlement_ids":["STL99999"],"evidence":'), proof, F.lit(',"confidence":0.9,"unresolved_reason":null}')))
        .when(kind == 4, F.lit('{"decision":"NO_MATCH","matched_settlement_ids":[],"evidence":[],"confidence":0.9,"unresolved_reason":"nothing fits"}'))
        .when(kind == 5, answer(0.5))
        .when(kind == 6, F.concat(F.lit("```json\n"), answer(0.95), F.lit("\n```")))
        .otherwise(answer(0.95))
    )
    return first.select("run_id", "bank_txn_id", response.alias("response")), pool.select("run_id", "bank_txn_id", "settlement_id")


def gates(bank: DataFrame, settled: DataFrame) -> DataFrame:
    answers, offered = scripted(bank, settled)
    return adjudication.gated(answers, bank, settled, offered).select("run_id", "bank_txn_id", "schema_code", "membership_code", "arithmetic_code", "confidence_code", "code")


def replayed(bank: DataFrame, settled: DataFrame) -> DataFrame:
    answers, offered = scripted(bank, settled)
    return adjudication.replay(answers, bank, settled, offered)


def by_hand(bank: DataFrame, settled: DataFrame) -> DataFrame:
    """The first exception of every seventh credit, resolved with some settlement: what else that closes."""
    log = exception_log(bank)
    chosen = bank.filter("file_seq % 7 = 0").select("run_id", F.concat_ws("-", "run_id", "bank_txn_id", F.lit("0")).alias("exception_id"), F.lit("S").alias("settlement_id"))
    return exceptions.resolved_by_hand(log, chosen).select("run_id", "exception_id", "code")


def pair_sums(bank: DataFrame, settled: DataFrame) -> DataFrame:
    """How many single settlements and pairs of a pool add up to its credit."""
    pool = tiers.pool(bank, settled).select("run_id", "bank_txn_id", "credit_paise", "settlement_id", "net_amount_paise")
    single = pool.filter(F.abs(F.col("credit_paise") - F.col("net_amount_paise")) <= 100).select("run_id", "bank_txn_id")
    other = pool.select("run_id", "bank_txn_id", F.col("settlement_id").alias("other"), F.col("net_amount_paise").alias("more"))
    two = pool.join(other, ["run_id", "bank_txn_id"]).filter((F.col("settlement_id") < F.col("other")) & (F.abs(F.col("credit_paise") - F.col("net_amount_paise") - F.col("more")) <= 100))
    return single.union(two.select("run_id", "bank_txn_id")).groupBy("run_id", "bank_txn_id").agg(F.count("*").alias("solutions"))


def cascade_of(which: tuple[int, ...], scripted_answers: bool = False) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        bank, settled = loaded(spark, d)
        proposals = cascade.shared(scripted(bank, settled)[0], "answers") if scripted_answers else None
        return text(cascade.tier_outcomes(cascade.reconcile(bank, settled, which, proposals=proposals)))

    return query


def decisions(bank: DataFrame, settled: DataFrame) -> DataFrame:
    found, raised = tiers.tier2(bank, settled, keep=cascade.shared)
    rows = found.select("run_id", "bank_txn_id", F.lit("POSTED").alias("code"), "settlement_ids")
    return rows.unionByName(raised.select("run_id", "bank_txn_id", "code", F.array().cast("array<string>").alias("settlement_ids")))


def drifted(settled: DataFrame) -> DataFrame:
    names = settled.filter(F.col("customer_name").contains(" TEXTILES ")).select("customer_name").distinct()
    return tiers.expected_net(settled, names.select("customer_name", F.lit(100).alias("drift_bps"))).select("settlement_id", "expected_net")


def prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.grouped(ledger.settlements(spark, d)).filter("k = lead").select("run_id", "settlement_id", "utr", "bank_txn_id")
    rows = rows.join(ledger.bank(spark, d).select("run_id", "bank_txn_id", "narration"), ["run_id", "bank_txn_id"])
    return rows.select("run_id", "settlement_id", rules.glued_prefix(F.col("narration"), F.col("utr")).alias("prefix")).filter("prefix <> ''")


def fee_drifts(settled: DataFrame) -> DataFrame:
    rows = settled.withColumn("credit_paise", F.col("net_amount_paise") - money._div(F.col("gross_amount_paise"), 100))
    return rows.select("settlement_id", rules.fee_drift().alias("drift")).filter("drift is not null")


def promotion(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("utr_prefix", "P1"), ("utr_prefix", "OLD")], "kind string, value string")
    new = ledger.settlements(spark, d).select(F.lit("utr_prefix").alias("kind"), F.concat(F.lit("P"), (F.col("r") % 5).cast("string")).alias("value"))
    return rules.promoted(old, new)


def printed(b: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["bank_txn_id", "value_date", "narration", "credit_paise"]
    return b.select("run_id", "bank_txn_id", ingest.fingerprint(keys).alias("row_sha256")), s.select("run_id", "settlement_id", ingest.fingerprint(["settlement_id", "utr", "net_amount_paise"]).alias("row_sha256"))


def queries() -> dict[str, Query]:
    kept = lambda f, *c: on_ledger(lambda b, s: f(b, s).select(*c))
    queued = lambda b: exceptions.queue(exception_log(b))
    return {
        "ledger_settlements": lambda spark, d: text(ledger.settlements(spark, d).select("run_id", "settlement_id", "invoice_ref", "customer_name", "method", "gross_amount_paise", "fee_paise", "gst_on_fee_paise", "tds_paise", "net_amount_paise", "captured_at", "settled_on", "utr", "status")),
        "ledger_bank": lambda spark, d: text(ledger.bank(spark, d).select("run_id", "bank_txn_id", "value_date", "narration", "credit_paise", "file_seq")),
        "ledger_truth": lambda spark, d: text(ledger.truth(spark, d)),
        "ledger_invoices": lambda spark, d: text(ledger.invoices(spark, d).drop("due_date")),
        "running_balance": kept(lambda b, s: b, "run_id", "bank_txn_id", "balance_paise"),
        "fee_breakdown": on_ledger(lambda b, s: s.select("settlement_id", *[c.alias(n) for n, c in zip(("fee_paise", "gst_on_fee_paise", "tds_paise", "net"), money.breakdown(F.col("gross_amount_paise"), F.col("method")).values())])),
        "business_day_window": on_ledger(lambda b, s: s.select("settled_on", business_days_after(F.col("settled_on"), 3).alias("latest")).distinct()),
        "row_fingerprint": on_ledger(lambda b, s: printed(b, s)[0]),
        "ingest_dedupe": on_ledger(lambda b, s: ingest.ingest(raw_bank(b), "bank")["loaded"].select("run_id", "file_seq", "bank_txn_id")),
        "ingest_quarantine": on_ledger(lambda b, s: ingest.ingest(raw_bank(b), "bank")["quarantine"].select("run_id", "file_seq", "error")),
        "load_report": on_ledger(lambda b, s: ingest.ingest(raw_bank(b), "bank")["report"]),
        "duplicate_suspected": on_ledger(lambda b, s: tiers.suspected_duplicates(b).select("run_id", "bank_txn_id", "value_at_risk_paise", F.get_json_object("detail", "$.duplicates_bank_txn_id").alias("duplicates"))),
        "utr_normalise": on_ledger(lambda b, s: b.select("run_id", "bank_txn_id", references.normalise(F.col("narration")).alias("said"))),
        "utr_candidates": on_ledger(lambda b, s: tiers.bank_tokens(b).select("run_id", "bank_txn_id", "token")),
        "uniqueness_guard": on_ledger(lambda b, s: tiers.unique_by(tiers.bank_tokens(b), ["run_id", "token"], "bank_txn_id")),
        "t0_reference": on_ledger(lambda b, s: one(tiers.tier0_reference(b, s))),
        "t0_amount_date": with_t0(lambda b, s, m: one(m.filter("rule_id = 'T0-AMOUNT-DATE-UNIQUE'"))),
        "t0_all": with_t0(lambda b, s, m: one(m)),
        "residual_after_t0": on_residual(lambda b, s: b.select("run_id", F.col("bank_txn_id").alias("id"), F.lit("bank").alias("side")).union(s.select("run_id", "settlement_id", F.lit("settlement")))),
        "t1_expected_net": on_residual(lambda b, s: tiers.expected_net(s).select("run_id", "settlement_id", "expected_net")),
        "t1_fee_override": on_ledger(lambda b, s: drifted(s)),
        "t1_candidates": on_residual(lambda b, s: tiers.tier1_candidates(b, s).select("run_id", "bank_txn_id", "settlement_id", "credit_paise", "expected_net", "distance")),
        "t1_scored": on_residual(lambda b, s: tiers.tier1_scored(tiers.tier1_candidates(b, s), with_names=False)),
        "t1_uncontested": on_residual(lambda b, s: uncontested(tiers.tier1_scored(tiers.tier1_candidates(b, s), with_names=False))),
        "t1_assign": on_residual(lambda b, s: one(tiers.tier1(b, s))),
        "t1_name_similarity": on_residual(lambda b, s: tiers.tier1_candidates(b, s).select("run_id", "bank_txn_id", "settlement_id", name_similarity(F.col("customer_name"), F.col("narration")).alias("similarity"))),
        "t2_pool": on_residual(lambda b, s: tiers.pool(b, s).select("run_id", "bank_txn_id", "settlement_id", "net_amount_paise")),
        "t2_pool_stats": on_residual(lambda b, s: tiers.pool(b, s).groupBy("run_id", "bank_txn_id").agg(F.count("*").alias("pool_size"), F.sum("net_amount_paise").alias("pool_paise"), (F.count("*") > 25).alias("too_large"))),
        "t2_pairs": on_residual(pair_sums),
        "t2_decisions": on_residual(decisions),
        "t3_rank_candidates": on_residual(lambda b, s: adjudication.ranked(b, s, with_names=False).select("run_id", "bank_txn_id", "settlement_id", "place")),
        "t3_prompts": on_residual(lambda b, s: adjudication.prompts(b, adjudication.ranked(b, s, with_names=False), s)),
        "t3_gates": on_residual(gates),
        "sweep_codes": with_t0(lambda b, s, m: tiers.sweep(b, s, tiers.residual(b, s, m)[0], b.limit(0)).select("run_id", "bank_txn_id", "code", F.get_json_object("detail", "$.pool_size").cast("bigint").alias("pool_size"))),
        "exception_queue": on_ledger(lambda b, s: queued(b).drop("suggested_action", "counterparty")),
        "exception_clusters": on_ledger(lambda b, s: exceptions.clusters(queued(b)).drop("diagnosis", "counterparties")),
        "exception_actions": on_ledger(lambda b, s: exceptions.clusters(queued(b)).select("run_id", "code", "diagnosis")),
        "exceptions_by_code": on_ledger(lambda b, s: exceptions.by_code(queued(b))),
        "supersede": with_t0(lambda b, s, m: exceptions.superseded(exception_log(b), m).select("run_id", "exception_id", "code")),
        "queue_top": on_ledger(lambda b, s: exceptions.in_order(queued(b), 20).select("bank_txn_id", "value_at_risk_paise")),
        "score_t0": lambda spark, d: with_t0(lambda b, s, m: scoring.score(m, ledger.truth(spark, d), b))(spark, d),
        "score_by_run": lambda spark, d: with_t0(lambda b, s, m: scoring.score(m, ledger.truth(spark, d), b, ("run_id",)))(spark, d),
        "rule_prefix": lambda spark, d: text(prefixes(spark, d)),
        "rule_fee_drift": on_ledger(lambda b, s: fee_drifts(s)),
        "rule_promote": lambda spark, d: promotion(spark, d),
        "provenance_join": with_t0(lambda b, s, m: provenance.source_fingerprints(m, *printed(b, s)).select("run_id", "bank_txn_id", "fingerprints")),
        "provenance_sample": with_t0(lambda b, s, m: provenance.sample_by_tier(m, 3).select("run_id", "bank_txn_id", "rule_id")),
        "run_summary": with_t0(lambda b, s, m: provenance.run_summary(b, m, queued(b)).drop("llm_assisted")),
        "tier_outcomes_t0": with_t0(lambda b, s, m: m.groupBy("run_id").agg(F.count("*").alias("matched_credits"), F.sum(F.size("settlement_ids")).alias("matched_settlements"))),
        "paise_format": on_ledger(lambda b, s: b.select("bank_txn_id", money.format_rupees(F.col("credit_paise")).alias("plain"), money.format_lakh(F.col("credit_paise")).alias("grouped"))),
        "paise_parse": on_ledger(lambda b, s: b.select("bank_txn_id", money.parse_rupees(money.format_lakh(F.col("credit_paise"))).alias("paise"))),
        "cascade_outcomes": cascade_of((0, 1, 2)),
        "cascade_with_answers": cascade_of((0, 1, 2, 3), True),
        "ablation_arms": lambda spark, d: text(cascade.ablation(*loaded(spark, d), known_truth(spark, d), proposals=cascade.shared(scripted(*loaded(spark, d))[0], "answers"))),
        "t3_replay": on_residual(lambda b, s: replayed(b, s).select("run_id", "bank_txn_id", "schema", "membership", "arithmetic", "confidence", "verdict")),
        "replay_examples": on_residual(lambda b, s: adjudication.examples(replayed(b, s), 6).select("run_id", "bank_txn_id", "verdict", "place")),
        "match_evidence": with_t0(lambda b, s, m: provenance.recorded(m, b, s, *printed(b, s), model="m", prompt_version="v").select("run_id", "bank_txn_id", "evidence", "model", "prompt_version", F.size("fingerprints").alias("prints"))),
        "score_stored_run": lambda spark, d: on_ledger(lambda b, s: scoring.score_run(tiers.tier0(b, s), exception_log(b), ledger.truth(spark, d), b)[0])(spark, d),
        "open_codes": lambda spark, d: on_ledger(lambda b, s: scoring.score_run(tiers.tier0(b, s), exception_log(b), ledger.truth(spark, d), b)[1])(spark, d),
        "resolution_closes": on_ledger(by_hand),
        "superseded_in_cascade": on_ledger(lambda b, s: cascade.reconcile(b, s).resolutions().select("run_id", "bank_txn_id", "code", "resolution")),
        "rule_lift": lambda spark, d: text(learning.lift(*loaded(spark, d), known_truth(spark, d))),
        "call_estimate": on_ledger(learning.call_estimate),
    }


def uncontested(scored: DataFrame) -> DataFrame:
    """Credits with one settlement that nobody else wants."""
    wanted = scored.groupBy("run_id", "settlement_id").agg(F.count("*").alias("wanted"))
    rows = scored.join(wanted, ["run_id", "settlement_id"]).groupBy("run_id", "bank_txn_id").agg(F.max("wanted").alias("w"), F.count("*").alias("n"), F.min("settlement_id").alias("settlement_id"))
    return rows.filter("w = 1 and n = 1").select("run_id", "bank_txn_id", "settlement_id")
