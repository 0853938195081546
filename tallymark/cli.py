"""python -m tallymark.cli: generate, reconcile, exceptions, resolve, evaluate, report."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import adjudication, exceptions, provenance, rules, scoring
from tallymark.operators import tiers as operators
from tallymark.operators.tiers import EXCEPTION, MATCH
from tallymark.plans import cascade, learning, report
from tallymark.sources import fixtures, ingest, model, rule_file
from tallymark.sources.store import Store, current_exceptions, with_ids


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    bank, settled, links = fixtures.batches(spark, a.profile, a.n, [a.seed])
    bank = bank.withColumns({"debit_paise": F.lit(0), "balance_paise": F.lit(0)})
    invoices = settled.select(F.col("invoice_ref").alias("invoice_id"), F.lit("MERCH001").alias("merchant_id"), F.lit("CUST001").alias("customer_id"), "customer_name", F.col("gross_amount_paise").alias("invoice_amount_paise"), F.lit("INR").alias("currency"), F.col("captured_at").alias("issue_date"), F.col("captured_at").alias("due_date"), F.lit("raised").alias("status"))
    ingest.write_csv(bank, f"{a.out}/{ingest.FILES['bank']}", ["file_seq"], list(ingest.SHAPES["bank"]))
    ingest.write_csv(settled, f"{a.out}/{ingest.FILES['settlements']}", ["settlement_id"], list(ingest.SHAPES["settlements"]))
    ingest.write_csv(invoices, f"{a.out}/{ingest.FILES['invoices']}", ["invoice_id"], list(ingest.SHAPES["invoices"]))
    ingest.write_csv(links, f"{a.out}/truth_links.csv", ["bank_txn_id", "settlement_id"], ["bank_txn_id", "settlement_id", "invoice_id", "link_type", "chaos_tags"])


def reconcile(spark: SparkSession, a: argparse.Namespace) -> None:
    tiers = cascade.parse_tiers(a.tiers)
    store = Store(spark, a.store)
    store.start_run(a.run, a.tiers, now())
    loaded = ingest.load_batch(spark, a.folder, a.run)
    for kind, parts in loaded.items():
        store.append(kind, parts["loaded"])
        store.append("quarantine", parts["quarantine"].withColumn("kind", F.lit(kind)))
    bank, settled = store.read("bank", a.run), store.read("settlements", a.run)
    known = learning.applied(rule_file.load(spark, a.rules)) if a.rules else {}
    proposals = None
    if 3 in tiers and a.cache:
        proposals = answered(spark, bank, settled, tiers, known, a)
    out = cascade.reconcile(bank, settled, tiers, proposals=proposals, **known)
    prints = bank.select("run_id", "bank_txn_id", "row_sha256"), settled.select("run_id", "settlement_id", "row_sha256")
    store.append("matches", provenance.recorded(out.matches, bank, settled, *prints, model=a.model, prompt_version=adjudication.PROMPT_VERSION))
    store.append("exceptions", with_ids(out.exceptions))
    store.append("resolutions", out.resolutions())
    store.finish_run(a.run, tiers, not out.exceptions.filter("code = 'MODEL_UNAVAILABLE'").isEmpty(), now())
    cascade.tier_outcomes(out).orderBy("tier").show()


def answered(spark: SparkSession, bank: DataFrame, settled: DataFrame, tiers: tuple[int, ...], known: dict, a: argparse.Namespace) -> DataFrame:
    """Answers for the credits that the earlier tiers leave: from the cache, and for the rest from the endpoint, if one is given."""
    first = cascade.reconcile(bank, settled, tuple(t for t in tiers if t < 3), **known) if tiers != (3,) else None
    left, free = (bank, settled) if first is None else operators.residual(bank, settled, first.matches, first.exceptions.filter("code = 'AMBIGUOUS_SUBSET'"))
    prompts = cascade.shared(adjudication.prompts(left, adjudication.ranked(left, free), free), "prompts")
    adapter = model.Patient(model.HttpAdapter(a.model, a.endpoint)) if a.endpoint else None
    name = adjudication.model_of_record(adapter, a.model)
    _, misses = model.looked_up(prompts, model.cached_answers(spark, a.cache), name)
    model.ask(misses, adapter, a.cache)
    return model.looked_up(prompts, model.cached_answers(spark, a.cache), name)[0]


def open_of(store: Store, run: str) -> DataFrame:
    rows = store.held("exceptions", f"{EXCEPTION}, exception_id string, exc_seq bigint", run)
    return current_exceptions(rows, store.read("resolutions", run))


def resolve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Close an exception and all other open ones of its credit; with --rules, keep what that teaches."""
    store = Store(spark, a.store)
    chosen = spark.createDataFrame([(a.run, a.exception, a.settlement)], "run_id string, exception_id string, settlement_id string")
    done, taught = learning.resolve(open_of(store, a.run), store.held("bank", learning_schema("bank"), a.run), store.held("settlements", learning_schema("settlements"), a.run), chosen)
    done, taught = cascade.shared(done, "resolved"), cascade.shared(taught, "taught")
    store.append("resolutions", done)
    store.append("promoted", taught)
    if a.rules:
        rule_file.save(cascade.shared(rules.promoted(rule_file.load(spark, a.rules), taught), "rules"), a.rules)
    done.show(truncate=False)
    taught.show(truncate=False)


def learning_schema(kind: str) -> str:
    return "run_id string, " + ", ".join(f"{c} {t}" for c, t in ingest.SHAPES[kind].items())


def show(spark: SparkSession, a: argparse.Namespace) -> None:
    queued = exceptions.queue(open_of(Store(spark, a.store), a.run))
    exceptions.in_order(queued, a.limit).show(truncate=False)
    exceptions.clusters(queued).orderBy(F.desc("value_at_risk_paise"), "code").show(truncate=False)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    bank, settled, links = fixtures.batches(spark, a.profile, a.n, list(range(a.seed, a.seed + a.batches)))
    truth = scoring.truth_from_links(links)
    print(report.summary_markdown(cascade.ablation(bank, settled, truth), a.profile))
    r = learning.lift(bank, settled, truth).first()
    print(f"{r['rules']} rules: {report.percent(r['auto_match_before'])} to {report.percent(r['auto_match_after'])}")


def write_page(spark: SparkSession, a: argparse.Namespace) -> None:
    store = Store(spark, a.store)
    out = cascade.Outcome(store.read("bank", a.run), store.read("settlements", a.run), store.held("matches", MATCH, a.run), store.held("exceptions", EXCEPTION, a.run))
    Path(a.out).write_text(report.page(report.payload(out, a.run)), encoding="utf-8")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallymark")
    sub = p.add_subparsers(required=True)
    for name, f, options in (
        ("generate", generate, {"--profile": "adversarial", "--n": 250, "--seed": 42, "--out": "fixture"}),
        ("reconcile", reconcile, {"--folder": "fixture", "--store": "store", "--run": "run1", "--tiers": "0,1,2", "--rules": "", "--cache": "", "--endpoint": "", "--model": "none"}),
        ("exceptions", show, {"--store": "store", "--run": "run1", "--limit": 20}),
        ("resolve", resolve, {"--store": "store", "--run": "run1", "--exception": "", "--settlement": "", "--rules": ""}),
        ("evaluate", evaluate, {"--profile": "adversarial", "--n": 250, "--seed": 42, "--batches": 1}),
        ("report", write_page, {"--store": "store", "--run": "run1", "--out": "report.html"}),
    ):
        q = sub.add_parser(name)
        q.set_defaults(run_it=f)
        for option, default in options.items():
            q.add_argument(option, default=default, type=type(default))
    a = p.parse_args(argv)
    a.run_it(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
