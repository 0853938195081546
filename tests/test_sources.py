import json

import pytest
from pyspark.sql import functions as F

from tallymark import cli
from tallymark.operators import adjudication, scoring, tiers
from tallymark.plans import cascade, report
from tallymark.sources import fixtures, ingest, model
from tallymark.sources.store import Store
from tallymark.streaming.ingest_stream import stream_bank

HEAD = "bank_txn_id,value_date,narration,credit_paise,debit_paise,balance_paise\n"


def test_csv_rows_are_fingerprinted_deduplicated_and_quarantined(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEAD + 'B1,2026-08-10,"NEFT/a,b",100,0,5\nB1,2026-08-10,"NEFT/a,b", 100 ,0,5\nB2,2026-13-10,x,1,0,0\nB3,2026-08-10,,5,-1,0\n\nB4,2026-08-11,y,0,0,1\n', encoding="utf-8")
    rows = ingest.scan_csv(spark, str(tmp_path / "b.csv"), list(ingest.SHAPES["bank"]), "R")
    found = ingest.ingest(rows, "bank")
    assert [(r.bank_txn_id, r.narration, r.credit_paise) for r in found["loaded"].orderBy("file_seq").collect()] == [("B1", "NEFT/a,b", 100), ("B4", "y", 0)]
    assert [r.error for r in found["quarantine"].orderBy("file_seq").collect()] == ["value_date: not valid", "debit_paise: not valid"]
    r = found["report"].first()
    assert (r.inserted, r.skipped, r.quarantined) == (2, 1, 2)
    again = ingest.ingest(rows, "bank", seen=found["loaded"])
    assert again["loaded"].count() == 0
    forged = spark.createDataFrame([("a", "b\x1fc"), ("a\x1fb", "c")], "x string, y string").select(ingest.fingerprint(["x", "y"]).alias("h"))
    assert forged.distinct().count() == 2


def test_store_refuses_a_run_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("bank") is None and not store.run_exists("R")
    store.start_run("R", "0,1", "2026-01-01T00:00:00")
    store.finish_run("R", (0, 1), False, "2026-01-01T00:00:00")
    with pytest.raises(ValueError):
        store.start_run("R", "0", "2026-01-01T00:00:01")
    assert [r.state for r in store.runs().collect()] == ["finished"]
    with pytest.raises(ValueError):
        ingest.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_stream_adds_each_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for k, body in enumerate(["B1,2026-08-10,x,1,0,0\nB2,bad,x,1,0,0\n", "B1,2026-08-10,x,1,0,0\nB3,2026-08-10,x,1,0,0\n"]):
        (tmp_path / "in" / f"{k}.csv").write_text(HEAD + body)
        stream_bank(spark, str(tmp_path / "in"), store, "R", str(tmp_path / "check")).awaitTermination()
    assert sorted(r.bank_txn_id for r in store.read("bank").collect()) == ["B1", "B3"] and store.read("quarantine").count() == 1


def test_batches_follow_their_seed_and_truth(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    one, two = fixtures.batches(spark, "adversarial", 60, [7, 8]), fixtures.batches(spark, "adversarial", 60, [7])
    for both, alone in zip(one, two):
        assert rows(both.filter("run_id = 'adversarial-7'")) == rows(alone) and rows(both.filter("run_id = 'adversarial-8'")) != rows(alone)
    bank, world, links = one
    assert bank.filter("bank_txn_id like 'BNKORPH%'").count() == 4 and bank.filter("bank_txn_id = 'BNKDUP001'").count() == 2
    nets = {(r.run_id, r.settlement_id): r.net_amount_paise for r in world.collect()}
    told = {}
    for r in links.filter("settlement_id <> ''").collect():
        told.setdefault((r.run_id, r.bank_txn_id), []).append(nets[r.run_id, r.settlement_id])
    credits = {(r.run_id, r.bank_txn_id): r.credit_paise for r in bank.collect()}
    assert all(abs(credits[key] - sum(parts)) <= 3 and len(parts) <= 3 for key, parts in told.items())
    for run in ("adversarial-7", "adversarial-8"):  # the decoys: two credits of two settlements with one sum
        sums = [credits[key] for key, parts in told.items() if key[0] == run and len(parts) == 2]
        assert any(abs(x - y) <= 6 for k, x in enumerate(sums) for y in sums[:k])
    easy = fixtures.batches(spark, "easy", 60, [7])
    assert easy[0].count() == easy[1].count() == 60 and easy[2].filter("link_type <> 'one_to_one' or chaos_tags <> ''").count() == 0
    with pytest.raises(KeyError):
        fixtures.batches(spark, "unknown", 10, [1])


def test_easy_batches_are_matched_and_nothing_wrong_is_posted(spark):
    bank, settled, links = (x.cache() for x in fixtures.batches(spark, "easy", 60, [1, 2]))
    arms = {r.arm: r for r in cascade.ablation(bank, settled, scoring.truth_from_links(links), ((0,), (0, 1, 2))).collect()}
    assert arms["T0"].false_match == 0 and arms["T0+T1+T2"].auto_match >= arms["T0"].auto_match > 900_000
    text = report.metrics_markdown(spark.createDataFrame([arms["T0"]]))
    assert text.startswith("| arm |") and "%" in text
    assert report.spliced("a<!-- m:begin -->x<!-- m:end -->b", "new\n", "m") == "a<!-- m:begin -->\nnew\n<!-- m:end -->b"
    with pytest.raises(ValueError):
        report.spliced("a", "b", "m")
    assert report.grouped(275436513) == "₹27,54,365.13" and report.grouped(-5) == "-₹0.05"


def test_command_line_round(spark, tmp_path):
    at = str(tmp_path)
    cli.main(["generate", "--profile", "realistic", "--n", "40", "--out", f"{at}/f"])
    cli.main(["reconcile", "--folder", f"{at}/f", "--store", f"{at}/s", "--run", "<r>"])
    cli.main(["report", "--store", f"{at}/s", "--run", "<r>", "--out", f"{at}/r.html"])
    page = (tmp_path / "r.html").read_text()
    assert "<r>" not in page and "&lt;r&gt;" in page and "http" not in page
    store = Store(spark, f"{at}/s")
    kept = store.read("matches")
    assert kept.filter("evidence is null or size(fingerprints) < 2 or model is not null").isEmpty()
    held = store.read("exceptions")
    open_rows = [] if held is None else held.orderBy("exc_seq").collect()
    if open_rows:
        settlement = store.read("settlements").first()["settlement_id"]
        cli.main(["resolve", "--store", f"{at}/s", "--run", "<r>", "--exception", open_rows[0]["exception_id"], "--settlement", settlement, "--rules", f"{at}/rules.yaml"])
        assert open_rows[0]["exception_id"] in {r.exception_id for r in store.read("resolutions").collect()}
    assert store.read("matches").count() > 0 and store.held("quarantine", "run_id string").count() == 0


def test_cached_answers_are_not_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([("R", "B1", 'say "é" 1'), ("R", "B2", "two")], "run_id string, bank_txn_id string, prompt string")
    empty = spark.createDataFrame([], "key string, response string")
    adapter = model.Scripted(["one", "two"])
    _, misses = model.looked_up(prompts, empty, adapter.name)
    assert model.ask(misses, adapter, str(tmp_path / "c")) == 2 and len(adapter.asked) == 2
    answers, misses = model.looked_up(prompts, model.cached_answers(spark, str(tmp_path / "c")), adapter.name)
    assert {r.bank_txn_id: r.response for r in answers.collect()} == {"B1": "one", "B2": "two"} and misses.count() == 0
    assert json.loads(next((tmp_path / "c").glob("*.json")).read_text())["key"]
    assert adjudication.cost_estimate(prompts).first().calls == 2
    slept = []

    class Broken:
        name = "broken"

        def complete(self, prompt):
            raise OSError("503")

    with pytest.raises(model.Unavailable):
        model.Patient(Broken(), tries=3, clock=lambda: 0.0, sleep=slept.append).complete("x")
    assert slept[:1] == [2] and 4 in slept
