import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.config import CODES, HOLIDAYS
from tallymark.functions import calendar, money, references
from tallymark.functions.similarity import name_score, token_set_ratio
from tallymark.operators import adjudication, exceptions, rules, scoring, tiers
from tallymark.operators.subsets import find_subsets
from tallymark.plans import cascade, learning, report
from tallymark.sources import rule_file

BANK = "run_id string, bank_txn_id string, value_date date, narration string, credit_paise bigint, file_seq bigint"
SETTLED = "run_id string, settlement_id string, customer_name string, method string, gross_amount_paise bigint, fee_paise bigint, gst_on_fee_paise bigint, tds_paise bigint, net_amount_paise bigint, settled_on date, utr string, status string"
DAY = date(2026, 8, 10)


def bank(spark, *rows):
    """rows: (id, credit, narration, day offset)."""
    return spark.createDataFrame([("R", i, DAY + timedelta(d), n, c, k) for k, (i, c, n, d) in enumerate(rows)], BANK)


def settled(spark, *rows):
    """rows: (id, method, gross, net, utr, name, day offset)."""
    return spark.createDataFrame([("R", i, name, m, g, 0, 0, 0, n, DAY + timedelta(d), u, "captured") for i, m, g, n, u, name, d in rows], SETTLED)


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money(spark):
    lit = lambda x: F.lit(x).cast("bigint")
    assert value(spark, money.apply_rate(lit(10_000_000), 200), money.apply_rate(lit(1), 5_000), money.apply_rate(lit(-1), 5_000), money.apply_rate(lit(123_456), 0)) == (200_000, 1, -1, 0)
    parts = money.breakdown(lit(100_000), F.lit("credit_card"))
    assert value(spark, *parts.values()) == (2_000, 360, 100, 97_540)
    assert value(spark, money.mdr_fee(lit(100_000_000), F.lit("debit_card")), money.mdr_fee(lit(500), F.lit("netbanking"))) == (100_000, 1_800)
    good = {"₹1,23,456.78": 12_345_678, "-5": -500, "0.5": 50, "12.30": 1_230}
    bad = ["", "abc", "12.345", "1.2.3", "12.", None]
    assert value(spark, *[money.parse_rupees(F.lit(t)) for t in good]) == tuple(good.values())
    assert value(spark, *[money.parse_rupees(F.lit(t).cast("string")) for t in bad]) == (None,) * len(bad)
    assert value(spark, money.format_lakh(lit(275436513)), money.format_lakh(lit(99_900)), money.format_rupees(lit(-5))) == ("₹27,54,365.13", "₹999.00", "-0.05")
    with pytest.raises(Exception, match="negative rate"):
        value(spark, money.apply_rate(lit(1), lit(-1)))


def test_business_days(spark):
    def after(day, n):
        while n:
            day += timedelta(1)
            n -= day.weekday() < 5 and day not in HOLIDAYS
        return day

    days = [date(2026, 8, 1) + timedelta(k) for k in range(90)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (0, 1, 2, 3, 11):
        assert [r.x for r in df.select("d", calendar.business_days_after(F.col("d"), n).alias("x")).orderBy("d").collect()] == [after(d, n) for d in days]
    with pytest.raises(ValueError):
        calendar.business_days_after(F.col("d"), -1)


def test_references(spark):
    cases = {"rzrpy3-482986": "RZRPY3482986", "NEFTRZRPY3482986": "RZRPY3482986", "CR123456": "CR123456", "NEFTCRRZRPY3482986": "RZRPY3482986"}
    assert value(spark, *[references.normalise(F.lit(x)) for x in cases]) == tuple(cases.values())
    assert value(spark, references.candidates(F.lit("NEFT-CR/HDFC/ACME RETAIL PVT/BLR")), references.candidates(F.lit("upi/cr/rzrpy1234567|RZRPY1234567"))) == ([], ["RZRPY1234567"])
    assert value(spark, references.distance(F.lit("NEFT/RZRPY12345/X"), F.lit("RZRPY1234567")), references.distance(F.lit("NEFT-CR/ACME/BLR"), F.lit("RZRPY1234567"))) == (2, None)
    assert value(spark, references.normalise(F.lit("MMTCRRZRPY1234567"), ("MMTCR",))) == ("RZRPY1234567",)


def test_names():
    assert token_set_ratio("ACME RETAIL PVT LTD", "ACME RETAIL") == 100
    assert name_score("ACME RETAIL PVT LTD", "NEFT/x/acme retail pvt/BLR") == 100
    assert name_score("", "a/b") == 0 and name_score("ACME", "") == 0
    assert token_set_ratio("abc", "abd") == pytest.approx(200 / 3)


def test_tier0(spark):
    b = bank(spark, ("B1", 10_000, "NEFT/RZRPY1234567/A/BLR", 0), ("B2", 500, "NEFT/none/BLR", 0), ("B3", 700, "NEFT/RZRPY7777777/A", 0), ("B4", 700, "NEFT/RZRPY7777777/A", 0))
    s = settled(spark, ("S1", "upi", 10_000, 10_000, "RZRPY1234567", "A", 0), ("S2", "upi", 500, 500, None, "B", 0), ("S3", "upi", 700, 700, "RZRPY7777777", "C", 0))
    found = {r.bank_txn_id: (r.settlement_ids, r.rule_id) for r in tiers.tier0(b, s).collect()}
    assert found == {"B1": (["S1"], "T0-UTR-EXACT"), "B2": (["S2"], "T0-AMOUNT-DATE-UNIQUE")}


def test_tier1_scores_and_ties(spark):
    b = bank(spark, ("B1", 97_540, "NEFT/RZRPY12345/ACME RETAIL PVT LTD/BLR", 1), ("B2", 97_540, "NEFT/QQQQQ99999/OTHER/BLR", 1))
    s = settled(spark, ("S1", "credit_card", 100_000, 97_540, "RZRPY1234567", "ACME RETAIL PVT LTD", 0), ("S2", "credit_card", 100_000, 97_540, "ZZZZZ0000000", "ACME RETAIL PVT LTD", 0))
    scored = tiers.tier1_scored(tiers.tier1_candidates(b, s)).collect()
    assert [(r.bank_txn_id, r.settlement_id, r.score) for r in scored] == [("B1", "S1", 9_900)]
    tied = spark.createDataFrame([("R", "B1", "S1", 9_000), ("R", "B1", "S2", 9_000), ("R", "B2", "S3", 9_900), ("R", "B3", "S3", 9_000), ("R", "B3", "S4", 9_000)], "run_id string, bank_txn_id string, settlement_id string, score int")
    assert {r.bank_txn_id: r.settlement_ids for r in tiers.tier1_assign(tied).collect()} == {"B2": ["S3"], "B3": ["S4"]}


def brute_subsets(pool, target, band, most):
    out = []
    for mask in range(1, 1 << len(pool)):
        part = [pool[k] for k in range(len(pool)) if mask >> k & 1]
        if len(part) <= most and abs(sum(a for _, a in part) - target) <= band:
            out.append(tuple(sorted(i for i, _ in part)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=9), st.integers(1, 150), st.integers(0, 4), st.integers(1, 6))
def test_subsets_agree_with_all_subsets(amounts, target, band, most):
    pool = [(f"S{k}", a) for k, a in enumerate(amounts)]
    want = brute_subsets(pool, target, band, most)
    found, complete = find_subsets(pool, target, band, most, 10**6)
    assert complete and len(found) == min(2, len(want)) and set(found) <= set(want) and len(set(found)) == len(found)


def test_subset_limits():
    assert find_subsets([("S1", 300), ("S2", 200), ("S3", 999)], 500, 0, 12, 1000) == ([("S1", "S2")], True)
    assert find_subsets([(f"S{k}", k) for k in range(2, 42, 2)], 211, 0, 12, 25) == ([], False)
    six = [(f"S{k}", 100) for k in range(6)]
    assert find_subsets(six, 400, 0, 3, 1000) == ([], True) and len(find_subsets(six, 400, 0, 4, 1000)[0]) == 2


def test_tier2_claims_in_file_order_and_declines(spark):
    b = bank(spark, ("B1", 500, "x", 0), ("B2", 300, "x", 0), ("B3", 40_000, "x", 0))
    s = settled(spark, ("S1", "upi", 1, 10_300, None, "A", 0), ("S2", "upi", 1, 10_200, None, "A", 0))
    b = b.withColumn("credit_paise", F.when(F.col("bank_txn_id") == "B1", 20_500).when(F.col("bank_txn_id") == "B2", 10_300).otherwise(F.col("credit_paise")))
    found, raised = tiers.tier2(b, s)
    assert [(r.bank_txn_id, r.settlement_ids) for r in found.collect()] == [("B1", ["S1", "S2"])] and raised.count() == 0
    s = settled(spark, ("S1", "upi", 1, 30_000, None, "A", 0), ("S2", "upi", 1, 10_000, None, "A", 0), ("S3", "upi", 1, 40_000, None, "A", 0))
    assert [r.code for r in tiers.tier2(bank(spark, ("B1", 40_000, "x", 0)), s)[1].collect()] == ["AMBIGUOUS_SUBSET"]
    many = settled(spark, *[(f"S{k:02}", "upi", 1, 1_000 + k, None, "A", 0) for k in range(26)])
    assert [r.code for r in tiers.tier2(bank(spark, ("B1", 40_000, "x", 0)), many)[1].collect()] == ["POOL_TOO_LARGE"]


GOOD = '{"decision":"MATCH","matched_settlement_ids":["S1"],"evidence":[{"field_name":"a","bank_value":"b","settlement_value":"c","reasoning":"d"}],"confidence":0.9,"unresolved_reason":null}'
ANSWERS = {
    GOOD: True,
    "```json\n" + GOOD + "\n```": True,
    '{"decision":"NO_MATCH","matched_settlement_ids":[],"evidence":[],"confidence":0.2,"unresolved_reason":"none fits"}': True,
    "{": False,
    "[]": False,
    None: False,
    GOOD.replace('"MATCH"', '"MAYBE"'): False,
    GOOD.replace('["S1"]', "[]"): False,
    GOOD.replace('["S1"]', '["S1","S1"]'): False,
    GOOD.replace("0.9", "1.1"): False,
    GOOD.replace('"reasoning":"d"', f'"reasoning":"{"d" * 201}"'): False,
    '{"decision":"NO_MATCH","matched_settlement_ids":["S1"],"evidence":[],"confidence":0.2,"unresolved_reason":"x"}': False,
    '{"decision":"NO_MATCH","matched_settlement_ids":[],"evidence":[],"confidence":0.2,"unresolved_reason":null}': False,
}


def test_contract(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "k int, response string")
    assert [r.fits for r in adjudication.schema_gate(rows).orderBy("k").collect()] == list(ANSWERS.values())


def test_tier3_gates_in_order(spark):
    b = bank(spark, *[(f"B{k}", 10_000, "x", 0) for k in range(5)])
    s = settled(spark, ("S1", "upi", 1, 10_000, "RZRPY1234567", "A", 0), ("S2", "upi", 1, 9_000, "RZRPY1234568", "A", 0))
    told = [("R", "B0", GOOD.replace("S1", "S9")), ("R", "B1", GOOD.replace("S1", "S2")), ("R", "B2", GOOD.replace("0.9", "0.5")), ("R", "B3", GOOD)]
    found, raised = adjudication.tier3(b, s, spark.createDataFrame(told, "run_id string, bank_txn_id string, response string"))
    assert [(r.bank_txn_id, r.settlement_ids) for r in found.collect()] == [("B3", ["S1"])]
    assert [r.confidence for r in found.collect()] == [9_000]  # the answer's own
    assert {r.bank_txn_id: r.code for r in raised.collect()} == {"B0": "LLM_INVALID_OUTPUT", "B1": "AMOUNT_BEYOND_TOLERANCE", "B2": "LOW_CONFIDENCE", "B4": "MODEL_UNAVAILABLE"}


def test_a_later_match_supersedes_what_an_earlier_tier_raised(spark):
    s_rows = [(f"S{k:02}", "upi", 100 + k, 100 + k, None, "A", 0) for k in range(27)] + [("A99", "upi", 5_000, 5_000, None, "A", 0)]
    b, s = bank(spark, ("B1", 5_100, "x", 0)), settled(spark, *s_rows)
    answer = GOOD.replace('["S1"]', '["A99", "S00"]')
    told = spark.createDataFrame([("R", "B1", answer)], "run_id string, bank_txn_id string, response string")
    out = cascade.reconcile(b, s, (0, 1, 2, 3), proposals=told)
    assert [(r.code, r.raised_by) for r in out.exceptions.collect()] == [("POOL_TOO_LARGE", "tier2")]
    assert [(r.tier, r.settlement_ids, r.confidence) for r in out.matches.collect()] == [(3, ["A99", "S00"], 9_000)]
    assert [r.code for r in out.resolutions().collect()] == ["POOL_TOO_LARGE"] and out.open_exceptions().count() == 0
    r = cascade.run_report(out).first()
    assert (r.matches, r.exceptions, r.degraded) == (1, 0, False)
    arms = {r.arm: r for r in cascade.ablation(b, s, spark.createDataFrame([("R", "B1", ["A99", "S00"])], "run_id string, bank_txn_id string, settlement_ids array<string>"), ((0, 1, 2), (3,)), proposals=told.limit(0)).collect()}
    assert arms["T0+T1+T2"].measured and not arms["T3"].measured and arms["T3"].posted is None
    text = report.summary_markdown(spark.createDataFrame([arms["T0+T1+T2"], arms["T3"]], "arm string, credits bigint, explainable bigint, posted bigint, correct bigint, reconciled_paise bigint, at_risk_paise bigint, auto_match bigint, precision bigint, false_match bigint, recall bigint, measured boolean"), "x")
    back = report.rows_back("intro\n" + text + "\n## y\n| a |\n", "x")
    assert [r["arm"] for r in back] == ["T0+T1+T2", "T3"] and back[0]["posted"] == "0" and back[1]["recall"] is None and report.rows_back("", "x") == []
    assert "credits a second" in report.throughput_markdown([("T0", 10, 2.0)])


def test_replay_has_a_verdict_for_each_gate(spark):
    b = bank(spark, *[(f"B{k}", 10_000, "x", 0) for k in range(5)])
    s = settled(spark, ("S1", "upi", 1, 10_000, "RZRPY1234567", "A", 0), ("S2", "upi", 1, 9_000, "RZRPY1234568", "A", 0))
    told = [("R", "B0", GOOD.replace("S1", "S9")), ("R", "B1", GOOD.replace("S1", "S2")), ("R", "B2", GOOD.replace("0.9", "0.5")), ("R", "B3", GOOD), ("R", "B4", GOOD)]
    pool = tiers.pool(b, s).select("run_id", "bank_txn_id", "settlement_id")
    found = adjudication.replay(spark.createDataFrame(told, "run_id string, bank_txn_id string, response string"), b, s, pool)
    got = {r.bank_txn_id: (r.schema, r.membership, r.arithmetic, r.confidence, r.verdict) for r in found.collect()}
    assert got["B0"] == ("pass", "LLM_INVALID_OUTPUT", "not reached", "not reached", "LLM_INVALID_OUTPUT") and got["B3"] == ("pass",) * 4 + ("ACCEPTED",)
    assert got["B1"][2] == "AMOUNT_BEYOND_TOLERANCE" and got["B2"][3] == "LOW_CONFIDENCE"
    shown = adjudication.examples(found, 4).orderBy("place").collect()
    assert {r.verdict for r in shown} == {r[4] for r in got.values()} and len(shown) == 4
    assert adjudication.model_of_record(None, "m") == "m"


def test_rules_are_learned_and_lift_the_next_run(spark, tmp_path):
    names = ["ORCHID RETAIL PVT LTD", "NIMBUS TEXTILES LTD"]
    s_rows = [(f"S{k:02}", "credit_card", 1_000_000 + 7_000 * k, 0, None, names[k % 2], 0) for k in range(8)]
    s_rows = [(i, m, g, g - 30_000 - 5_400 - g // 1_000 - 3 * k if n == names[1] else g, u, n, d) for k, (i, m, g, _, u, n, d) in enumerate(s_rows)]
    s = settled(spark, *[(i, m, g, net, u, n, d) for i, m, g, net, u, n, d in s_rows]).withColumn("tds_paise", F.expr("gross_amount_paise div 1000"))
    b = bank(spark, *[(f"B{k:02}", row[3] - 11_000, f"NEFT/{row[5]}/BLR", 1) for k, row in enumerate(s_rows)])
    truth = spark.createDataFrame([("R", f"B{k:02}", [row[0]]) for k, row in enumerate(s_rows)], "run_id string, bank_txn_id string, settlement_ids array<string>")
    r = learning.lift(b, s, truth).first()
    assert r.rules <= 5 and r.lift == r.auto_match_after - r.auto_match_before and r.false_match_after == 0
    assert learning.call_estimate(b, s).first().calls >= 0
    path = str(tmp_path / "rules.yaml")
    assert rule_file.load(spark, path).count() == 0
    rule_file.save(spark.createDataFrame([("utr_prefix", 'MM"T'), ("fee_override", "ACME: X:100"), ("utr_prefix", 'MM"T')], "kind string, value string"), path)
    assert sorted(map(tuple, rule_file.load(spark, path).collect())) == [("fee_override", "ACME: X:100"), ("utr_prefix", 'MM"T')]
    (tmp_path / "own.yaml").write_text("- kind: utr_prefix\n  value: MMT\n- kind: odd\n  value: x\n# end\n")
    assert [tuple(x) for x in rule_file.load(spark, str(tmp_path / "own.yaml")).collect()] == [("utr_prefix", "MMT")]


def test_resolutions(spark):
    b, s = bank(spark, ("B1", 100, "MMTCRRZRPY1234567/ACME/BLR", 0)), settled(spark, ("S1", "upi", 100, 100, "RZRPY1234567", "ACME", 0))
    rows = [("R", "e1", 1, "B1", "NO_CANDIDATE", 5, "sweep"), ("R", "e2", 2, "B1", "AMBIGUOUS_SUBSET", 5, "tier2"), ("R", "e4", 4, "B2", "ORPHAN_CREDIT", 1, "sweep")]
    open_rows = spark.createDataFrame(rows, "run_id string, exception_id string, exc_seq bigint, bank_txn_id string, code string, value_at_risk_paise bigint, raised_by string")
    pick = lambda e, i: spark.createDataFrame([("R", e, i)], "run_id string, exception_id string, settlement_id string")
    done, taught = learning.resolve(open_rows, b, s, pick("e2", "S1"))
    assert sorted(r.exception_id for r in done.collect()) == ["e1", "e2"] and [(r.kind, r.value, r.exception_id) for r in taught.collect()] == [("utr_prefix", "MMTCR", "e2")]
    for e, i in (("e9", "S1"), ("e2", "S9")):
        with pytest.raises(KeyError):
            learning.resolve(open_rows, b, s, pick(e, i))
    party = open_rows.withColumn("detail", F.lit('{"counterparty":"ACME"}'))
    assert all(r.counterparties == ["ACME"] for r in exceptions.clusters(exceptions.queue(party)).collect())


def test_every_credit_is_matched_or_raised_and_no_settlement_twice(spark):
    rnd = random.Random(4)
    s_rows = [(f"S{k:02}", "upi", n, n, f"RZRPY{1_000_000 + k}", "A", k % 3) for k, n in enumerate(rnd.randint(1_000, 9_000) for _ in range(20))]
    s = settled(spark, *s_rows)
    b_rows = [(f"B{k:02}", sum(x[3] for x in part), f"NEFT/{part[0][4] if k % 3 else 'none'}/A", 1) for k, part in enumerate([[s_rows[0]], s_rows[1:3], s_rows[3:6], [s_rows[6]], [s_rows[7]]])] + [("B90", 1, "x", 0), ("B91", 10**9, "y", 2)]
    out = cascade.reconcile(bank(spark, *b_rows), s)
    matched = [r.bank_txn_id for r in out.matches.collect()]
    used = [i for r in out.matches.collect() for i in r.settlement_ids]
    assert len(matched) == len(set(matched)) and len(used) == len(set(used))
    assert {*matched} | {r.bank_txn_id for r in out.exceptions.collect()} == {r[0] for r in b_rows}


def test_scores(spark):
    truth = spark.createDataFrame([("R", "B1", ["S1", "S2"]), ("R", "B2", ["S3"]), ("R", "B3", [])], "run_id string, bank_txn_id string, settlement_ids array<string>")
    posted = spark.createDataFrame([("R", "B1", ["S1"], 0), ("R", "B2", ["S3"], 0)], "run_id string, bank_txn_id string, settlement_ids array<string>, tier int")
    r = scoring.score(posted, truth, bank(spark, ("B1", 10, "", 0), ("B2", 20, "", 0), ("B3", 30, "", 0))).first()
    assert (r.credits, r.explainable, r.posted, r.correct, r.reconciled_paise, r.at_risk_paise, r.precision, r.false_match, r.recall) == (3, 2, 2, 1, 20, 30, 500_000, 500_000, 500_000)
    links = spark.createDataFrame([("R", "B1", "S2", "b| a"), ("R", "B1", "S1", "a"), ("R", "B2", "", "")], "run_id string, bank_txn_id string, settlement_id string, chaos_tags string")
    assert {x.bank_txn_id: (x.settlement_ids, x.tags) for x in scoring.truth_from_links(links).collect()} == {"B1": (["S1", "S2"], ["a", "b"]), "B2": ([], [])}


def test_queue_and_supersede(spark):
    rows = [("R", "e1", 1, "B1", "NO_CANDIDATE", 5, "sweep"), ("R", "e2", 2, "B1", "AMBIGUOUS_SUBSET", 5, "tier2"), ("R", "e3", 3, None, "POOL_TOO_LARGE", 9, "tier2"), ("R", "e4", 4, "B2", "AMOUNT_BEYOND_TOLERANCE", 1, "tier3")]
    open_rows = spark.createDataFrame(rows, "run_id string, exception_id string, exc_seq bigint, bank_txn_id string, code string, value_at_risk_paise bigint, raised_by string")
    queued = exceptions.queue(open_rows)
    assert [(r.exception_id, r.code, r.history) for r in exceptions.in_order(queued).collect()] == [("e3", "POOL_TOO_LARGE", ""), ("e2", "AMBIGUOUS_SUBSET", "NO_CANDIDATE"), ("e4", "AMOUNT_BEYOND_TOLERANCE", "")]
    assert exceptions.clusters(queued).count() == 3 and len(CODES) == 10
    match = spark.createDataFrame([("R", "B1", ["S"], 1, "T1-TOLERANT", 9_000)], tiers.MATCH)
    assert [r.exception_id for r in exceptions.superseded(open_rows, match).collect()] == ["e1"]


def test_rules(spark):
    cols = "run_id string, bank_txn_id string, narration string, utr string, customer_name string, method string, gross_amount_paise bigint, tds_paise bigint, net_amount_paise bigint, credit_paise bigint, status string"
    rows = [
        ("R", "B1", "MMTCRRZRPY1234567/ACME/BLR", "RZRPY1234567", "ACME RETAIL PVT LTD", "upi", 100_000, 100, 99_900, 99_900, "captured"),
        ("R", "B2", "NEFT/ACME RTL P L/BLR", "", "ACME RETAIL PVT LTD", "upi", 100_000, 100, 99_900, 99_900, "captured"),
        ("R", "B3", "x", None, "acme ", "credit_card", 1_000_000, 1_000, 975_400, 963_600, "captured"),
        ("R", "B4", "x", None, "ACME", "upi", 100_000, 100, 99_900, 99_900, "captured"),
    ]
    found = {r.bank_txn_id: (r.kind, r.value) for r in rules.proposed(spark.createDataFrame(rows, cols)).collect()}
    assert found == {"B1": ("utr_prefix", "MMTCR"), "B2": ("name_alias", "ACME RTL P L=ACME RETAIL PVT LTD"), "B3": ("fee_override", "ACME:100")}


def test_tier_spec():
    assert cascade.parse_tiers(" 2,0,, 1") == (0, 1, 2)
    for bad in ("", "4", "a", " , "):
        with pytest.raises(ValueError):
            cascade.parse_tiers(bad)


def test_a_subset_search_over_few_agrees_with_the_budgeted_one():
    rnd = random.Random(7)
    for _ in range(400):
        pool = [(f"S{k}", rnd.randint(0, 30)) for k in range(rnd.randint(0, 8))]
        target, band, most = rnd.randint(1, 90), rnd.randint(0, 3), rnd.randint(1, 8)
        want = sorted((tuple(sorted(o)) for o in brute_subsets(pool, target, band, most)))
        found, complete = find_subsets(pool, target, band, most, 10**6, enough=10**6)
        assert complete and sorted(found) == want
        by_place = sorted(pool, key=lambda x: (-x[1], x[0]))
        order = sorted((tuple(k for k, x in enumerate(by_place) if x[0] in f) for f in found))
        first = [tuple(sorted(by_place[k][0] for k in o)) for o in order[:2]]
        assert find_subsets(pool, target, band, most, 10**6)[0] == first


def test_runs_stream_in_order_whole_and_once(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("R"), F.col("id") % 3).alias("run_id"), (-F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("t"))

    def decide(run, part):
        seen = [(n, t) for _, n, t in part]
        yield run, len(seen), [t for _, t in seen[:2]], seen == sorted(seen, key=lambda x: x[0]), sum(t == "x" for _, t in seen)

    found = tiers.by_run(rows, ("n",), lambda run, part: ((a, b, c, int(d), e) for a, b, c, d, e in decide(run, part)), "run_id string, n bigint, first array<string>, ordered int, x bigint").collect()
    assert sorted((r.run_id, r.n, r.ordered, r.x) for r in found) == [(f"R{k}", 10_000, 1, 5_000) for k in range(3)]


def test_tiers_that_raise_decide_once(spark, monkeypatch):
    cuts = []
    keep = cascade.shared
    monkeypatch.setattr(cascade, "shared", lambda df, tag: cuts.append(tag) or keep(df, tag))
    b = bank(spark, ("B1", 20_500, "x", 0), ("B2", 999, "y", 0))
    s = settled(spark, ("S1", "upi", 1, 10_300, None, "A", 0), ("S2", "upi", 1, 10_200, None, "A", 0), ("S3", "upi", 1, 800, None, "A", 0))
    out = cascade.reconcile(b, s, (0, 1, 2, 3), proposals=spark.createDataFrame([("R", "B2", GOOD.replace("S1", "S3"))], "run_id string, bank_txn_id string, response string"))
    assert {(r.bank_txn_id, r.tier) for r in out.matches.collect()} == {("B1", 2)} and [(r.bank_txn_id, r.code) for r in out.exceptions.collect()] == [("B2", "AMOUNT_BEYOND_TOLERANCE")]
    assert cuts.count("tier2") == cuts.count("tier3") == 1 and "raised2" not in cuts and "raised3" not in cuts


def test_arms_share_the_tiers_that_they_begin_with(spark, monkeypatch):
    cuts = []
    keep = cascade.shared
    monkeypatch.setattr(cascade, "shared", lambda df, tag: cuts.append(tag) or keep(df, tag))
    b = bank(spark, ("B1", 20_500, "x", 0), ("B2", 700, "NEFT/RZRPY7777777/A", 0))
    s = settled(spark, ("S1", "upi", 1, 10_300, None, "A", 0), ("S2", "upi", 1, 10_200, None, "A", 0), ("S3", "upi", 700, 700, "RZRPY7777777", "C", 0))
    truth = spark.createDataFrame([("R", "B1", ["S1", "S2"]), ("R", "B2", ["S3"])], "run_id string, bank_txn_id string, settlement_ids array<string>")
    told = spark.createDataFrame([("R", "B1", GOOD.replace('["S1"]', '["S2","S1"]')), ("R", "B2", GOOD.replace("S1", "S3"))], "run_id string, bank_txn_id string, response string")
    arms = {r.arm: r for r in cascade.ablation(b, s, truth, proposals=told).collect()}
    assert {a: (r.posted, r.correct, r.measured) for a, r in arms.items()} == {"T0": (1, 1, True), "T0+T1": (1, 1, True), "T0+T1+T2": (2, 2, True), "T0+T1+T2+T3": (2, 2, True), "T3": (2, 2, True)}
    assert [cuts.count(t) for t in ("tier0", "tier1", "tier2", "tier3")] == [1, 1, 1, 2]


def test_lift_asks_for_the_queue_once_and_for_an_alias_only_where_nothing_else_explains(spark, monkeypatch):
    cuts, asked = [], []
    keep, named = cascade.shared, rules.alias
    monkeypatch.setattr(cascade, "shared", lambda df, tag: cuts.append(tag) or keep(df, tag))
    monkeypatch.setattr(rules, "alias", lambda text, name: asked.append(text) or named(text, name))
    s = settled(spark, *[(f"S{k}", "upi", 9_000 + 100 * k, 9_000 + 100 * k, f"RZRPY123456{k}", "ACME", 0) for k in range(3)])
    b = bank(spark, *[(f"B{k}", 9_001 + 100 * k, f"MMTCRRZRPY123456{k}/ACME/BLR", 9) for k in range(3)])  # beyond the window: the queue
    truth = spark.createDataFrame([("R", f"B{k}", [f"S{k}"]) for k in range(3)], "run_id string, bank_txn_id string, settlement_ids array<string>")
    r = learning.lift(b, s, truth).first()
    assert (r.rules, r.posted_before, r.posted_after) == (1, 0, 0)
    assert cuts.count("exceptions") == cuts.count("decided") == 1 and cuts.count("tier2") == 2
    two = spark.createDataFrame([("a/b", "P", None), ("a/b", None, None)], "narration string, prefix string, drift bigint")
    assert [x[0] for x in two.select(asked[0]).collect()] == [None, "a/b"]
