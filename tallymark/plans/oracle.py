"""The same results in SQL, over the same tables. Each string starts from the ledger's derivation."""

from __future__ import annotations

from tallymark.config import CODES, PATTERN_AT, REFUSED_PROPOSAL

_AFTER = "(SELECT bd.d FROM bd WHERE bd.n = (SELECT count(*) FROM bd x WHERE x.d <= {day}) + {n})"


def norm(x: str, extra: str = "") -> str:
    return f"regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g'), '^(?:NEFT|IMPS|RTGS|UPI|CR|DR{extra})*(.{{8,}})$', '\\1')"


def rate(x: str, bps: str) -> str:
    return f"((({x}) * ({bps}) + 5000) // 10000)"


def fee(gross: str, method: str, drift: str = "0") -> str:
    bps = f"((CASE {method} WHEN 'debit_card' THEN 40 WHEN 'credit_card' THEN 200 WHEN 'wallet' THEN 200 ELSE 0 END) + {drift})"
    part = rate(gross, bps)
    return f"((CASE WHEN {method} = 'debit_card' THEN least({part}, 100000) ELSE {part} END) + (CASE WHEN {method} = 'netbanking' THEN 1800 ELSE 0 END))"


LEDGER = f"""
cal AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2026-09-01', DATE '2026-12-31', INTERVAL 1 DAY) t(d)),
bd AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM cal WHERE isodow(d) < 6 AND d NOT IN (DATE '2026-09-17', DATE '2026-10-02')),
days AS (SELECT c.d, (SELECT count(*) FROM bd WHERE bd.d <= c.d) AS m FROM cal c),
nth AS (SELECT bd.d, bd.n - z.n AS idx FROM bd, (SELECT n FROM bd WHERE d = DATE '2026-09-07') z),
o AS (SELECT o_orderkey AS k, o_orderkey // 64 AS r, o_orderkey % 64 AS i, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS own_gross,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'upi' WHEN '2' THEN 'debit_card' WHEN '3' THEN 'credit_card' WHEN '4' THEN 'netbanking' WHEN '5' THEN 'wallet' END AS own_method FROM orders),
o2 AS (SELECT o.*, o.r % 4 = 0 AND o.i < 4 AS decoy, p.own_gross AS two_gross, p.own_method AS two_method FROM o LEFT JOIN o p ON p.k = o.k - 2 AND p.r = o.r),
o3 AS (SELECT o2.*, CASE WHEN decoy AND i >= 2 THEN coalesce(two_gross, own_gross) ELSE own_gross END AS gross, CASE WHEN decoy AND i >= 2 THEN coalesce(two_method, own_method) ELSE own_method END AS method,
  CASE WHEN decoy THEN 5 ELSE (i * 7) % (CASE WHEN r % 10 = 9 THEN 4 ELSE 20 END) END AS off,
  CASE WHEN decoy THEN 'captured' WHEN k % 41 = 7 THEN 'refunded' WHEN k % 43 = 9 THEN 'disputed' WHEN k % 20 = 11 THEN 'partial_refund' ELSE 'captured' END AS status,
  c_mktsegment || ' ' || (['RETAIL', 'TEXTILES', 'TRADERS', 'LOGISTICS', 'EXPORTS', 'DIGITAL', 'STORES', 'MOTORS'])[o_custkey % 8 + 1] || ' PVT LTD' AS customer_name
  FROM o2 JOIN customer ON c_custkey = o_custkey),
o4 AS (SELECT o3.*, {fee('gross', 'method')} AS fee, {rate('gross', '10')} AS tds, a.d AS captured_at, b.d AS settled_on FROM o3 JOIN nth a ON a.idx = off JOIN nth b ON b.idx = off + 2),
o5 AS (SELECT o4.*, {rate('fee', '1800')} AS gst FROM o4),
s AS (SELECT 'R' || lpad(CAST(r AS VARCHAR), 6, '0') AS run_id, 'STL' || lpad(CAST(k AS VARCHAR), 8, '0') AS settlement_id, 'INV' || lpad(CAST(k AS VARCHAR), 8, '0') AS invoice_ref, customer_name, method,
  gross AS gross_amount_paise, fee AS fee_paise, gst AS gst_on_fee_paise, tds AS tds_paise, gross - fee - gst - tds - (CASE WHEN status = 'partial_refund' THEN gross // 8 ELSE 0 END) AS net_amount_paise,
  captured_at, settled_on, 'RZRPY' || CAST(1000000 + (k * 7919) % 9000000 AS VARCHAR) AS utr, status, k, r, i, decoy FROM o5),
g1 AS (SELECT s.*, CASE WHEN decoy THEN 'D' || CAST(i // 2 AS VARCHAR) ELSE CAST((row_number() OVER (PARTITION BY run_id, settled_on, decoy ORDER BY k) - 1) // ((r + dayofyear(settled_on)) % 3 + 1) AS VARCHAR) END AS part FROM s WHERE status IN ('captured', 'partial_refund')),
g2 AS (SELECT g1.*, min(k) OVER (PARTITION BY run_id, settled_on, part) AS lead FROM g1),
c1 AS (SELECT run_id, r, lead, settled_on, decoy, sum(net_amount_paise) AS net, arg_min(utr, k) AS utr, arg_min(customer_name, k) AS customer_name, list_sort(list(settlement_id)) AS settlement_ids FROM g2 GROUP BY ALL),
c2 AS (SELECT run_id, r, 'BNK' || lpad(CAST(lead AS VARCHAR), 8, '0') AS bank_txn_id, CASE WHEN lead % 4 = 3 THEN nx.d ELSE settled_on END AS value_date,
  CASE lead % 10 WHEN 4 THEN 'NEFT/' || utr[:-2] || '/' || customer_name || '/BLR' WHEN 5 THEN 'NEFT/' || utr[:-3] || '/' || customer_name || '/BLR' WHEN 6 THEN 'NEFT/' || utr[1:6] || '-' || utr[7:] || '/' || customer_name || '/BLR'
    WHEN 7 THEN 'UPI/CR/' || lower(utr) || '/' || customer_name || '/BLR' WHEN 8 THEN 'NEFT-CR/' || customer_name || '/BLR' WHEN 9 THEN 'MMTCR' || utr || '/' || customer_name || '/BLR' ELSE 'NEFT/' || utr || '/' || customer_name || '/BLR' END AS narration,
  CAST(net + CASE WHEN lead % 10 IN (1, 4, 6) AND NOT decoy THEN lead % 3 + 1 ELSE 0 END AS BIGINT) AS credit_paise, settlement_ids
  FROM c1 JOIN days ON days.d = c1.settled_on JOIN bd nx ON nx.n = days.m + 1),
f AS (SELECT run_id, r, min(value_date) AS value_date, arg_min(narration, CAST(value_date AS VARCHAR) || bank_txn_id) AS narration, arg_min(credit_paise, CAST(value_date AS VARCHAR) || bank_txn_id) AS credit_paise FROM c2 GROUP BY ALL),
every AS (SELECT run_id, bank_txn_id, value_date, narration, credit_paise, settlement_ids FROM c2
  UNION ALL SELECT run_id, 'BNKORPH' || lpad(CAST(r AS VARCHAR), 6, '0'), value_date, 'IMPS/UNKNOWN REMITTER/MUM', 777777 + 13 * r, [] FROM f
  UNION ALL SELECT run_id, 'BNKDUP' || lpad(CAST(r AS VARCHAR), 6, '0'), value_date, narration, credit_paise, [] FROM f WHERE r % 3 = 0),
b AS (SELECT run_id, bank_txn_id, value_date, narration, credit_paise, settlement_ids, row_number() OVER (PARTITION BY run_id ORDER BY value_date, bank_txn_id) AS file_seq FROM every)"""

TOKENS = f"""
tok AS (SELECT DISTINCT run_id, bank_txn_id, credit_paise, t AS token FROM (SELECT run_id, bank_txn_id, credit_paise, unnest(list_transform(string_split_regex(narration, '[/|]'), lambda x: {norm('x')})) AS t FROM b WHERE credit_paise > 0)
  WHERE regexp_full_match(t, '[A-Z0-9]{{8,32}}') AND regexp_matches(t, '[0-9]'))"""

T0 = f"""{TOKENS},
tok1 AS (SELECT run_id, token, min(bank_txn_id) AS bank_txn_id, min(credit_paise) AS credit_paise FROM tok GROUP BY ALL HAVING count(*) = 1),
ref AS (SELECT run_id, settlement_id, net_amount_paise, {norm('utr')} AS token FROM s),
ref1 AS (SELECT run_id, token, min(settlement_id) AS settlement_id, min(net_amount_paise) AS net FROM ref WHERE token <> '' GROUP BY run_id, token HAVING count(*) = 1),
t0a AS (SELECT run_id, bank_txn_id, settlement_id, 'T0-UTR-EXACT' AS rule_id FROM tok1 JOIN ref1 USING (run_id, token) WHERE credit_paise = net),
lb AS (SELECT * FROM b WHERE (run_id, bank_txn_id) NOT IN (SELECT (run_id, bank_txn_id) FROM t0a)),
ls AS (SELECT * FROM s WHERE (run_id, settlement_id) NOT IN (SELECT (run_id, settlement_id) FROM t0a)),
lb1 AS (SELECT run_id, credit_paise AS amount, value_date AS day, min(bank_txn_id) AS bank_txn_id FROM lb WHERE credit_paise > 0 GROUP BY ALL HAVING count(*) = 1),
ls1 AS (SELECT run_id, net_amount_paise AS amount, settled_on AS day, min(settlement_id) AS settlement_id FROM ls GROUP BY ALL HAVING count(*) = 1),
t0b AS (SELECT run_id, bank_txn_id, settlement_id, 'T0-AMOUNT-DATE-UNIQUE' AS rule_id FROM lb1 JOIN ls1 USING (run_id, amount, day)),
t0 AS (SELECT * FROM t0a UNION ALL SELECT * FROM t0b),
rb AS (SELECT * FROM b WHERE (run_id, bank_txn_id) NOT IN (SELECT (run_id, bank_txn_id) FROM t0)),
rs AS (SELECT * FROM s WHERE (run_id, settlement_id) NOT IN (SELECT (run_id, settlement_id) FROM t0))"""

WINDOW = """
win AS (SELECT days.d AS settled_on, l.d AS latest FROM days JOIN bd l ON l.n = days.m + 3)"""

POOL = f"""{WINDOW},
pool AS (SELECT rb.run_id, rb.bank_txn_id, rb.credit_paise, rb.narration, rb.file_seq, rb.value_date, rs.settlement_id, rs.net_amount_paise, rs.utr FROM rb JOIN rs USING (run_id) JOIN win ON win.settled_on = rs.settled_on
  WHERE rb.value_date BETWEEN rs.settled_on AND win.latest AND rs.net_amount_paise <= rb.credit_paise + 100)"""


def distance(narration: str, utr: str) -> str:
    tokens = f"list_filter(list_transform(string_split_regex({narration}, '[/|]'), lambda x: {norm('x')}), lambda x: regexp_full_match(x, '[A-Z0-9]{{8,32}}') AND regexp_matches(x, '[0-9]'))"
    return f"list_min(list_transform({tokens}, lambda y: levenshtein({norm(utr)}, y)))"


EXPECTED = f"gross_amount_paise - {fee('gross_amount_paise', 'method')} - {rate(fee('gross_amount_paise', 'method'), '1800')} - {rate('gross_amount_paise', '10')}"
T1 = f"""{WINDOW},
ex AS (SELECT rs.*, {EXPECTED} AS expected_net FROM rs),
cand AS (SELECT rb.run_id, rb.bank_txn_id, ex.settlement_id, rb.credit_paise, ex.expected_net, {distance('rb.narration', 'ex.utr')} AS distance FROM rb JOIN ex USING (run_id) JOIN win ON win.settled_on = ex.settled_on
  WHERE rb.credit_paise > 0 AND rb.value_date BETWEEN ex.settled_on AND win.latest AND abs(rb.credit_paise - ex.expected_net) <= greatest(100, {rate('greatest(abs(rb.credit_paise), abs(ex.expected_net))', '50')}))"""

# A log of exceptions by formula: three open rows for some credits, one for others.
LOG = """
log AS (SELECT run_id, bank_txn_id, credit_paise AS value_at_risk_paise, file_seq * 10 + j AS exc_seq, run_id || '-' || bank_txn_id || '-' || CAST(j AS VARCHAR) AS exception_id,
  (['POOL_TOO_LARGE', 'AMOUNT_BEYOND_TOLERANCE', 'NO_CANDIDATE', 'LLM_INVALID_OUTPUT', 'AMBIGUOUS_SUBSET'])[(file_seq + j) % 5 + 1] AS code, CASE WHEN j = 1 THEN 'tier3' ELSE 'tier2' END AS raised_by
  FROM b, (SELECT unnest([0, 1, 2]) AS j) WHERE j <= file_seq % 3)"""
QUEUE = """
q AS (SELECT run_id, bank_txn_id, arg_max(exception_id, exc_seq) AS exception_id, arg_max(code, exc_seq) AS code, arg_max(value_at_risk_paise, exc_seq) AS value_at_risk_paise, arg_max(raised_by, exc_seq) AS raised_by,
  array_to_string(list_slice(list(code ORDER BY exc_seq), 1, len(list(code)) - 1), ',') AS history FROM log GROUP BY run_id, bank_txn_id)"""

# Answers by formula, from the two first members of each pool.
ANSWERS = """
mem AS (SELECT run_id, bank_txn_id, credit_paise, file_seq, value_date, list(settlement_id ORDER BY settlement_id) AS ids FROM pool GROUP BY ALL),
sums AS (SELECT mem.run_id, mem.bank_txn_id, mem.credit_paise, mem.file_seq, mem.value_date, mem.ids[1] AS one, n.net_amount_paise AS net, n.settled_on, file_seq % 8 AS kind FROM mem JOIN s n ON n.run_id = mem.run_id AND n.settlement_id = mem.ids[1])"""
GATES = f"""{ANSWERS},
gate AS (SELECT sums.*, win.latest,
  CASE WHEN kind IN (1, 2) THEN 'LLM_INVALID_OUTPUT' END AS schema_code,
  CASE WHEN kind = 3 THEN 'LLM_INVALID_OUTPUT' END AS membership_code,
  CASE WHEN kind IN (1, 2, 4, 3) THEN NULL WHEN abs(credit_paise - net) > greatest(100, {rate('greatest(abs(credit_paise), abs(net))', '50')}) THEN 'AMOUNT_BEYOND_TOLERANCE' WHEN NOT value_date BETWEEN sums.settled_on AND win.latest THEN 'DATE_OUT_OF_WINDOW' END AS arithmetic_code,
  CASE WHEN kind = 5 THEN 'LOW_CONFIDENCE' END AS confidence_code FROM sums JOIN win ON win.settled_on = sums.settled_on)"""

SCORED = """
posted AS (SELECT run_id, bank_txn_id, max(settlement_id) AS p FROM t0 GROUP BY ALL),
j AS (SELECT b.run_id, b.bank_txn_id, b.credit_paise, len(b.settlement_ids) > 0 AS explainable, p IS NOT NULL AS is_posted, coalesce(b.settlement_ids = [p], false) AS ok FROM b LEFT JOIN posted USING (run_id, bank_txn_id))"""
SCORE = """count(*) AS credits, count(*) FILTER (explainable) AS explainable, count(*) FILTER (is_posted) AS posted, count(*) FILTER (ok) AS correct,
 CAST(coalesce(sum(credit_paise) FILTER (ok), 0) AS BIGINT) AS reconciled_paise, CAST(coalesce(sum(credit_paise) FILTER (NOT is_posted), 0) AS BIGINT) AS at_risk_paise,
 count(*) FILTER (is_posted) * 1000000 // count(*) AS auto_match,
 CASE WHEN count(*) FILTER (is_posted) = 0 THEN 1000000 ELSE count(*) FILTER (ok) * 1000000 // count(*) FILTER (is_posted) END AS "precision",
 CASE WHEN count(*) FILTER (is_posted) = 0 THEN 0 ELSE (count(*) FILTER (is_posted) - count(*) FILTER (ok)) * 1000000 // count(*) FILTER (is_posted) END AS false_match,
 CASE WHEN count(*) FILTER (explainable) = 0 THEN 1000000 ELSE count(*) FILTER (ok) * 1000000 // count(*) FILTER (explainable) END AS recall"""

PRINT_BANK = "sha256('bank_txn_id' || chr(30) || bank_txn_id || chr(31) || 'credit_paise' || chr(30) || CAST(credit_paise AS VARCHAR) || chr(31) || 'narration' || chr(30) || narration || chr(31) || 'value_date' || chr(30) || CAST(value_date AS VARCHAR))"
PRINT_SETTLED = "sha256('net_amount_paise' || chr(30) || CAST(net_amount_paise AS VARCHAR) || chr(31) || 'settlement_id' || chr(30) || settlement_id || chr(31) || 'utr' || chr(30) || utr)"
# Text rows with faults by formula, and each run's first row twice.
RAW = """
raw AS (SELECT run_id, 2 * file_seq + z AS file_seq, bank_txn_id, CASE WHEN file_seq % 11 = 3 THEN 'soon' ELSE CAST(value_date AS VARCHAR) END AS value_date, narration, CASE WHEN file_seq % 13 = 5 THEN '-' || CAST(credit_paise AS VARCHAR) ELSE ' ' || CAST(credit_paise AS VARCHAR) END AS credit_paise,
  CASE WHEN file_seq % 17 = 7 THEN '1.5' ELSE '0' END AS debit_paise, '0' AS balance_paise FROM b, (SELECT unnest([0, 1]) AS z) WHERE z = 0 OR file_seq % 5 = 0),
marked AS (SELECT raw.*, row_number() OVER (PARTITION BY run_id, bank_txn_id, value_date, narration, trim(credit_paise), debit_paise ORDER BY file_seq) = 1 AS is_new,
  (CASE WHEN value_date = 'soon' THEN 'value_date: not valid; ' ELSE '' END) || (CASE WHEN credit_paise LIKE '-%' THEN 'credit_paise: not valid; ' ELSE '' END) || (CASE WHEN debit_paise = '1.5' THEN 'debit_paise: not valid; ' ELSE '' END) AS wrong FROM raw)"""


REPLAY = """
gc AS (SELECT run_id, bank_txn_id, schema_code, membership_code, arithmetic_code, confidence_code, coalesce(schema_code, membership_code, arithmetic_code, confidence_code) AS code, kind FROM gate),
rep AS (SELECT run_id, bank_txn_id, coalesce(schema_code, 'pass') AS schema, CASE WHEN schema_code IS NOT NULL THEN 'not reached' ELSE coalesce(membership_code, 'pass') END AS membership,
  CASE WHEN schema_code IS NOT NULL OR membership_code IS NOT NULL THEN 'not reached' ELSE coalesce(arithmetic_code, 'pass') END AS arithmetic,
  CASE WHEN schema_code IS NOT NULL OR membership_code IS NOT NULL OR arithmetic_code IS NOT NULL THEN 'not reached' ELSE coalesce(confidence_code, 'pass') END AS confidence,
  coalesce(code, CASE WHEN kind = 4 THEN 'NO_MATCH' ELSE 'ACCEPTED' END) AS verdict FROM gc)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def diagnosis() -> str:
    """Of n members with code and m from the model: what the clusters say."""
    action = "CASE code " + " ".join(f"WHEN {quoted(c)} THEN {quoted(x.action)}" for c, x in CODES.items()) + " END"
    refused = f"CASE WHEN code = 'AMOUNT_BEYOND_TOLERANCE' AND m = n THEN {quoted(REFUSED_PROPOSAL)} ELSE {action} END"
    count = "CAST(n AS VARCHAR)"
    said = {"code = 'AMOUNT_BEYOND_TOLERANCE' AND m = n": " proposals were refused; the arithmetic gate works.", "code = 'AMOUNT_BEYOND_TOLERANCE'": " records point to one wrong assumption in the fee model.", "code = 'DATE_OUT_OF_WINDOW'": " records point to one wrong assumption about timing.", "code = 'LLM_INVALID_OUTPUT'": " answers were unusable; look at the model or prompt."}
    return f"CASE WHEN n < {PATTERN_AT} THEN {count} || ' record(s). ' || {refused} " + " ".join(f"WHEN {when} THEN {count} || {quoted(text)}" for when, text in said.items()) + f" ELSE {count} || ' records share this code; look for a common cause.' END"


def sql() -> dict[str, str]:
    def q(select: str, *parts: str) -> str:
        return "WITH " + ",".join((LEDGER, *parts)) + "\n" + select

    day = lambda c: f"CAST({c} AS VARCHAR) AS {c.split('.')[-1]}"
    return {
        "ledger_settlements": q(f"SELECT run_id, settlement_id, invoice_ref, customer_name, method, gross_amount_paise, fee_paise, gst_on_fee_paise, tds_paise, net_amount_paise, {day('captured_at')}, {day('settled_on')}, utr, status FROM s"),
        "ledger_bank": q(f"SELECT run_id, bank_txn_id, {day('value_date')}, narration, credit_paise, file_seq FROM b"),
        "ledger_truth": q("SELECT run_id, bank_txn_id, array_to_string(settlement_ids, ',') AS settlement_ids FROM b"),
        "ledger_invoices": q(f"SELECT run_id, invoice_ref AS invoice_id, 'MERCH001' AS merchant_id, customer_name, gross_amount_paise AS invoice_amount_paise, 'INR' AS currency, CAST(captured_at AS VARCHAR) AS issue_date, CASE WHEN status = 'captured' THEN 'raised' ELSE status END AS status FROM s"),
        "running_balance": q("SELECT run_id, bank_txn_id, CAST(250000000 + sum(credit_paise) OVER (PARTITION BY run_id ORDER BY file_seq) AS BIGINT) AS balance_paise FROM b"),
        "fee_breakdown": q("SELECT settlement_id, fee_paise, gst_on_fee_paise, tds_paise, gross_amount_paise - fee_paise - gst_on_fee_paise - tds_paise AS net FROM s"),
        "business_day_window": q("SELECT DISTINCT CAST(s.settled_on AS VARCHAR) AS settled_on, CAST(win.latest AS VARCHAR) AS latest FROM s JOIN win USING (settled_on)", WINDOW),
        "row_fingerprint": q(f"SELECT run_id, bank_txn_id, {PRINT_BANK} AS row_sha256 FROM b"),
        "ingest_dedupe": q("SELECT run_id, file_seq, bank_txn_id FROM marked WHERE is_new AND wrong = ''", RAW),
        "ingest_quarantine": q("SELECT run_id, file_seq, rtrim(wrong, '; ') AS error FROM marked WHERE is_new AND wrong <> ''", RAW),
        "load_report": q("SELECT run_id, count(*) FILTER (is_new AND wrong = '') AS inserted, count(*) FILTER (NOT is_new) AS skipped, count(*) FILTER (is_new AND wrong <> '') AS quarantined FROM marked GROUP BY run_id", RAW),
        "duplicate_suspected": q("SELECT run_id, bank_txn_id, credit_paise AS value_at_risk_paise, f AS duplicates FROM (SELECT *, row_number() OVER w AS n, first_value(bank_txn_id) OVER w AS f FROM b WHERE credit_paise > 0 WINDOW w AS (PARTITION BY run_id, credit_paise, value_date, narration ORDER BY file_seq)) WHERE n > 1"),
        "utr_normalise": q(f"SELECT run_id, bank_txn_id, {norm('narration')} AS said FROM b"),
        "utr_candidates": q("SELECT run_id, bank_txn_id, token FROM tok", TOKENS),
        "uniqueness_guard": q("SELECT run_id, token, bank_txn_id FROM tok1", T0),
        "t0_reference": q("SELECT * FROM t0a", T0),
        "t0_amount_date": q("SELECT * FROM t0b", T0),
        "t0_all": q("SELECT * FROM t0", T0),
        "residual_after_t0": q("SELECT run_id, bank_txn_id AS id, 'bank' AS side FROM rb UNION ALL SELECT run_id, settlement_id, 'settlement' FROM rs", T0),
        "t1_expected_net": q("SELECT run_id, settlement_id, expected_net FROM ex", T0, T1),
        "t1_fee_override": q(f"SELECT settlement_id, CAST(gross_amount_paise - f - {rate('f', '1800')} - {rate('gross_amount_paise', '10')} AS BIGINT) AS expected_net FROM (SELECT s.*, {fee('gross_amount_paise', 'method', '(CASE WHEN customer_name LIKE chr(37) || chr(32) || chr(84) || chr(69) || chr(88) || chr(84) || chr(73) || chr(76) || chr(69) || chr(83) || chr(32) || chr(37) THEN 100 ELSE 0 END)')} AS f FROM s)"),
        "t1_candidates": q("SELECT run_id, bank_txn_id, settlement_id, credit_paise, expected_net, CAST(distance AS BIGINT) AS distance FROM cand", T0, T1),
        "t1_scored": q("SELECT run_id, bank_txn_id, settlement_id, CAST(9000 AS BIGINT) AS score FROM cand WHERE distance <= 2", T0, T1),
        "t1_uncontested": q("""SELECT run_id, bank_txn_id, min(settlement_id) AS settlement_id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, settlement_id) AS wanted FROM cand WHERE distance <= 2)
GROUP BY run_id, bank_txn_id HAVING max(wanted) = 1 AND count(*) = 1""", T0, T1),
        "t2_pool": q("SELECT run_id, bank_txn_id, settlement_id, net_amount_paise FROM pool", T0, POOL),
        "t2_pool_stats": q("SELECT run_id, bank_txn_id, count(*) AS pool_size, CAST(sum(net_amount_paise) AS BIGINT) AS pool_paise, count(*) > 25 AS too_large FROM pool GROUP BY run_id, bank_txn_id", T0, POOL),
        "t2_pairs": q("""SELECT run_id, bank_txn_id, CAST(sum(n) AS BIGINT) AS solutions FROM (SELECT run_id, bank_txn_id, count(*) AS n FROM pool WHERE abs(credit_paise - net_amount_paise) <= 100 GROUP BY ALL
 UNION ALL SELECT x.run_id, x.bank_txn_id, count(*) FROM pool x JOIN pool y ON x.run_id = y.run_id AND x.bank_txn_id = y.bank_txn_id AND x.settlement_id < y.settlement_id WHERE abs(x.credit_paise - x.net_amount_paise - y.net_amount_paise) <= 100 GROUP BY ALL) GROUP BY run_id, bank_txn_id""", T0, POOL),
        "t3_rank_candidates": q(f"""SELECT run_id, bank_txn_id, settlement_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, bank_txn_id ORDER BY coalesce(greatest(0, 64 - {distance('narration', 'utr')}), 0) DESC, settlement_id) AS place FROM pool) WHERE place <= 8""", T0, POOL),
        "t3_gates": q("SELECT run_id, bank_txn_id, schema_code, membership_code, arithmetic_code, confidence_code, coalesce(schema_code, membership_code, arithmetic_code, confidence_code) AS code FROM gate", T0, POOL, GATES),
        "sweep_codes": q("SELECT rb.run_id, rb.bank_txn_id, CASE WHEN count(a.settlement_id) > 0 THEN 'NO_CANDIDATE' ELSE 'ORPHAN_CREDIT' END AS code, count(a.settlement_id) AS pool_size FROM rb LEFT JOIN (SELECT s.*, latest FROM s JOIN win USING (settled_on)) a ON a.run_id = rb.run_id AND rb.value_date BETWEEN a.settled_on AND a.latest AND a.net_amount_paise <= rb.credit_paise + 100 WHERE rb.credit_paise > 0 GROUP BY rb.run_id, rb.bank_txn_id", T0, WINDOW),
        "exception_queue": q("SELECT run_id, bank_txn_id, exception_id, code, value_at_risk_paise, history, raised_by FROM q", LOG, QUEUE),
        "exception_clusters": q("SELECT run_id, code, count(*) AS members, CAST(sum(value_at_risk_paise) AS BIGINT) AS value_at_risk_paise, count(*) FILTER (raised_by = 'tier3') AS from_model FROM q GROUP BY run_id, code", LOG, QUEUE),
        "exception_actions": q(f"SELECT run_id, code, {diagnosis()} AS diagnosis FROM (SELECT run_id, code, count(*) AS n, count(*) FILTER (raised_by = 'tier3') AS m FROM q GROUP BY run_id, code)", LOG, QUEUE),
        "t3_prompts": q(f"""SELECT x.run_id, x.bank_txn_id, 'Prompt v1. Which settlements explain this credit? Answer in JSON.' || chr(10) || x.bank_txn_id || ' | ' || CAST(x.credit_paise AS VARCHAR) || ' | ' || CAST(x.value_date AS VARCHAR) || ' | ' || x.narration || chr(10) || 'Candidates:' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS prompt
 FROM (SELECT pool.*, pool.settlement_id || ' | ' || CAST(pool.net_amount_paise AS VARCHAR) || ' | ' || CAST(s.settled_on AS VARCHAR) || ' | ' || coalesce(s.utr, '-') || ' | ' || s.customer_name AS line, row_number() OVER (PARTITION BY pool.run_id, pool.bank_txn_id ORDER BY coalesce(greatest(0, 64 - {distance('pool.narration', 'pool.utr')}), 0) DESC, pool.settlement_id) AS place FROM pool JOIN s ON s.run_id = pool.run_id AND s.settlement_id = pool.settlement_id) x
 WHERE place <= 8 GROUP BY x.run_id, x.bank_txn_id, x.credit_paise, x.value_date, x.narration""", T0, POOL),
        "t3_replay": q("SELECT * FROM rep", T0, POOL, GATES, REPLAY),
        "replay_examples": q("SELECT run_id, bank_txn_id, verdict, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY again, verdict, bank_txn_id) AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, verdict ORDER BY bank_txn_id) > 1 AS INTEGER) AS again FROM rep)) WHERE place <= 6", T0, POOL, GATES, REPLAY),
        "match_evidence": q("""SELECT t0.run_id, t0.bank_txn_id, '{"rule_id":"' || rule_id || '","credit_paise":' || CAST(credit_paise AS VARCHAR) || ',"net_paise":' || CAST(net_amount_paise AS VARCHAR) || ',"difference_paise":' || CAST(credit_paise - net_amount_paise AS VARCHAR) || ',"value_date":"' || CAST(value_date AS VARCHAR) || '","first_settled_on":"' || CAST(settled_on AS VARCHAR) || '","members":1}' AS evidence,
 CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS prompt_version, CAST(2 AS BIGINT) AS prints FROM t0 JOIN b USING (run_id, bank_txn_id) JOIN s ON s.run_id = t0.run_id AND s.settlement_id = t0.settlement_id""", T0),
        "score_stored_run": q(f"SELECT run_id, {SCORE} FROM j GROUP BY run_id", T0, SCORED),
        "open_codes": q("SELECT run_id, code, count(*) AS open FROM q GROUP BY run_id, code", LOG, QUEUE),
        "resolution_closes": q("SELECT log.run_id, log.exception_id, log.code FROM log JOIN b USING (run_id, bank_txn_id) WHERE b.file_seq % 7 = 0", LOG),
        "exceptions_by_code": q("SELECT code, count(*) AS n, CAST(sum(value_at_risk_paise) AS BIGINT) AS value_at_risk_paise FROM q GROUP BY code", LOG, QUEUE),
        "supersede": q("SELECT DISTINCT log.run_id, log.exception_id, log.code FROM log JOIN t0 USING (run_id, bank_txn_id) WHERE code <> 'AMBIGUOUS_SUBSET'", T0, LOG),
        "queue_top": q("SELECT bank_txn_id, value_at_risk_paise FROM q ORDER BY value_at_risk_paise DESC, bank_txn_id, exception_id LIMIT 20", LOG, QUEUE),
        "score_t0": q(f"SELECT {SCORE} FROM j", T0, SCORED),
        "score_by_run": q(f"SELECT run_id, {SCORE} FROM j GROUP BY run_id", T0, SCORED),
        "rule_prefix": q("""SELECT g.run_id, g.settlement_id, p AS prefix FROM (SELECT g2.run_id, g2.settlement_id, substr(string_split(b.narration, '/')[1], 1, length(string_split(b.narration, '/')[1]) - length(utr)) AS p, utr, b.narration FROM g2 JOIN b ON b.run_id = g2.run_id AND b.bank_txn_id = 'BNK' || lpad(CAST(lead AS VARCHAR), 8, '0') WHERE k = lead) g WHERE ends_with(string_split(narration, '/')[1], utr) AND p <> ''"""),
        "rule_fee_drift": q("""SELECT settlement_id, drift FROM (SELECT settlement_id, CAST(round_even(CAST(fee AS DOUBLE) * 10000 / gross_amount_paise, 0) AS BIGINT) - (CASE method WHEN 'debit_card' THEN 40 WHEN 'credit_card' THEN 200 WHEN 'wallet' THEN 200 ELSE 0 END) AS drift, fee
 FROM (SELECT *, ((gross_amount_paise - tds_paise - (net_amount_paise - gross_amount_paise // 100)) * 10000) // 11800 AS fee FROM s WHERE status = 'captured' AND gross_amount_paise // 100 > greatest(500, gross_amount_paise // 1000))) WHERE fee > 0 AND abs(drift) BETWEEN 10 AND 500"""),
        "rule_promote": q("SELECT 'utr_prefix' AS kind, p AS value FROM (SELECT DISTINCT 'P' || CAST(r % 5 AS VARCHAR) AS p FROM s UNION SELECT 'P1' UNION SELECT 'OLD')"),
        "provenance_join": q(f"SELECT t0.run_id, t0.bank_txn_id, x.h || ',' || y.h AS fingerprints FROM t0 JOIN (SELECT run_id, bank_txn_id, {PRINT_BANK} AS h FROM b) x USING (run_id, bank_txn_id) JOIN (SELECT run_id, settlement_id, {PRINT_SETTLED} AS h FROM s) y USING (run_id, settlement_id)", T0),
        "provenance_sample": q("SELECT run_id, bank_txn_id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY bank_txn_id, rule_id) AS n FROM t0) WHERE n <= 3", T0),
        "run_summary": q("SELECT b.run_id, count(*) AS bank_rows, coalesce(max(m.n), 0) AS matches, coalesce(max(e.n), 0) AS open_exceptions, CAST(coalesce(max(e.v), 0) AS BIGINT) AS value_at_risk_paise FROM b LEFT JOIN (SELECT run_id, count(*) AS n FROM t0 GROUP BY run_id) m USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n, sum(value_at_risk_paise) AS v FROM q GROUP BY run_id) e USING (run_id) GROUP BY b.run_id", T0, LOG, QUEUE),
        "tier_outcomes_t0": q("SELECT run_id, count(*) AS matched_credits, count(*) AS matched_settlements FROM t0 GROUP BY run_id", T0),
        "paise_format": q("SELECT bank_txn_id, CAST(credit_paise // 100 AS VARCHAR) || '.' || lpad(CAST(credit_paise % 100 AS VARCHAR), 2, '0') AS plain, '₹' || CASE WHEN length(w) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(w[:-4]), '(..)', '\\1,', 'g')), '^,', '') || ',' || w[-3:] ELSE w END || '.' || lpad(CAST(credit_paise % 100 AS VARCHAR), 2, '0') AS grouped FROM (SELECT *, CAST(credit_paise // 100 AS VARCHAR) AS w FROM b)"),
        "paise_parse": q("SELECT bank_txn_id, credit_paise AS paise FROM b"),
    }
