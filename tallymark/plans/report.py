"""Reports: small aggregates are collected, then written as Markdown or one HTML page."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import adjudication, exceptions, provenance, scoring
from tallymark.plans.cascade import Outcome, run_report, tier_outcomes

METRICS = ["arm", "credits", "posted", "correct", "auto_match", "precision", "false_match", "recall"]


def grouped(paise: int) -> str:
    """Rupees with Indian grouping."""
    whole, cents = divmod(abs(paise), 100)
    head, tail = str(whole)[:-3], str(whole)[-3:]
    while len(head) > 2:
        head, tail = head[:-2], f"{head[-2:]},{tail}"
    return f"{'-' if paise < 0 else ''}₹{f'{head},' if head else ''}{tail}.{cents:02}"


def percent(millionths: int) -> str:
    return f"{millionths / 10_000:.1f}%"


def markdown(rows: list[dict], columns: list[str]) -> str:
    cells = [[percent(r[c]) if c in ("auto_match", "precision", "false_match", "recall") else str(r[c]) for c in columns] for r in rows]
    return "\n".join(f"| {' | '.join(x)} |" for x in [columns, ["---"] * len(columns), *cells]) + "\n"


def metrics_markdown(arms: DataFrame) -> str:
    return markdown([r.asDict() for r in arms.orderBy("arm").collect()], METRICS)


def throughput_markdown(rows: list[tuple[str, int, float]]) -> str:
    """rows: (configuration, credits, seconds)."""
    return markdown([{"configuration": c, "credits": n, "seconds": f"{s:.2f}", "credits a second": f"{n / s:.0f}" if s else "-"} for c, n, s in rows], ["configuration", "credits", "seconds", "credits a second"])


def summary_markdown(arms: DataFrame, name: str) -> str:
    """A section with the arms' figures; arms that are not measured say so."""
    rows = [r.asDict() for r in arms.orderBy("arm").collect()]
    said = [{c: r[c] if r["measured"] else (r[c] if c == "arm" else "not measured") for c in METRICS} for r in rows]
    cells = [[percent(x[c]) if isinstance(x[c], int) and c in ("auto_match", "precision", "false_match", "recall") else str(x[c]) for c in METRICS] for x in said]
    return f"## {name}\n\n" + "\n".join(f"| {' | '.join(x)} |" for x in [METRICS, ["---"] * len(METRICS), *cells]) + "\n"


def rows_back(text: str, name: str) -> list[dict[str, str | None]]:
    """The rows of a section of summary_markdown; what was not measured is None."""
    part = text.split(f"## {name}\n", 1)
    if len(part) < 2:
        return []
    lines = [x for x in part[1].split("\n## ", 1)[0].splitlines() if x.startswith("| ")]
    cells = [[c.strip() for c in x.strip("| ").split(" | ")] for x in lines]
    return [dict(zip(cells[0], [None if c == "not measured" else c for c in x])) for x in cells[2:] if len(x) == len(cells[0])] if cells else []


INVENTED = {"bank_txn_id": "BNK00042", "decision": "MATCH", "settlement_ids": "STL99999", "schema": "pass", "membership": "LLM_INVALID_OUTPUT", "arithmetic": "not reached", "confidence": "not reached", "verdict": "LLM_INVALID_OUTPUT"}  # a scripted case: an id that no settlement has


def spliced(text: str, block: str, name: str) -> str:
    """text with what lies between the markers of this name replaced; an error if they are not there."""
    first, last = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if text.count(first) != 1 or text.count(last) != 1 or text.index(first) > text.index(last):
        raise ValueError(f"no markers for {name}")
    return text[: text.index(first) + len(first)] + "\n" + block + text[text.index(last) :]


def payload(out: Outcome, run_id: str, truth: DataFrame | None = None, sample: int = 12, replayed: DataFrame | None = None, prints: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """What a page about one run shows; each list has a fixed bound. replayed: of adjudication.replay; prints: fingerprints of bank rows and settlements."""
    one = Outcome(*(x.filter(F.col("run_id") == run_id) for x in (out.bank, out.settled, out.matches, out.exceptions)))
    queued = exceptions.queue(one.open_exceptions())
    tiers = sorted((r.asDict() for r in tier_outcomes(one).collect()), key=lambda r: r["tier"])
    return {
        "run_id": run_id,
        "counts": (run_report(one).first() or one.bank.sparkSession.range(1).first()).asDict(),
        "tiers": tiers,
        "clusters": [r.asDict() for r in exceptions.clusters(queued).orderBy(F.desc("value_at_risk_paise"), "code").collect()],
        "queue": [r.asDict() for r in exceptions.in_order(queued, 20).collect()],
        "matches": [r.asDict() for r in provenance.sample_by_tier(one.matches, max(1, sample // max(1, len(tiers)))).orderBy("tier", "place").collect()],
        "gates": [r.asDict() for r in adjudication.examples(replayed.filter(F.col("run_id") == run_id), sample).orderBy("place").collect()] if replayed is not None else [],
        "invented": INVENTED,
        "provenance": [r.asDict() for r in provenance.source_fingerprints(provenance.sample_by_tier(one.matches, 1).drop("place"), *prints).orderBy("tier").collect()] if prints else [],
        "score": scoring.score(one.matches, truth.filter(F.col("run_id") == run_id), one.bank).first().asDict() if truth is not None else None,
    }


def page(data: dict) -> str:
    """A page that loads nothing from elsewhere; every value is escaped."""

    def cell(name: str, value: object) -> str:
        if name.endswith("_paise") and isinstance(value, int):
            return escape(grouped(value))
        return escape(", ".join(map(str, value)) if isinstance(value, list) else str(value))

    def grid(title: str, rows: list[dict]) -> str:
        if not rows:
            return f"<h2>{escape(title)}</h2><p>None.</p>"
        head = "".join(f"<th>{escape(c)}</th>" for c in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{cell(c, v)}</td>" for c, v in r.items()) + "</tr>" for r in rows)
        return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"

    parts = [grid("Run", [data["counts"]]), grid("Tiers", data["tiers"]), grid("Clusters", data["clusters"]), grid("Queue", data["queue"]), grid("Matches", data["matches"]), grid("Gates", data.get("gates", [])), grid("An invented settlement", [data["invented"]] if data.get("invented") else []), grid("Provenance", data.get("provenance", []))]
    if data["score"]:
        parts.append(grid("Score", [data["score"]]))
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .6em;text-align:left}"
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{escape(data['run_id'])}</title><style>{style}</style></head><body><h1>Run {escape(data['run_id'])}</h1>{''.join(parts)}</body></html>"
