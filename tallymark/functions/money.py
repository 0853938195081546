"""Integer money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.config import DEFAULT_FEES, FeeModel


def _div(a: Column, b: Column | int) -> Column:
    """Truncating integer division that stays bigint."""
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def apply_rate(base: Column, bps: Column | int) -> Column:
    """base * bps / 10000, rounded half away from zero; an error for negative bps."""
    rate = F.lit(bps) if isinstance(bps, int) else bps
    rate = F.when(rate < 0, F.raise_error(F.lit("negative rate")).cast("bigint")).otherwise(rate.cast("bigint"))
    return F.signum(base).cast("bigint") * _div(F.abs(base).cast("bigint") * rate + 5000, 10_000)


def within_tolerance(a: Column, b: Column, flat: int, bps: int) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(flat).cast("bigint"), apply_rate(F.greatest(F.abs(a), F.abs(b)), bps))


def _by_method(method: Column, value: dict[str, int | None]) -> Column:
    out = F.lit(None).cast("bigint")
    for name, x in value.items():
        out = F.when(method == name, F.lit(x).cast("bigint")).otherwise(out)
    return out


def mdr_fee(gross: Column, method: Column, fees: FeeModel = DEFAULT_FEES, drift_bps: Column | None = None) -> Column:
    """The method's share of gross, capped, and its flat part; drift is added to the method's rate."""
    rate = _by_method(method, {m: p.rate_bps for m, p in fees.prices.items()})
    part = apply_rate(gross, rate if drift_bps is None else rate + drift_bps)
    cap = _by_method(method, {m: p.cap for m, p in fees.prices.items()})
    return F.least(part, F.coalesce(cap, part)) + _by_method(method, {m: p.flat for m, p in fees.prices.items()})


def breakdown(gross: Column, method: Column, fees: FeeModel = DEFAULT_FEES, drift_bps: Column | None = None) -> dict[str, Column]:
    fee = mdr_fee(gross, method, fees, drift_bps)
    gst, tds = apply_rate(fee, fees.gst_bps), apply_rate(gross, fees.tds_bps)
    return {"fee": fee, "gst": gst, "tds": tds, "net": gross - fee - gst - tds}


def parse_rupees(text: Column) -> Column:
    """Rupees as written, with or without sign, grouping and currency mark, to paise; null for what is no such amount."""
    bare = F.regexp_replace(F.trim(text), "[,₹ ]", "")
    ok = bare.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,2})?$")
    whole = F.regexp_extract(bare, r"^[+-]?([0-9]+)", 1).cast("bigint")
    cents = F.rpad(F.regexp_extract(bare, r"\.([0-9]{1,2})$", 1), 2, "0").cast("bigint")
    return F.when(ok, F.when(bare.startswith("-"), -1).otherwise(1) * (whole * 100 + cents))


def format_rupees(paise: Column) -> Column:
    size = F.abs(paise)
    return F.concat(F.when(paise < 0, "-").otherwise(""), _div(size, 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def format_lakh(paise: Column) -> Column:
    """Rupees with Indian grouping: the last three digits, then pairs."""
    whole = _div(F.abs(paise), 100).cast("string")
    n = F.length(whole)
    head, tail = F.substring(whole, F.lit(1), n - 3), F.substring(whole, n - 2, F.lit(3))
    pairs = F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ",")
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), F.when(n > 3, F.concat(pairs, F.lit(","), tail)).otherwise(whole), F.lit("."), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0"))
