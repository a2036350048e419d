"""Amounts and numbers: real zero is a value, blank and '-' are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import once

# Units of won.
UNITS = {"원": 1, "백만원": 1_000_000, "천만원": 10_000_000, "억원": 100_000_000}


def source_value(c: Column) -> Column:
    """Trimmed; blank and '-' are null."""
    return F.nullif(F.nullif(F.trim(c), F.lit("-")), F.lit(""))


def _number(c: Column, signs: str) -> Column:
    text = F.trim(F.regexp_replace(c, signs, ""))
    return once(text, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t))


# What needs no cleaning before it is read; the others go the long way, which is dearer by far.
_PLAIN = r"^[0-9]{1,20}(\.[0-9]{1,6})?\z"


def amount_state(c: Column) -> Column:
    """The status of amount_status alone."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", "blank").when(text.rlike(_PLAIN), "ok").otherwise(_cleaned(c)["status"])


def amount_status(c: Column) -> Column:
    """struct<status, amount>: blank, invalid, negative or ok."""
    text = F.trim(F.coalesce(c, F.lit("")))
    plain = F.struct(F.when(text == "", "blank").otherwise("ok").alias("status"), text.try_cast("decimal(38,6)").alias("amount"))
    return F.when((text == "") | text.rlike(_PLAIN), plain).otherwise(_cleaned(c))


def _cleaned(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    both = once(text, lambda t: F.struct(t.alias("text"), _number(t, "[,₩]").try_cast("decimal(38,6)").alias("value")))
    state = lambda t, v: F.when(t == "", "blank").when(v.isNull(), "invalid").when(v < 0, "negative").otherwise("ok")
    return once(both, lambda x: F.struct(state(x["text"], x["value"]).alias("status"), x["value"].alias("amount")))


def int_or_missing(c: Column) -> Column:
    value = _number(source_value(c), ",").try_cast("decimal(38,6)")
    return once(value, lambda v: F.when(v == F.floor(v), v.cast("bigint")))


def decimal_or_missing(c: Column) -> Column:
    return _number(source_value(c), "[,%]").try_cast("double")


def listing_budget(c: Column) -> Column:
    digits = F.regexp_replace(F.trim(c), ",", "")
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("bigint"))


def krw(amount: Column, unit: Column) -> Column:
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.regexp_replace(amount, ",", "").try_cast("bigint") * F.try_element_at(units, unit)


def canonical_order(c: Column) -> Column:
    """Numeric padding removed, so 00 and 000 are one order."""
    text = F.coalesce(source_value(c), F.lit(""))
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).otherwise(text)


def notice_identity(number: Column, order: Column) -> Column:
    return F.concat_ws("-", F.trim(F.coalesce(number, F.lit(""))), F.nullif(F.trim(order), F.lit("")))


def display_budget(budget: Column, category: Column) -> Column:
    digits = listing_budget(budget)
    blank = F.when(category == "grant_application", "see notice").otherwise("not given")
    return F.when(digits.isNotNull(), F.format_number(digits, 0)).when(F.trim(F.coalesce(budget, F.lit(""))) == "", blank).otherwise(F.trim(budget))


def status_means_collected(c: Column) -> Column:
    # Tokens of collection statuses.
    text = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_\-—:]+", ""))
    blocked = text.rlike("미수집|부분완료|미확인|연결전|필요|오류|notcollected|pending|partial")
    done = text.isin("완료", "수집완료", "수집됨", "complete", "completed", "collected", "success") | text.rlike("수집완료|completed|collected")
    return ~blocked & done


def typed_cell(c: Column, kind: str) -> Column:
    """struct<value, raw>: the typed value, or the raw text where it isn't one."""
    from .dates import parse_data_ts

    value = parse_data_ts(c).cast("string") if kind == "date" else _number(F.coalesce(c, F.lit("")), ",").try_cast("double").cast("string")
    return F.struct(value.alias("value"), F.when(value.isNull(), c).alias("raw"))
