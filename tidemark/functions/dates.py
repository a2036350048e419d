"""Dates and deadlines. ``as_of`` is always given; texts that aren't dates give null or ''."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a date looks like.
DATE = r"(?<!\d)(20\d{2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})(?!\d)"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is computed once and not once for each place that names it."""
    return F.transform(F.array(c), use)[0]


def _date(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.date_format(made, "yyyy-MM-dd"), F.lit(""))


def normal_date(c: Column) -> Column:
    """The first date in a text as yyyy-mm-dd; '' if there is none or it doesn't exist."""
    text = F.coalesce(c, F.lit(""))
    return _date(*[F.regexp_extract(text, DATE, g) for g in (1, 2, 3)])


def parse_notice_ts(c: Column) -> Column:
    """ISO text, or the first 14, 12 or 8 of its digits."""
    text, digits = F.trim(c), F.regexp_replace(c, r"\D", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(text))
    some = [F.when(F.length(digits) >= n, F.try_to_timestamp(F.substring(digits, 1, n), F.lit(p))) for n, p in ((14, "yyyyMMddHHmmss"), (12, "yyyyMMddHHmm"), (8, "yyyyMMdd"))]
    return F.coalesce(iso, *some)


def parse_data_ts(c: Column) -> Column:
    """The whole text must be one of the shapes; a zone is dropped."""
    text = F.trim(c)
    zone = r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?:Z|[+-]\d{2}:?\d{2})$"
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(text, zone, "$1")))
    shapes = ((r"^\d{14}$", "yyyyMMddHHmmss"), (r"^\d{12}$", "yyyyMMddHHmm"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}\.\d{1,2}\.\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy.M.d H:m:s"), (r"^\d{4}\.\d{1,2}\.\d{1,2} \d{1,2}:\d{1,2}$", "yyyy.M.d H:m"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"))
    any_shape = F.coalesce(iso, *[F.when(text.rlike(r), F.try_to_timestamp(text, F.lit(p))) for r, p in shapes])
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(text)).when(text != "", any_shape)  # most are a day


def _clock(tail: Column, last: bool) -> Column:
    """hh:mm after a date; the day's first or last minute if there is none; '' if impossible."""
    colon, hour = r"(?<!\d)(\d{1,2})\s*:\s*(\d{2})(?!\d)", r"(?<!\d)(\d{1,2})\s*시(?:\s*(\d{1,2})\s*분)?"
    get = lambda p, g: F.regexp_extract(tail, p, g)
    h = F.when(get(colon, 1) != "", get(colon, 1)).when(get(hour, 1) != "", get(hour, 1)).otherwise("23" if last else "0").cast("int")
    m = F.when(get(colon, 1) != "", get(colon, 2)).when(get(hour, 1) != "", F.coalesce(F.nullif(get(hour, 2), F.lit("")), F.lit("0"))).otherwise("59" if last else "0").cast("int")
    return F.when((h <= 23) & (m <= 59), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))).otherwise("")


# The label of an application period, and how far its dates may stand from it.
def application_window(c: Column, label: str = r"(?:신청|접수)\s*(?:기간|기한)\s*[:：]?\s*") -> Column:
    """struct<start, end> of a labelled application period; one date is the deadline."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))

    def stamp(date: Column, tail: Column, last: bool) -> Column:
        both = F.struct(normal_date(date).alias("day"), once(tail, lambda t: _clock(t, last)).alias("clock"))
        return once(both, lambda x: F.when((x["day"] != "") & (x["clock"] != ""), F.concat(x["day"], F.lit(" "), x["clock"])).otherwise(""))

    def one(segment: Column, first: Column) -> Column:
        after = F.substr(segment, F.instr(segment, first) + F.length(first))
        return F.struct(F.lit("").alias("start"), stamp(first, F.substring(after, 1, 28), True).alias("end"))

    def two(after1: Column, first: Column, second: Column) -> Column:
        at2 = F.instr(after1, second)
        until2 = F.substr(after1, F.lit(1), F.least(at2 - 1, F.lit(28)))
        tail2 = F.substring(F.substr(after1, at2 + F.length(second)), 1, 28)
        return F.struct(stamp(first, until2, False).alias("start"), stamp(second, tail2, True).alias("end"))

    def period(segment: Column, dates: Column) -> Column:
        first, second = F.try_element_at(dates, F.lit(1)), F.try_element_at(dates, F.lit(2))
        after1 = F.substr(segment, F.instr(segment, first) + F.length(first))
        none = F.struct(F.lit("").alias("start"), F.lit("").alias("end"))
        return F.when(second.isNotNull(), once(after1, lambda after: two(after, first, second))).when(first.isNotNull(), one(segment, first)).otherwise(none)

    found = once(F.regexp_extract(text, f"{label}(.{{0,180}})", 1), lambda s: F.struct(s.alias("segment"), F.regexp_extract_all(s, F.lit(DATE), F.lit(0)).alias("dates")))
    return once(found, lambda x: period(x["segment"], x["dates"]))


def two_date_window(c: Column) -> Column:
    """struct<start, end>: two ordered dates, written with signs or else as eight digits."""
    text = F.coalesce(c, F.lit(""))
    written = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), normal_date)
    packed = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)20\d{6}(?!\d)"), F.lit(0)), lambda d: F.coalesce(F.date_format(F.try_to_date(d, "yyyyMMdd"), "yyyy-MM-dd"), F.lit("")))
    dates = F.when(F.size(written) >= 2, written).when(~F.array_contains(packed, ""), packed)
    a, b = F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(dates, F.lit(2)), F.lit(""))
    ok = (a != "") & (b != "") & (a <= b)
    return F.struct(F.when(ok, a).otherwise("").alias("start"), F.when(ok, b).otherwise("").alias("end"))


def days_remaining(deadline: Column, as_of: Column) -> Column:
    return F.datediff(F.to_date(deadline), F.to_date(as_of))


def deadline_label(days: Column) -> Column:
    return F.when(days == 0, "D-DAY").when(days.between(1, 7), F.concat(F.lit("D-"), days.cast("string"))).otherwise("")


def deadline_band(label: Column) -> Column:
    return F.when(label == "D-DAY", "deep-red").when(label.isin("D-1", "D-2", "D-3"), "red").when(label.isin("D-4", "D-5", "D-6", "D-7"), "yellow").otherwise("")


def is_active(category: Column, deadline_text: Column, status: Column, start: Column, as_of: Column) -> Column:
    """Bids without a known deadline are open, grants are not; a date alone lasts its day."""
    grant = category == "grant_application"
    deadline = parse_notice_ts(deadline_text)
    whole_day = F.length(F.regexp_replace(F.coalesce(deadline_text, F.lit("")), r"\D", "")) <= 8
    closed = F.regexp_replace(F.coalesce(status, F.lit("")), " ", "").rlike("마감|접수종료|취소")
    in_time = F.when(deadline.isNull(), ~grant).when(whole_day, F.to_date(deadline) >= F.to_date(as_of)).otherwise(deadline >= as_of)
    return F.when(grant & (closed | F.coalesce(start > as_of, F.lit(False))), False).otherwise(in_time)


def is_upcoming(category: Column, deadline: Column, status: Column, start: Column, as_of: Column) -> Column:
    closed = F.regexp_replace(F.coalesce(status, F.lit("")), " ", "").rlike("마감|접수종료|취소")
    return F.coalesce((category == "grant_application") & ~closed & (start > as_of) & (deadline >= start), F.lit(False))


def iso_week_key(c: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), c).cast("string"), 2, "0"))


def daily_slot_key(c: Column, slot: str) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("-" + slot))


def not_historical(published: Column, baseline: Column) -> Column:
    """Not published before the baseline, by date if the text has only a date; what has no
    readable date counts as new."""
    at = parse_notice_ts(published)
    only_date = F.length(F.regexp_replace(F.coalesce(published, F.lit("")), r"\D", "")) <= 8
    return F.coalesce(F.when(only_date, F.to_date(at) >= F.to_date(baseline)).otherwise(at >= baseline), F.lit(True))
