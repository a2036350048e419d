"""Data quality of the history tables: every rule of a table in one pass, values never changed.

A rule is a code and a flag column. The report has a row a code: how many rows break it and
up to five ids, the smallest, which a window limit finds without gathering a code's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amount_state, amount_status, status_means_collected
from ..functions.dates import parse_data_ts

AMOUNT_SAMPLES = 5


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def report(df: DataFrame, rules: Mapping[str, Column], sample_id: Column, samples: int = AMOUNT_SAMPLES, weight: Column | None = None) -> DataFrame:
    """code, count, samples of all the rules, zero counts included; a row counts ``weight`` times.
    The flags are computed once:
    what breaks a rule comes down to a row a code and id, from which both counts and samples
    follow."""
    codes = F.array_compact(F.array(*[F.when(flag, F.lit(code)) for code, flag in rules.items()]))
    broken = df.select(sample_id.cast("string").alias("id"), (F.lit(1).cast("long") if weight is None else weight).alias("w"), F.explode(codes).alias("code")).groupBy("code", "id").agg(F.sum("w").alias("n"))
    counts = broken.groupBy("code").agg(F.sum("n").alias("count"))
    # n in the order, which it doesn't change, keeps both uses of the aggregate alike: it is shuffled once
    top = broken.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id", "n"))).filter(F.col("place") <= samples)
    listed = top.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("code"))
    return every.join(counts, "code", "left").join(listed, "code", "left").select("code", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("samples", F.lit("")).alias("samples"))


def duplicates(df: DataFrame, keys: Sequence[str], code: str, surplus: bool = True) -> DataFrame:
    """Keys standing more than once: the surplus rows, or the keys."""
    many = df.filter(~F.concat_ws("", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).eqNullSafe("")).groupBy(*keys).count().filter("count > 1")
    total = many.agg(F.coalesce(F.sum(F.col("count") - 1) if surplus else F.count("*"), F.lit(0)).alias("count"))
    top = many.select(F.concat_ws("-", *keys).alias("id")).orderBy("id").limit(AMOUNT_SAMPLES).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return total.crossJoin(top).select(F.lit(code).alias("code"), F.col("count").cast("bigint").alias("count"), "samples")  # a row each


def orphans(details: DataFrame, notices: DataFrame, key: str, code: str) -> DataFrame:
    """Details whose non-blank key no notice has. Keys are counted before they are looked up."""
    keys = details.filter(~blank(key)).groupBy(key).agg(F.count("*").alias("__n"))
    lost = keys.join(notices.select(key).distinct(), key, "left_anti")
    return report(lost, {code: F.lit(True)}, F.col(key), weight=F.col("__n"))


def parsed(notices: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Adds what notice_rules reads, so that each date and amount is parsed once a row."""
    dates = {f"__{c}": parse_data_ts(F.coalesce(F.col(c), F.lit(""))) for c in ("notice_date", "close_date", "open_date")}
    return notices.withColumns({**dates, "__states": F.array(*[amount_state(F.col(a)) for a in amounts])})


def notice_rules(start: str, end: str, contract_details: Column | None = None) -> dict[str, Column]:
    """Rules of ``parsed`` notices. contract_details: the notice's good contract rows, which count
    as contract data."""
    notice, close, opening = (F.col(f"__{c}") for c in ("notice_date", "close_date", "open_date"))
    bad = notice.isNull() | (~blank("close_date") & close.isNull()) | (~blank("open_date") & opening.isNull())
    chronology = F.when(notice > close, True).otherwise(F.coalesce(close > opening, F.lit(False)))
    any_ = lambda what: F.array_contains("__states", what)
    missing = lambda status, *values: status_means_collected(F.col(status)) & F.forall(F.array(*[blank(v) for v in values]), lambda b: b)
    return {
        "blank_record_id": blank("record_id"), "blank_bid_notice_no": blank("bid_no"), "invalid_date_value": bad,
        "notice_date_outside_period": ~F.to_date(notice).between(F.lit(start).cast("date"), F.lit(end).cast("date")), "date_chronology_violation": chronology,
        "notice_year_mismatch": ~blank("notice_year") & (F.year(notice).cast("string") != F.trim("notice_year")), "non_numeric_amount": any_("invalid"), "negative_amount": any_("negative"),
        "participant_status_without_data": missing("participant_status", "participant_count"), "award_status_without_data": missing("award_status", "award_company"),
        "contract_status_without_data": missing("contract_status", "contract_no") & (F.coalesce(contract_details if contract_details is not None else F.lit(0), F.lit(0)) == 0), "request_status_without_data": missing("request_status", "request_no", "request_name"),
        "procurement_request_data_without_number": ~blank("request_name") & blank("request_no"),
    }


def detail_rules(prefix: str, rate: str | None = None) -> dict[str, Column]:
    state = amount_state(F.col("amount"))
    rules = {
        f"invalid_{prefix}_amount": state == "invalid", f"negative_{prefix}_amount": state == "negative",
        f"{prefix}_parse_error_without_raw": (F.col("parse_status") != "ok") & blank("raw_entry"), f"{prefix}_order_not_exact": ~F.coalesce(F.col("exact"), F.lit("")).isin("Y", ""),
    }
    if rate:
        r = amount_status(F.col(rate))
        rules[f"invalid_{prefix}_rate"] = r["status"].isin("invalid", "negative") | (r["amount"] > 100)
    return rules


def summary_mismatch(notices: DataFrame, details: DataFrame, code: str, unsafe: str | None = None, pairs: Mapping[str, str] | None = None) -> DataFrame:
    """The notice's count against its good details, its values (``pairs``: summary column to
    detail column) against those of a single one, and values filled although there are several."""
    pairs = pairs or {}
    n = details.filter("parse_status = 'ok'").groupBy("record_id").agg(F.count("*").alias("n"), *[F.max(d).alias(f"__{d}") for d in pairs.values()])
    j = notices.join(n, "record_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    differ = F.lit(False)
    for summary, detail in pairs.items():
        differ = differ | ~F.trim(F.col(summary)).eqNullSafe(F.trim(F.col(f"__{detail}")))
    rules = {code: (F.col("detail_count").isNotNull() & (F.col("detail_count") != F.col("n"))) | ((F.col("n") == 1) & differ)}
    if unsafe:
        rules[unsafe] = (F.col("n") > 1) & ~blank("detail_value")
    return report(j, rules, F.col("record_id"))


def request_amounts(requests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Amounts of a request that are no number or negative, field by field; only those become rows."""
    states = {f: amount_state(F.col(f)) for f in fields}
    bad = F.array_compact(F.array(*[F.when(x.isin("invalid", "negative"), F.struct(F.lit(f).alias("field"), x.alias("state"))) for f, x in states.items()]))
    each = requests.select("request_no", F.explode(bad).alias("a"))
    state = F.col("a.state")
    rules = {f"{what}_procurement_request_amount": state == what.replace("non_numeric", "invalid") for what in ("invalid", "negative")}
    return report(each, rules, F.concat_ws(":", "request_no", "a.field"))


def access_findings(access: DataFrame, expected: Sequence[str]) -> DataFrame:
    """access (service_id, status, run_status): missing, doubled or blocked services, runs not done."""
    known = access.select("service_id").distinct()
    wanted = access.sparkSession.createDataFrame([(x,) for x in expected], "service_id string")
    lost = report(wanted.join(known, "service_id", "left_anti"), {"missing_access_service": F.lit(True)}, F.col("service_id"))
    rest = report(access, {"missing_collection_run_status": blank("run_status"), "collection_not_complete": ~blank("run_status") & ~status_means_collected(F.col("run_status")), "api_access_attention": F.col("status").isin("permission", "error", "apply")}, F.col("service_id"))
    return lost.unionByName(rest).unionByName(duplicates(access, ["service_id"], "duplicate_access_service"))


def schema_findings(columns: Sequence[str] | None, required: Sequence[str]) -> list[tuple[str, str]]:
    """Fatal findings of one file's header: no file (None), no header, missing and repeated columns."""
    if columns is None:
        return [("missing_file", "")]
    if not columns:
        return [("missing_header", "")]
    seen = [c for c in columns if list(columns).count(c) > 1]
    return [("missing_column", c) for c in required if c not in columns] + [("duplicate_header", c) for c in sorted(set(seen))]


def fatal_findings(headers: Mapping[str, Sequence[str] | None], required: Mapping[str, Sequence[str]], start: str, end: str) -> tuple[bool, list[tuple[str, str, str]]]:
    """Whether the tables may be checked at all, and what is fatal: (table, finding, what)."""
    found = [(name, *f) for name, columns in required.items() for f in schema_findings(headers.get(name), columns)]
    days = []
    for name, day in (("start", start), ("end", end)):
        try:
            days.append(date.fromisoformat(day))
        except ValueError:
            found.append(("period", "invalid_date", name))
    if len(days) == 2 and days[0] > days[1]:
        found.append(("period", "start_after_end", f"{start} {end}"))
    return not found, found


def per_record(tables: Mapping[str, DataFrame], links: DataFrame) -> DataFrame:
    """record_id with the rows and the good rows of each detail table, and the links to it: a
    row a record, summed in the map tasks before anything moves."""
    names = [*tables, "links"]
    parts = [t.select("record_id", *[(F.lit(1) if n == m else F.lit(0)).alias(m) for m in names], *[(F.col("parse_status").eqNullSafe("ok").cast("int") if n == m else F.lit(0)).alias(f"{m}_good") for m in tables]) for n, t in tables.items()]
    parts.append(links.select("record_id", *[F.lit(int(m == "links")).alias(m) for m in names], *[F.lit(0).alias(f"{m}_good") for m in tables]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("record_id").agg(*[F.sum(c).alias(c) for c in out.columns[1:]])


def _distribution(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row: for each name the JSON of value -> rows, sorted by value; a list counts each value."""
    def named(n: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(n).alias("name"), F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit("(blank)")).alias("value"))

    listed = [F.transform(c, named(n)) for n, c in columns.items()]
    counts = rows.select(F.explode(F.flatten(F.array(*listed))).alias("x")).groupBy("x.name", "x.value").count()
    maps = counts.groupBy("name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count"))))).alias("json"))
    return maps.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("json"))), F.lit("{}")).alias(n) for n in columns])


def summary_record(notices: DataFrame, details: Mapping[str, DataFrame], requests: DataFrame, access: DataFrame, start: str, end: str, amounts: Sequence[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: the period, 25 counters, four distributions and the run's status. Each table is
    read once: its flags are summed in one aggregate, details and links come down to a row a
    record (``write`` keeps that table), which the notices are joined with. details: awards,
    contracts, bidders; requests has links (ids joined by ;); access service_id, status."""
    notices, rules = parsed(notices, amounts), notice_rules(start, end, F.col("contracts_good"))
    values = lambda what: F.coalesce(F.sum(F.size(F.filter("__states", lambda s: s == what))), F.lit(0))
    n = lambda code: F.count_if(F.coalesce(rules[code], F.lit(False)))
    links = requests.select(F.explode(F.filter(F.split(F.coalesce("links", F.lit("")), ";"), lambda x: F.trim(x) != "")).alias("record_id"))
    records = write(per_record(details, links))
    joined = notices.join(records, "record_id", "left")
    good = lambda t: F.coalesce(f"{t}_good", F.lit(0))
    differs = lambda t: F.count_if(F.coalesce(F.col(f"{t}_count") != good(t), F.lit(False)))
    own = joined.agg(
        F.count("*").alias("notices"), n("blank_bid_notice_no").alias("blank_bid_notice_no"), n("notice_date_outside_period").alias("notice_date_outside_period"), n("invalid_date_value").alias("invalid_date_values"),
        n("date_chronology_violation").alias("chronology_violations"), values("invalid").alias("invalid_amount_values"), values("negative").alias("negative_amount_values"),
        *[n(f"{x}_status_without_data").alias(f"{x}_status_without_data") for x in ("participant", "award", "contract", "request")], n("procurement_request_data_without_number").alias("procurement_request_data_without_number"),
        differs("awards").alias("award_detail_summary_mismatch"), differs("contracts").alias("contract_detail_summary_mismatch"),
        F.count_if((good("awards") > 1) & ~blank("detail_value")).alias("unsafe_multiple_summary"),
        (F.count_if(~blank("record_id")) - F.count_distinct(F.when(~blank("record_id"), F.col("record_id")))).alias("duplicate_record_rows"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = records.agg(*[total(t).alias(t) for t in details])
    lost = records.filter(~blank("record_id")).join(notices.select("record_id"), "record_id", "left_anti").agg(
        total("awards").alias("orphan_award_rows"), total("contracts").alias("orphan_contract_rows"), total("links").alias("orphan_procurement_request_links"), total("bidders").alias("orphan_bidder_rows"))
    asked = requests.agg(F.count("*").alias("procurement_requests"))
    runs = access.agg(F.count("*").alias("access_rows"), F.coalesce(F.max(F.when(F.col("service_id") == "collection_run", F.col("status"))), F.lit("unknown")).alias("collection_run_status"))
    shares = _distribution(notices, {"relevance_status": F.array("relevance_status"), "notice_year": F.array("notice_year"), "categories": F.split("categories", ";")})
    services = _distribution(access, {"access_status": F.array("status")})
    out = own
    for one in (rows, lost, asked, runs, shares, services):
        out = out.crossJoin(one)  # a row each
    return out.withColumns({"start_date": F.lit(start), "end_date": F.lit(end)})
