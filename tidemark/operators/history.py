"""The multi-year history: answers of the contract service as award, contract and request rows,
what single rows say on the notices, and the six files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..sources.pages import write_csv
from .tables import exact_link, packed_rows

# The entries of the packed lists, and the columns of the six files in order.
WINNER = ("winner_sequence", "winner_company", "winner_business_no", "winner_ceo", "award_amount_krw", "award_rate_pct", "participant_count", "opening_date")
CONTRACT = ("contract_sequence", "contract_no", "contract_name", "contract_agency", "contract_demand_agency", "contract_method", "contract_amount_krw", "contract_date")
FILES = {
    "notices": (
        "record_id", "bid_notice_no", "bid_notice_order", "notice_title", "notice_date", "notice_year", "notice_kind", "rebid_yn", "notice_agency", "demand_agency",
        "bid_method", "contract_method", "award_method", "service_type", "budget_amount_krw", "estimated_price_krw", "vat_amount_krw", "bid_start", "bid_close", "opening_date",
        "participant_limit_yn", "joint_contract_method", "order_plan_unified_no", "pre_spec_registration_no", "procurement_request_no", "search_terms", "categories",
        "relevance_status", "relevance_reason", "tracker_tier", "tracker_score", "matched_keywords", "winner_count", "participant_count", "winner_company", "winner_business_no",
        "award_amount_krw", "award_rate_pct", "contract_count", "contract_amount_krw", "contract_date", "procurement_request_name", "procurement_request_budget_amount_krw",
        "procurement_request_representative_amount_krw", "procurement_request_total_service_budget_amount_krw", "procurement_request_current_budget_amount_krw",
        "procurement_request_order_agency", "procurement_request_input_date", "participant_data_status", "award_data_status", "contract_data_status",
        "procurement_request_data_status", "notice_url", "source_dataset", "source_url",
    ),
    "bidders": (
        "record_id", "bid_notice_no", "bid_notice_order", "bid_classification_no", "rebid_no", "opening_rank", "participant_company", "participant_business_no",
        "participant_ceo", "bid_amount_krw", "bid_rate_pct", "bid_date", "final_winner_yn", "source_dataset", "source_url",
    ),
    "awards": (
        "record_id", "bid_notice_no", "bid_notice_order", "contract_process_item_index", *WINNER, "parse_status", "raw_entry", "bidwinr_info_list_raw",
        "exact_order_match_yn", "link_status", "source_dataset", "source_url",
    ),
    "contracts": (
        "record_id", "bid_notice_no", "bid_notice_order", "contract_process_item_index", *CONTRACT, "parse_status", "raw_entry", "contract_info_list_raw",
        "exact_order_match_yn", "link_status", "source_dataset", "source_url",
    ),
    "requests": (
        "procurement_request_no", "linked_record_ids", "linked_bid_notice_nos", "linked_bid_notice_orders", "service_type", "request_name", "budget_amount_krw",
        "representative_amount_krw", "total_service_budget_amount_krw", "current_budget_amount_krw", "order_agency", "input_date", "request_data_status",
        "source_operation", "source_dataset", "source_url",
    ),
    "access": ("service_id", "service_name", "dataset_url", "operation", "purpose", "access_status", "error_code", "message", "checked_at", "next_action"),
}
REQUEST_VALUES = ("request_name", "budget_amount_krw", "representative_amount_krw", "total_service_budget_amount_krw", "current_budget_amount_krw", "order_agency", "input_date")
LISTED = 50  # linked records named in a request's row; ``links`` has them all

_KEY = ("bid_notice_no", "bid_notice_order")


def _linked(rows: DataFrame, notices: DataFrame) -> DataFrame:
    known = notices.select(F.col("bid_notice_no").alias("bid_no"), F.col("bid_notice_order").alias("order"), "record_id", "ord")
    out = exact_link(rows.withColumns({"bid_no": F.col("bid_notice_no"), "order": F.col("bid_notice_order")}), known)
    return out.withColumnRenamed("exact", "exact_order_match_yn").drop("bid_no", "order", "order_key")


def detail_rows(responses: DataFrame, notices: DataFrame, packed: str, fields: Sequence[str], numbers: Mapping[str, Callable[[Column], Column]], dated: str) -> DataFrame:
    """A row an entry of the packed list, linked to the notice of exactly its order. Numbers and
    the date are given only where the whole entry is good; what can't be read stays as it came."""
    rows = packed_rows(responses, packed, fields)
    # the numbers as columns of their own: the status and the values name them, and read them once
    rows = rows.select("*", F.inline(F.array(F.struct(*[read(F.col(c)).alias(f"__{c}") for c, read in numbers.items()]))))
    wrong = F.array_compact(F.array(*[F.when((F.col(c) != "") & F.col(f"__{c}").isNull(), F.lit(c)) for c in numbers]))
    status = F.when((F.col("parse_status") == "ok") & (F.size(wrong) > 0), F.concat(F.lit("invalid number: "), F.array_join(wrong, ", "))).otherwise(F.col("parse_status"))
    rows = rows.withColumn("parse_status", status)
    good = F.col("parse_status") == "ok"
    values = {c: F.when(good, F.col(f"__{c}")) for c in numbers} | {dated: F.when(good, F.col(dated)).otherwise("")}
    kept = ["bid_notice_no", "bid_notice_order", "contract_process_item_index", "item_index", *fields, "parse_status", "raw_entry", F.col(packed).alias(f"{packed}_raw")]
    return _linked(rows.withColumns(values).select(*kept), notices)


def award_rows(responses: DataFrame, notices: DataFrame) -> DataFrame:
    numbers = {"award_amount_krw": A.int_or_missing, "award_rate_pct": A.decimal_or_missing, "participant_count": A.int_or_missing}
    return detail_rows(responses, notices, "bidwinr_info_list", WINNER, numbers, "opening_date")


def contract_rows(responses: DataFrame, notices: DataFrame) -> DataFrame:
    return detail_rows(responses, notices, "contract_info_list", CONTRACT, {"contract_amount_krw": A.int_or_missing}, "contract_date")


def request_links(responses: DataFrame, notices: DataFrame, operation: Callable[[Column], Column]) -> DataFrame:
    """One row a request and notice: the number stands on an answer of exactly the notice's order;
    which service knows it is told by the notice's service type."""
    named = responses.withColumn("procurement_request_no", A.source_value(F.col("procurement_request_no"))).filter("procurement_request_no is not null")
    linked = _linked(named.select(*_KEY, "procurement_request_no").distinct(), notices).filter("record_id <> ''")
    typed = linked.select("procurement_request_no", "record_id").join(notices.select("record_id", "service_type", *_KEY), "record_id")
    return typed.withColumn("source_operation", operation(F.col("service_type"))).dropDuplicates(["source_operation", "procurement_request_no", "record_id"])


def request_rows(links: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a linked request, with what the service answered: values of a single answer only.
    Of many linked records the first ``LISTED`` are named."""
    key = ["source_operation", "procurement_request_no"]
    one = answers.groupBy(*key).agg(F.count("*").alias("__n"), F.max(F.struct(*REQUEST_VALUES)).alias("__v"))
    # a window with a limit: a request that a third of all records name is cut on the map side
    named = links.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("record_id"))).filter(F.col("__r") <= LISTED) \
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("record_id", *_KEY))).alias("__l"))
    counts = links.groupBy(*key).agg(F.count("*").alias("linked_records"), F.min_by("service_type", "record_id").alias("service_type"))
    joined = counts.join(named, key).join(one, key, "left")
    lists = {f"linked_{c}s": F.array_join(F.col(f"__l.{c}"), "; ") for c in ("record_id", *_KEY)}
    values = {c: F.when(F.col("__n") == 1, F.col(f"__v.{c}")) for c in REQUEST_VALUES}
    status = F.when(F.col("__n").isNull(), "looked up: none").when(F.col("__n") == 1, "collected: single").otherwise(F.concat(F.lit("several answers: "), F.col("__n").cast("string")))
    return joined.withColumns(lists | values | {"request_data_status": status}).drop("__n", "__v", "__l")


def _told(rows: DataFrame, name: str, values: Mapping[str, str]) -> DataFrame:
    """Per notice the good and bad rows, and of good ones the greatest values."""
    good = F.col("parse_status") == "ok"
    told = F.max(F.when(good, F.struct(*[F.col(c).alias(v) for v, c in values.items()]))).alias(f"__{name}")
    return rows.filter("record_id <> ''").groupBy("record_id").agg(F.count_if(good).alias(f"__{name}_n"), F.count_if(~good).alias(f"__{name}_bad"), told)


def enriched(notices: DataFrame, responses: DataFrame, awards: DataFrame, contracts: DataFrame, links: DataFrame, requests: DataFrame) -> DataFrame:
    """Notices with the counts of their details and the values of single ones: of several rows, or
    where one can't be read, neither a sum nor one of them. All joins are by record."""
    asked = responses.select("bid_notice_no").distinct().withColumn("__asked", F.lit(True))
    matched = _linked(responses.select(*_KEY).distinct(), notices).filter("record_id <> ''").select("record_id").distinct().withColumn("__exact", F.lit(True))
    winner = _told(awards, "w", {c: c for c in ("participant_count", "winner_company", "winner_business_no", "award_amount_krw", "award_rate_pct")})
    contract = _told(contracts, "c", {c: c for c in ("contract_amount_krw", "contract_date")})
    key = ["source_operation", "procurement_request_no"]
    of_request = links.select("record_id", *key).join(requests.select(*key, *REQUEST_VALUES, "request_data_status"), key) \
        .groupBy("record_id").agg(F.count("*").alias("__r_n"), F.max(F.struct("procurement_request_no", *REQUEST_VALUES, "request_data_status")).alias("__r"))
    j = notices.join(asked, "bid_notice_no", "left")
    for part in (matched, winner, contract, of_request):
        j = j.join(part, "record_id", "left")
    exact = F.col("__exact").isNotNull()
    n = lambda x: F.coalesce(f"__{x}_n", F.lit(0))
    bad = lambda x: F.coalesce(f"__{x}_bad", F.lit(0)) > 0
    lookup = F.when(F.col("__asked").isNull(), "not looked up").otherwise("looked up: no item of this order")

    def status(x):
        return F.when(~exact, lookup).when(bad(x), "parse issue: see details").when(n(x) == 1, "collected: single") \
            .when(n(x) > 1, F.concat(F.lit("several: "), n(x).cast("string"))).otherwise("looked up: none")

    new = {}
    for x, name, fields in (("w", "winner", winner.schema["__w"].dataType.names), ("c", "contract", contract.schema["__c"].dataType.names)):
        new[f"{name}_count"] = F.when(exact & ~bad(x), n(x))
        new |= {c: F.when((n(x) == 1) & ~bad(x), F.col(f"__{x}.{c}")) for c in fields}
    single = n("r") == 1
    new["procurement_request_no"] = F.when(single, F.col("__r.procurement_request_no"))
    new |= {"procurement_request_" + c.removeprefix("request_"): F.when(single, F.col(f"__r.{c}")) for c in REQUEST_VALUES}
    new |= {"participant_data_status": status("w"), "award_data_status": status("w"), "contract_data_status": status("c")}
    new["procurement_request_data_status"] = F.when(~exact, lookup).when(single, F.col("__r.request_data_status")) \
        .when(n("r") > 1, F.concat(F.lit("several: "), n("r").cast("string"))).otherwise("looked up: none")
    return j.withColumns(new).drop("__asked", "__exact", *[f"__{x}{s}" for x in ("w", "c", "r") for s in ("", "_n", "_bad")])


def bundle(notices: DataFrame, responses: DataFrame, answers: DataFrame, access: DataFrame, operation: Callable[[Column], Column], bidders: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """notices (record_id, bid_notice_no, bid_notice_order, ord, service_type, ...), responses
    (bid_notice_no, bid_notice_order, contract_process_item_index, bidwinr_info_list,
    contract_info_list, procurement_request_no) and answers of the request service to the tables
    of the history. ``links`` has every pair of request and record. ``keep`` may write the answers
    and the links, which are read several times."""
    responses = keep(responses)
    awards, contracts = award_rows(responses, notices), contract_rows(responses, notices)
    links = keep(request_links(responses, notices, operation))
    requests = request_rows(links, answers)
    spark = notices.sparkSession
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in FILES["bidders"]))
    return {"notices": enriched(notices, responses, awards, contracts, links, requests), "bidders": none if bidders is None else bidders,
            "awards": awards, "contracts": contracts, "requests": requests, "access": access, "links": links}


def write_files(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Each file's rows with its fixed columns in order, those that a table lacks empty."""
    out = {}
    for name, fields in FILES.items():
        t, out[name] = tables[name], f"{path}/{name}"
        write_csv(t.withColumns({c: F.lit("") for c in fields if c not in t.columns}) if set(fields) - set(t.columns) else t, out[name], fields)
    return out
