"""Queries of the multi-year history: its tables, its notices with what the details say, its files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import history as H
from . import bind

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, bind.sql("attachments", "history") + sql


def _text(c):
    return F.col(c).cast("string")


def _notices(s, d):
    """Orders as notices: the customer is the bid number, the key's last digit the order."""
    k = F.col("o_orderkey")
    return bind.read(s, d, "orders").select(
        k.cast("string").alias("record_id"), _text("o_custkey").alias("bid_notice_no"), F.lpad((k % 10).cast("string"), 3, "0").alias("bid_notice_order"), k.alias("ord"),
        F.col("o_orderpriority").alias("notice_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("notice_date"), F.date_format("o_orderdate", "yyyy").alias("notice_year"),
        F.when(F.col("o_orderpriority").contains("URGENT"), "technical").otherwise("general").alias("service_type"), F.floor("o_totalprice").cast("string").alias("budget_amount_krw"),
    )


def _joined(*parts):
    return F.concat(F.lit("["), *[x for p in parts for x in (p, F.lit("^"))][:-1], F.lit("]"))


def _responses(s, d):
    """An answer for each order that has lines: winners from all of them, contracts from the first
    two. Some entries are cut, some amounts no numbers, some answers of another order."""
    price, none = F.col("price").cast("bigint").cast("string"), F.lit("-")
    amount = F.when((F.col("line") == 2) & (F.col("quantity") > 45), "n/a").otherwise(price)
    day = F.date_format("stamp", "yyyy-MM-dd")
    winner = F.when((F.col("line") == 3) & (F.col("quantity") > 40), _joined(_text("line"), _text("supp"))) \
        .otherwise(_joined(_text("line"), F.concat(F.lit("co"), "supp"), _text("supp"), none, amount, F.concat(F.col("quantity").cast("int"), F.lit(".5%")), F.lit("1,003"), day))
    contract = F.when(F.col("id") <= 2, _joined(_text("id"), F.concat(F.lit("C"), "part"), _text("label"), none, none, F.lit("open"), price, day))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("id", c)))), lambda x: x[c]), ", ")
    packed = bind.attachments(s, d).withColumns({"w": winner, "c": contract}).groupBy("notice_id").agg(listed("w").alias("w"), listed("c").alias("c"))
    k = F.col("o_orderkey")
    return bind.read(s, d, "orders").join(packed, k == F.col("notice_id")).select(
        _text("o_custkey").alias("bid_notice_no"), F.when(k % 13 == 0, F.lit("77")).otherwise((k % 10).cast("string")).alias("bid_notice_order"), (k % 1000).alias("contract_process_item_index"),
        F.col("w").alias("bidwinr_info_list"), F.when(k % 4 == 0, "").otherwise(F.col("c")).alias("contract_info_list"), F.when(k % 5 == 0, " - ").otherwise(F.concat(F.lit("R"), k % 30)).alias("procurement_request_no"),
    )


def _answers(s, d):
    """Suppliers as answers of the request services; every seventh comes twice."""
    k = F.col("s_suppkey")
    twice = F.explode(F.sequence(F.lit(1), F.when(k % 7 == 0, 2).otherwise(1)))
    return bind.read(s, d, "supplier").withColumn("__again", twice).select(
        F.when(k % 3 == 0, "technical").otherwise("general").alias("source_operation"), F.concat(F.lit("R"), k).alias("procurement_request_no"), F.col("s_name").alias("request_name"),
        (k * 1000).alias("budget_amount_krw"), (k * 10).alias("representative_amount_krw"), (k * 100).alias("total_service_budget_amount_krw"), k.alias("current_budget_amount_krw"),
        _text("s_nationkey").alias("order_agency"), F.lit("2001-01-01").alias("input_date"),
    )


def _access(s, d):
    n = bind.read(s, d, "nation")
    return n.select(_text("n_nationkey").alias("service_id"), F.col("n_name").alias("service_name"), F.when(F.col("n_nationkey") % 3 == 0, "usable").otherwise("permission").alias("access_status"))


def _bundle(s, d):
    return H.bundle(_notices(s, d), _responses(s, d), _answers(s, d), _access(s, d), lambda kind: kind, keep=lambda df: bind.kept(df, "history"))


bind.SQL["history"] = """hn as (select cast(o_orderkey as varchar) as record_id, cast(o_custkey as varchar) as no, o_orderkey % 10 as k, lpad(cast(o_orderkey % 10 as varchar), 3, '0') as ord_text, o_orderkey, case when contains(o_orderpriority, 'URGENT') then 'technical' else 'general' end as kind from orders),
latest as (select no, k, max(o_orderkey) as rec from hn group by 1, 2),
resp as (select o_orderkey as nid, hn.no, case when o_orderkey % 13 = 0 then 77 else hn.k end as rk, case when o_orderkey % 5 <> 0 then 'R' || (o_orderkey % 30) end as req from hn where o_orderkey in (select l_orderkey from lineitem)),
linked as (select resp.*, cast(rec as varchar) as rec from resp left join latest on latest.no = resp.no and latest.k = resp.rk),
wr as (select rec, linked.no, rk, nid, a.id, line, supp, quantity, price, stamp, case when line = 3 and quantity > 40 then 'expected 8, got 2' when line = 2 and quantity > 45 then 'invalid number: award_amount_krw' else 'ok' end as st from linked join attachments a on a.notice_id = nid),
cr as (select rec, linked.no, rk, nid, a.id, part, label, price, stamp from linked join attachments a on a.notice_id = nid where a.id <= 2 and nid % 4 <> 0),
ln as (select distinct kind as op, req, rec, hn.no, ord_text from linked join hn on hn.record_id = linked.rec where req is not null),
an as (select case when s_suppkey % 3 = 0 then 'technical' else 'general' end as op, 'R' || s_suppkey as req, s_suppkey, s_name, s_nationkey, case when s_suppkey % 7 = 0 then 2 else 1 end as n from supplier),
rr as (select ln.op, ln.req, count(*) as records, min(rec) as first_rec, array_to_string(list_sort(list(rec))[1:50], '; ') as recs, any_value(an.n) as n, any_value(s_suppkey) as s, any_value(s_name) as s_name, any_value(s_nationkey) as nat from ln left join an on an.op = ln.op and an.req = ln.req group by 1, 2)"""
_DAY = "strftime(stamp, '%Y-%m-%d')"
_LINK = "case when rec is null then 'N' else 'Y' end as exact_order_match_yn"

add("m21_history_awards", lambda s, d: H.award_rows(_responses(s, d), _notices(s, d)).select("record_id", "bid_notice_no", "bid_notice_order", F.col("contract_process_item_index").alias("item"), "item_index", "winner_sequence", "winner_company", "winner_business_no", "winner_ceo", "award_amount_krw", "award_rate_pct", "participant_count", "opening_date", "parse_status", "exact_order_match_yn"),
    f"""select coalesce(rec, '') as record_id, no as bid_notice_no, cast(rk as varchar) as bid_notice_order, nid % 1000 as item, cast(id as int) as item_index, case when st like 'exp%' then '' else cast(line as varchar) end as winner_sequence, case when st like 'exp%' then '' else 'co' || supp end as winner_company,
  case when st like 'exp%' then '' else cast(supp as varchar) end as winner_business_no, '' as winner_ceo, case when st = 'ok' then cast(trunc(price) as bigint) end as award_amount_krw, case when st = 'ok' then cast(quantity as int) + 0.5::double end as award_rate_pct, case when st = 'ok' then 1003::bigint end as participant_count,
  case when st = 'ok' then {_DAY} else '' end as opening_date, st as parse_status, {_LINK} from wr""")
add("m21_history_contracts", lambda s, d: H.contract_rows(_responses(s, d), _notices(s, d)).select("record_id", "bid_notice_no", "bid_notice_order", F.col("contract_process_item_index").alias("item"), "item_index", "contract_sequence", "contract_no", "contract_name", "contract_method", "contract_amount_krw", "contract_date", "parse_status", "link_status"),
    f"select coalesce(rec, '') as record_id, no as bid_notice_no, cast(rk as varchar) as bid_notice_order, nid % 1000 as item, cast(id as int) as item_index, cast(id as varchar) as contract_sequence, 'C' || part as contract_no, label as contract_name, 'open' as contract_method, cast(trunc(price) as bigint) as contract_amount_krw, {_DAY} as contract_date, 'ok' as parse_status, case when rec is null then 'no notice of this order' else 'linked' end as link_status from cr")
_R_STATUS = "case when n is null then 'looked up: none' when n = 1 then 'collected: single' else 'several answers: ' || n end"
add("m21_history_requests", lambda s, d: _bundle(s, d)["requests"].select("source_operation", "procurement_request_no", "linked_records", "linked_record_ids", "service_type", "request_name", "budget_amount_krw", "representative_amount_krw", "total_service_budget_amount_krw", "current_budget_amount_krw", "order_agency", "input_date", "request_data_status"),
    f"select op as source_operation, req as procurement_request_no, records as linked_records, recs as linked_record_ids, op as service_type, case when n = 1 then s_name end as request_name, case when n = 1 then s * 1000 end as budget_amount_krw, case when n = 1 then s * 10 end as representative_amount_krw, case when n = 1 then s * 100 end as total_service_budget_amount_krw, case when n = 1 then s end as current_budget_amount_krw, case when n = 1 then cast(nat as varchar) end as order_agency, case when n = 1 then '2001-01-01' end as input_date, {_R_STATUS} as request_data_status from rr")
_SHOWN = ["record_id", "bid_notice_no", "bid_notice_order", "service_type", "winner_count", "participant_count", "winner_company", "winner_business_no", "award_amount_krw", "award_rate_pct", "contract_count", "contract_amount_krw", "contract_date", "procurement_request_no", "procurement_request_name",
          "procurement_request_budget_amount_krw", "procurement_request_order_agency", "participant_data_status", "award_data_status", "contract_data_status", "procurement_request_data_status"]
_LOOKUP = "when not exact then case when asked then 'looked up: no item of this order' else 'not looked up' end"
_NOTICES_SQL = f"""select hn.record_id, no as bid_notice_no, ord_text as bid_notice_order, kind as service_type, case when exact and coalesce(w_bad, 0) = 0 then coalesce(w_n, 0) end as winner_count, {", ".join(f"case when w_n = 1 and w_bad = 0 then {v} end as {c}" for c, v in (("participant_count", "1003::bigint"), ("winner_company", "w_co"), ("winner_business_no", "w_no"), ("award_amount_krw", "w_amount"), ("award_rate_pct", "w_rate")))},
  case when exact then coalesce(c_n, 0) end as contract_count, case when c_n = 1 then c_amount end as contract_amount_krw, case when c_n = 1 then c_day end as contract_date, case when r_n = 1 then r_no end as procurement_request_no, case when r_n = 1 then r_name end as procurement_request_name, case when r_n = 1 then r_budget end as procurement_request_budget_amount_krw, case when r_n = 1 then r_agency end as procurement_request_order_agency,
  case {_LOOKUP} when w_bad > 0 then 'parse issue: see details' when w_n = 1 then 'collected: single' when w_n > 1 then 'several: ' || w_n else 'looked up: none' end as participant_data_status, participant_data_status as award_data_status,
  case {_LOOKUP} when c_n = 1 then 'collected: single' when c_n > 1 then 'several: ' || c_n else 'looked up: none' end as contract_data_status, case {_LOOKUP} when r_n = 1 then r_status when r_n > 1 then 'several: ' || r_n else 'looked up: none' end as procurement_request_data_status
from (select *, record_id in (select rec from linked where rec is not null) as exact, no in (select no from resp) as asked from hn) hn
left join (select rec, count_if(st = 'ok') as w_n, count_if(st <> 'ok') as w_bad, max(case when st = 'ok' then 'co' || supp end) as w_co, max(case when st = 'ok' then cast(supp as varchar) end) as w_no, max(case when st = 'ok' then cast(trunc(price) as bigint) end) as w_amount, max(case when st = 'ok' then cast(quantity as int) + 0.5::double end) as w_rate from wr group by 1) w on w.rec = hn.record_id
left join (select rec, count(*) as c_n, max(cast(trunc(price) as bigint)) as c_amount, max({_DAY}) as c_day from cr group by 1) c on c.rec = hn.record_id
left join (select ln.rec, count(*) as r_n, max(ln.req) as r_no, max(case when n = 1 then s_name end) as r_name, max(case when n = 1 then s * 1000 end) as r_budget, max(case when n = 1 then cast(nat as varchar) end) as r_agency, max({_R_STATUS}) as r_status from ln join rr on rr.op = ln.op and rr.req = ln.req group by 1) r on r.rec = hn.record_id"""
add("m21_history_bundle", lambda s, d: _bundle(s, d)["notices"].select(*_SHOWN), _NOTICES_SQL)


def _files(s, d):
    """The six files, read back: rows, columns, and of each a sum over one column."""
    paths = H.write_files(_bundle(s, d), bind.folder(s, "history"))
    summed = {"notices": "winner_count", "bidders": "bid_amount_krw", "awards": "award_amount_krw", "contracts": "contract_amount_krw", "requests": "budget_amount_krw", "access": "service_id"}

    def one(name, path):
        t = s.read.csv(path, header=True, inferSchema=False, schema=", ".join(f"{c} string" for c in H.FILES[name]), enforceSchema=False)
        return t.agg(F.lit(name).alias("file"), F.lit(len(t.columns)).alias("columns"), F.count("*").alias("n"), F.coalesce(F.sum(F.col(summed[name]).cast("bigint")), F.lit(0)).alias("total"))

    return reduce(lambda a, b: a.unionByName(b), [one(*x) for x in paths.items()])


add("a14_write_history_csvs", _files, f"""select 'notices' as file, 55 as columns, count(*) as n, cast(coalesce(sum(winner_count), 0) as bigint) as total from ({_NOTICES_SQL})
union all select 'bidders', 15, 0, 0 union all select 'awards', 19, count(*), cast(sum(case when st = 'ok' then trunc(price) end) as bigint) from wr union all select 'contracts', 19, count(*), cast(sum(trunc(price)) as bigint) from cr
union all select 'requests', 16, count(*), cast(coalesce(sum(case when n = 1 then s * 1000 end), 0) as bigint) from rr union all select 'access', 10, count(*), cast(sum(n_nationkey) as bigint) from nation""")
