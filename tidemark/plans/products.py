"""Queries of filters, joins, aggregates, windows, orders, merges and data products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import text as T
from ..operators import classify as C
from ..operators import merge as M
from ..operators import payloads as P
from ..operators import tables as O
from . import bind

QUERIES: dict = {}
ORACLES: dict = {}
AT = f"timestamp '{bind.AS_OF}'"
DAYS = f"date_diff('day', date '{bind.AS_OF[:10]}', cast(deadline as date))"
LABEL = f"(case when {DAYS} = 0 then 'D-DAY' when {DAYS} between 1 and 7 then 'D-' || {DAYS} else '' end)"
ACTIVE = f"(deadline >= {AT})"
TIER = "(case tier when 'tier_1' then 0 when 'tier_2' then 1 when 'tier_3' then 2 else 3 end)"
START, START_SQL = F.expr, "(deadline - interval 40 day)"


def add(name, query, sql=None, *views):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (bind.sql(*views) if views else "") + sql


def of_notices(name, query, sql, *views):
    add(name, lambda s, d: query(view(s, d)), sql, "notices", *views)


def view(s, d):
    """Notices with what the products need: days, label, activity."""
    n = bind.notices(s, d)
    days = D.days_remaining(F.col("deadline"), bind.as_of())
    active = D.is_active(F.col("category"), F.col("deadline_at"), F.lit(""), F.lit(None).cast("timestamp"), bind.as_of())
    return n.withColumns({"days": days, "label": D.deadline_label(days), "active": active, "tier_rank": O.tier_rank(F.col("tier")).cast("int")})


N, A_, I, R, L = bind.notices, bind.attachments, bind.insights, bind.reviews, bind.deliveries
tz = bind.as_of
VISIBLE = "tier in ('tier_1', 'tier_2')"

# filters
of_notices("c14_recency_window", lambda n: n.filter((F.to_date("deadline") >= F.to_date(tz())) | (F.col("first_seen") >= tz() - F.expr("interval 30 days"))).select("id"), f"select id from notices where cast(deadline as date) >= date '2001-07-25' or first_seen >= {AT} - interval 30 day")
of_notices("c15_within_days_lenient", lambda n: n.filter(F.coalesce(D.parse_notice_ts(F.when(F.col("id") % 3 == 0, "unknown").otherwise(F.col("deadline_at"))) >= tz() - F.expr("interval 90 days"), F.lit(True))).select("id"), f"select id from notices where id % 3 = 0 or deadline >= {AT} - interval 90 day")
of_notices("c16_currently_open", lambda n: n.filter(F.col("deadline").isNull() | (F.col("deadline") >= tz())).select("id"), f"select id from notices where deadline >= {AT}")
of_notices("c17_is_active", lambda n: n.withColumn("t", F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, F.date_format("deadline", "yyyyMMdd")).otherwise(F.col("deadline_at"))).select("id", D.is_active(F.col("category"), F.col("t"), F.when(F.col("id") % 10 == 0, "접수 종료").otherwise(""), F.col("deadline") - F.expr("interval 40 days"), tz()).alias("is_active")),
           f"select id, case when category = 'grant_application' and (id % 10 = 0 or {START_SQL} > {AT}) then false when id % 7 = 0 then category <> 'grant_application' when id % 7 = 1 then cast(deadline as date) >= date '2001-07-25' else deadline >= {AT} end as is_active from notices")
of_notices("c18_is_upcoming", lambda n: n.select("id", D.is_upcoming(F.col("category"), F.col("deadline"), F.lit(""), F.col("deadline") - F.expr("interval 3 days"), tz()).alias("is_upcoming")), f"select id, category = 'grant_application' and deadline - interval 3 day > {AT} as is_upcoming from notices")
of_notices("c19_chronology_reject", lambda n: n.filter(~(F.col("deadline") < F.col("first_seen") + F.make_interval(days=(F.col("id") % 30).cast("int")))).select("id"), "select id from notices where not deadline < first_seen + to_days(cast(id % 30 as int))")
add("c20_host_allowlist", lambda s, d: bind.read(s, d, "pages").filter(F.col("url").startswith("https://") & F.lower(F.try_parse_url("url", F.lit("HOST"))).rlike(r"(^|\.)example\.net$") & F.col("url").contains("/en/")).select("page_id"), "select page_id from pages where url like 'https://%' and regexp_matches(regexp_extract(url, '://([^/?#:]*)', 1), '(^|\\.)example\\.net$') and contains(url, '/en/')")
of_notices("c21_list_filter", lambda n: n.filter("review_status = 'new' and tier = 'tier_1' and score >= 2").orderBy(F.desc("score"), "deadline_at", F.desc("first_seen"), "id").limit(50).select("id", "score"), "select id, score from notices where review_status = 'new' and tier = 'tier_1' and score >= 2 order by score desc, deadline_at, first_seen desc, id limit 50")
_counted = lambda rows: rows.orderBy("id").limit(25).crossJoin(rows.agg(F.count("*").alias("total"))).select("id", "total")
of_notices("c22_dashboard_filter", lambda n: _counted(n.filter(F.col("active") & T.normalize_text(F.col("title")).contains("high") & (F.col("label") != ""))), f"select id, count(*) over () as total from notices where {ACTIVE} and contains(lower(title), 'high') and {LABEL} <> '' order by id limit 25")
of_notices("c23_visible_filter", lambda n: n.filter(F.col("tier").isin("tier_1", "tier_2") & ~T.is_sample(F.col("source_id"), F.col("url"))).select("id"), f"select id from notices where {VISIBLE}")
of_notices("c24_not_historical", lambda n: n.filter(F.col("first_seen").isNull() | (F.to_date("first_seen") >= F.lit("2001-01-15").cast("date"))).select("id"), "select id from notices where cast(first_seen as date) >= date '2001-01-15'")
of_notices("c27_intake_review_flag", lambda n: n.filter("review_status = 'needs_review'").select("id", F.lit("review").alias("category"), F.concat(F.lit("check: "), "title").alias("note")), "select id, 'review' as category, 'check: ' || title as note from notices where review_status = 'needs_review'")

# joins
_DOCS_SQL = "select n.id, coalesce(a.id, 0) as attachment_id, case when a.id is null then 'missing' else 'other' end as kind, {0} as label from notices n left join attachments a on a.notice_id = n.id".format(LABEL)
add("d01_document_rows", lambda s, d: O.document_rows(N(s, d), A_(s, d), tz()).select("id", F.coalesce("attachment_id", F.lit(0)).alias("attachment_id"), "kind", F.col("deadline_label").alias("label")), _DOCS_SQL, "notices", "attachments")
add("d02_readable_semi", lambda s, d: O.readable(O.document_rows(N(s, d), A_(s, d), tz()), I(s, d)).select("id", "attachment_id"), "select n.id, a.id as attachment_id from notices n join attachments a on a.notice_id = n.id where exists (select 1 from insights i where i.notice_id = n.id and i.document_url = a.url and status = 'extracted' and summary <> '')", "notices", "attachments", "insights")
add("d03_insight_join", lambda s, d: I(s, d).join(N(s, d).select(F.col("id").alias("notice_id"), "tier"), "notice_id").join(A_(s, d).select("notice_id", "id", "label"), ["notice_id", "id"], "left").select("notice_id", "id", "status", "tier", "label"), "select i.notice_id, i.id, status, tier, label from insights i join notices n on n.id = i.notice_id left join attachments a on a.notice_id = i.notice_id and a.id = i.id", "notices", "attachments", "insights")
add("d04_review_join", lambda s, d: R(s, d).join(N(s, d).select(F.col("id").alias("notice_id"), "tier"), "notice_id").orderBy(O.tier_rank(F.col("tier")), "notice_id"), "select notice_id, fit, decision, tier from reviews join notices on id = notice_id", "notices", "reviews")
_REC_SQL = "(select cast(s_suppkey as varchar) as recipient from supplier where s_suppkey <= 5)"
_rec = lambda s, d: bind.read(s, d, "supplier").filter("s_suppkey <= 5").select(F.col("s_suppkey").cast("string").alias("recipient"))
_FRESH = "first_seen >= timestamp '2001-01-01' and score >= 2 and tier in ('tier_1', 'tier_2') and review_status not in ('needs_review', 'not_relevant', 'closed')"
add("d05_unnotified_anti", lambda s, d: O.unnotified(N(s, d), _rec(s, d), L(s, d), tz("2001-01-01 00:00:00"), 2, ("tier_1", "tier_2"), ("needs_review", "not_relevant", "closed")).select("id", "recipient"), f"select id, r.recipient from notices, {_REC_SQL} r where {_FRESH} and not exists (select 1 from deliveries l where l.key = cast(notices.id as varchar) and l.recipient = r.recipient and l.status = 'sent')", "notices", "deliveries")
of_notices("d06_since_filter", lambda n: n.filter(_FRESH).select("id"), f"select id from notices where {_FRESH}")


def _with_insights(s, d):
    docs = O.document_rows(N(s, d).filter(VISIBLE), A_(s, d), tz())
    found = I(s, d).select(F.col("notice_id").alias("id"), "document_url", "status", "summary").dropDuplicates(["id", "document_url"])
    return docs.join(found, ["id", "document_url"], "left").filter("status = 'extracted' and summary <> ''")


add("d07_documents_with_insights", lambda s, d: _with_insights(s, d).select("id", "attachment_id", "status"), f"select n.id, a.id as attachment_id, 'extracted' as status from notices n join attachments a on a.notice_id = n.id where {VISIBLE} and exists (select 1 from (select *, row_number() over (partition by notice_id, document_url order by id) as rn from insights) i where i.notice_id = n.id and i.document_url = a.url and status = 'extracted' and summary <> '')", "notices", "attachments", "insights")
_PAIR_ORDER = lambda: [F.desc("score"), F.col("deadline_at"), F.col("id")]
of_notices("d08_similar_pairs", lambda n: O.similar_pairs(n.filter("active"), _PAIR_ORDER(), considered=40), f"""select left_id, right_id, common from (
  select l.id as left_id, r.id as right_id, array_to_string(list_sort(list_intersect(l.keywords, r.keywords)), ',') as common, l.rn as a, r.rn as b from (select *, row_number() over (order by score desc, deadline_at, id) as rn from notices where {ACTIVE}) l,
  (select *, row_number() over (order by score desc, deadline_at, id) as rn from notices where {ACTIVE}) r where l.rn < r.rn and r.rn <= 40 and (len(list_intersect(l.keywords, r.keywords)) >= 2 or (len(list_intersect(l.keywords, r.keywords)) = 1 and l.buyer = r.buyer)) order by a, b limit 8)""")


def _history(s, d):
    return bind.read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("bid_no"), F.lpad((F.col("o_orderkey") % 10).cast("string"), 3, "0").alias("order"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("budget"))


def _details(s, d):
    a = A_(s, d)
    o = bind.read(s, d, "orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_custkey").cast("string").alias("bid_no"))
    return a.join(o, "notice_id").select("bid_no", F.when(F.col("id") == 1, (F.col("notice_id") % 10).cast("string")).otherwise("77").alias("order"), "notice_id", "id", F.col("price").cast("bigint").cast("string").alias("value"), F.when((F.col("line") == 3) & (F.col("quantity") > 40), "expected 3, got 2").otherwise("ok").alias("parse_status"))


_HIST = "h as (select cast(o_custkey as varchar) as bid_no, cast(o_orderkey % 10 as varchar) as k, max(o_orderkey) as record_id from orders group by 1, 2), det as (select cast(o_custkey as varchar) as bid_no, case when a.id = 1 then cast(notice_id % 10 as varchar) else '77' end as k, notice_id, a.id, cast(cast(round(price) as bigint) as varchar) as value, case when line = 3 and quantity > 40 then 'bad' else 'ok' end as parse_status from attachments a join orders on o_orderkey = notice_id)"
bind.SQL["hist"] = _HIST
add("d09_exact_order_link", lambda s, d: O.exact_link(_details(s, d), _history(s, d)).select("notice_id", "id", "record_id", "exact"), "select notice_id, id, coalesce(cast(record_id as varchar), '') as record_id, case when record_id is null then 'N' else 'Y' end as exact from det left join h using (bid_no, k)", "attachments", "hist")


def _requests(s, d):
    req = O.exact_link(_details(s, d), _history(s, d)).filter("exact = 'Y'").select("bid_no", (F.col("notice_id") % 3).alias("op"), F.col("value").alias("budget"))
    return req.groupBy("bid_no", "op").agg(F.count("*").alias("n"), F.max("budget").alias("b")).select("bid_no", "op", F.when(F.col("n") == 1, "filled").otherwise("multiple").alias("status"), F.when(F.col("n") == 1, F.col("b")).otherwise("").alias("budget"))


add("d10_request_link", _requests, "select bid_no, notice_id % 3 as op, case when count(*) = 1 then 'filled' else 'multiple' end as status, case when count(*) = 1 then max(cast(cast(trunc(price) as bigint) as varchar)) else '' end as budget from (select det.*, price from det join h using (bid_no, k) join attachments a on a.notice_id = det.notice_id and a.id = det.id) group by bid_no, notice_id % 3", "attachments", "hist")
add("d11_orphan_anti", lambda s, d: A_(s, d).join(N(s, d).filter("id % 4 <> 0").select(F.col("id").alias("notice_id")), "notice_id", "left_anti").select("notice_id", "id"), "select notice_id, id from attachments where notice_id not in (select id from notices where id % 4 <> 0)", "notices", "attachments")
_LINKS = lambda s, d: bind.read(s, d, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("ord", "a")).select("page_id", "url", "ord", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("text"))
bind.SQL["links"] = """links as (select page_id, url, unnest(range(len(m))) as ord, regexp_extract(unnest(m), 'href="([^"]*)"', 1) as href, regexp_extract(unnest(m), '>([^<]*)<', 1) as text from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') as m from pages))"""
add("a04_extract_links", lambda s, d: _LINKS(s, d).filter(~F.col("href").rlike("(?i)^(javascript|mailto|tel):")).select("page_id", "ord", "href", "text"), "select page_id, cast(ord as int) as ord, href, text from links where not regexp_matches(href, '(?i)^(javascript|mailto|tel):')", "links")
def _detail_pages(s, d):
    """Each listing page with the detail page of its URL: the first of those that hold the word,
    brought down to one a URL before the join."""
    pages = bind.read(s, d, "pages").select(T.canonical_url(F.col("url")).alias("u"), "page_id", "html")
    details = pages.filter(F.lower("html").contains("the")).groupBy("u").agg(F.min("page_id").alias("detail_id"))
    return pages.select("u", "page_id").join(details, "u").select("page_id", "detail_id")


add("d12_listing_detail_join", _detail_pages, "select l.page_id, r.detail_id from pages l join (select regexp_replace(url, '#.*$', '') as u, min(page_id) as detail_id from pages where contains(lower(html), 'the') group by 1) r on regexp_replace(l.url, '#.*$', '') = r.u")
_flagged = lambda s, d: _LINKS(s, d).withColumns({"is_notice": F.length("text") <= 3, "is_document": F.length("text") > 3})
add("d13_attach_follow_links", lambda s, d: O.attach_follow_links(_flagged(s, d)).select("page_id", "ord", "notice_ord"), "select page_id, cast(ord as int) as ord, cast(n as int) as notice_ord from (select *, max(case when length(text) <= 3 then ord end) over (partition by page_id order by ord) as n from links) where length(text) > 3", "links")
add("d14_official_attachments", lambda s, d: O.first_by(_LINKS(s, d).filter(F.col("text").contains("th")), ["page_id", "href"], F.col("ord")).select("page_id", "href", "ord"), "select page_id, href, cast(min(ord) as int) as ord from links where contains(text, 'th') group by 1, 2", "links")


def _nested(s, d):
    att = A_(s, d).groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "url"))).alias("attachments"))
    ins = I(s, d).groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("id", "status", "summary"))).alias("insights"))
    rev = R(s, d).select("notice_id", F.struct("fit", "decision").alias("review"))
    return N(s, d).withColumnRenamed("id", "notice_id").join(att, "notice_id", "left").join(ins, "notice_id", "left").join(rev, "notice_id", "left")


add("d15_nested_workbench", lambda s, d: _nested(s, d).select("notice_id", F.coalesce(F.size("attachments"), F.lit(0)).alias("n_attachments"), F.array_join("attachments.label", ",").alias("labels"), F.array_join("insights.status", ",").alias("statuses"), F.col("review.fit").alias("fit")), "select n.id as notice_id, (select cast(count(*) as int) from attachments a where a.notice_id = n.id) as n_attachments, (select string_agg(label, ',' order by id) from attachments a where a.notice_id = n.id) as labels, (select string_agg(status, ',' order by id) from insights a where a.notice_id = n.id) as statuses, fit from notices n left join reviews r on r.notice_id = n.id", "notices", "attachments", "insights", "reviews")


def _portal(s, d):
    comp = bind.read(s, d, "supplier").select(F.col("s_suppkey").alias("company")).orderBy("company").limit(20)
    hits = O.first_by(_LINKS(s, d).filter(F.col("text").contains("th")).withColumn("company", F.col("page_id") + 1), ["company", "ord"], F.col("href"))
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("company").orderBy("ord"))).filter("n <= 5").select("company", "ord", "href")
    return comp.join(top, "company", "left").select("company", F.coalesce("ord", F.lit(-1)).alias("ord"), F.when(F.col("href").isNull(), "no_candidate").otherwise("candidate").alias("status"))


_PORTAL = "p as (select c.company, coalesce(cast(ord as int), -1) as ord, case when href is null then 'no_candidate' else 'candidate' end as status from (select s_suppkey as company from supplier order by 1 limit 20) c left join (select *, row_number() over (partition by page_id order by ord) as n from links where contains(text, 'th')) l on l.page_id + 1 = c.company and n <= 5)"
bind.SQL["portal"] = _PORTAL
add("d16_portal_candidates", _portal, "select * from p", "links", "portal")
add("f09_top_n_per_company", lambda s, d: _portal(s, d).filter("status = 'candidate'").select("company", "ord"), "select company, ord from p where status = 'candidate'", "links", "portal")
add("e17_portal_status_counts", lambda s, d: _portal(s, d).groupBy("status").count(), "select status, count(*) as count from p group by 1", "links", "portal")

# aggregates
of_notices("e01_review_stats", lambda n: n.groupBy("review_status").count().orderBy(F.desc("count"), "review_status"), "select review_status, count(*) as count from notices group by 1")
of_notices("e02_tier_stats", lambda n: n.groupBy("tier").count().orderBy(O.tier_rank(F.col("tier"))), "select tier, count(*) as count from notices group by 1")


def _kind_summary(s, d):
    kinds = s.range(len(T.KINDS)).select(F.element_at(F.array(*map(F.lit, T.KINDS)), F.col("id").cast("int") + 1).alias("kind"))
    return kinds.join(O.document_rows(N(s, d), A_(s, d), tz()).groupBy("kind").count(), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("count"))


add("e03_kind_summary", _kind_summary, f"select k.kind, count(x.kind) as count from (select unnest({list(T.KINDS)}) as kind) k left join ({_DOCS_SQL}) x on x.kind = k.kind group by 1", "notices", "attachments")
add("e04_extraction_outcomes", lambda s, d: I(s, d).groupBy("status").count(), "select status, count(*) as count from insights group by 1", "attachments", "insights")
of_notices("e10_prune_audit", lambda n: n.agg(F.count_if(T.normalize_text(F.col("title")).contains("low")).alias("excluded"), F.count_if(~T.normalize_text(F.col("title")).contains("low") & (F.col("tier") == "unclassified")).alias("unrelated")), "select count_if(contains(lower(title), 'low')) as excluded, count_if(not contains(lower(title), 'low') and tier = 'unclassified') as unrelated from notices")
_YEAR = "(case when year(deadline) < 1996 then null else year(deadline) end)"
of_notices("e13_category_summary", lambda n: n.select(F.explode("keywords").alias("category"), "tier").groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.expr("tier = 'tier_1'")).alias("core")).orderBy(F.desc("total"), "category"), "select category, count(*) as total, count_if(tier = 'tier_1') as core from (select unnest(keywords) as category, tier from notices) group by 1")
add("e14_history_kpis", lambda s, d: N(s, d).agg(F.count("*").alias("total"), F.min("deadline_at").alias("first"), F.max("deadline_at").alias("last"), F.sum(F.when(F.year("deadline") >= 1996, F.col("budget").cast("bigint"))).alias("budget")).crossJoin(A_(s, d).agg(F.count_distinct("notice_id").alias("with_detail"))), f"select count(*) as total, min(deadline_at) as first, max(deadline_at) as last, cast(sum(case when {_YEAR} is not null then cast(budget as bigint) end) as bigint) as budget, (select count(distinct notice_id) from attachments) as with_detail from notices", "notices", "attachments")
add("e16_status_label_counts", lambda s, d: I(s, d).groupBy(T.labelled(F.col("status"), {"extracted": "done"}).alias("label")).count(), "select case status when 'extracted' then 'done' else status end as label, count(*) as count from insights group by 1", "attachments", "insights")
of_notices("e18_qa_distributions", lambda n: n.groupBy(F.coalesce(F.nullif(F.when(F.col("id") % 9 == 0, "").otherwise(F.col("source_id")), F.lit("")), F.lit("(blank)")).alias("value")).count().orderBy(F.desc("count"), "value"), "select case when id % 9 = 0 then '(blank)' else source_id end as value, count(*) as count from notices group by 1")
add("e19_search_term_set", lambda s, d: A_(s, d).groupBy("notice_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("terms")), "select notice_id, string_agg(distinct label, '; ' order by label) as terms from attachments group by 1", "attachments")
def _first_five(each, key, id_, name):
    """each (key, id, n), a row a pair: per key the sum of n and the five smallest ids."""
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(id_)))).filter("rn <= 5").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(id_)), ",").alias(name))
    total = each.groupBy(key).agg(F.sum("n").alias("n"))
    return total.join(first, total[key].eqNullSafe(first[key])).select(total[key], "n", name)


add("e20_request_links", lambda s, d: _first_five(A_(s, d).select("supp", "notice_id").distinct().withColumn("n", F.col("notice_id").isNotNull().cast("bigint")), "supp", "notice_id", "first"), "select supp, count(distinct notice_id) as n, array_to_string(list_sort(list(distinct notice_id))[1:5], ',') as first from attachments group by 1", "attachments")
_rollup = lambda s, d: O.single_detail_rollup(_history(s, d).select("record_id"), _details(s, d).withColumn("record_id", F.col("notice_id").cast("string")), "value")
add("e21_single_detail_rollup", lambda s, d: _rollup(s, d).select("record_id", "detail_count", "status", (F.col("value") != "").alias("filled")), "select cast(o_orderkey as varchar) as record_id, case when count_if(parse_status <> 'ok') = 0 and count(det.id) > 0 then count_if(parse_status = 'ok') end as detail_count, case when count(det.id) = 0 then 'none' when count_if(parse_status <> 'ok') > 0 then 'parse issue' when count_if(parse_status = 'ok') > 1 then 'multiple' else 'single' end as status, count(det.id) = 1 and count_if(parse_status <> 'ok') = 0 as filled from orders left join det on notice_id = o_orderkey group by o_orderkey", "attachments", "hist")
add("e22_status_min", lambda s, d: I(s, d).groupBy("notice_id").agg(F.min_by("status", O.ranked(F.col("status"), O.STATUS_ORDER)).alias("status")), "select notice_id, arg_min(status, case status when 'extracted' then 0 when 'processed_no_evidence' then 1 when 'missing_document_url' then 2 else 5 end) as status from insights group by 1", "attachments", "insights")
of_notices("e23_metadata_options", lambda n: n.select("review_status").distinct().orderBy("review_status"), "select distinct review_status from notices")
_SYNC = f"select source_id, count(*) as candidates, count_if({VISIBLE}) as accepted, count_if({VISIBLE} and first_seen >= timestamp '2001-01-01') as new from notices group by 1"
_sync = lambda n: n.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if(F.expr(VISIBLE)).alias("accepted"), F.count_if(F.expr(f"{VISIBLE} and first_seen >= timestamp '2001-01-01'")).alias("new"))
of_notices("e24_sync_metrics", _sync, _SYNC)

# windows
_EXACT_ORDER = ["stamp", "id"]
add("f01_latest_revision", lambda s, d: A_(s, d).groupBy("notice_id").agg(F.max_by("id", F.struct("stamp", -F.col("id"))).alias("kept")), "select notice_id, id as kept from (select *, row_number() over (partition by notice_id order by stamp desc, id) as rn from attachments) where rn = 1", "attachments")
add("f02_last_wins_dedup", lambda s, d: A_(s, d).groupBy("notice_id", "label").agg(F.max("id").alias("kept"), F.min("id").alias("position")), "select notice_id, label, max(id) as kept, min(id) as position from attachments group by 1, 2", "attachments")


def _round_robin(s, d):
    h = _history(s, d).groupBy("bid_no").agg(F.max(F.year("date")).alias("year"), F.max(F.col("status") == "P").alias("core"), F.max("date").alias("last"))
    all_ = O.placed(h, bind.folder(s, "years"), F.asc("year"), F.desc("core"), F.desc("last"), F.desc("bid_no"))
    first = all_.groupBy("year").agg(F.min("place").alias("first"))  # a row a year
    return all_.join(first, "year").select("bid_no", F.col("year").cast("bigint").alias("year"), (F.col("place") - F.col("first") + 1).cast("int").alias("rn")).orderBy("rn", F.desc("year"))


add("f03_year_round_robin", _round_robin, "select bid_no, year, cast(row_number() over (partition by year order by core desc, last desc, bid_no desc) as int) as rn from (select cast(o_custkey as varchar) as bid_no, max(year(o_orderdate)) as year, max(o_orderstatus = 'P') as core, max(o_orderdate) as last from orders group by 1)")
add("f04_primary_insight", lambda s, d: O.first_by(I(s, d).filter("summary <> ''"), ["notice_id"], O.ranked(F.col("status"), O.STATUS_ORDER), F.col("document_label"), F.col("id")).select("notice_id", "id"), "select notice_id, id from (select *, row_number() over (partition by notice_id order by case status when 'extracted' then 0 when 'processed_no_evidence' then 1 when 'missing_document_url' then 2 else 5 end, document_label, id) as rn from insights where summary <> '') where rn = 1", "attachments", "insights")
_PARAS = lambda s, d: bind.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "paragraph"))
bind.SQL["paras"] = r"paras as (select doc_id, unnest(range(len(p))) as seq, unnest(p) as paragraph, from (select doc_id, string_split(text, chr(10)) as p from documents)), lines as (select *, trim(regexp_replace(paragraph, '[\s\x{3000}\x{00A0}]+', ' ', 'g')) as line from paras), g as (select *, length(line) >= 18 and not regexp_matches(line, '^[0-9 .-]+$') as good from lines)"
_LABELS = (("token", "token"), ("The", "The"))
add("f05_amount_evidence", lambda s, d: O.amount_evidence(_PARAS(s, d), "doc_id", _LABELS, r"(\d+)(\d)").select("doc_id", "basis", "amount_text"), r"select doc_id, basis, amount_text from (select *, row_number() over (partition by doc_id order by r, seq) as rn from (select doc_id, seq, 0 as r, 'token' as basis, regexp_extract(regexp_extract(line, '(?:token)(.*)$', 1), '(\d+)(\d)', 0) as amount_text from lines union all select doc_id, seq, 1, 'The', regexp_extract(regexp_extract(line, '(?:The)(.*)$', 1), '(\d+)(\d)', 0) from lines) where amount_text <> '') where rn = 1", "paras")
add("f06_task_summary", lambda s, d: O.task_summary(_PARAS(s, d), "doc_id", ("nowhere",), ("the", "der")).select("doc_id", F.sha1("summary").alias("summary")), "select doc_id, sha1(case when length(x) <= 460 then x when strpos(x[1:460], '.') > 0 and 460 - strpos(reverse(x[1:460]), '.') >= 230 then x[1 : 461 - strpos(reverse(x[1:460]), '.')] else rtrim(x[1:459]) || '…' end) as summary from (select l.doc_id, coalesce((select string_agg(line, ' ' order by seq) from (select *, row_number() over (partition by doc_id order by seq) as rn from g where good and regexp_matches(paragraph, 'the|der')) c where c.doc_id = l.doc_id and rn <= 3), line) as x from lines l where seq = 0)", "paras")
add("f07_first_link_wins", lambda s, d: O.first_by(_LINKS(s, d), ["page_id", "href"], F.col("ord")).select("page_id", "ord"), "select page_id, cast(min(ord) as int) as ord from links group by page_id, href", "links")
add("f08_consecutive_dedup", lambda s, d: O.consecutive_dedup(_PARAS(s, d), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")), "select doc_id, count(*) as n from (select *, lag(paragraph) over (partition by doc_id order by seq) as b from paras) where b is null or b <> paragraph group by 1", "paras")
add("f10_duplicate_keys", lambda s, d: A_(s, d).groupBy("notice_id", "line").count().filter("count > 1").select("notice_id", "line", (F.col("count") - 1).alias("surplus")), "select notice_id, line, count(*) - 1 as surplus from attachments group by 1, 2 having count(*) > 1", "attachments")
of_notices("f11_sample_ids", lambda n: _first_five(n.groupBy("review_status", "id").agg(F.count("*").alias("n")), "review_status", "id", "samples"), "select review_status, count(*) as n, array_to_string(list_sort(list(distinct id))[1:5], ',') as samples from notices group by 1")
add("f12_attachment_dedup", lambda s, d: O.first_by(A_(s, d).withColumn("identity", T.attachment_identity(F.col("label"), F.col("url"))), ["notice_id", "identity"], F.col("id")).select("notice_id", "id"), "select notice_id, min(id) as id from attachments group by notice_id, label, line", "attachments")
add("f13_item_index", lambda s, d: _LINKS(s, d).select("page_id", "href", (F.col("ord") + 1).alias("item_index")), "select page_id, href, cast(ord + 1 as int) as item_index from links", "links")

# orders: every row with its place; two of them are limits
_ORDERS = {
    "g01_list_order": ("true", ["score desc", "deadline_at", "first_seen desc", "id"]), "g02_workbench_order": ("true", ["tier_rank", "score desc", "deadline_at", "id"]), "g03_tier_case_order": ("true", ["tier_rank", "deadline_at", "id"]),
    "g04_urgent_order": (f"active and {VISIBLE} and label <> ''", ["days", "tier_rank", "id"]), "g05_public_order": ("true", ["active desc", "tier_rank", "deadline_at", "id"]), "g06_new_rows_order": ("first_seen >= timestamp '2001-01-01'", ["active desc", "tier_rank", "deadline_at", "id"]),
    "g07_workbook_order": ("true", ["active desc", "tier_rank", "band", "deadline_at", "id"]), "g08_action_queue_topk": ("active", ["tier_rank", "days", "score desc", "id"]), "g09_history_order": ("true", ["deadline_at desc", "external_id desc"]),
    "g10_detail_order": ("true", ["buyer", "external_id"]), "g11_page_limit": ("active", ["id"]), "g12_weekly_alert_order": ("active and label <> ''", ["days", "tier_rank", "id"]),
}
_BAND = "case when label in ('D-DAY', 'D-1', 'D-2', 'D-3') then 0 when label <> '' then 1 else 2 end"
_LIMITS = {"g08_action_queue_topk": 100, "g11_page_limit": 100}


def _ordered(s, d, name, where, keys):
    rows = view(s, d).withColumn("band", F.expr(_BAND)).filter(where)
    cols = [F.desc(k[:-5]) if k.endswith(" desc") else F.asc(k) for k in keys]
    if name in _LIMITS:
        rows = rows.orderBy(*cols).limit(_LIMITS[name])
    return O.placed(rows, bind.folder(s, "order"), *cols).select("id", "place")


for _name, (_where, _keys) in _ORDERS.items():
    _limit = f" qualify place <= {_LIMITS[_name]}" if _name in _LIMITS else ""
    add(_name, lambda s, d, name=_name, where=_where, keys=_keys: _ordered(s, d, name, where, keys), f"select id, row_number() over (order by {', '.join(_keys)}) as place from (select *, {_BAND} as band from (select *, {DAYS} as days, {LABEL} as label, {ACTIVE} as active, {TIER} as tier_rank from notices)) where {_where}{_limit}", "notices")

# sets, generators, packed lists
of_notices("h01_union_sources", lambda n: n.filter("source_id = 'P'").select("id").unionByName(n.filter("source_id <> 'P'").select("id")).agg(F.count("*").alias("n")), "select count(*) as n from notices")
of_notices("h02_ordered_union_dedup", lambda n: O.first_by(n.filter("active and label <> ''").select("id", F.lit(0).alias("branch")).unionByName(n.filter("active and score >= 5").select("id", F.lit(1).alias("branch"))).unionByName(n.filter("active and review_status = 'watch'").select("id", F.lit(2).alias("branch"))), ["id"], F.col("branch")), f"select id, min(b) as branch from (select id, 0 as b from notices where {ACTIVE} and {LABEL} <> '' union all select id, 1 from notices where {ACTIVE} and score >= 5 union all select id, 2 from notices where {ACTIVE} and review_status = 'watch') group by 1")
of_notices("h03_three_way_scope", lambda n: n.filter("tier = 'tier_1'").select("id").unionByName(n.filter("tier = 'tier_2'").select("id")).unionByName(n.filter("id % 6 = 0").select("id").join(n.filter(VISIBLE).select("id"), "id", "left_anti")), f"select id from notices where {VISIBLE} or id % 6 = 0")
_MONTHS = lambda n: n.agg(F.to_date(F.min("deadline")).alias("a"), F.to_date(F.max("deadline")).alias("b")).select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("interval 1 month"))).alias("m")).select(F.greatest("a", "m").alias("start"), F.least("b", F.last_day("m")).alias("end"))
_MONTHS_SQL = "(select greatest(a, m) as start, least(b, last_day(m)) as \"end\" from (select a, b, cast(unnest(range(cast(date_trunc('month', a) as timestamp), cast(b as timestamp) + interval 1 day, interval 1 month)) as date) as m from (select cast(min(deadline) as date) as a, cast(max(deadline) as date) as b from notices)))"
_iso = lambda df: df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])
of_notices("h04_month_windows", lambda n: _iso(_MONTHS(n)), f'select cast(start as varchar) as start, cast("end" as varchar) as "end" from {_MONTHS_SQL}')
of_notices("h05_trailing_windows", lambda n: _iso(n.agg(F.to_date(F.max("deadline")).alias("b")).select(F.explode(F.sequence(F.lit(0), F.lit(89), F.lit(30))).alias("k"), "b").select(F.date_sub("b", F.least(F.lit(89), F.col("k") + 29)).alias("start"), F.date_sub("b", F.col("k")).alias("end"))), "select cast(b - (k + 29) as varchar) as start, cast(b - k as varchar) as \"end\" from (select cast(max(deadline) as date) as b from notices), (select unnest([0, 30, 60]) as k)")
of_notices("h06_window_term_grid", lambda n: n.select(F.col("source_id").alias("term")).distinct().crossJoin(F.broadcast(_MONTHS(n))).groupBy("term").count(), f"select term, count(*) as count from {_MONTHS_SQL}, (select distinct source_id as term from notices) group by 1")


def _packed(s, d):
    entry = F.when((F.col("line") == 3) & (F.col("quantity") > 40), F.concat(F.lit("["), "line", F.lit("^"), "supp", F.lit("]"))).otherwise(F.concat(F.lit("["), "line", F.lit("^"), "supp", F.lit("^"), F.col("price").cast("bigint"), F.lit("]")))
    return A_(s, d).groupBy("notice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), " , ").alias("packed"))


add("h07_packed_list_explode", lambda s, d: O.packed_rows(_packed(s, d), "packed", ["seq", "company", "amount"]).select("notice_id", "item_index", "company", "parse_status", "field_count"), "select notice_id, cast(id as int) as item_index, case when line = 3 and quantity > 40 then '' else cast(supp as varchar) end as company, case when line = 3 and quantity > 40 then 'expected 3, got 2' else 'ok' end as parse_status, case when line = 3 and quantity > 40 then 2 else 3 end as field_count from attachments", "attachments")
_awards = lambda s, d: O.packed_rows(_packed(s, d), "packed", ["seq", "company", "amount"]).withColumn("value", A.int_or_missing(F.col("amount")))
add("h08_winner_rows", lambda s, d: _awards(s, d).select("notice_id", "item_index", F.when((F.col("parse_status") == "ok") & F.col("value").isNull(), "invalid number").otherwise(F.col("parse_status")).alias("parse_status"), "value"), "select notice_id, cast(id as int) as item_index, case when line = 3 and quantity > 40 then 'expected 3, got 2' else 'ok' end as parse_status, case when not (line = 3 and quantity > 40) then cast(trunc(price) as bigint) end as value from attachments", "attachments")
add("h09_contract_rows", lambda s, d: _awards(s, d).filter("parse_status = 'ok'").groupBy("notice_id").agg(F.sum("value").alias("total")), "select notice_id, cast(sum(cast(trunc(price) as bigint)) as bigint) as total from attachments where not (line = 3 and quantity > 40) group by 1", "attachments")
of_notices("h10_request_rows", lambda n: n.select("id", F.when(F.col("title").contains("URGENT"), "technical").otherwise("general").alias("op"), F.when(~F.col("title").contains("URGENT"), A.int_or_missing(F.col("budget"))).alias("general_budget"), F.when(F.col("title").contains("URGENT"), A.int_or_missing(F.col("budget"))).alias("technical_budget")), "select id, case when contains(title, 'URGENT') then 'technical' else 'general' end as op, case when not contains(title, 'URGENT') then cast(budget as bigint) end as general_budget, case when contains(title, 'URGENT') then cast(budget as bigint) end as technical_budget from notices")


def _spec(s, d):
    urls = F.from_json("props", "map<string,string>")
    e = bind.read(s, d, "events").withColumn("e", F.explode(F.map_entries(urls))).select("event_id", F.concat(F.lit("http://f/"), "e.key", F.lit("."), F.lit("pdf")).alias("url"), F.col("e.value").alias("label"))
    return e.dropDuplicates(["event_id", "url"]).withColumn("file_type", T.file_extension(F.col("url")))


add("h11_spec_attachments", _spec, "select event_id, 'http://f/k.pdf' as url, json_extract_string(props, '$.k') as label, 'pdf' as file_type from events")
add("h12_missing_row_drop", lambda s, d: I(s, d).filter("summary <> ''").unionByName(I(s, d).filter("summary = ''").join(A_(s, d).select("notice_id").distinct(), "notice_id", "left_anti").select(*["notice_id", "id", "document_url", "document_label", "status", "summary"])).select("notice_id", "id"), "select notice_id, id from insights where summary <> ''", "attachments", "insights")
of_notices("h13_history_notice_rows", lambda n: n.select(A.notice_identity(F.col("buyer"), F.lpad((F.col("id") % 10).cast("string"), 3, "0")).alias("record_id"), F.col("id"), F.year("deadline").cast("bigint").alias("year"), F.when(F.col("id") % 2 == 0, "not collected").otherwise("pending").alias("data_status")), "select buyer || '-' || lpad(cast(id % 10 as varchar), 3, '0') as record_id, id, year(deadline) as year, case when id % 2 = 0 then 'not collected' else 'pending' end as data_status from notices")

# payloads and companies


def _grants(s, d):
    n, key = N(s, d), F.col("id")
    end = F.when(key % 11 == 0, F.date_sub(F.to_date("first_seen"), 3)).otherwise(F.to_date("deadline"))
    items = n.select(
        "id", F.col("external_id"), F.when(key % 2 == 0, "탄소중립 설비 지원사업 모집 공고").when(key % 10 == 5, "탄소중립 설명회 모집 공고").otherwise(F.col("title")).alias("title"),
        F.concat(F.when(key % 3 == 0, "https://www.grants.example/n/").when(key % 3 == 1, "https://GRANTS.example/n/").when(key % 6 == 2, "http://grants.example/n/").otherwise("https://xgrants.example/n/"), key).alias("url"),
        F.date_format("first_seen", "yyyy.MM.dd").alias("published_at"), F.when(key % 7 == 0, "상시").otherwise(F.concat(F.date_format(F.date_sub(end, 10), "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(end, "yyyy.MM.dd"))).alias("window"),
    )
    return O.grant_items(items, tz(), 60, "grants.example").filter(C.portfolio_grant(F.col("title"))).select("id", "title", "published_at", "start_at", "deadline_at")


add("a03_map_grant_item", _grants, """select id, '탄소중립 설비 지원사업 모집 공고' as title, strftime(first_seen, '%Y-%m-%d') as published_at, case when id % 7 = 0 then '' else strftime(e - 10, '%Y-%m-%d') end as start_at, case when id % 7 = 0 then '' else strftime(e, '%Y-%m-%d') end as deadline_at
  from (select *, case when id % 11 = 0 then cast(first_seen as date) - 3 else cast(deadline as date) end as e from notices) where id % 2 = 0 and id % 3 < 2 and (id % 7 = 0 or e >= cast(first_seen as date)) and ((id % 7 <> 0 and e >= date '2001-07-25') or cast(first_seen as date) >= date '2001-07-25' - 60)""", "notices")
add("a16_company_sources", lambda s, d: bind.read(s, d, "supplier").filter("s_name <> ''").orderBy("s_suppkey").limit(50).select(F.concat(F.lit("company_"), T.pad_ticker(F.col("s_suppkey").cast("string"))).alias("source_id"), F.lit(False).alias("enabled")), "select 'company_' || lpad(cast(s_suppkey as varchar), 6, '0') as source_id, false as enabled from supplier where s_name <> '' order by s_suppkey limit 50")

# merges
_current = lambda s, d: N(s, d).filter("id % 3 <> 0").withColumn("last_seen", F.col("first_seen"))
_coming = lambda s, d: N(s, d).filter("id % 2 = 0").withColumns({"title": F.concat("title", F.lit("*")), "tier": F.lit("tier_3"), "tier_source": F.lit("automatic"), "last_seen": F.col("first_seen")})
add("i01_upsert_notices", lambda s, d: M.upsert_notices(_current(s, d), _coming(s, d), tz()).select("id", "title", "tier", "tier_source", "change", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen")),
    "select id, case when id % 2 = 0 then title || '*' else title end as title, case when id % 2 = 0 and (id % 3 = 0 or tier_source <> 'manual') then 'tier_3' else tier end as tier, case when id % 2 = 0 and id % 3 = 0 then 'automatic' else tier_source end as tier_source, case when id % 3 = 0 then 'inserted' when id % 2 = 0 then 'updated' else 'kept' end as change, case when id % 3 = 0 then '2001-07-25' else strftime(first_seen, '%Y-%m-%d') end as first_seen from notices where id % 3 <> 0 or id % 2 = 0", "notices")
_slim = lambda s, d: A_(s, d).select("notice_id", "id", "label", "url")
_upd = lambda s, d: M.upsert_attachments(_slim(s, d).filter("id <= 4"), _slim(s, d).filter("id >= 4"))
add("i02_upsert_attachments", lambda s, d: _upd(s, d).groupBy("change").count(), "select change, count(*) as count from (select case when i is null then 'kept' when c is null then 'inserted' else 'updated' end as change from (select notice_id, label, line, min(case when id <= 4 then id end) as c, min(case when id >= 4 then id end) as i from attachments group by 1, 2, 3) union all select 'deduplicated' from (select *, row_number() over (partition by notice_id, label, line order by id) as rn from attachments where id <= 4) where rn > 1) group by 1", "attachments")


def _fit(s, d):
    patch = N(s, d).filter("id % 14 = 0 or id % 10 = 1").select(F.col("id").alias("notice_id"), F.when(F.col("id") % 2 == 0, "medium").otherwise("bogus").alias("fit"), F.lit(None).cast("string").alias("decision"))
    return M.upsert_fit_review(R(s, d), patch, N(s, d), {"fit": "not_reviewed", "decision": "pending"}, {"fit": ("high", "medium", "low")})[0]


add("i04_upsert_fit_review", _fit, "select id as notice_id, case when id % 14 = 0 then 'medium' else 'low' end as fit, 'pending' as decision from notices where id % 7 = 0", "notices")
_patch = lambda n, **values: n.filter("id % 5 = 0").withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).select("id", "arrival", *[v.alias(k) for k, v in values.items()])
of_notices("i05_set_review", lambda n: M.set_review(n.withColumn("review_note", F.lit("old")), _patch(n, review_status=F.when(F.col("arrival") == 2, "won").otherwise("lost"), note=F.concat(F.lit("by "), "buyer", F.lit(" "), "arrival"))).select("id", "review_status", "review_note"),
           "select id, case when id % 5 = 0 then 'won' else review_status end as review_status, case when id % 5 = 0 then 'by ' || buyer || ' 2' else 'old' end as review_note from notices")
of_notices("i06_set_tier", lambda n: M.set_tier(n.withColumn("tier_reason", F.lit("old")), _patch(n, tier=F.concat(F.lit("tier_"), "arrival"), reason=F.when((F.col("id") % 2 == 0) & (F.col("arrival") == 2), " ").otherwise(F.concat(F.lit(" why "), "buyer")))).select("id", "tier", "tier_source", "tier_reason"),
           "select id, case when id % 10 = 0 then 'tier_1' when id % 5 = 0 then 'tier_2' else tier end as tier, case when id % 5 = 0 then 'manual' else tier_source end as tier_source, case when id % 5 = 0 then 'why ' || buyer else 'old' end as tier_reason from notices")


def _cascade(s, d):
    led = N(s, d).select(F.col("id").alias("notice_id"))
    out = M.delete_cascade(N(s, d), {"attachments": A_(s, d), "insights": I(s, d), "reviews": R(s, d)}, led, N(s, d).filter("id % 5 = 0"))
    counts = [t.agg(F.lit(k).alias("table"), F.count("*").alias("n"), F.count("notice_id" if "notice_id" in t.columns else "id").alias("linked")) for k, t in sorted(out.items())]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


add("i07_delete_cascade", _cascade, "select 'attachments' as \"table\", count(*) as n, count(*) as linked from attachments where notice_id % 5 <> 0 union all select 'deliveries', count(*), count_if(id % 5 <> 0) from notices union all select 'insights', count(*), count(*) from insights where notice_id % 5 <> 0 union all select 'notices', count(*), count(*) from notices where id % 5 <> 0 union all select 'reviews', count(*), count(*) from reviews where notice_id % 5 <> 0", "notices", "attachments", "insights", "reviews")
add("i10_prune", lambda s, d: M.delete_cascade(N(s, d), {"attachments": A_(s, d)}, N(s, d).select(F.col("id").alias("notice_id")), N(s, d).filter(T.normalize_text(F.col("title")).contains("low")))["attachments"].select("notice_id", "id"), "select notice_id, id from attachments where notice_id not in (select id from notices where contains(lower(title), 'low'))", "notices", "attachments")


def _answers(s, d):
    """The answers that one source's notices were made from: ten links each, with other tokens than
    the stored ones, the first also under a key without a number. A board has the same ones."""
    n, url = F.pmod(F.col("id") - 1, F.lit(P.SPEC_PAIRS)) + 1, F.concat("url", F.lit("&as="), "id", F.lit(".pdf"))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    e = F.filter(F.array(entry(F.concat(F.lit(P.SPEC_URL), n), url), entry(F.concat(F.lit(P.SPEC_NAME), n), F.col("label")), F.when(n == 1, entry(F.lit("stdNtceDocUrl"), url))), lambda x: x.isNotNull())
    said = A_(s, d).groupBy("notice_id", F.floor((F.col("id") - 1) / P.SPEC_PAIRS).alias("part")).agg(F.to_json(F.map_from_entries(F.flatten(F.collect_list(e)))).alias("raw_json"))
    of = lambda i, source: said.select(i.alias("id"), F.lit(source).alias("source_id"), "raw_json")
    return of(F.col("notice_id"), "g2b_bids").unionByName(of(-F.col("notice_id"), "board"))


def _backfilled(s, d):
    """A second backfill out of the same answers: all links are there and none comes twice."""
    stored = _slim(s, d).filter("id <= 4")
    came = bind.kept(P.saved_links(_answers(s, d), "g2b_").select(*stored.columns), "links")
    first = M.upsert_attachments(stored, came, named_only=True).filter("change <> 'deduplicated'")
    return M.upsert_attachments(first.select(*stored.columns), came, named_only=True)


add("i11_backfill_attachments", lambda s, d: _backfilled(s, d).groupBy("change").count(), "select 'updated' as change, count(*) as count from (select distinct notice_id, label, line from attachments)", "attachments")
add("i12_record_delivery", lambda s, d: M.record_delivery(L(s, d), L(s, d).filter("status = 'failed'").withColumn("status", F.lit("sent")), tz(bind.EVENTS_AS_OF)).groupBy("status", "change").count(), "select 'sent' as status, case when status = 'failed' then 'updated' else 'kept' end as change, count(*) as count from deliveries group by 2", "deliveries")
of_notices("i13_add_missing_columns", lambda n: M.add_missing_columns(n.select("id"), {"note": "", "id": 0}), "select id, '' as note from notices")
_base = lambda n, where: M.baseline(n.filter(where).select(F.col("deadline").alias("baseline_at")), tz()).select(F.date_format("baseline_at", "yyyy-MM-dd HH:mm:ss").alias("baseline_at"), "first")
of_notices("i14_baseline", lambda n: _base(n, "id < 0").unionByName(_base(n, "id % 5 = 0")), f"select '{bind.AS_OF}' as baseline_at, true as first union all select strftime(max(deadline), '%Y-%m-%d %H:%M:%S'), false from notices where id % 5 = 0")

# data products
of_notices("m01_notice_view", lambda n: n.select("id", "days", F.when(F.col("active"), F.col("label")).otherwise("").alias("label"), "active", F.array_join(F.array_sort("keywords"), ",").alias("keywords")), f"select id, cast({DAYS} as int) as days, case when {ACTIVE} then {LABEL} else '' end as label, {ACTIVE} as active, array_to_string(list_sort(keywords), ',') as keywords from notices")
_ELIGIBLE = "active and tier in ('tier_1', 'tier_2') and review_status not in ('needs_review', 'closed', 'not_relevant')"


def _workbench(s, d):
    best = O.first_by(I(s, d).filter("summary <> ''"), ["notice_id"], O.ranked(F.col("status"), O.STATUS_ORDER), F.col("document_label"), F.col("id")).select(F.col("notice_id").alias("id"), F.col("summary"), F.col("status").alias("document_status"))
    return view(s, d).filter(VISIBLE).join(best, "id", "left").join(R(s, d).withColumnRenamed("notice_id", "id"), "id", "left").withColumn("fit", F.coalesce("fit", F.lit("not_reviewed")))


bind.SQL["bench"] = f"best as (select * from (select notice_id, summary, status, row_number() over (partition by notice_id order by case status when 'extracted' then 0 when 'processed_no_evidence' then 1 when 'missing_document_url' then 2 else 5 end, document_label, id) as rn from insights where summary <> '') where rn = 1), bench as (select n.*, {DAYS} as days, {LABEL} as label, {ACTIVE} as active, {TIER} as tier_rank, b.summary, b.status as document_status, coalesce(fit, 'not_reviewed') as fit from notices n left join best b on b.notice_id = n.id left join reviews r on r.notice_id = n.id where {VISIBLE})"
_BV = ("notices", "attachments", "insights", "reviews", "bench")
bench = lambda name, q, sql: add(name, lambda s, d: q(_workbench(s, d)), sql, *_BV)
of_notices("m06_urgent_list", lambda n: n.filter(f"active and {VISIBLE} and label <> ''").select("id", "label"), f"select id, {LABEL} as label from notices where {ACTIVE} and {VISIBLE} and {LABEL} <> ''")
of_notices("m07_upcoming_list", lambda n: n.filter(D.is_upcoming(F.col("category"), F.col("deadline"), F.lit(""), F.col("deadline") - F.expr("interval 3 days"), tz()) & (F.col("tier") == "tier_1")).select("id"), f"select id from notices where category = 'grant_application' and tier = 'tier_1' and deadline - interval 3 day > {AT}")
of_notices("m08_priority_list", lambda n: n.filter("tier = 'tier_1' and active and review_status not in ('not_relevant', 'lost', 'closed')").select("id"), f"select id from notices where tier = 'tier_1' and {ACTIVE} and review_status not in ('not_relevant', 'lost', 'closed')")
of_notices("m09_grant_counts", lambda n: n.filter("category = 'grant_application'").agg(F.count("*").alias("total"), F.count_if(F.col("active")).alias("active")), f"select count(*) as total, count_if({ACTIVE}) as active from notices where category = 'grant_application'")
of_notices("m10_active_rows", lambda n: n.filter("active and review_status not in ('not_relevant', 'closed')").select("id"), f"select id from notices where {ACTIVE} and review_status not in ('not_relevant', 'closed')")
add("m11_immediate_batch", lambda s, d: O.unnotified(N(s, d), _rec(s, d), L(s, d), tz("2001-01-01 00:00:00"), 0, ("tier_1",), ("needs_review", "not_relevant", "closed")).groupBy("recipient").count(), f"select r.recipient, count(*) as count from notices, {_REC_SQL} r where first_seen >= timestamp '2001-01-01' and tier = 'tier_1' and review_status not in ('needs_review', 'not_relevant', 'closed') and not exists (select 1 from deliveries l where l.key = cast(notices.id as varchar) and l.recipient = r.recipient and l.status = 'sent') group by 1", "notices", "deliveries")
_NEW = "(tier = 'tier_1' and cast(first_seen as date) = date '2001-07-15')"
of_notices("m12_daily_sections", lambda n: n.filter(f"active and {VISIBLE}").select("id", F.when(F.expr(_NEW), "new").otherwise("ongoing").alias("section")), f"select id, case when {_NEW} then 'new' else 'ongoing' end as section from notices where {ACTIVE} and {VISIBLE}")
of_notices("m13_weekly_digest", lambda n: n.filter(f"active and {VISIBLE} and review_status not in ('not_relevant', 'closed')").groupBy("tier").agg(F.count("*").alias("items"), F.count_if(F.expr(_NEW)).alias("new"), F.count_if(F.expr("label <> ''")).alias("alerts")), f"select tier, count(*) as items, count_if({_NEW}) as new, count_if({LABEL} <> '') as alerts from notices where {ACTIVE} and {VISIBLE} and review_status not in ('not_relevant', 'closed') group by 1")
of_notices("m14_group_by_tier", lambda n: n.filter("active").select("tier", "id").orderBy(O.tier_rank(F.col("tier")), "id"), f"select tier, id from notices where {ACTIVE}")
_WEEK = lambda: D.iso_week_key(F.col("deadline")).alias("key")
_SENT = lambda s, d: N(s, d).filter("id % 997 = 0").select(_WEEK()).distinct().crossJoin(_rec(s, d).filter("recipient <> '3'"))
add("m15_digest_due", lambda s, d: N(s, d).select(_WEEK()).distinct().crossJoin(_rec(s, d)).join(_SENT(s, d), ["key", "recipient"], "left_anti"), f"select distinct strftime(deadline, '%G-W%V') as key, recipient from notices, {_REC_SQL} r where recipient = '3' or strftime(deadline, '%G-W%V') not in (select strftime(deadline, '%G-W%V') from notices where id % 997 = 0)", "notices")
bench("m16_workbook_notices", lambda w: w.select("id", "tier", "active", "label", "fit"), "select id, tier, active, label, fit from bench")
add("m17_documents", lambda s, d: _with_insights(s, d).select("id", F.col("attachment_id").alias("document"), "summary"), f"select n.id, a.id as document, i.summary from notices n join attachments a on a.notice_id = n.id join (select notice_id, document_url, any_value(status) as status, any_value(summary) as summary from insights group by 1, 2) i on i.notice_id = n.id and i.document_url = a.url where {VISIBLE} and i.status = 'extracted' and i.summary <> ''", "notices", "attachments", "insights")
add("m18_fallback", lambda s, d: _workbench(s, d).filter("summary is null").join(O.first_by(A_(s, d), ["notice_id"], F.col("id")).select(F.col("notice_id").alias("id"), F.col("url").alias("link")), "id", "left").select("id", F.coalesce("link", "url").alias("link")), "select b.id, coalesce(a.url, b.url) as link from bench b left join attachments a on a.notice_id = b.id and a.id = 1 where summary is null", *_BV)
bench("m19_new", lambda w: w.filter("first_seen >= timestamp '2001-06-01'").select("id", "tier"), "select id, tier from bench where first_seen >= timestamp '2001-06-01'")
bench("m20_fit", lambda w: w.filter("fit <> 'not_reviewed'").select("id", "fit", "decision"), "select id, fit, 'pending' as decision from bench where fit <> 'not_reviewed'")
add("m22_enrichment_outcome", lambda s, d: O.exact_link(_details(s, d), _history(s, d)).agg(F.count("*").alias("lookups"), F.count_if(F.expr("exact = 'N'")).alias("unmatched"), F.count_if(F.expr("parse_status <> 'ok'")).alias("malformed")), "select count(*) as lookups, count_if(record_id is null) as unmatched, count_if(parse_status <> 'ok') as malformed from det left join h using (bid_no, k)", "attachments", "hist")
add("m23_access_status", lambda s, d: bind.read(s, d, "events").withColumn("code", F.get_json_object("props", "$.k").cast("bigint")).groupBy(F.when(F.col("code") % 4 == 0, "usable").when(F.col("code") % 4 == 1, "apply").when(F.col("code") % 4 == 2, "permission").otherwise("error").alias("status")).count(), "select case cast(json_extract(props, '$.k') as bigint) % 4 when 0 then 'usable' when 1 then 'apply' when 2 then 'permission' else 'error' end as status, count(*) as count from events group by 1")
of_notices("m24_grant_check", lambda n: n.filter("category = 'grant_application'").groupBy("source_id").agg(F.count("*").alias("grants"), F.count_if(F.expr("tier = 'tier_2'")).alias("tier_2"), F.count_if(F.col("active")).alias("open")), f"select source_id, count(*) as grants, count_if(tier = 'tier_2') as tier_2, count_if({ACTIVE}) as open from notices where category = 'grant_application' group by 1")
