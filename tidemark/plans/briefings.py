"""Queries of the briefing, the public projection and the audits by title rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as Audits
from ..operators import briefing as B
from ..operators import classify as C
from ..operators import workbench as W
from . import bind

QUERIES: dict = {}
ORACLES: dict = {}
AS_OF = "2001-07-10 10:00:00"  # a day on which notices were first seen
LIMIT = 20
_DAYS = f"date_diff('day', date '{AS_OF[:10]}', cast(deadline as date))"
bind.SQL["briefed"] = f"""briefed as (select *, eligible and cast(first_seen as date) = date '{AS_OF[:10]}' as new_today, eligible and days between 0 and 7 as urgent, eligible and label <> '' as due, eligible and documents = 0 as missing,
  eligible and review_status in ('watch', 'interesting') as watched, eligible and documents = 0 and score >= 5 as high_missing from (select *, score >= 3 and deadline >= timestamp '{AS_OF}' and review_status not in ('not_relevant', 'closed', 'needs_review') as eligible from (
  select n.*, cast({_DAYS} as int) as days, case when deadline < timestamp '{AS_OF}' then '' when {_DAYS} = 0 then 'D-DAY' when {_DAYS} between 1 and 7 then 'D-' || {_DAYS} else '' end as label, coalesce(a.documents, 0) as documents from notices n left join (select notice_id, count(*) as documents from attachments group by 1) a on a.notice_id = n.id where tier in ('tier_1', 'tier_2'))))"""
_VIEWS = ("notices", "attachments", "briefed")
_SHOWN = ", ".join(B.SHOWN)
_LISTED = "score desc, deadline_at, first_seen desc, id"
_BRANCH = "case when urgent then 0 when new_today then 1 when high_missing then 2 when watched then 3 end"
_QUEUE = f"tier, days is null, days, score desc, {_BRANCH}, deadline_at, first_seen desc, id"


def add(name, query, sql, *views):
    QUERIES[name], ORACLES[name] = query, bind.sql(*views) + sql


def flagged(s, d):
    return B.flagged(bind.notices(s, d), bind.attachments(s, d), bind.as_of(AS_OF))


add("e07_briefing_summary", lambda s, d: B.counts(flagged(s, d)), "select count(*) as total_notices, count_if(eligible) as eligible_notices, count_if(new_today) as new_today, count_if(eligible and review_status = 'new') as unreviewed, count_if(urgent) as urgent, count_if(missing) as missing_documents, count_if(watched) as watching, count_if(eligible and tier = 'tier_1') as tier_1, count_if(eligible and tier = 'tier_2') as tier_2 from briefed", *_VIEWS)
add("m02_action_queue", lambda s, d: B.action_queue(flagged(s, d), LIMIT), f"select {_SHOWN} from briefed where {_BRANCH} is not null order by {_QUEUE} limit {LIMIT}", *_VIEWS)


def _list(section, where, order, limit=True):
    cut = f" qualify place <= {LIMIT}" if limit else ""
    return f"(select '{section}' as section, row_number() over (order by {order}) as place, {_SHOWN} from briefed where {where}{cut})"


add("m02_briefing", lambda s, d: B.lists(flagged(s, d), LIMIT, bind.folder(s, "due")), " union all ".join((
    _list("action_queue", f"{_BRANCH} is not null", _QUEUE), _list("new_today", "new_today", _LISTED), _list("urgent", "urgent", _LISTED), _list("missing_documents", "missing", _LISTED), _list("deadline_priority", "due", _LISTED, False))), *_VIEWS)


def workbench(s, d, tiers=B.VISIBLE):
    """Notices with nested links and insights, some without a public link, and inner columns."""
    a = bind.attachments(s, d)
    url = F.when(F.col("line") % 4 == 3, "").when(F.col("line") % 4 == 2, F.concat(F.lit("ftp://h/"), "part")).otherwise(F.col("url"))
    label = F.when(F.col("part") % 3 == 0, "과업지시서").when(F.col("part") % 3 == 1, "제안요청서").otherwise(F.col("label"))
    links = a.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("id", label.alias("label"), url.alias("url"), F.lit("hwpx").alias("file_type")))).alias("attachments"))
    status = F.when(F.col("supp") % 4 < 2, "extracted").when(F.col("supp") % 4 == 2, "missing_document_url").otherwise("download_failed")
    summary = F.when(F.col("quantity") < 10, " ").otherwise(F.concat(F.lit("task "), "part"))
    found = a.filter("id <= 3").groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("id", label.alias("document_label"), url.alias("document_url"), status.alias("status"), summary.alias("summary"), F.lit("/inner/path").alias("cache_path")))).alias("insights"))
    n = B.flagged(bind.notices(s, d), a, bind.as_of(AS_OF), tiers=tiers)
    n = n.withColumns({"tiered_at": F.when(F.col("id") % 2 == 0, bind.as_of(AS_OF)), "active": F.col("deadline") >= bind.as_of(AS_OF), "new_today": F.to_date("first_seen") == F.lit(AS_OF[:10]).cast("date"), "source_id": F.when(F.col("id") % 17 == 0, "sample_x").otherwise(F.col("source_id")), "review_note": F.lit("inner")})
    n = n.withColumn("new_tier_1", F.col("new_today") & F.col("active") & (F.col("tier") == "tier_1"))
    key = lambda x: x.withColumnRenamed("notice_id", "id")
    return n.join(key(links), "id", "left").join(key(found), "id", "left")


_PUBLIC = ["id", "title", "url", "tier", "active", "new_today", "new_tier_1", "label"]
_HTTP = "line % 4 not in (2, 3)"
_LABEL = "case when part % 3 = 0 then '과업지시서' when part % 3 = 1 then '제안요청서' else label end"
_READ = "supp % 4 < 2 and quantity >= 10"
bind.SQL["shown"] = f"""shown as (select n.*, deadline >= timestamp '{AS_OF}' as is_active, cast(first_seen as date) = date '{AS_OF[:10]}' as is_new from briefed n where id % 17 <> 0)"""
bind.SQL["linked"] = f"linked as (select *, {_LABEL} as name from attachments where {_HTTP})"


def _projection(s, d):
    p = B.public_notices(workbench(s, d), _PUBLIC)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[f] for f in (B.PUBLIC_LINK if c == "attachments" else B.PUBLIC_INSIGHT)])), ";")
    return p.select("id", "title", "url", "tier", "active", "new_today", "document_status", text("attachments").alias("attachments"), text("insights").alias("insights"), F.col("primary.document_label").alias("primary_label"), F.col("primary.summary").alias("primary_summary"))


_I = "(case when supp % 4 < 2 then 'extracted' when supp % 4 = 2 then 'missing_document_url' else 'download_failed' end)"
_S = "(case when quantity < 10 then ' ' else 'task ' || part end)"
add("m04_public_projection", _projection, f"""select n.id, title, n.url, tier, is_active as active, is_new as new_today, coalesce(document_status, 'not_attempted') as document_status, coalesce(attachments, '') as attachments, coalesce(insights, '') as insights, primary_label, primary_summary
  from shown n left join (select notice_id, case when count_if({_READ} and id <= 3) > 0 then 'extracted' else 'fallback_notice_info' end as document_status, string_agg(name || '|' || url || '|hwpx', ';' order by id) as attachments,
  string_agg(url || '|' || name || '|' || {_I} || '|' || {_S}, ';' order by id) filter (id <= 3) as insights,
  (list(name order by case part % 3 when 1 then 0 when 0 then 1 else 3 end, name, url, {_S}) filter ({_READ} and id <= 3))[1] as primary_label,
  (list({_S} order by case part % 3 when 1 then 0 when 0 then 1 else 3 end, name, url, {_S}) filter ({_READ} and id <= 3))[1] as primary_summary from linked group by 1) a on a.notice_id = n.id""", *_VIEWS, "shown", "linked")
add("e06_public_summary", lambda s, d: B.public_counts(B.public_notices(workbench(s, d), _PUBLIC)), """select count(*) as total_notices, count_if(is_active) as active_notices, count_if(is_active and tier = 'tier_1') as active_tier_1, count_if(is_active and tier = 'tier_2') as active_tier_2, 0 as active_tier_3,
  count_if(is_new) as new_today, count_if(is_new and is_active and tier = 'tier_1') as new_tier_1_today, count_if(is_new and is_active) as new_active_today, (select count(*) from linked a join shown n on n.id = a.notice_id where a.id <= 3 and supp % 4 < 2) as extracted_documents,
  count_if(label = 'D-7') as deadline_d7, count_if(label = 'D-3') as deadline_d3, (select count(distinct a.url) from linked a join shown n on n.id = a.notice_id) as public_document_links from shown""", *_VIEWS, "shown", "linked")

# Rules for the titles at hand: urgent work is tier 1, high equipment tier 2, low is nothing to advise on.
_TERMS = C.TierTerms(non_consulting=("low",), domain_1=("urgent", "high", "medium"), work_1=("urgent",), domain_2=("high",), support_2=("high",), equipment_2=("high",))
_GROUPS = {"ghg": ("medium",), "environment": ("low", "urgent")}
_POLICY = {"domain_keyword_groups": ["ghg", "environment"], "strong_keyword_groups": ["ghg"], "generic_environment_terms": ["low"], "explicit_consulting_environment_terms": ["none"], "advisory_terms": ["none"]}
_policy = lambda: C.title_policy(F.col("title"), _GROUPS, (), ("nothing",), _POLICY, _TERMS)["tier"]
_NEW = "(case when contains(title, 'LOW') then 'tier_3' when contains(title, 'HIGH') and category = 'grant_application' then 'tier_2' when contains(title, 'URGENT') and category <> 'grant_application' then 'tier_1' else 'tier_3' end)"
_SAID = "(case when contains(title, 'URGENT') or contains(title, 'HIGH') or contains(title, 'MEDIUM') then 'strong' when contains(title, 'LOW') then 'needs_review' else 'ignore' end)"
_CONCERNED = "source_id = 'O'"
add("e08_tier_audit", lambda s, d: Audits.tier_audit(bind.notices(s, d), _TERMS), f"select count(*) as total, count_if(tier_source <> 'manual') as automatic, count_if(tier_source = 'manual') as manual_preserved, {', '.join(f"count_if(tier_source <> 'manual' and {_NEW} = '{x}') as {x}" for x in Audits.TIERS)}, count_if(tier_source <> 'manual' and {_NEW} <> tier) as would_change from notices", "notices")
add("i08_reclassify", lambda s, d: Audits.reclassify(bind.notices(s, d), _TERMS).select("id", "tier", "tier_source"), f"select id, case when tier_source <> 'manual' then {_NEW} else tier end as tier, tier_source from notices", "notices")
add("e09_title_audit", lambda s, d: Audits.title_audit(bind.notices(s, d).filter(_CONCERNED), _policy()), f"select count(*) as total, {', '.join(f"count_if({_SAID} = '{x}') as {x}" for x in ('strong', 'needs_review', 'ignore'))}, count_if({_SAID} <> 'strong' and review_status = 'new') as eligible_for_quarantine from notices where {_CONCERNED}", "notices")
add("i09_quarantine", lambda s, d: Audits.quarantine(bind.notices(s, d).withColumn("review_note", F.lit("")), _policy(), "look at it", F.expr(_CONCERNED)).select("id", "review_status", "review_note"), f"select id, case when {_CONCERNED} and {_SAID} <> 'strong' and review_status = 'new' then 'needs_review' else review_status end as review_status, case when {_CONCERNED} and {_SAID} <> 'strong' and review_status = 'new' then 'look at it' else '' end as review_note from notices", "notices")


def _bench(s, d):
    return W.notices(workbench(s, d, W.TIERS), bind.as_of(AS_OF))


bind.SQL["desk"] = f"""desk as (select n.*, case when id % 17 = 0 then 'sample_not_priority' when tier <> 'tier_1' then 'not_priority' when review_status in ('not_relevant', 'closed', 'lost', 'won') then 'not_priority' else 'official_tier_1' end as priority,
  case when id % 17 = 0 then 90 when tier <> 'tier_1' then 80 when review_status in ('not_relevant', 'closed', 'lost', 'won') then 70 else 0 end as rank,
  case when reads > 0 then 'extracted' when links > 0 then 'fallback_notice_info' else 'not_attempted' end as document_status, case when not is_active then '' when {_DAYS} = 0 then 'D-DAY' when {_DAYS} between 1 and 7 then 'D-' || {_DAYS} else '' end as label
  from (select n.*, deadline >= timestamp '{AS_OF}' as is_active, cast(first_seen as date) = date '{AS_OF[:10]}' as is_new, coalesce(links, 0) as links, coalesce(named, 0) as named, coalesce(reads, 0) as reads from notices n
  left join (select notice_id, count(*) as links, count_if(line % 4 <> 3) as named, count_if({_READ} and id <= 3) as reads from attachments group by 1) a on a.notice_id = n.id where tier in ('tier_1', 'tier_2', 'tier_3')) n)"""
_DESK = ("notices", "attachments", "desk")
_NEW_1 = "(tier = 'tier_1' and (is_new or (tier_source = 'manual' and id % 2 = 0)) and is_active and priority = 'official_tier_1')"
add("m03_workbench", lambda s, d: _bench(s, d).select("id", "tier", "active", "label", "document_status", F.col("priority.status").alias("priority"), F.col("priority.rank").alias("rank"), "new_today", "new_tier_1", "readable", "fallback", F.coalesce(F.size("attachments"), F.lit(0)).alias("links")),
    f"select id, tier, is_active as active, label, document_status, priority, rank, is_new as new_today, {_NEW_1} as new_tier_1, reads as readable, document_status <> 'extracted' as fallback, links from desk", *_DESK)
add("m03_documents", lambda s, d: W.documents(_bench(s, d)).select("notice_id", "title", "document_label", "document_url", "summary"),
    f"select n.id as notice_id, title, name as document_label, case line % 4 when 3 then '' when 2 then 'ftp://h/' || part else a.url end as document_url, 'task ' || part as summary from desk n join (select *, {_LABEL} as name from attachments) a on a.notice_id = n.id where {_READ} and a.id <= 3", *_DESK)
add("m05_new_tier1_today", lambda s, d: _bench(s, d).filter("new_tier_1").select("id"), f"select id from desk where {_NEW_1}", *_DESK)
add("c25_priority_metadata", lambda s, d: _bench(s, d).select("id", "priority.status", "priority.rank", (F.length("priority.reason") > 0).alias("reasoned")), "select id, priority as status, rank, true as reasoned from desk", *_DESK)
add("e05_workbench_summary", lambda s, d: W.counts(_bench(s, d)), f"""select count(*) as total_notices, count_if(is_active) as active_notices, {", ".join(f"count_if(is_active and tier = '{x}') as active_{x}, count_if(tier = '{x}') as {x}" for x in W.TIERS)}, count_if(is_new) as new_today, count_if(is_new and is_active) as new_active_today, count_if({_NEW_1}) as new_tier_1_today,
  count_if(is_new and tier = 'tier_2') as new_tier_2_today, cast(sum(reads) as bigint) as extracted_documents, count_if(document_status = 'fallback_notice_info') as fallback_notices, count_if(document_status = 'fallback_notice_info' and named = 0) as missing_document_urls,
  count_if(priority = 'official_tier_1') as official_tier_1_priorities, count_if(label = 'D-7') as deadline_d7, count_if(label = 'D-3') as deadline_d3 from desk""", *_DESK)
add("e15_workbook_counts", lambda s, d: W.workbook_counts(_bench(s, d)), "select 'activity' as counted, tier, case when is_active then 'active' else 'closed' end as value, count(*) as count from desk group by all union all select 'label', '', label, count(*) from desk group by all union all select 'extracted', tier, '', cast(sum(reads) as bigint) from desk group by all", *_DESK)


def _read_documents(s, d):
    """Line items as documents that reading got more or less far with."""
    a = bind.attachments(s, d)
    key = lambda n: F.col("part") % n == 0
    status = W.extraction_status(F.when(key(7), "").when(key(5), F.concat(F.lit("ftp://h/"), "part")).otherwise(F.col("url")), F.when(F.col("notice_id") % 17 == 0, "sample_x").otherwise("s"), F.lit("http://h/n"), F.when(key(3), "pdf").otherwise("HWPX"),
                                 F.when(F.col("supp") % 6 < 5, F.col("supp") % 6 > 0), F.col("supp") % 6 > 1, F.col("supp") % 6 > 2)
    return a.select("notice_id", "id", status.alias("status"))


add("c26_extraction_status", _read_documents, "select notice_id, id, case when part % 7 = 0 then 'missing_document_url' when notice_id % 17 = 0 then 'sample_source' when part % 3 = 0 or part % 5 = 0 then 'unsupported_file_type' else (['download_failed', 'parse_failed', 'processed_no_evidence', 'extracted', 'extracted', 'not_attempted'])[supp % 6 + 1] end as status from attachments", "notices", "attachments")


def _annual(s, d):
    n, key = bind.notices(s, d), F.col("id")
    h = n.select(F.when(key % 5 == 0, " ").otherwise(F.year("deadline").cast("string")).alias("notice_year"), F.when(key % 35 == 0, "none").otherwise(F.col("deadline_at")).alias("notice_date"), F.when(key % 3 == 0, "core").when(key % 3 == 1, "review").when(key % 2 == 0, "exclude: x").otherwise("").alias("relevance_status"),
                 F.when(key % 4 == 0, "n/a").otherwise(F.col("budget")).alias("budget"))
    return W.annual(h)


add("e12_annual_summary", _annual, "select case when id % 35 = 0 then '' else cast(year(deadline) as varchar) end as year, count(*) as total, count_if(id % 3 = 0) as core, count_if(id % 3 = 1) as review, count_if(id % 3 = 2 and id % 2 = 0) as excluded, cast(coalesce(sum(cast(budget as bigint)) filter (id % 4 <> 0), 0) as bigint) as budget, count_if(id % 4 <> 0) as budget_known from notices group by 1", "notices")
