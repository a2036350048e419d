"""Queries of items as notices, links out of saved answers, insights and the two CSV products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import exports as E
from ..operators import merge as M
from ..operators import payloads as P
from ..sources.pages import write_csv
from . import bind, products

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql, *views):
    QUERIES[name], ORACLES[name] = query, (bind.sql(*views) if views else "") + sql


def _items(s, d):
    """Events as items: title, number and buyer under one of their names, or none of them."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    title = F.when(i % 10 == 9, " ").otherwise(F.concat(F.lit("T "), "event_type", k))
    item = F.to_json(F.struct(
        F.when(i % 3 == 0, title).when(i % 3 == 1, " ").alias("bidNtceNm"), F.when(i % 3 == 1, title).alias("bidNm"), F.when(i % 3 == 2, title).alias("ntceNm"),
        F.when(i % 4 > 0, F.col("user_id")).alias("bidNtceNo"), F.when(i % 6 > 0, k).alias("bidOrd"), F.when(i % 2 == 0, F.concat(F.lit("http://h/"), i)).alias("ntceDtlUrl"),
        F.date_format("ts", "yyyy-MM-dd").alias("ntceDt"), F.when(i % 5 > 0, F.lit("2024-02-01")).otherwise("").alias("bidClseDt"), F.lit("2024-03-01").alias("opengDt"),
        F.col("event_type").alias("ntceInsttNm"), (i * 10).alias("presmptPrce"), F.lit("open").alias("bidMethdNm"),
    ))
    return bind.read(s, d, "events").select("event_id", F.try_parse_json(item).alias("item"))


add("a02_map_notice_item", lambda s, d: P.map_notice_items(_items(s, d), F.lit("src")), """select event_id, 'T ' || event_type || k as title, case when event_id % 2 = 0 then 'http://h/' || event_id else '' end as url, strftime(ts, '%Y-%m-%d') as published_at,
  case when event_id % 5 > 0 then '2024-02-01' else '2024-03-01' end as deadline_at, event_type as buyer, cast(event_id * 10 as varchar) as budget, 'open' as procurement_method, 'src' as source_id,
  case when event_id % 12 = 0 then substr(sha1('src|T ' || event_type || k), 1, 16) else concat_ws('-', case when event_id % 4 > 0 then cast(user_id as varchar) end, case when event_id % 6 > 0 then k end) end as external_id
from (select *, json_extract_string(props, '$.k') as k from events) where event_id % 10 <> 9""")


def _raw(s, d):
    """Each notice with a saved answer: some are no JSON, a list or empty; others name the links
    2 to 4 of the notice, the last without a file name, and one that is no link."""
    a = bind.attachments(s, d).filter("id between 2 and 4").select("notice_id", F.explode(F.array(
        F.struct(F.concat(F.lit(P.SPEC_URL), F.col("id") - 1).alias("key"), F.col("url").alias("value")),
        F.when(F.col("id") < 4, F.struct(F.concat(F.lit(P.SPEC_NAME), F.col("id") - 1).alias("key"), F.concat("label", F.lit(".pdf")).alias("value"))))).alias("e")).filter("e is not null")
    named = a.groupBy("notice_id").agg(F.to_json(F.map_from_entries(F.array_append(F.array_sort(F.collect_list("e")), F.struct(F.lit(f"{P.SPEC_URL}9").alias("key"), F.lit("no link").alias("value"))))).alias("j"))
    k = F.col("id") % 9
    n = bind.notices(s, d).join(named, F.col("id") == F.col("notice_id"), "left")
    return n.select("id", "source_id", F.when(k == 0, "{broken").when(k == 1, "[1]").when(k == 2, "").otherwise(F.coalesce("j", F.lit("{}"))).alias("raw_json"))


def _backfill(s, d):
    stored = bind.attachments(s, d).filter("id <= 2").select("notice_id", "id", F.concat("label", F.lit(".pdf")).alias("label"), "url")
    return P.backfill(_raw(s, d), stored, "F", lambda df: bind.kept(df, "links"))


bind.SQL["backfilled"] = """raw as (select n.id as nid, n.id % 9 as k, count(a.id) as links from notices n left join attachments a on a.notice_id = n.id and a.id between 2 and 4 where source_id = 'F' group by 1),
came as (select notice_id, case when a.id = 4 then 'attachment 3' else label || '.pdf' end as label, line, min(a.id) as id from (select * from attachments where id between 2 and 4 qualify row_number() over (partition by notice_id, url order by id) = 1) a join raw on nid = notice_id where k >= 3 group by 1, 2, 3),
stored as (select notice_id, id, label || '.pdf' as label, line, notice_id in (select notice_id from came) as here, row_number() over (partition by notice_id, label, line order by id) as rn from attachments where id <= 2)"""
add("e11_backfill_summary", lambda s, d: _backfill(s, d)[1], """select count(*) as processed_notices, count_if(k < 2) as invalid_raw_json, count_if(k >= 3 and links > 0) as with_explicit_attachments, count_if(k = 2 or (k > 2 and links = 0)) as without_explicit_attachments,
  (select count(*) from came c where not exists (select 1 from stored s where s.notice_id = c.notice_id and s.label = c.label and s.line = c.line)) as added, (select count(*) from came c where exists (select 1 from stored s where s.notice_id = c.notice_id and s.label = c.label and s.line = c.line)) as updated,
  (select count(*) from stored where here and rn > 1) as deduplicated from raw""", "notices", "attachments", "backfilled")
add("i11_backfilled_links", lambda s, d: _backfill(s, d)[0].select("notice_id", "id", "label", "change"), """select notice_id, id, label, 'deduplicated' as change from stored where here and rn > 1 union all select notice_id, id, label, 'kept' from stored where not here
union all select coalesce(s.notice_id, c.notice_id), coalesce(s.id, c.id - 1), coalesce(c.label, s.label), case when s.id is null then 'inserted' when c.id is null then 'kept' else 'updated' end from (select * from stored where here and rn = 1) s full join came c on s.notice_id = c.notice_id and s.label = c.label and s.line = c.line""", "notices", "attachments", "backfilled")


def _insights(s, d):
    """What was found in every link of two thirds of the notices, and in those of a half again."""
    a, k = bind.attachments(s, d), F.col("notice_id")
    found = a.select("notice_id", F.col("id").alias("arrival"), F.col("url").alias("document_url"), F.col("label").alias("document_label"), F.when(F.col("quantity") < 10, "").otherwise(F.concat(F.lit("task "), "part")).alias("summary"), F.col("price").cast("bigint").alias("amount_krw"), F.lit("").alias("error"))
    old = M.last_by(found.filter(k % 3 != 0), ["notice_id", "document_url"], F.col("arrival")).drop("arrival").withColumn("extracted_at", bind.as_of("2001-01-01 00:00:00"))
    again = found.filter(k % 2 == 0).withColumns({"summary": F.when(k % 4 == 0, "").otherwise(F.concat("summary", F.lit(" again"))), "error": F.when(k % 4 == 0, "TimeoutError").otherwise("")})
    return M.upsert_insights(old, again, bind.as_of()).withColumn("extracted_at", F.date_format("extracted_at", "yyyy-MM-dd"))


add("i03_upsert_insights", _insights, """select notice_id, url as document_url, label as document_label, case when not c then summary when notice_id % 4 = 0 then '' else summary || ' again' end as summary, cast(trunc(price) as bigint) as amount_krw, case when c and notice_id % 4 = 0 then 'TimeoutError' else '' end as error,
  case when c then '2001-07-25' else '2001-01-01' end as extracted_at, case when notice_id % 3 = 0 then 'inserted' when c then 'updated' else 'kept' end as change
from (select *, notice_id % 2 = 0 as c, case when quantity < 10 then '' else 'task ' || part end as summary from attachments qualify row_number() over (partition by notice_id, url order by id desc) = 1) where notice_id % 3 <> 0 or c""", "attachments")
_TIERS = ("tier_1", "tier_2")


def _full(s, d):
    """Notices with all that the files show; every 17th is a sample."""
    i = F.col("id")
    return bind.notices(s, d).withColumns({
        "source_id": F.when(i % 17 == 0, F.concat(F.lit("Sample_"), "source_id")).otherwise(F.col("source_id")), "source_name": T.labelled(F.col("source_id"), {"F": "first", "O": "open"}), "tier_reason": F.concat(F.lit("why "), "tier"),
        "published_at": F.date_format("first_seen", "yyyy-MM-dd"), "procurement_method": F.when(i % 2 == 0, "open").otherwise("limited"), "review_note": F.when(i % 5 == 0, 'said "no", then left').otherwise(""), "last_seen": F.col("deadline"),
    })


def _read_back(s, rows, columns, what):
    at = bind.folder(s, what)
    write_csv(rows, at, columns)
    out = s.read.csv(at, header=True, inferSchema=False, escape="\\").fillna("")
    assert tuple(out.columns) == tuple(columns)
    return out


_SAID = "case when id % 5 = 0 then 'said \"no\", then left' else '' end"
_COMMON = f"""case source_id when 'F' then 'first' when 'O' then 'open' else source_id end as source_name, cast(id as varchar) as notice_id, review_status, tier as business_tier, 'why ' || tier as tier_reason, tier_source, buyer, strftime(first_seen, '%Y-%m-%d') as published_at,
  deadline_at, {products.LABEL} as deadline_priority, case when id % 2 = 0 then 'open' else 'limited' end as procurement_method, budget, cast(score as varchar) as relevance_score, array_to_string(keywords, ', ') as matched_keywords, {_SAID} as review_note"""
add("a11_write_notices_csv", lambda s, d: _read_back(s, E.notice_export(_full(s, d), _TIERS, bind.as_of()), E.NOTICES, "notices-csv"),
    f"select {_COMMON}, title, url, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen_at, strftime(deadline, '%Y-%m-%d %H:%M:%S') as last_seen_at from notices where tier in {_TIERS} and id % 17 <> 0", "notices")


def _named_links(s, d):
    return bind.attachments(s, d).filter("notice_id % 8 <> 0").withColumn("label", F.concat("label", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" price "), F.col("id"), F.lit(".xlsx"))).otherwise("")))


def _documents(s, d):
    rows = E.document_export(_full(s, d), _named_links(s, d), bind.as_of(), {"pricing": "prices", "missing": "none yet"}, (("P", "portal"), ("O", "board")), "no link", "site")
    return _read_back(s, rows, E.DOCUMENTS, "documents-csv")


add("a12_write_documents_csv", _documents, f"""select {_COMMON.replace("(id", "(n.id").replace("when id", "when n.id")}, case when a.id is null then 'missing' when a.id % 2 = 0 then 'pricing' else 'other' end as document_kind, case when a.id is null then 'none yet' when a.id % 2 = 0 then 'prices' else 'other' end as document_kind_label,
  coalesce(label || case when a.id % 2 = 0 then ' price ' || a.id || '.xlsx' else '' end, '') as document_label, coalesce(a.url, '') as document_url, case when a.url is null then 'no link' when n.id % 17 = 0 then 'site' when source_id = 'P' then 'portal' when source_id = 'O' then 'board' else 'site' end as document_access_hint,
  case when a.id % 2 = 0 then 'xlsx' else '' end as file_type, title as notice_title, n.url as notice_url from notices n left join attachments a on a.notice_id = n.id and n.id % 8 <> 0""", "notices", "attachments")
