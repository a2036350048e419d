"""Queries of page readers, file sinks, streams and the larger composed products."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import merge as M
from ..operators import payloads as Payloads
from ..operators import sync as Sync
from ..operators import tables as O
from ..sources import boards as Boards
from ..sources import pages as P
from ..streaming import notices as S
from ..streaming.keyed import KeyedTable
from . import bind, products, scalars

QUERIES: dict = {}
ORACLES: dict = {}


folder = bind.folder


def add(name, query, sql=None, *views):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (bind.sql(*views) if views else "") + sql


_PAGES = lambda s, d: bind.read(s, d, "pages")
add("a05_html_to_text", lambda s, d: P.html_to_text(_PAGES(s, d)))
_BASE = "https://board.example/web/list.do?x=1"
_ROWS = {  # a document's row on each board; {0} its id, {1} the title, {2} the day of the month
    "onclick_table": '<tr onClick="javascript:goDetail({0})" style="x"><td>8</td><td>{1}</td><td>r</td><td>2026-04-13 09:00 ~ 2026-05-{2} 16:00</td><td><span>접수마감</span></td></tr>',
    "sequence_table": "<tr><td>1</td><td class=t><a href='#' onclick=\"location.href='./view.do?article_seq={0}&amp;cpage=1'\">{1}</a></td><td>a</td><td></td><td>2026.05.{2}</td></tr>",
    "card_list": '<a href="/x/notice/view.do?seq={0}" class="i"><b class="board_title">{1}</b><div class="board_col board_col_date">2025.12.{2}</div></a>',
    "auction_table": "<tr><td>4</td><td><a href='../y/notice/view.do?seq={0}'>{1}</a></td><td>m</td><td>2026-04-{2}</td></tr>",
    "subject_cards": '<li><a href="ex/View.do?cbIdx=277&amp;bcIdx={0}"><span class="date">2026-03-{2}</span><span class="subject">{1}</span></a></li>',
    "badge_table": "<tr><td>9</td><td><a href='#' onclick=\"fn_view('PB_{0}');\"><span>마감</span> {1}</a></td><td>m</td><td>2026-02-{2}</td></tr>",
}


def _boards(s, d):
    """Documents as rows of listing pages, eight a page, the pages' layouts in turn."""
    title = F.substring_index("text", "\n", 1)
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(k), F.lit(v))
    docs = bind.read(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("page_id"), title.alias("title"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0").alias("day"))
    out = []
    for n, (name, row) in enumerate(_ROWS.items()):
        parts = [F.lit(x) if x not in ("0", "1", "2") else F.col(("doc_id", "title", "day")[int(x)]).cast("string") for x in re.split(r"[{](\d)[}]", row)]
        pages = docs.filter(F.col("page_id") % len(_ROWS) == n).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(*parts).alias("row")))), lambda x: x["row"]), "\n").alias("html"))
        gate = C.portfolio_grant if name in ("subject_cards", "badge_table") else C.customer_grant
        out.append(Boards.board_rows(pages, Boards.LAYOUTS[name], _BASE, lambda t, gate=gate: gate(t, scalars._G)).withColumn("layout", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), out)


_BOARD_SQL = f"""with l as (select doc_id, doc_id // 8 as page_id, doc_id % 8 as ord, lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') as day, trim(regexp_replace({scalars._LINE_SQL}, '[\\s\\x{{3000}}\\x{{00A0}}]+', ' ', 'g')) as y from documents),
k as (select *, lower(y) as z, ({list(_ROWS)})[page_id % 6 + 1] as layout from l)
select page_id, cast(row_number() over (partition by page_id order by ord) as int) as n, layout, case layout when 'badge_table' then 'PB_' else '' end || doc_id as external_id, y as title,
  'https://board.example/' || case layout when 'onclick_table' then 'web/bsnPuanView.do?bsnDvCd=CNF&bsnTrgtCd=ETR&bsnPuanId=' when 'sequence_table' then 'web/view.do?article_seq=' when 'card_list' then 'x/notice/view.do?seq=' when 'auction_table' then 'y/notice/view.do?seq=' when 'subject_cards' then 'web/ex/View.do?cbIdx=277&bcIdx=' else 'web/pbancView.do?seq=PB_' end || doc_id as url,
  case layout when 'onclick_table' then '' when 'sequence_table' then '2026-05-' || day when 'card_list' then '2025-12-' || day when 'auction_table' then '2026-04-' || day when 'subject_cards' then '2026-03-' || day else '2026-02-' || day end as published_at,
  case layout when 'onclick_table' then '2026-04-13 09:00' else '' end as start_at, case layout when 'onclick_table' then '2026-05-' || day || ' 16:00' else '' end as deadline_at, case layout when 'onclick_table' then '접수마감' when 'badge_table' then '마감' else '' end as source_status
from k where {scalars._g_sql} and case when layout not in ('subject_cards', 'badge_table') then true when contains(z, 'by') and not contains(z, 'of') then false when contains(z, 'on') then contains(z, 'tion') when contains(z, 're') then true else contains(z, 'sh') end"""
_numbered = lambda rows: rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")).alias("n"), "layout", *Boards.FIELDS)
add("a06_extract_board_rows", lambda s, d: _numbered(_boards(s, d)), _BOARD_SQL)
_CARD = P.BoardSpec(r"<card>.*?</card>", {"category": "<b>([^<]*)</b>", "title": "<i>([^<]*)</i>", "url": 'href="([^"]*)"', "external_id": 'data-id="([^"]*)"'})


def _cards(s, d):
    card = F.format_string('<card><b>%s</b><i>%s</i><a data-id="%d" href="%s"></a></card>', F.when(F.col("page_id") % 2 == 0, "bid").otherwise("news"), F.when(F.col("page_id") % 6 == 0, "award result").otherwise("tender"), F.col("page_id"), F.concat(F.when(F.col("page_id") % 10 == 0, "http://x").otherwise(""), F.lit("/v?id="), F.col("page_id") - F.when(F.col("page_id") % 14 == 0, 1).otherwise(0)))
    return P.bid_cards(_PAGES(s, d).select("page_id", card.alias("html")), _CARD, "bid", "result|award").select("page_id", "title")


add("a07_extract_bid_cards", _cards, "select page_id, 'tender' as title from pages where page_id % 2 = 0 and page_id % 6 <> 0 and page_id % 10 <> 0 and page_id % 14 <> 0")


def _tables(s, d):
    rows = bind.notices(s, d).groupBy("buyer").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("<tr><td>%d</td><td> %s </td></tr>", "id", "title"))), "").alias("r"))
    return P.html_table_rows(rows.select(F.col("buyer").cast("long").alias("page_id"), F.concat(F.lit("<table><tr><th>id</th><th>title</th></tr><tr><td></td></tr>"), "r", F.lit("</table>")).alias("html"))).select(F.col("page_id").alias("buyer"), F.col("record")["id"].cast("bigint").alias("id"), F.col("record")["title"].alias("title"))


add("a08_html_table_rows", _tables, "select cast(buyer as bigint) as buyer, id, title from notices", "notices")


def _archives(s, d):
    def zipped(parts):
        import io
        import zipfile

        import pandas as pd

        for part in parts:
            out = []
            for i, t in zip(part["doc_id"], part["text"], strict=True):
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w") as z:
                    z.writestr("Contents/section0.xml", "<s>" + "".join(f"<p>{P.html.escape(x)}</p>" for x in (t or "").split("\n")) + "</s>")
                out.append((str(i), f.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    docs = bind.read(s, d, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("text"))
    found = P.archive_paragraphs(docs.mapInPandas(zipped, "path string, content binary"))
    return found.groupBy(F.col("path").cast("long").alias("doc_id"), "status").agg(F.count("paragraph").alias("n"))


add("a09_archive_paragraphs", _archives)


def _csv(s, d):
    at = folder(s, "csv")
    P.write_csv(bind.notices(s, d).select("id", "title", F.when(F.col("id") % 3 != 0, F.col("buyer")).alias("buyer"), F.lit("000").alias("order")), at, ["id", "title", "buyer", "order"])
    return s.read.csv(at, header=True, inferSchema=False).fillna("").select(F.col("id").cast("bigint").alias("id"), "title", "buyer", "order")


add("a10_read_contract_csv", _csv, "select id, title, case when id % 3 <> 0 then buyer else '' end as buyer, '000' as \"order\" from notices", "notices")


def _json(s, d):
    at = folder(s, "json")
    P.write_json(products._nested(s, d).select("notice_id", "title", "attachments", "review"), at)
    return s.read.schema("notice_id long, title string, attachments array<struct<id:long,label:string,url:string>>, review struct<fit:string,decision:string>").json(at).select("notice_id", "title", F.coalesce(F.size("attachments"), F.lit(0)).alias("n"), F.col("review.fit").alias("fit"))


add("a13_write_nested_json", _json, "select n.id as notice_id, title, (select cast(count(*) as int) from attachments a where a.notice_id = n.id) as n, fit from notices n left join reviews r on r.notice_id = n.id", "notices", "attachments", "reviews")


def _stream(s, d, name):
    table = bind.read(s, d, name)
    if any(f"/{name}.parquet/" in f for f in table.inputFiles()):  # a folder of part files
        return S.files(s, f"{d}/{name}.parquet", table.schema)
    return S.files(s, d, table.schema, f"{name}.parquet")


def _events(s, d):
    return _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("key"), F.col("user_id").alias("recipient"), "event_type")


def _ingest(s, d):
    """Orders arrive in four files, every fifth twice; a batch a file."""
    at = folder(s, "ingest")
    rows = bind.read(s, d, "orders").withColumn("arrival", F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows.repartition(4).write.parquet(f"{at}/landed")
    stream = S.files(s, f"{at}/landed", rows.schema, per_trigger=1).select(F.col("o_orderstatus").alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"), F.lit("new").alias("review_status"), F.lit("tier_2").alias("tier"), F.lit("automatic").alias("tier_source"), "arrival")
    table = KeyedTable(s, f"{at}/table", ["source_id", "external_id"])
    S.ingest(stream, table, f"{at}/state", bind.as_of()).awaitTermination()
    return table.read().groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("keys"), F.date_format(F.max("first_seen"), "yyyy-MM-dd").alias("first_seen"))


add("j01_stream_ingest", _ingest, "select o_orderstatus as source_id, count(*) as n, count(distinct o_orderkey) as keys, '2001-07-25' as first_seen from orders group by 1")
_text = lambda df: df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
add("j02_first_seen", lambda s, d: _text(S.drained(S.first_seen(_events(s, d), ["recipient"], "ts"), folder(s, "first"), "complete")), "select user_id as recipient, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen from events group by 1")
_BASELINE = "2024-01-10 00:00:00"


def _seen(s, d):
    """Events as notices first seen, with what an alert asks for."""
    e = _stream(s, d, "events")
    ts = F.col("ts").cast("timestamp")
    published = F.when(F.col("event_id") % 4 == 0, F.date_format(ts - F.expr("interval 6 days"), "yyyyMMdd")).when(F.col("event_id") % 4 == 1, F.date_format(ts - F.expr("interval 6 days"), "yyyy-MM-dd HH:mm:ss")).otherwise("")
    return e.select(ts.alias("ts"), F.col("event_id").alias("key"), F.col("user_id").alias("recipient"), F.when(F.col("event_type") == "purchase", "tier_1").when(F.col("event_type") == "signup", "tier_2").otherwise("tier_3").alias("tier"),
                    (F.col("event_id") % 7).alias("score"), F.when(F.col("event_id") % 11 == 0, "closed").otherwise("new").alias("review_status"), F.when(F.col("event_id") % 13 == 0, "sample_x").otherwise("board").alias("source_id"), published.alias("published_at"))


def _ledger(s, at):
    return KeyedTable(s, f"{at}/ledger", S.LEDGER)


def _alerts(s, d):
    """The stream is read twice, the second time from its beginning: nothing is sent again."""
    at = folder(s, "alerts")
    for run in ("first", "again"):
        S.alerts(_seen(s, d), _ledger(s, at), f"{at}/{run}", bind.as_of(_BASELINE), least=2).awaitTermination()
    return _ledger(s, at).read().groupBy("type", "key", "recipient", "status").agg(F.count("*").alias("n"))


add("j03_immediate_alerts", _alerts, f"select 'immediate' as type, cast(event_id as varchar) as key, cast(user_id as varchar) as recipient, 'sent' as status, count(*) as n from (select *, ts - interval 6 day as p from events) where event_type = 'purchase' and ts > timestamp '{_BASELINE}' and event_id % 7 >= 2 and event_id % 11 <> 0 and event_id % 13 <> 0 and case event_id % 4 when 0 then cast(p as date) >= date '{_BASELINE[:10]}' when 1 then date_trunc('second', p) >= timestamp '{_BASELINE}' else true end group by all")


def _digests(s, d):
    at = folder(s, "digests")
    for run in ("first", "again"):
        S.digests(_seen(s, d), KeyedTable(s, f"{at}/counts-{run}", ["type", "key"], 4), _ledger(s, at), f"{at}/{run}", ("desk", "head"), delay="2 hours").awaitTermination()
    return _ledger(s, at).read().select("type", "key", "recipient", F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("sent_at"), "tier_1", "tier_2")


add("j04_digest_windows", _digests, """with e as (select ts, event_type, date_trunc('day', ts) as day from events), p as (
  select *, 'daily' as type, case when ts <= day + interval 10 hour then day + interval 10 hour when ts <= day + interval 17 hour then day + interval 17 hour else day + interval 34 hour end as due from e
  union all select *, 'weekly', date_trunc('week', ts) + interval 7 day from e)
select type, case type when 'daily' then strftime(due, '%Y-%m-%d-%H%M') else strftime(due - interval 7 day, '%G-W%V') end as key, recipient, strftime(due, '%Y-%m-%d %H:%M') as sent_at,
  count_if(event_type = 'purchase') as tier_1, count_if(event_type = 'signup') as tier_2 from p, (values ('desk'), ('head')) r(recipient)
where event_type in ('purchase', 'signup') and due <= (select max(ts) from events) - interval 2 hour group by all""")
add("j05_revision_stream", lambda s, d: S.drained(S.latest_revision(_stream(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "user_id", "ts", "event_id"), folder(s, "revisions"), "complete"), "select user_id, event_id as kept from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def _late(s, d):
    at = folder(s, "late")
    stored = KeyedTable(s, f"{at}/stored", ["key"])
    S.late_policy(_seen(s, d), stored, _ledger(s, at), f"{at}/state", bind.as_of(_BASELINE)).awaitTermination()
    gone = _ledger(s, at).read().select(F.col("key").cast("long").alias("key"), F.lit(True).alias("sent"))
    return stored.read().join(gone, "key", "left").groupBy("alert", F.coalesce("sent", F.lit(False)).alias("sent")).count()


add("j06_late_policy", _late, f"select ts >= timestamp '{_BASELINE}' as alert, ts >= timestamp '{_BASELINE}' as sent, count(*) as count from events group by all")


def _insight_run(s, d):
    paras = products._PARAS(s, d)
    amount, task = O.amount_evidence(paras, "doc_id", products._LABELS, r"(\d+)(\d)"), O.task_summary(paras, "doc_id", ("nowhere",), ("the", "der"))
    return task.join(amount, "doc_id", "left").select("doc_id", F.when(F.col("basis").isNotNull() | (F.col("summary") != ""), "extracted").otherwise("processed_no_evidence").alias("status"), F.coalesce("amount_text", F.lit("")).alias("amount_text"))


add("m25_extract_insights", _insight_run, r"select doc_id, case when amount_text <> '' or exists (select 1 from lines l where l.doc_id = docs.doc_id and (seq = 0 or (length(line) >= 18 and regexp_matches(paragraph, 'the|der'))) and line <> '') then 'extracted' else 'processed_no_evidence' end as status, coalesce(amount_text, '') as amount_text from (select doc_id from documents) docs left join (select doc_id, amount_text from (select *, row_number() over (partition by doc_id order by r, seq) as rn from (select doc_id, seq, 0 as r, regexp_extract(regexp_extract(line, '(?:token)(.*)$', 1), '(\d+)(\d)', 0) as amount_text from lines union all select doc_id, seq, 1, regexp_extract(regexp_extract(line, '(?:The)(.*)$', 1), '(\d+)(\d)', 0) from lines) where amount_text <> '') where rn = 1) a using (doc_id)", "paras")


def _reconcile(s, d):
    incoming = products._coming(s, d).filter(F.col("deadline") >= bind.as_of())
    merged = M.upsert_notices(products._current(s, d), incoming, bind.as_of())
    return merged.groupBy("change").agg(F.count("*").alias("n"), F.count_if(F.col("deadline") >= bind.as_of()).alias("open"))


add("m26_reconcile_open", _reconcile, f"select case when id % 3 = 0 then 'inserted' when id % 2 = 0 and deadline >= {products.AT} then 'updated' else 'kept' end as change, count(*) as n, count_if(deadline >= {products.AT}) as open from notices where id % 3 <> 0 or (id % 2 = 0 and deadline >= {products.AT}) group by 1", "notices")


_SHAPES = ('{{"response":{{"body":{{"items":[{0},5,{0},"x",null]}}}}}}', '{{"response":{{"body":{{"items":{{"item":[{0},"x"]}}}}}}}}', '{{"response":{{"body":{{"items":{{"item":{0}}}}}}}}}', '{{"response":{{"body":{{"items":{0}}}}}}}',
           '{{"response":{{"body":{{"items":"{0}"}}}}}}', '{{"response":{{"body":', '{{"response":{{"body":{{"items":{{"item":null}}}}}}}}', '{{"response":{{"body":{{}}}}}}')
_KEPT = (2, 1, 1, 1, 0, 0, 0, 0)  # items of each shape that are objects


def _payloads(s, d):
    """Each event's properties as an answer, in one of eight shapes."""
    shape = lambda t: F.concat(*[x for part in t.format("\0").split("\0") for x in (F.lit(part), F.col("props"))][:-1])
    n, chosen = (F.col("event_id") % len(_SHAPES)).cast("int"), F.lit(None).cast("string")
    for i, t in enumerate(_SHAPES):
        chosen = F.when(n == i, shape(t)).otherwise(chosen)
    return bind.read(s, d, "events").select("event_id", chosen.alias("payload"))


add("a01_explode_notice_payload", lambda s, d: Payloads.explode_items(_payloads(s, d), "payload").select("event_id", "item_pos", F.variant_get("item", "$.k", "bigint").alias("k")),
    f"select event_id, cast(pos as int) as item_pos, cast(json_extract(props, '$.k') as bigint) as k from (select *, unnest(range(({list(_KEPT)})[event_id % 8 + 1])) as pos from events)")
_FAILING = ("src3", "src7")


def _landed(s, d, broken=_FAILING):
    """Documents as calls: one item each, the title its first line; two sources break."""
    c = bind.read(s, d, "documents").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"))
    payload = F.concat(F.lit('{"response":{"body":{"items":{"item":'), F.to_json(F.struct(F.col("doc_id").alias("id"), "title")), F.lit("}}}}"))
    cut = F.col("source").isin(broken[0]) & (F.col("doc_id") % 7 == 0)
    error = F.when(F.col("source").isin(*broken[1:]) & (F.col("doc_id") % 3 == 0), "TimeoutError").otherwise("")
    return c.select(F.col("source").alias("source_id"), F.col("doc_id").alias("pos"), F.when(cut, F.substring(payload, 1, 30)).otherwise(payload).alias("payload"), error.alias("error"))


def _stored(s, d):
    """Every third document's notice was stored before."""
    c = bind.read(s, d, "documents").filter("doc_id % 3 = 0")
    at, text = bind.as_of("2001-01-01 00:00:00"), lambda x: F.lit(x)
    return c.select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), text("old").alias("title"), text("").alias("category"), text("").alias("buyer"), text("watch").alias("review_status"), text("automatic").alias("tier_source"), text("tier_3").alias("tier"), at.alias("first_seen"), at.alias("last_seen"))


def _sources(fatal=None):
    names = [f"src{i}" for i in range(20)]
    return [Sync.Source(n, n != fatal) for n in names]


def _sync(s, d):
    """One run in which two optional sources fail: what is stored by source afterwards."""
    at = folder(s, "sync")
    merged = Sync.run(_landed(s, d), _sources(), _stored(s, d), f"{at}/merged", f"{at}/ledger", 1, scalars.TERMS, bind.as_of())
    return merged.groupBy("source_id").agg(F.count_if(F.expr("change = 'inserted'")).alias("inserted"), F.count_if(F.expr("change = 'updated'")).alias("updated"), F.count_if(F.expr("change = 'kept'")).alias("kept"), F.count_if(F.expr("change = 'updated' and review_status = 'watch' and title <> 'old'")).alias("reviews_kept"), F.count_if(F.expr("tier = 'tier_1'")).alias("tier_1"))


def _runs(s, d):
    """Three runs: every source answers, two optional ones fail, one that must not fail does."""
    at = folder(s, "runs")
    for number, (broken, fatal) in enumerate(((("-", "-"), None), (_FAILING, None), (_FAILING, "src3")), 1):
        Sync.run(_landed(s, d, broken), _sources(fatal), _stored(s, d), f"{at}/merged-{number}", f"{at}/ledger", number, scalars.TERMS, bind.as_of())
    return s.read.parquet(f"{at}/ledger").withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm"))


_TITLED = scalars._X.replace("doc_id,", "doc_id, source,", 1) + f", g as (select *, {scalars._plain_cascade} as k, {scalars._plain_cascade} < 3 or {scalars._has(scalars.TERMS.topic)} or regexp_matches(x, 'ti([^o]|o[^n]|o?$)') as ok from t where x <> '')"
_ACC = "ok and source not in ('src3', 'src7')"
add("m27_sync", _sync, _TITLED + f""" select t.source as source_id, count_if(acc and t.doc_id % 3 <> 0) as inserted, count_if(acc and t.doc_id % 3 = 0) as updated, count_if(not acc and t.doc_id % 3 = 0) as kept, count_if(acc and t.doc_id % 3 = 0) as reviews_kept, count_if(acc and k = 1) as tier_1
  from (select t.doc_id, t.source, k, coalesce({_ACC.replace("source", "t.source")}, false) as acc from t left join g on g.doc_id = t.doc_id) t where acc or doc_id % 3 = 0 group by 1""")
_RUN = lambda n, status, message, cond: f"select {n} as run, '2001-07-25 10:00' as started_at, '{status}' as status, '{message}' as message, 20 as sources, count_if({cond}) as candidates, count_if({cond} and doc_id % 3 <> 0) as inserted from g"
add("a15_run_ledger", _runs, _TITLED + " " + " union all ".join((_RUN(1, "success", "", "ok"), _RUN(2, "partial", "src3: not JSON; src7: TimeoutError", _ACC), _RUN(3, "failed", "src3: not JSON", "ok and cast(substr(source, 4) as int) < 3"))))
