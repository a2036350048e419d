"""Queries of the column functions (b, and the title rules of c)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import text as T
from ..operators import classify as C
from . import bind

QUERIES: dict = {}
ORACLES: dict = {}
_LINE = lambda: F.substring_index(F.col("text"), "\n", 1)
_LINE_SQL = "string_split(coalesce(text, ''), chr(10))[1]"
_NORM_SQL = rf"lower(trim(regexp_replace({_LINE_SQL}, '[\s\x{{3000}}\x{{00A0}}]+', ' ', 'g')))"


def _add(name, table, key, column, sql, where=None):
    def query(spark, sf_dir):
        df = bind.notices(spark, sf_dir) if table == "notices" else bind.attachments(spark, sf_dir) if table == "attachments" else bind.read(spark, sf_dir, table)
        return df.select(*key.split(", "), column().alias("value"))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = (bind.sql(table) if table in bind.SQL else "") + f"select {key}, {sql} as value from {table}"


def _bounded_sql(x, t):
    return f"regexp_matches({x}, '(^|[^a-z0-9])' || {t} || '($|[^a-z0-9])')"


_joined = lambda c: F.array_join(c, "|")
_norm = lambda: T.normalize_text(_LINE())
_TERMS = ("the", "and", "of", "r&d", "tion", "des")
_LISTED = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"
_URLX = lambda: F.concat("url", F.when(F.col("page_id") % 3 == 0, ".pdf?x=1").when(F.col("page_id") % 3 == 1, ".hwpx").otherwise(""))
_URLX_SQL = "url || case when page_id % 3 = 0 then '.pdf?x=1' when page_id % 3 = 1 then '.hwpx' else '' end"

_add("b01_normalize_text", "documents", "doc_id", lambda: F.sha1(T.normalize_text(F.col("text"))), r"sha1(lower(trim(regexp_replace(coalesce(text, ''), '[\s\x{3000}\x{00A0}]+', ' ', 'g'))))")
_add("b02_contains_term", "documents", "doc_id", lambda: T.contains_term(_norm(), "The"), _bounded_sql(_NORM_SQL, "'the'"))
_add("b03_signal_match", "documents", "doc_id", lambda: _joined(T.signals(_norm(), _TERMS)), f"array_to_string(list_filter({_LISTED}, lambda t: {_bounded_sql(_NORM_SQL, 't')}), '|')")
_add("b04_matched_terms", "documents", "doc_id", lambda: _joined(T.matched_terms(_norm(), _TERMS)), f"array_to_string(list_sort(list_filter({_LISTED}, lambda t: case when t = 'r&d' then contains({_NORM_SQL}, t) else {_bounded_sql(_NORM_SQL, 't')} end)), '|')")
_add("b05_file_extension", "pages", "page_id", lambda: T.file_extension(_URLX()), rf"regexp_extract(lower({_URLX_SQL}), '\.(pdf|hwpx|hwp|docx|doc|xlsx|xls|pptx|ppt|zip)($|[?#\s()\[\],])', 1)")
_add("b06_canonical_url", "pages", "page_id", lambda: T.canonical_url(F.concat("url", F.lit(";jsessionid=9?k=1#t"))), r"regexp_replace(regexp_replace(url || ';jsessionid=9?k=1#t', ';jsessionid=[^?#]*', '', 'gi'), '#.*$', '')")
_add("b07_stable_id", "pages", "page_id", lambda: T.stable_id(F.col("url"), F.col("page_id").cast("string")), "substr(sha1(url || '|' || page_id), 1, 16)")
_add("b08_normalize_homepage", "supplier", "s_suppkey", lambda: T.normalize_homepage(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "www.").otherwise("//"), "s_name")), "case when s_suppkey % 2 = 0 then 'https://www.' || s_name else 'https://' || s_name end")
_DOT = lambda: F.concat(F.lit("등록 "), F.date_format("deadline", "yyyy.M.d"), F.lit(" x"))
_DOT_SQL = "'등록 ' || strftime(deadline, '%Y.%-m.%-d') || ' x'"
_add("b09_normal_date", "notices", "id", lambda: D.normal_date(_DOT()), "case when year(deadline) >= 2000 then strftime(deadline, '%Y-%m-%d') else '' end")
_MIXED = lambda: F.when(F.col("id") % 4 == 0, F.date_format("deadline", "yyyyMMdd")).when(F.col("id") % 4 == 1, F.date_format("deadline", "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 4 == 2, F.date_format("deadline", "yyyy.MM.dd HH:mm")).otherwise("none")
_add("b10_parse_notice_ts", "notices", "id", lambda: F.date_format(D.parse_notice_ts(_MIXED()), "yyyy-MM-dd HH:mm:ss"), "case id % 4 when 0 then strftime(deadline, '%Y-%m-%d 00:00:00') when 1 then strftime(deadline, '%Y-%m-%d %H:%M:%S') when 2 then strftime(deadline, '%Y-%m-%d %H:%M:00') end")
_add("b11_parse_data_ts", "notices", "id", lambda: F.date_format(D.parse_data_ts(F.concat(_MIXED(), F.when(F.col("id") % 8 == 0, " x").otherwise(""))), "yyyy-MM-dd HH:mm:ss"), "case when id % 8 = 0 then null when id % 4 = 0 then strftime(deadline, '%Y-%m-%d 00:00:00') when id % 4 = 1 then strftime(deadline, '%Y-%m-%d %H:%M:%S') when id % 4 = 2 then strftime(deadline, '%Y-%m-%d %H:%M:00') end")
_WINDOW = lambda: F.concat(F.lit("접수 기간 : 2001.7.1 9:30 ~ "), F.date_format(F.col("deadline") + F.expr("interval 3650 days"), "yyyy-MM-dd"), F.when(F.col("id") % 2 == 0, " 16시").otherwise(""))
_add("b12_application_window", "notices", "id", lambda: D.once(D.application_window(_WINDOW()), lambda w: F.concat_ws("/", w["start"], w["end"])), "'2001-07-01 09:30/' || strftime(deadline + interval 3650 day, '%Y-%m-%d') || case when id % 2 = 0 then ' 16:00' else ' 23:59' end")
_TWO = lambda: F.concat(F.lit("20010101 - "), F.date_format(F.col("deadline") + F.expr("interval 1500 days"), "yyyyMMdd"))
_add("b13_two_date_window", "notices", "id", lambda: F.concat_ws("/", D.two_date_window(_TWO())["start"], D.two_date_window(_TWO())["end"]), "case when deadline + interval 1500 day >= timestamp '2001-01-01' then '2001-01-01/' || strftime(deadline + interval 1500 day, '%Y-%m-%d') else '/' end")
_add("b14_board_metadata", "notices", "id", lambda: F.concat_ws("/", F.regexp_extract(F.concat(F.lit("등록일 2001-02-03 작성자 "), "buyer", F.lit(" ")), r"등록일\s*(20\d{2}-\d{2}-\d{2})", 1), F.regexp_extract(F.concat(F.lit("작성자 "), "buyer", F.lit(" ")), r"작성자\s*(\S+)", 1)), "'2001-02-03/' || buyer")
_AMT = lambda: F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, F.concat(F.lit("₩"), F.format_number(F.col("budget").cast("long"), 0))).when(F.col("id") % 5 == 2, F.concat(F.lit("-"), "budget")).when(F.col("id") % 5 == 3, "n/a").otherwise(F.col("budget"))
_add("b15_amount_tristate", "notices", "id", lambda: F.concat_ws(":", A.amount_status(_AMT())["status"], A.amount_status(_AMT())["amount"].cast("bigint")), "case id % 5 when 0 then 'blank' when 1 then 'ok:' || budget when 2 then 'negative:-' || budget when 3 then 'invalid' else 'ok:' || budget end")
_add("b16_int_or_missing", "notices", "id", lambda: A.int_or_missing(F.when(F.col("id") % 3 == 0, "-").when(F.col("id") % 3 == 1, F.concat("budget", F.lit(".5"))).otherwise(F.col("budget"))), "case when id % 3 = 2 then cast(budget as bigint) end")
_add("b17_decimal_or_missing", "notices", "id", lambda: A.decimal_or_missing(F.when(F.col("id") % 3 == 0, "-").otherwise(F.concat((F.col("id") % 100).cast("string"), F.lit(".5%")))), "case when id % 3 <> 0 then (id % 100) + 0.5::double end")
_add("b18_source_value", "notices", "id", lambda: A.source_value(F.when(F.col("id") % 2 == 0, " - ").otherwise(F.concat(F.lit(" "), "buyer"))), "case when id % 2 <> 0 then buyer end")
_add("b19_listing_budget", "notices", "id", lambda: A.listing_budget(F.when(F.col("id") % 2 == 0, F.format_number(F.col("budget").cast("long"), 0)).otherwise(F.concat("budget", F.lit(" won")))), "case when id % 2 = 0 then cast(budget as bigint) end")
_UNIT = lambda: F.element_at(F.array(*[F.lit(u) for u in A.UNITS]), (F.col("id") % 4).cast("int") + 1)
_add("b20_krw_unit_amount", "notices", "id", lambda: A.krw(F.col("budget"), _UNIT()), "cast(budget as bigint) * ([1, 1000000, 10000000, 100000000])[id % 4 + 1]")
_add("b21_canonical_order", "notices", "id", lambda: A.canonical_order(F.concat(F.lit("00"), (F.col("id") % 10).cast("string"))), "cast(id % 10 as varchar)")
_add("b22_notice_identity", "notices", "id", lambda: A.notice_identity(F.col("buyer"), F.when(F.col("id") % 2 == 0, "001").otherwise(" ")), "case when id % 2 = 0 then buyer || '-001' else buyer end")
_DAYS = lambda: D.days_remaining(F.col("deadline"), bind.as_of())
_DAYS_SQL = f"date_diff('day', date '{bind.AS_OF[:10]}', cast(deadline as date))"
_LABEL_SQL = f"case when {_DAYS_SQL} = 0 then 'D-DAY' when {_DAYS_SQL} between 1 and 7 then 'D-' || {_DAYS_SQL} else '' end"
_add("b23_days_remaining", "notices", "id", _DAYS, f"cast({_DAYS_SQL} as int)")
_add("b24_deadline_label", "notices", "id", lambda: D.deadline_label(_DAYS()), _LABEL_SQL)
_add("b25_deadline_band", "notices", "id", lambda: D.deadline_band(D.deadline_label(_DAYS())), f"case when {_DAYS_SQL} = 0 then 'deep-red' when {_DAYS_SQL} between 1 and 3 then 'red' when {_DAYS_SQL} between 4 and 7 then 'yellow' else '' end")
_KLABEL = lambda: F.element_at(F.array(*map(F.lit, ("Scope of Work", "RFP", "bid notice", "platform", "price list", "terms", "x"))), (F.col("id") % 7).cast("int") + 1)
_add("b26_document_kind", "attachments", "notice_id, id", lambda: T.document_kind(_KLABEL(), F.col("url"), F.lit("")), "(['scope', 'rfp', 'notice', 'forms', 'pricing', 'contract', 'other'])[id % 7 + 1]")
_SQ_SQL = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{3000}\x{00A0}]+', ' ', 'g'))"
_add("b27_compact_summary", "documents", "doc_id", lambda: F.sha1(T.compact_summary(F.col("text"), 200)), f"sha1(case when length({_SQ_SQL}) <= 200 then {_SQ_SQL} when strpos({_SQ_SQL}[1:200], '.') > 0 and 200 - strpos(reverse({_SQ_SQL}[1:200]), '.') >= 100 then {_SQ_SQL}[1 : 201 - strpos(reverse({_SQ_SQL}[1:200]), '.')] else rtrim({_SQ_SQL}[1:199]) || '…' end)")
_add("b28_meaningful_paragraph", "documents", "doc_id", lambda: T.meaningful_paragraph(_LINE()), f"length(trim(regexp_replace({_LINE_SQL}, '[\\s\\x{{3000}}\\x{{00A0}}]+', ' ', 'g'))) >= 18")
_HOST_SQL = "regexp_extract(url, '://([^/?#:]*)', 1)"
_add("b29_sample_flag", "pages", "page_id", lambda: T.is_sample(F.when(F.col("page_id") % 9 == 0, "sample_x").otherwise("live"), F.col("url")), f"page_id % 9 = 0 or {_HOST_SQL} = 'example.com' or {_HOST_SQL} like '%.example.com'")
_add("b30_http_url_flag", "pages", "page_id", lambda: T.is_http(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("ftp://x/y")), "page_id % 2 = 0")
_add("b31_access_hint", "notices", "id", lambda: T.access_hint(F.col("source_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("url")), (("P", "portal"), ("O", "board")), "no link", "site"), "case when id % 3 = 0 then 'no link' when source_id like 'P%' then 'portal' when source_id like 'O%' then 'board' else 'site' end")
_add("b32_status_label", "notices", "id", lambda: T.labelled(F.col("review_status"), {"new": "New", "won": "Won"}), "case review_status when 'new' then 'New' when 'won' then 'Won' else review_status end")
_add("b33_attachment_identity", "attachments", "notice_id, id", lambda: T.attachment_identity(F.when(F.col("id") % 4 == 0, "").otherwise(F.col("label")), F.col("url")), "case when id % 4 = 0 then url else lower(label) || '|' || line end")
_add("b34_display_budget", "notices", "id", lambda: A.display_budget(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("budget")), F.col("category")), "case when id % 3 = 0 then case when category = 'grant_application' then 'see notice' else 'not given' end else format('{:,}', cast(budget as bigint)) end")
_add("b35_display_deadline", "notices", "id", lambda: F.concat_ws(" ", F.col("deadline_at"), F.nullif(D.deadline_label(_DAYS()), F.lit(""))), f"concat_ws(' ', deadline_at, nullif({_LABEL_SQL}, ''))")
_add("b36_pad_ticker", "supplier", "s_suppkey", lambda: T.pad_ticker(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("A"), "s_suppkey"))), "case when s_suppkey % 2 = 0 then lpad(cast(s_suppkey as varchar), cast(greatest(6, length(cast(s_suppkey as varchar))) as int), '0') else 'A' || s_suppkey end")
_add("b37_request_operation", "notices", "id", lambda: F.when(F.col("title").contains("URGENT"), "technical").otherwise("general"), "case when contains(title, 'URGENT') then 'technical' else 'general' end")
_ST = lambda: F.element_at(F.array(*map(F.lit, ("완료", "부분완료", "not collected", "Collected", "", "pending", "수집 완료"))), (F.col("id") % 7).cast("int") + 1)
_add("b38_status_means_collected", "notices", "id", lambda: A.status_means_collected(_ST()), "([true, false, false, true, false, false, true])[id % 7 + 1]")
_add("b39_typed_cell", "notices", "id", lambda: F.concat_ws("/", A.typed_cell(F.when(F.col("id") % 2 == 0, F.col("budget")).otherwise("n/a"), "number")["value"].cast("double").cast("bigint"), A.typed_cell(F.when(F.col("id") % 2 == 0, F.col("budget")).otherwise("n/a"), "number")["raw"]), "case when id % 2 = 0 then budget else 'n/a' end")
_add("b40_split_multi", "notices", "id", lambda: F.array_join(T.split_multi(F.concat("title", F.lit("; , "), "source_id", F.lit("| "))), "+"), "title || '+' || source_id")
_add("b41_safe_json", "notices", "id", lambda: F.array_join(T.safe_json_strings(F.when(F.col("id") % 2 == 0, F.concat(F.lit('["'), "source_id", F.lit('","x"]'))).otherwise("{bad")), "+"), "case when id % 2 = 0 then source_id || '+x' else '' end")
_add("b42_iso_week_key", "notices", "id", lambda: D.iso_week_key(F.col("deadline")), "strftime(deadline, '%G-W%V')")
_add("b43_daily_slot_key", "notices", "id", lambda: D.daily_slot_key(F.col("deadline"), "1000"), "strftime(deadline, '%Y-%m-%d') || '-1000'")
_add("b44_nested_item_text", "notices", "id", lambda: F.to_json(F.struct(F.trim("source_id").alias("s"), F.col("id").alias("n"))), "'{\"s\":\"' || source_id || '\",\"n\":' || id || '}'")

GROUPS = {"ghg": ("the", "that"), "environment": ("der", "die", "und"), "reporting": ("les", "que")}
TENDER, EXCLUDED = ("of", "to"), ("from", "ein")
TERMS = C.TierTerms(non_consulting=("from",), science_only=("oron",), domain_1=("the", "der", "que"), work_1=("and", "des"), planning=("an",), science_project=("by",), domain_2=("de", "los"), support_2=("la", "del"), equipment_2=("en", "por"), application_2=("un",), goods=("con",), private_buyer=("7",), topic=("in",), topic_pattern="ti(?!on)")
POLICY = {"domain_keyword_groups": ["ghg", "environment"], "strong_keyword_groups": ["ghg"], "generic_environment_terms": ["der"], "explicit_consulting_environment_terms": ["von"], "advisory_terms": ["zu", "in"]}


def _has(terms):
    inner = "|".join(terms)
    return f"regexp_matches(x, '(^|[^a-z0-9])({inner})($|[^a-z0-9])')"


def _list(terms):
    items = ", ".join(f"'{t}'" for t in terms)
    return f"list_filter([{items}], lambda t: regexp_matches(x, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))"


_X = f"with t as (select doc_id, {_NORM_SQL} as x from documents)\n"
_EVERY = [t for g in GROUPS.values() for t in g] + list(TENDER)
_SCORE_SQL = " + ".join(f"case when {_has(t)} then {3 if g in C.HEAVY_GROUPS else 2} else 0 end" for g, t in GROUPS.items()) + " + " + " + ".join(f"case when {_has([t])} then 1 else 0 end" for t in TENDER)
_titles = lambda spark, sf_dir: bind.read(spark, sf_dir, "documents").select("doc_id", _LINE().alias("title"))


def _title_query(name, build, sql):
    QUERIES[name] = lambda spark, sf_dir: build(_titles(spark, sf_dir))
    ORACLES[name] = _X + sql


_KEYS_SQL = f"array_to_string(list_sort({_list(_EVERY)}), '|')"
_title_query("c01_score_text", lambda d: C.score_text(d, "title", GROUPS, TENDER).select("doc_id", "score", _joined("keywords").alias("keywords")), f"select doc_id, {_SCORE_SQL} as score, {_KEYS_SQL} as keywords from t")
_title_query("c02_exclude_terms", lambda d: C.with_excluded(d, "title", EXCLUDED).select("doc_id", _joined("excluded_terms").alias("excluded_terms")), f"select doc_id, array_to_string(list_sort({_list(EXCLUDED)}), '|') as excluded_terms from t")
_title_query("c03_relevance_filter", lambda d: C.relevant(d, "title", GROUPS, TENDER, EXCLUDED, 3).select("doc_id", "score"), f"select doc_id, {_SCORE_SQL} as score from t where not {_has(EXCLUDED)} and {_SCORE_SQL} >= 3")
_title_query("c04_domain_keyword_required", lambda d: C.domain_required(C.score_text(d, "title", GROUPS, TENDER), "keywords", ("The", "Der")).select("doc_id"), f"select doc_id from t where {_has(['the', 'der'])}")


def _cascade_sql(cat):
    h = {n: _has(getattr(TERMS, n)) for n in ("non_consulting", "science_only", "domain_1", "work_1", "planning", "science_project", "domain_2", "support_2", "equipment_2", "application_2", "goods")}
    grant = f"case when {h['science_project']} and not {h['planning']} then 3 when {h['domain_2']} and {h['equipment_2']} and {h['support_2']} then 2 when {h['domain_2']} and {h['support_2']} and {h['domain_1']} and {h['work_1']} then 2 else 3 end"
    rest = f"case when {h['domain_2']} and {h['support_2']} and {h['equipment_2']} then case when not {h['application_2']} and ({h['goods']} or doc_id % 10 = 7) then 3 else 2 end when not {h['domain_1']} then 3 when {h['science_only']} then 3 when {h['science_project']} and not {h['planning']} then 3 when {h['work_1']} then 1 else 3 end"
    return f"case when x = '' or {h['non_consulting']} then 3 when {cat} then {grant} else {rest} end"


_TIER = lambda: C.tier_cascade(F.col("title"), F.when(F.col("doc_id") % 2 == 0, "grant_application").otherwise("board"), (F.col("doc_id") % 10).cast("string"), F.lit("open"), TERMS)
_title_query("c06_tier_cascade", lambda d: d.select("doc_id", _TIER()["tier"].alias("tier")), f"select doc_id, 'tier_' || {_cascade_sql('doc_id % 2 = 0')} as tier from t")
_title_query("c07_tier_reason", lambda d: d.select("doc_id", T.tier_reason("p", T.signals(T.normalize_text(F.col("title")), _EVERY)).alias("reason")), f"select doc_id, case when len({_list(_EVERY)}) > 0 then 'p (' || array_to_string({_list(_EVERY)}[1:3], ', ') || ')' else 'p' end as reason from t")
_related_sql = f"({_cascade_sql('doc_id % 2 = 0')} < 3 or {_has(TERMS.topic)} or regexp_matches(x, 'ti([^o]|o[^n]|o?$)'))"
_title_query("c08_related_reference_gate", lambda d: d.filter(C.related_reference(F.col("title"), _TIER()["tier"], TERMS)).select("doc_id"), f"select doc_id from t where {_related_sql}")
_plain_cascade = _cascade_sql("false").replace("or doc_id % 10 = 7", "")
_title_query("c09_climate_title_gate", lambda d: d.filter(C.climate_title(F.col("title"), EXCLUDED, TERMS)).select("doc_id"), f"select doc_id from t where not {_has(EXCLUDED)} and ({_plain_cascade} < 3 or {_has(TERMS.topic)} or regexp_matches(x, 'ti([^o]|o[^n]|o?$)'))")
_POLICY_SQL = f"case when {_plain_cascade} < 3 and not {_has(EXCLUDED)} then 'strong' when not {_has(['the', 'that', 'der', 'die', 'und'])} then 'ignore' when {_has(['the', 'that', 'von'])} then 'strong' when {_has(['die', 'und'])} and {_has(['zu', 'in'])} then 'strong' else 'needs_review' end"
_policy = lambda: C.title_policy(F.col("title"), GROUPS, TENDER, EXCLUDED, POLICY, TERMS)
_title_query("c05_title_policy", lambda d: d.select("doc_id", _policy()["tier"].alias("tier"), _joined(_policy()["keywords"]).alias("keywords")), f"select doc_id, {_POLICY_SQL} as tier, {_KEYS_SQL} as keywords from t")
_G = C.GrantPatterns(domain="(?i)the|der|que", support="(?i)and|des", call="er|en", funding="in|an", role="from", research="by", installs="of", advice="on", advice_domain="tion", reduction="re", equipment="sh")
_g_sql = "regexp_matches(y, '(?i)the|der|que') and regexp_matches(y, '(?i)and|des') and regexp_matches(y, 'er|en') and regexp_matches(y, 'in|an') and not regexp_matches(y, 'from')"
_Y = f"(select doc_id, {_LINE_SQL} as y, lower({_LINE_SQL}) as z from documents)"
_title_query("c10_overseas_feasibility_gate", lambda d: d.filter(C.overseas_feasibility(F.col("title"), C.TierTerms(feasibility=("the", "and", "in", "er|an"), feasibility_not="from"))).select("doc_id"), "select doc_id from t where contains(x, 'the') and contains(x, 'and') and contains(x, 'in') and regexp_matches(x, 'er|an') and not contains(x, 'from')")
_title_query("c11_customer_grant_gate", lambda d: d.filter(C.customer_grant(F.col("title"), _G)).select("doc_id"), f"select doc_id from {_Y} where {_g_sql}")
_title_query("c12_portfolio_grant_gate", lambda d: d.filter(C.portfolio_grant(F.col("title"), _G)).select("doc_id"), f"select doc_id from {_Y} where {_g_sql} and case when contains(z, 'by') and not contains(z, 'of') then false when contains(z, 'on') then contains(z, 'tion') when contains(z, 're') then true else contains(z, 'sh') end")
_CATS = {"en": ("the", "of"), "fr": ("les", "que"), "de": ("der",)}
_title_query("c13_history_relevance", lambda d: C.history_relevance(d, "title", _CATS, ("that",), EXCLUDED).select("doc_id", _joined("categories").alias("categories"), "status", "reason"), f"select doc_id, array_to_string(list_sort(list_filter([case when {_has(['der'])} then 'de' end, case when {_has(['the', 'of'])} then 'en' end, case when {_has(['les', 'que'])} then 'fr' end], lambda v: v is not null)), '|') as categories, case when {_has(['that'])} then 'core' when {_has(['the', 'of', 'les', 'que', 'der'])} then 'review' else 'exclude' end as status, case when {_has(['that'])} then 'specific term' when {_has(['the', 'of', 'les', 'que', 'der'])} and not {_has(EXCLUDED)} then 'possible relation' when {_has(['the', 'of', 'les', 'que', 'der'])} then 'related and excluded terms' else 'no context' end as reason from t")
