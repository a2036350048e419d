"""Landed API payloads: one JSON text a call, in any of the shapes that the services answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import once
from .merge import upsert_attachments
from .tables import first_by

ITEMS = "$.response.body.items"
#: Fixed value: where the services put an error of their own.
API_ERROR = "$.OpenAPI_ServiceResponse.cmmMsgHeader"


def _map(v: Column) -> Column:
    """The fields of a JSON object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def payload_error(payload: Column) -> Column:
    """Why a payload has no items to give: not JSON, not an object, or the service's own error."""
    def of(v: Column) -> Column:
        code = F.coalesce(F.try_variant_get(v, f"{API_ERROR}.returnReasonCode", "string"), F.lit("unknown"))
        return F.when(v.isNull(), "not JSON").when(_map(v).isNull(), "not an object") \
            .when(F.size(F.try_variant_get(v, API_ERROR, "map<string, variant>")) > 0, F.concat(F.lit("service error "), code))

    return once(F.try_parse_json(payload), of)


def items(payload: Column, path: str = ITEMS) -> Column:
    """The payload's items as variants: a list, one object, or either of them as the field
    ``item`` of an object. What isn't an object is dropped, what isn't JSON has none."""
    def inner(found: Column) -> Column:
        wrapper = _map(found)
        return F.when(F.map_contains_key(wrapper, "item"), wrapper["item"]).otherwise(found)

    found = once(F.try_variant_get(F.try_parse_json(payload), path, "variant"), inner)
    listed = once(found, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(_map(v).isNotNull(), F.array(v))))
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: _map(v).isNotNull())


def explode_items(landed: DataFrame, payload: str, path: str = ITEMS) -> DataFrame:
    """landed without its payload, with item (a variant) and its place among the kept items."""
    return landed.select(*[c for c in landed.columns if c != payload], F.posexplode(items(F.col(payload), path)).alias("item_pos", "item"))


def field(*names: str, item: Column | str = "item") -> Column:
    """The first of these fields of an item that isn't blank, trimmed; else ''. Each is read once."""
    v = F.col(item) if isinstance(item, str) else item
    texts = F.array(*[F.trim(F.try_variant_get(v, f"$.{n}", "string")) for n in names])
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1)), F.lit(""))


# The services' names of a notice's fields; the first that isn't blank counts.
NOTICE_FIELDS = {
    "title": ("bidNtceNm", "bidNm", "ntceNm"),
    "bid_no": ("bidNtceNo", "bidNo"),
    "bid_order": ("bidNtceOrd", "bidOrd"),
    "url": ("bidNtceDtlUrl", "ntceDtlUrl", "bidNtceUrl"),
    "published_at": ("bidNtceDt", "ntceDt"),
    "deadline_at": ("bidClseDt", "opengDt"),
    "buyer": ("dminsttNm", "ntceInsttNm"),
    "budget": ("asignBdgtAmt", "presmptPrce"),
    "procurement_method": ("cntrctCnclsMthdNm", "bidMethdNm"),
}
# The numbered pairs of link and file name.
SPEC_URL, SPEC_NAME, SPEC_PAIRS = "ntceSpecDocUrl", "ntceSpecFileNm", 10


def map_notice_items(items: DataFrame, source_id: Column) -> DataFrame:
    """Rows with an item (a variant) to notices. The id is number and order, as far as given, else
    a hash of source and title; items without a title are left out."""
    # all fields of an item at once, the filter inside: neither it nor a field makes the item again
    read = F.transform(F.array("item"), lambda v: F.struct(*[field(*names, item=v).alias(name) for name, names in NOTICE_FIELDS.items()]))
    rows = items.drop(*NOTICE_FIELDS).select("*", F.inline(F.filter(read, lambda x: x["title"] != "")))
    given = F.concat_ws("-", F.nullif("bid_no", F.lit("")), F.nullif("bid_order", F.lit("")))
    return rows.withColumns({"source_id": source_id, "external_id": F.when(given != "", given).otherwise(text.stable_id(source_id, F.col("title")))}).drop("item", "bid_no", "bid_order")


def spec_links(rows: DataFrame, raw: str, unnamed: str = "attachment") -> DataFrame:
    """rows without their answer (JSON), a row a link that it names: the numbered ones, and those
    under any other key with "url" in it that show a document's extension, labelled with the key; n
    is their order, the numbered ones first. A file name tells the type before the link does; links
    that repeat stay."""
    get = lambda m, key: F.trim(F.try_variant_get(F.try_element_at(m, key), "$", "string"))
    numbers = F.array(*[F.lit(f"{SPEC_URL}{n}") for n in range(1, SPEC_PAIRS + 1)])
    keys = F.filter(F.json_object_keys(raw), lambda k: F.lower(k).contains("url"))  # in the answer's order

    def link(m: Column, k: Column, i: Column) -> Column:
        n = F.array_position(numbers, k)
        name = F.when(n > 0, get(m, F.concat(F.lit(SPEC_NAME), n.cast("string")))).otherwise(F.trim(k))
        return F.struct(F.when(n > 0, n.cast("int")).otherwise(i + SPEC_PAIRS + 1).alias("n"), get(m, k).alias("url"), name.alias("name"))

    links = once(_map(F.try_parse_json(raw)), lambda m: F.transform(keys, lambda k, i: link(m, k, i)))
    links = F.filter(links, lambda x: x["url"].isNotNull() & ((x["n"] <= SPEC_PAIRS) | (text.file_extension(x["url"]) != "")))
    kept = [c for c in rows.columns if c != raw]
    found = rows.select(*kept, F.inline(links)).filter(text.is_http(F.col("url")))
    found = found.withColumn("label", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit(f"{unnamed} "), F.col("n").cast("string"))))
    named = F.when(F.col("n") <= SPEC_PAIRS, F.nullif(text.file_extension(F.col("label")), F.lit("")))
    return found.withColumn("file_type", F.coalesce(named, text.file_extension(F.col("url")))).drop("name")


def _of_source(answers: DataFrame, prefix: str) -> DataFrame:
    raw = F.coalesce(F.nullif("raw_json", F.lit("")), F.lit("{}"))
    return answers.filter(F.col("source_id").startswith(prefix)).select(F.col("id").alias("notice_id"), raw.alias("raw"))


def saved_links(answers: DataFrame, prefix: str) -> DataFrame:
    """The links (notice_id, id, label, url, file_type) that saved answers (id of the notice,
    source_id, raw_json) of one source prefix name, each once a notice: the first counts."""
    links = first_by(spec_links(_of_source(answers, prefix), "raw"), ["notice_id", "url"], F.col("n"), F.col("label"))
    return links.select("notice_id", F.col("n").cast("long").alias("id"), "label", "url", "file_type")


def backfill(notices: DataFrame, stored: DataFrame, prefix: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Links out of the answers that notices (id, source_id, raw_json) were made from, merged into
    the stored ones (notice_id, id, label, url and perhaps file_type) of the same notices; other
    links stay. Returns the merged links and one row of counts. ``keep`` may write the links that
    came, which are read several times."""
    read, links = _of_source(notices, prefix), saved_links(notices, prefix)
    came = keep(links.select(*[c for c in links.columns if c in stored.columns]))
    named = came.select("notice_id").distinct()
    there, other = (stored.join(named, "notice_id", how) for how in ("left_semi", "left_anti"))
    merged = upsert_attachments(there, came)  # what other notices have needs no merge
    change = lambda x: F.count_if(F.col("change") == x)
    seen = read.agg(F.count("*").alias("processed_notices"), F.count_if(_map(F.try_parse_json("raw")).isNull()).alias("invalid_raw_json"))
    some = named.agg(F.count("*").alias("with_explicit_attachments"))
    done = merged.agg(change("inserted").alias("added"), change("updated").alias("updated"), change("deduplicated").alias("deduplicated"))
    parts = seen.unionByName(some, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    counts = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])
    counts = counts.withColumn("without_explicit_attachments", F.expr("processed_notices - invalid_raw_json - with_explicit_attachments"))
    return merged.unionByName(other.withColumn("change", F.lit("kept")), allowMissingColumns=True), counts
