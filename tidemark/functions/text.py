"""Text, link and document columns: normalising, term matching, identities, kinds."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document extensions, and the words that make a document's kind, in order.
EXTENSIONS = ("pdf", "hwpx", "hwp", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "zip")
KIND_TERMS = {
    "scope": ("과업지시서", "과업 내용서", "과업내용서", "과업", "scope of work", "statement of work", "sow", "task order"),
    "rfp": ("제안요청서", "제안 요청서", "제안요구서", "rfp", "request for proposal", "proposal request"),
    "notice": ("입찰공고", "입찰 공고", "공고문", "bid notice", "notice"),
    "forms": ("제출서식", "제출 서식", "서식", "양식", "별지", "첨부양식", "form", "forms", "template"),
    "pricing": ("산출내역서", "가격", "견적", "가격제안", "가격 제안", "budget", "price", "pricing", "quote"),
    "contract": ("계약서", "계약조건", "계약 조건", "약관", "agreement", "contract", "terms"),
}
KINDS = (*KIND_TERMS, "other", "missing")


def _plain(term: str) -> str:
    return re.sub(r"\s+", " ", term or "").strip().lower()


def quoted(term: str) -> str:
    """A literal in both regular-expression dialects used here."""
    return re.sub(r"([.^$*+?()\[\]{}\\|&-])", r"\\\1", term)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def _bounded(term: str) -> str:
    return f"(?<![a-z0-9]){quoted(term)}(?![a-z0-9])"


def contains_term(text: Column, term: str) -> Column:
    """text is normalised. Latin terms need boundaries, others are substrings."""
    plain = _plain(term)
    if not plain:
        return F.lit(False)
    return text.rlike(_bounded(plain)) if re.fullmatch(r"[a-z0-9][a-z0-9 .-]*", plain) else text.contains(plain)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """One alternation for all terms: cheaper than a test each."""
    plain = [p for p in map(_plain, terms) if p]
    bounded = [p for p in plain if re.fullmatch(r"[a-z0-9][a-z0-9 .-]*", p)]
    parts = [quoted(p) for p in plain if p not in bounded] + ([f"(?<![a-z0-9])(?:{'|'.join(map(quoted, bounded))})(?![a-z0-9])"] if bounded else [])
    return text.rlike("|".join(parts)) if parts else F.lit(False)


def _listed(text: Column, terms: Sequence[str], test) -> Column:
    hits = [F.when(test(text, t), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that match, sorted, each once."""
    return F.array_sort(F.array_distinct(_listed(text, terms, contains_term)))


def signal(text: Column, term: str) -> Column:
    """As contains_term, but every ASCII term with a letter is bounded."""
    plain = term.lower().strip()
    return text.rlike(_bounded(plain)) if plain.isascii() and any(x.isalpha() for x in plain) else text.contains(plain)


def signals(text: Column, terms: Sequence[str]) -> Column:
    """The terms found, in the order of the list."""
    return _listed(text, terms, signal)


def has_signal(text: Column, terms: Sequence[str]) -> Column:
    bounded = [t.lower().strip() for t in terms if t.isascii() and any(x.isalpha() for x in t)]
    parts = [quoted(t.lower().strip()) for t in terms if not (t.isascii() and any(x.isalpha() for x in t))]
    parts += [f"(?<![a-z0-9])(?:{'|'.join(map(quoted, bounded))})(?![a-z0-9])"] if bounded else []
    return text.rlike("|".join(parts)) if parts else F.lit(False)


def file_extension(c: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"\.(" + "|".join(EXTENSIONS) + r")(?=$|[?#\s()\[\],])", 1)


def canonical_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i);jsessionid=[^?#]*", ""), r"#.*$", "")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def normalize_homepage(c: Column) -> Column:
    url = F.trim(F.coalesce(c, F.lit("")))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(F.lower(url).startswith("www."), F.concat(F.lit("https://"), url)).otherwise(url)


def document_kind(label: Column, url: Column, file_type: Column) -> Column:
    """The first kind one of whose words stands anywhere in label, link or type."""
    link = F.coalesce(F.try_url_decode(F.coalesce(url, F.lit(""))), url, F.lit(""))
    text = normalize_text(F.concat_ws(" ", F.coalesce(label, F.lit("")), link, F.coalesce(file_type, F.lit(""))))
    every = "|".join(quoted(x) for words in KIND_TERMS.values() for x in words)

    def first_kind(t: Column) -> Column:
        out = F.lit("other")
        for kind in reversed(KIND_TERMS):
            out = F.when(t.rlike("|".join(quoted(x) for x in KIND_TERMS[kind])), kind).otherwise(out)
        return F.when(t.rlike(every), out).otherwise("other")

    return F.transform(F.array(text), first_kind)[0]  # the text is made once, not once a kind


def compact_summary(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut after a late full stop or with an ellipsis."""
    text = collapse(c)
    head = F.substring(text, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    late = (F.instr(head, ".") > 0) & (stop - 1 >= most // 2)
    return F.when(F.length(text) <= most, text).when(late, F.substr(text, F.lit(1), stop)).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def meaningful_paragraph(c: Column) -> Column:
    # The least length, and what tables of contents and appendices begin with.
    text = collapse(c)
    return (F.length(text) >= 18) & ~text.contains("목 차") & ~text.startswith("[표]") & ~text.startswith("[별지]") & ~text.rlike(r"^[ⅠⅡⅢⅣⅤⅥ0-9 .-]+$")


def is_sample(source_id: Column, url: Column) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.coalesce(source_id, F.lit("")).startswith("sample") | (F.lower(host) == "example.com") | F.lower(host).endswith(".example.com")


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


def access_hint(source_id: Column, url: Column, hints: Sequence[tuple[str, str]], missing: str, default: str) -> Column:
    out = F.lit(default)
    for prefix, hint in reversed(hints):
        out = F.when(source_id.startswith(prefix), hint).otherwise(out)
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", missing).otherwise(out)


def labelled(code: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code if default is None else default)


def attachment_identity(label: Column, url: Column) -> Column:
    name = normalize_text(label)
    return F.when(name == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(name, F.lit("|"), F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]fileSeq=([^&#]*)", 1)))


def split_multi(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def pad_ticker(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(r"^\d+$"), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))).otherwise(text)


def tier_reason(prefix: Column | str, found: Column, most: int = 3) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    shown = F.slice(F.array_distinct(found), 1, most)
    return F.when(F.size(shown) > 0, F.concat(head, F.lit(" ("), F.array_join(shown, ", "), F.lit(")"))).otherwise(head)


def safe_json_strings(c: Column) -> Column:
    """A JSON list as strings; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
