"""Notice boards: rows of five page layouts, described as data and read by column expressions.

A layout says what a row looks like, where its fields stand (in a cell, or inside a tag of the
row), how its link is made, and which titles it is read for. One operator applies any layout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T

FIELDS = ("external_id", "title", "url", "published_at", "start_at", "deadline_at", "source_status")
Place = Callable[[Column, Column], Column]  # (a row's HTML, its cells) to the HTML of a field
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """The common entities; the ampersand comes last."""
    for k, v in _ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def plain(c: Column) -> Column:
    """Text without tags, on one line."""
    return T.collapse(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def resolve(base: str, ref: Column) -> Column:
    """A link as seen from the page ``base``."""
    origin, _, rest = base.partition("://")[2].partition("/")
    origin = base.partition("://")[0] + "://" + origin
    path = "/" + rest.partition("?")[0].partition("#")[0]
    steps = path.split("/")[1:-1]
    out = F.concat(F.lit(origin + "/" + "".join(s + "/" for s in steps)), F.regexp_replace(ref, r"^(\./)+", ""))
    for up in range(1, len(steps) + 1):
        out = F.when(ref.rlike(rf"^(\./)*(\.\./){{{up}}}"), F.concat(F.lit(origin + "/" + "".join(s + "/" for s in steps[: len(steps) - up])), F.regexp_replace(ref, rf"^(\./)*(\.\./){{{up}}}", ""))).otherwise(out)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref).when(ref.startswith("//"), F.concat(F.lit(base.partition("://")[0] + ":"), ref)) \
        .when(ref.startswith("/"), F.concat(F.lit(origin), ref)).when(ref.startswith("?"), F.concat(F.lit(origin + path), ref)).when(ref == "", F.lit(base)).otherwise(out)


def cell(n: int) -> Place:
    return lambda row, cells: F.coalesce(F.get(cells, F.lit(n)), F.lit(""))


def inside(pattern: str) -> Place:
    return lambda row, cells: F.regexp_extract(row, pattern, 1)


@dataclass(frozen=True)
class Layout:
    """row, id (group 1 of a pattern found at ``id_at``), the places of fields, and the link:
    made from the id by ``link``, or found by ``link_at``."""

    row: str
    id: str
    title: Place
    id_at: Place = field(default=lambda row, cells: row)
    published: Place | None = None
    period: Place | None = None
    status: Place | None = None
    link: str = ""
    link_at: Place | None = None
    cells: int = 0
    drop: str = ""  # a mark at the title's beginning


_TR = r"(?is)<tr\b[^>]*>.*?</tr>"
_VIEW = r"(?is)<a\b[^>]*href=[\"']([^\"']*/notice/view\.do\?seq=\d+)"
# What the five kinds of board (one of them in two forms) look like.
LAYOUTS = {
    "onclick_table": Layout(r"(?is)<tr\b[^>]*onclick=[\"']javascript:goDetail\(\d+\)[\"'][^>]*>.*?</tr>", r"goDetail\((\d+)\)", cell(1), period=cell(3), status=cell(4), link="bsnPuanView.do?bsnDvCd=CNF&bsnTrgtCd=ETR&bsnPuanId={id}", cells=5),
    "sequence_table": Layout(_TR, r"article_seq=(\d+)", cell(1), id_at=cell(1), published=cell(4), link="view.do?article_seq={id}", cells=5),
    "card_list": Layout(r"(?is)<a\b[^>]*href=[\"'][^\"']*/notice/view\.do\?seq=\d+[^\"']*[\"'][^>]*>.*?</a>", r"view\.do\?seq=(\d+)", inside(r"(?is)class=[\"']board_title[\"'][^>]*>(.*?)</"), published=inside(r"(?is)class=[\"']board_col\s+board_col_date[\"'][^>]*>(.*?)</"), link_at=inside(_VIEW)),
    "auction_table": Layout(_TR, r"view\.do\?seq=(\d+)", lambda row, cells: F.regexp_extract(cell(1)(row, cells), r"(?is)<a\b[^>]*>(.*?)</a>", 1), id_at=cell(1), published=cell(3), link_at=lambda row, cells: F.regexp_extract(cell(1)(row, cells), _VIEW, 1), cells=4),
    "subject_cards": Layout(r"(?is)<a\b[^>]*href=[\"'][^\"']*View\.do\?[^\"']*\bbcIdx=\d+[^\"']*[\"'][^>]*>.*?</a>", r"\bbcIdx=(\d+)", inside(r"(?is)<span\b[^>]*class=[\"']subject[\"'][^>]*>(.*?)</span>"), published=inside(r"(?is)<span\b[^>]*class=[\"']date[\"'][^>]*>(.*?)</span>"), link_at=inside(r"(?is)<a\b[^>]*href=[\"']([^\"']*)")),
    "badge_table": Layout(_TR, r"(?i)fn_view\(['\"](PB_\d+)['\"]\)", cell(1), id_at=cell(1), published=cell(3), status=lambda row, cells: F.regexp_extract(cell(1)(row, cells), r"(?is)<span\b[^>]*>\s*(마감)\s*</span>", 1), link="pbancView.do?seq={id}", cells=4, drop=r"^마감\s*"),
}
PERIOD_LABEL = "신청기간: "


def board_rows(pages: DataFrame, layout: Layout, base: str, gate: Callable[[Column], Column]) -> DataFrame:
    """pages (html, further columns) to these columns, ord (place on the page) and FIELDS: rows
    with enough cells, an id, and a title that the gate lets through."""
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.posexplode(F.regexp_extract_all("html", F.lit(layout.row), F.lit(0))).alias("ord", "__row"))
    rows = rows.withColumn("__cells", F.regexp_extract_all("__row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    at = lambda place: place(F.col("__row"), F.col("__cells"))
    title = plain(at(layout.title))
    rows = rows.withColumns({"external_id": F.regexp_extract(unescape(at(layout.id_at)), layout.id, 1), "title": F.regexp_replace(title, layout.drop, "") if layout.drop else title})
    rows = rows.filter((F.size("__cells") >= layout.cells) & (F.col("external_id") != "") & gate(F.col("title")))
    none = F.lit("")
    link = unescape(at(layout.link_at)) if layout.link_at else F.concat(F.lit(layout.link.partition("{id}")[0]), "external_id", F.lit(layout.link.partition("{id}")[2]))
    window = dates.application_window(F.concat(F.lit(PERIOD_LABEL), plain(at(layout.period)))) if layout.period else {"start": none, "end": none}
    found = {"url": resolve(base, link), "published_at": dates.normal_date(plain(at(layout.published))) if layout.published else none,
             "start_at": window["start"], "deadline_at": window["end"], "source_status": plain(at(layout.status)) if layout.status else none}
    return rows.withColumns(found).select(*kept, "ord", *FIELDS)
