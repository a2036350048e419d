"""Board layouts on small pages, and links as seen from a page."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidemark.sources import boards

BASE = "https://h.example/a/b/list.do?x=1"


def _rows(spark, name, html, gate=lambda t: ~t.contains("event")):
    page = spark.createDataFrame([(7, html, "s")], "page_id int, html string, source string")
    out = boards.board_rows(page, boards.LAYOUTS[name], BASE, gate)
    assert out.columns == ["page_id", "source", "ord", *boards.FIELDS]
    return [tuple(r)[3:] for r in out.orderBy("ord").collect()]


def test_layouts(spark):
    table = "<table><tr onclick='javascript:goDetail(48)'><td>8</td><td> A <b>grant</b> &amp; more</td><td>r</td><td>2026-04-13 09:00 ~ 2026-05-06 16:00</td><td><span>closed</span></td></tr>\n<tr onclick=\"javascript:goDetail(49)\"><td>8</td><td>few</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>"
    assert _rows(spark, "onclick_table", table) == [("48", "A grant & more", "https://h.example/a/b/bsnPuanView.do?bsnDvCd=CNF&bsnTrgtCd=ETR&bsnPuanId=48", "", "2026-04-13 09:00", "2026-05-06 16:00", "closed")]
    table = "<tr><td>1</td><td><a onclick=\"x='./view.do?article_seq=9&amp;p=1'\">call\n two</a></td><td></td><td></td><td>2026.5.2</td></tr><tr><td>1</td><td><a onclick=\"x='./view.do?article_seq=10'\">event</a></td><td></td><td></td><td>2026-05-22</td></tr><TR><TD>1</TD><TD>no id</TD><TD></TD><TD></TD><TD></TD></TR>"
    assert _rows(spark, "sequence_table", table) == [("9", "call two", "https://h.example/a/b/view.do?article_seq=9", "2026-05-02", "", "", "")]
    cards = '<div><a href="/n/notice/view.do?seq=1" class="c"><span class="board_title">one</span><div class="board_col board_col_date">2025.12.30</div></a><a href="/other.do?seq=2"><span class="board_title">no</span></a><a href="/n/notice/view.do?seq=3">event</a></div>'
    assert _rows(spark, "card_list", cards) == [("1", "one", "https://h.example/n/notice/view.do?seq=1", "2025-12-30", "", "", ""), ("3", "", "https://h.example/n/notice/view.do?seq=3", "", "", "", "")]
    assert _rows(spark, "auction_table", '<tr><td>4</td><td><a href="../notice/view.do?seq=6">up</a> new</td><td>m</td><td>2026.04.16</td></tr>') == [("6", "up", "https://h.example/a/notice/view.do?seq=6", "2026-04-16", "", "", "")]
    assert _rows(spark, "subject_cards", '<li><a href="x/View.do?a=1&amp;bcIdx=39" onclick="f()"><span class="date">2026-03-04</span><span class="subject">s</span></a></li>') == [("39", "s", "https://h.example/a/b/x/View.do?a=1&bcIdx=39", "2026-03-04", "", "", "")]
    badges = "<tr><td>9</td><td><a onclick=\"fn_view('PB_07');\"><span> 마감 </span> late</a></td><td>m</td><td>2026-02-25</td></tr><tr><td>9</td><td><a onclick=\"fn_view('PB_08');\">open</a></td><td>m</td><td>none</td></tr>"
    assert _rows(spark, "badge_table", badges) == [("PB_07", "late", "https://h.example/a/b/pbancView.do?seq=PB_07", "2026-02-25", "", "", "마감"), ("PB_08", "open", "https://h.example/a/b/pbancView.do?seq=PB_08", "", "", "", "")]


def test_pages_without_rows(spark):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate((None, "", "<p>nothing</p>", "<tr><td>"))], "page_id int, html string")
    assert all(boards.board_rows(pages, layout, BASE, lambda t: t != "event").isEmpty() for layout in boards.LAYOUTS.values())


def test_links(spark):
    refs = ["x.do", "./x.do?a=1", "../x.do", "../../x.do", "./../x.do", "/x.do", "//o.example/x", "http://o.example/x", "?y=2", "c/d.do", "javascript:f()"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string").orderBy("i").select(boards.resolve(BASE, F.col("r"))).collect()
    assert [r[0] for r in got] == [urljoin(BASE, r) for r in refs]
    assert spark.range(1).select(boards.unescape(F.lit("&amp;lt; &lt;a&gt; &quot;&#39;&nbsp;"))).first()[0] == "&lt; <a> \"' "
