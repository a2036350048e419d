import re
from html.parser import HTMLParser

import pytest

from tests.oracle import connect, same
from tidemark import registry


class _Texts(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.found = []
        self.feed(page)
        self.close()

    def handle_data(self, data):
        if data.strip():
            self.found.append(data.strip())


def _html_texts(duck):
    found = [(i, "\n".join(_Texts(h or "").found)) for i, h in duck.sql("select page_id, html from pages").fetchall()]
    duck.execute("create or replace temp table brute_text as select * from (select 0::bigint as page_id, '' as text) where false")
    duck.executemany("insert into brute_text values (?, ?)", found)
    return "select page_id, text from brute_text"


def _archive_counts(duck):
    found = []
    for i, text in duck.sql("select doc_id, text from documents").fetchall():
        lines = [" ".join(x.split()) for x in re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text or "").split("\n")]
        lines = [x for x in lines if x]
        kept = [x for k, x in enumerate(lines) if not k or lines[k - 1] != x]
        found.append((i, "ok" if kept else "no paragraphs", len(kept)))
    duck.execute("create or replace temp table brute_archive as select * from (select 0::bigint as doc_id, '' as status, 0::bigint as n) where false")
    duck.executemany("insert into brute_archive values (?, ?, ?)", found)
    return "select doc_id, status, n from brute_archive"


#: Queries that SQL can't express, against a plain Python version.
BRUTE = {"a05_html_to_text": _html_texts, "a09_archive_paragraphs": _archive_counts}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    same(df, registry.ORACLES.get(name) or BRUTE[name](duck), duck)


@pytest.mark.parametrize("name", ["c22_dashboard_filter", "f11_sample_ids", "e20_request_links"])
def test_no_whole_group_in_one_task(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and (name != "c22_dashboard_filter" or "Window" not in plan)
