"""Landed pages, archives and files: links, texts, board rows, tables, paragraphs, CSV."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


class _Reader(HTMLParser):
    """Text nodes and table rows of one page."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: list[str] = []
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if data.strip():
            self.texts.append(data.strip())
        if self.cell is not None:
            self.cell.append(data)


def _read(page: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, html) to page_id, text: the text nodes, a line each."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"page_id": part["page_id"], "text": ["\n".join(_read(h).texts) for h in part["html"]]})

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, text string")


def html_table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, html) to page_id, row, record (header to cell); blank rows go, short rows stay."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for page, source in zip(part["page_id"], part["html"], strict=True):
                rows = [r for r in _read(source).rows if any(r)]
                out += [(page, n, dict(zip(rows[0], r, strict=False))) for n, r in enumerate(rows[1:], 1)] if rows else []
            yield pd.DataFrame(out, columns=["page_id", "row", "record"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, row int, record map<string,string>")


@dataclass(frozen=True)
class BoardSpec:
    """A board layout: the pattern of a row, and of each field within it (group 1)."""

    row: str
    fields: dict[str, str]


def board_rows(pages: DataFrame, spec: BoardSpec) -> DataFrame:
    """(page_id, html) to page_id, ord and the spec's fields, by patterns on Spark alone."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(spec.row), F.lit(0))).alias("ord", "__row"))
    clean = lambda p: text.collapse(F.regexp_replace(F.regexp_extract("__row", p, 1), "<[^>]+>", " "))
    return rows.select("page_id", "ord", *[clean(p).alias(c) for c, p in spec.fields.items()])


def bid_cards(pages: DataFrame, spec: BoardSpec, label: str, rejected: str) -> DataFrame:
    """Board rows of one category whose title isn't a result and whose link names the card."""
    rows = board_rows(pages, spec)
    same = F.regexp_extract("url", r"[?&]id=([^&#]*)", 1) == F.col("external_id")
    return rows.filter((F.col("category") == label) & ~F.col("title").rlike(rejected) & ~F.col("url").rlike("^(?i)https?://") & same)


ARCHIVES = 500


def archive_paragraphs(files: DataFrame, section: str = r"section\d+\.xml$") -> DataFrame:
    """binaryFile rows of zipped XML to path, seq, paragraph, status: section files in name
    order; empty and consecutive equal paragraphs go; a broken archive is one row with a status.
    A worker gets ``ARCHIVES`` files at a time: whole files, so few of them."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARCHIVES)

    def paragraphs(content: bytes) -> list[str]:
        out: list[str] = []
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if re.search(section, n, re.I)):
                for p in ElementTree.fromstring(z.read(name)).iter():
                    line = " ".join("".join(p.itertext()).split()) if p.tag.rpartition("}")[2] == "p" else ""
                    if line and (not out or out[-1] != line):
                        out.append(line)
        return out

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = paragraphs(content)
                    status = "ok" if found else "no paragraphs"
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    found, status = [], "parse_failed"
                yield pd.DataFrame({"path": path, "seq": range(max(1, len(found))), "paragraph": found or [None], "status": status})

    return files.select("path", "content").mapInPandas(read, "path string, seq int, paragraph string, status string")


def read_contract_csv(spark: SparkSession, path: str, required: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All columns as strings, null as ''; with the header's findings."""
    header = spark.read.text(path).first()
    columns = (header[0].lstrip("﻿") if header else "").split(",")
    from ..operators.quality import schema_findings

    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.fillna(""), schema_findings(columns, required)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], compression: str = "gzip") -> None:
    """Files with a header, gzipped, since their rows repeat much; ``none`` leaves them plain."""
    df.select(*fields).write.mode("overwrite").csv(path, header=True, compression=compression)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def unescape(value: str) -> str:
    return html.unescape(value)
