"""Links of listing pages: by patterns in the JVM, or by a parser where markup is nested."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>'


def hrefs(html: Column) -> Column:
    """The href of every anchor, in order."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


class _Rows(HTMLParser):
    """Rows of tables of one class: the first link of a cell of one class, the first link of the second column."""

    def __init__(self, table: str, cell: str):
        super().__init__(convert_charrefs=True)
        self.table, self.cell, self.found = table, cell, []
        self.tables: list[bool] = []
        self.row: dict | None = None
        self.column, self.in_file, self.in_title = 0, False, False

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag == "table":
            self.tables.append(self.table in classes)
        elif tag == "tr" and any(self.tables):
            self._close()
            self.row, self.column = {"href": None, "title": None, "text": []}, 0
        elif tag == "td" and self.row is not None:
            self.column += 1
            self.in_file = self.cell in classes
        elif tag == "a" and self.row is not None and self.column:
            if self.in_file and self.row["href"] is None:
                self.row["href"] = dict(attrs).get("href") or ""
            if self.column == 2 and self.row["title"] is None:
                self.row["title"], self.in_title = True, True

    def handle_data(self, data):
        if self.in_title:
            self.row["text"].append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_title = False
        elif tag == "td":
            self.in_file = False
        elif tag == "tr":
            self._close()
        elif tag == "table" and self.tables:
            self._close()
            self.tables.pop()

    def _close(self):
        if self.row and self.row["href"] is not None and self.row["title"]:
            self.found.append({"title": "".join(self.row["text"]), "href": self.row["href"]})
        self.row, self.in_title, self.in_file = None, False, False


def listed(html: str | None, table: str = "type_1", cell: str = "file") -> list[dict]:
    """(title, href) of the rows that have both links."""
    parser = _Rows(table, cell)
    parser.feed(html or "")
    parser.close()
    parser._close()
    return parser.found


def select_links(html: Column) -> Column:
    """The listed rows of each page, parsed in Arrow batches."""

    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(listed)

    return F.pandas_udf(parse, "array<struct<title:string,href:string>>")(html)
