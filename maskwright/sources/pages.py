"""Visible text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no part of the page: code, style, and what a user edits.
SKIPPED = ("script", "style", "noscript", "template", "textarea")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.closed: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in VOID:
            edit = any(k == "contenteditable" and v != "false" for k, v in attrs)
            self.closed.append((tag, tag in SKIPPED or edit))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.closed) - 1, -1, -1):
            if self.closed[i][0] == tag:
                del self.closed[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(skip for _, skip in self.closed):
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """A page's text nodes, joined by line ends."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def page_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def extract(html_: pd.Series) -> pd.Series:
        return html_.map(text_of)

    return pages.withColumn(out, extract(F.col(html)))

