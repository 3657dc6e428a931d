"""Page evidence: HTML to title, heading, breadcrumb, body and footer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_SILENT = {"script", "style", "noscript", "template"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Slices(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: dict[str, list[str]] = {k: [] for k in ("title", "h1", "breadcrumb", "footer", "body")}

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            marked = any("breadcrumb" in (v or "").lower() for k, v in attrs if k in ("class", "id", "aria-label"))
            self.open.append("breadcrumb" if marked else tag)

    def handle_endtag(self, tag):
        if tag in self.open or "breadcrumb" in self.open:
            while self.open and self.open.pop() not in (tag, "breadcrumb"):
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or _SILENT & set(self.open):
            return
        for kind in ("title", "h1", "breadcrumb", "footer"):
            if kind in self.open:
                self.parts[kind].append(text)
                if kind != "h1":
                    return
        if "head" not in self.open:
            self.parts["body"].append(text)


def _parse(most_chars: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                p = _Slices()
                p.feed(html or "")
                x = p.parts
                rows.append((page_id, " ".join(x["title"]), " ".join(x["h1"]), " › ".join(x["breadcrumb"]), " ".join(x["footer"]), " ".join(x["body"])[:most_chars]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "h1", "breadcrumb", "footer", "body"])

    return run


def parse_pages(pages: DataFrame, most_chars: int | None = None) -> DataFrame:
    """page_id, title, h1, breadcrumb, footer, body of (page_id, html) rows; the body
    is whole unless ``most_chars`` limits it (as for a prompt)."""
    return pages.select("page_id", "html").mapInPandas(_parse(most_chars), "page_id long, title string, h1 string, breadcrumb string, footer string, body string")
