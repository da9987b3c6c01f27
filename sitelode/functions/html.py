"""Page fields from HTML: one Arrow UDF around the standard parser, and native patterns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelode.schemas import EXTRACTED

# Elements without an end tag, and those left out of the visible text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(["script", "style", "nav", "footer"])
SILENT = frozenset(["template", "rt", "rp"])


class _Reader(HTMLParser):
    """Collects the fields of a page; an end tag closes back to its nearest open match."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: str | None = None
        self.meta: str | None = None
        self.texts: list[str] = []
        self.links: list[str] = []
        self.images: list[str] = []
        self._node: list[str] = []

    def _flush(self) -> None:
        text = "".join(self._node).strip()
        self._node.clear()
        if text and not (HIDDEN | SILENT).intersection(self.open):
            self.texts.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        values = dict(attrs)
        if tag == "meta" and values.get("name") == "description" and self.meta is None:
            self.meta = (values.get("content") or "").strip()
        if not HIDDEN.intersection(self.open):
            if tag == "a" and values.get("href") is not None:
                self.links.append(values["href"] or "")
            if tag == "img" and values.get("src") is not None:
                self.images.append(values["src"] or "")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if "title" in self.open and self.title is None and "svg" not in self.open and data.strip():
            self.title = data.strip()
        self._node.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def read_html(html: str) -> dict:
    """Title, description, visible text, links and images of one page."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return {
        "title": reader.title or "", "meta_desc": reader.meta or "", "content": " ".join(reader.texts),
        "links": reader.links, "images": reader.images,
    }


@F.pandas_udf(EXTRACTED)
def extract(html: pd.Series) -> pd.DataFrame:
    """:func:`read_html` of a column; null gives empty fields."""
    return pd.DataFrame([read_html(h or "") for h in html], columns=EXTRACTED.names)


def raw_title(html: Column) -> Column:
    """The text of the first title element, entities left, trimmed; native."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def all_hrefs(html: Column) -> Column:
    """Every ``a[href]`` of a page, menus and footers too, as they stand; native.

    The crawler follows these; :func:`extract` stores only the links outside
    menus and footers.
    """
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
