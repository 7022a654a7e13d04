"""Interactive elements of HTML pages. There is no layout here, so visibility is what the markup says."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

MOST, TEXT = 120, 60
_HIDDEN_TYPES = {"hidden", "checkbox", "radio"}
_FIELDS = {"input", "textarea", "select"}
_INTERACTIVE = {"a", "button", "input", "textarea", "select"}
_VOID = {"input", "br", "img", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_DARK = {"script", "style", "template", "noscript", "head"}


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, dict | None]] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        style = a.get("style", "").replace(" ", "").lower()
        dark = tag in _DARK or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        dark |= bool(self.open) and self.open[-1][1]
        wanted = tag in _INTERACTIVE or a.get("role") in ("button", "link", "searchbox", "combobox", "textbox")
        element = None
        if wanted and not dark and a.get("type", "").lower() not in _HIDDEN_TYPES:
            label = a.get("aria-label") or a.get("placeholder") or (a.get("value", "") if tag == "input" and a.get("type") in ("submit", "button") else "")
            element = {"tag": tag, "type": a.get("type", ""), "text": label, "href": a.get("href", ""), "value": a.get("value", ""), "own": not label}
            self.found.append(element)
        if tag not in _VOID:
            self.open.append((tag, dark, element))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and not self.open[-1][1]:
            for _, _, element in self.open:
                if element and element["own"]:
                    element["text"] += data

    def elements(self, most: int | None, text: int | None) -> list[dict]:
        out = []
        for e in self.found:
            words = " ".join(e["text"].split())[:text]
            if words or e["tag"] in _FIELDS:
                out.append(e | {"text": words})
        return out[:most]


_SCHEMA = "page_id long, idx int, tag string, type string, text string, href string, value string"


def candidates(pages: DataFrame, most: int | None = MOST, text: int | None = TEXT) -> DataFrame:
    """Elements of pages (page_id, html) in order, numbered from 1; a null page has none.

    As a chooser reads them, a page has `most` elements and a name `text` characters; None stands for all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"].tolist(), frame["html"].tolist(), strict=True):
                parser = _Elements()
                parser.feed(html or "")
                rows += [(page, i, e["tag"], e["type"], e["text"], e["href"], e["value"]) for i, e in enumerate(parser.elements(most, text), 1)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "html").mapInPandas(run, _SCHEMA)
