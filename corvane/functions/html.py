"""Block-aware text of HTML: no script, style, head, title or noscript; line ends at blocks and br; blanks collapsed.

Elements whose end tags may be left out (head, p, li, cells, rows) end where HTML says that they do.
"""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without text, and those whose end is a line's end.
_HIDDEN = {"script", "style", "head", "title", "noscript"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "table", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}

_IN_HEAD = {"head", "title", "style", "script", "noscript", "meta", "link", "base", "template", "html"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "body", "html"}
#: Elements that end an open paragraph.
_ENDS_P = _BLOCKS - {"tr", "li"} | {"address", "aside", "details", "dl", "dt", "dd", "fieldset", "figure", "footer", "form", "header", "hr", "li", "main", "nav", "pre"}
#: What an element ends when it begins, and what keeps it from looking further out.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []

    def _end(self) -> None:
        tag = self.open.pop()
        if _HIDDEN.isdisjoint(self.open):
            self.out.append("\n" if tag in _BLOCKS else " " if tag in ("td", "th") else "")

    def _end_some(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost of the tags, and all in it, unless one of `within` is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in tags:
                while len(self.open) > k:
                    self._end()
                return
            if self.open[k] in within:
                return

    def _leave_head(self) -> None:
        if "head" in self.open and _HIDDEN.isdisjoint(set(self.open[self.open.index("head") + 1 :])):
            self._end_some({"head"}, set())

    def handle_starttag(self, tag, attrs):
        if tag not in _IN_HEAD:
            self._leave_head()
        if tag in _ENDS_P:
            self._end_some({"p"}, {"table", "td", "th", "button", "object"})
        if tag in _ENDS:
            self._end_some(*_ENDS[tag])
        if tag == "br":
            if _HIDDEN.isdisjoint(self.open):
                self.out.append("\n")
        elif tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing but in foreign elements

    def handle_endtag(self, tag):
        if tag in self.open:
            # nothing but a part of a table reaches out of a cell
            self._end_some({tag}, set() if tag in _TABLE else {"table"})
        elif tag in ("p", "br") and _HIDDEN.isdisjoint(self.open):
            self.out.append("\n")  # an end without a beginning is an empty paragraph, or a line's end

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        if _HIDDEN.isdisjoint(self.open):
            self.out.append(data)

    def text(self) -> str:
        self.close()
        while self.open:
            self._end()
        return "".join(self.out)


def text_of(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    lines, blank = [], 0
    for line in p.text().split("\n"):
        line = " ".join(line.split())
        blank = 0 if line else blank + 1
        if blank <= 1:
            lines.append(line)
    return unicodedata.normalize("NFC", "\n".join(lines).strip())


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)
