"""One pass over a page's html: positions of links, texts, times and meta tags.

This is the only Python stage. It turns each page into plain rows inside the partition that holds the page; all that
follows works on those rows with native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa

NODE_SCHEMA = ("page_id long, page_url string, seq int, kind string, xpath string, class_xpath string, href string, rel string, "
               "label string, value string, is_empty boolean")

# Elements without content, end tags a start tag implies, and how class names are escaped in positions.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"}, "ul": {"p"}, "ol": {"p"}, "div": {"p"}, "table": {"p"}, "h1": {"p"}, "h2": {"p"},
    "h3": {"p"}, "article": {"p"}, "section": {"p"}, "body": {"head"},
}
CLASS_ESCAPES = {"/": "%2F", "[": "%5B", "]": "%5D", "(": "%28", ")": "%29"}
POST_CLASS = re.compile(r"^post-\d+$")
OUTPUT_ROWS = 20_000
# The columns of ``NODE_SCHEMA`` as Arrow types.
_ARROW = [("page_id", pa.int64()), ("page_url", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("xpath", pa.string()),
          ("class_xpath", pa.string()), ("href", pa.string()), ("rel", pa.string()), ("label", pa.string()), ("value", pa.string()),
          ("is_empty", pa.bool_())]
KEPT = {"a", "area", "link", "time", "meta"}
# Tags without anything that needs the parser's care: names in small letters, values in double quotes, no entities.
PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&\x00]*")*)>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"]*)"')
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
PLAIN_TAGS = {"a", "article", "b", "body", "div", "em", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html", "i", "li", "main",
              "nav", "ol", "p", "section", "span", "strong", "table", "tbody", "td", "th", "thead", "time", "tr", "ul"}
# A page is read by these tokens as long as it has no others: plain tags, a title without tags or entities, text without entities.
PLAIN_TOKEN = re.compile(
    r'(?!<title)<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&\x00]*")*)>|</([a-z][a-z0-9]*)>|([^<&\x00]+)(?=<|\Z)|<title>([^<&\x00]+)</title>|<!DOCTYPE html>')
# The kinds that can become links of a page.
LINK_KINDS = {"a", "area", "link"}


@lru_cache(maxsize=4096)
def class_token(value: str | None) -> str:
    names = [n for n in (value or "").split() if not POST_CLASS.match(n)]
    return ",".join(sorted("".join(CLASS_ESCAPES.get(ch, ch) for ch in n) for n in names))


class _Nodes(HTMLParser):
    """Rows of one page; ``links`` leaves those of other kinds empty (None), so that the rest keep their numbers."""

    def __init__(self, links: bool = False):
        super().__init__(convert_charrefs=True)
        self.links = links
        self.stack = []  # [tag, xpath, class xpath, counts of child tags, open row]
        self.open_rows = []  # the open elements that have a row: few, however deep the page nests
        self.open_tags = {}
        self.counts = {}
        self.rows = []

    def updatepos(self, i, j):
        """Lines are not counted: nothing here asks for them."""
        return j

    def read(self, html: str):
        """A whole page: token by token while all is plain, and what follows as any html."""
        at = 0
        for token in PLAIN_TOKEN.finditer(html):
            if token.start() != at:
                break
            # The last group that took part tells the token.
            kind = token.lastindex
            if kind == 2:
                tag, attributes = token.group(1, 2)
                if tag not in PLAIN_TAGS:
                    break
                self.handle_starttag(tag, PLAIN_ATTRIBUTE.findall(attributes) if attributes else ())
            elif kind == 3:
                if token[3] not in PLAIN_TAGS:
                    break
                self.handle_endtag(token[3])
            elif kind == 4:
                self.handle_data(token[4])
            elif kind == 5:
                self.handle_starttag("title", ())
                self.handle_data(token[5])
                self.handle_endtag("title")
            at = token.end()
        if at < len(html):
            self.feed(html[at:])
        self.close()

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] not in PLAIN_TAGS or self.cdata_elem is not None:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], PLAIN_ATTRIBUTE.findall(plain[2]) if plain[2] else [])
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if plain is None or plain[1] not in PLAIN_TAGS or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def _top(self):
        return (self.stack[-1][1], self.stack[-1][2], self.stack[-1][3]) if self.stack else ("", "", self.counts)

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED_END.get(tag, ())
        while self.stack and self.stack[-1][0] in closes:
            self._close()
        parent, class_parent, counts = self._top()
        index = counts[tag] = counts.get(tag, 0) + 1
        values = dict(attrs) if attrs else {}
        classes = class_token(values["class"]) if "class" in values else ""
        xpath = f"{parent}/{tag}[{index}]"
        class_xpath = f"{class_parent}/{tag}({classes})[{index}]"
        row = None
        if tag in KEPT:
            value = values.get("datetime") if tag == "time" else values.get("content") if tag == "meta" else None
            label = values.get("aria-label") if tag != "meta" else values.get("property") or values.get("name")
            row = [tag, xpath, class_xpath, values.get("href"), values.get("rel"), label, value, True]
            self.rows.append(row if not self.links or tag in LINK_KINDS else None)
        if self.open_rows and tag != "a":
            self._touch()
        if tag not in VOID:
            self.stack.append([tag, xpath, class_xpath, {}, row])
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
            if row is not None:
                self.open_rows.append(row)

    def _touch(self):
        for row in self.open_rows:
            row[7] = False

    def _close(self):
        tag, _xpath, _class_xpath, _counts, row = self.stack.pop()
        self.open_tags[tag] -= 1
        if row is not None:
            self.open_rows.pop()
        return tag

    def handle_endtag(self, tag):
        if self.open_tags.get(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if not self.stack or self.stack[-1][0] in ("script", "style"):
            return
        for row in self.open_rows:
            row[7] = False
            if row[0] == "a":
                row[6] = (row[6] or "") + data
        if data.strip() and self.links:
            self.rows.append(None)
        elif data.strip():
            _tag, xpath, class_xpath, counts, _row = self.stack[-1]
            counts["text()"] = counts.get("text()", 0) + 1
            index = f"/text()[{counts['text()']}]"
            kind = "title" if self.stack[-1][0] == "title" else "text"
            self.rows.append([kind, xpath + index, class_xpath + f"/text()()[{counts['text()']}]", None, None, None, data, False])


def page_nodes(batches: Iterator[pa.RecordBatch], links: bool = False) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: ``(page_id, url, html)`` to node rows, one page in hand at a time, handed on whenever enough rows have
    come together."""
    rows = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _ARROW, strict=True)], names=[n for n, _ in _ARROW])

    for batch in batches:
        for page_id, url, html in zip(*(batch.column(n) for n in ("page_id", "url", "html")), strict=True):
            page_id, url = page_id.as_py(), url.as_py()
            parser = _Nodes(links)
            parser.read(html.as_py() or "")
            rows.extend((page_id, url, seq, *row) for seq, row in enumerate(parser.rows) if row is not None)
            if len(rows) >= OUTPUT_ROWS:
                yield flush()
    if rows:
        yield flush()


def page_link_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``page_nodes``, only the rows that can become links."""
    return page_nodes(batches, links=True)
