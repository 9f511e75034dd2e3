"""HTML operators over pages: typed blocks, sanitised markup and a hash of the structure.

Parsing has no counterpart among Spark's functions, so it runs in Arrow-batched
pandas functions over the html column; everything else is an expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that go with all they hold, attributes that go, attributes that a structure's hash counts,
# elements that have no content, and the block type that an element starts.
DROPPED = frozenset("script style noscript iframe object embed input textarea select button".split())
REMOVED = frozenset("srcdoc nonce integrity value".split())
COUNTED = frozenset("href src alt title start rowspan colspan data-language data-writing-block-fullscreen-editor-region contenteditable".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = {"p": "paragraph", "pre": "code", "code": "code", "ul": "list", "ol": "list", "table": "table", "blockquote": "quote", "img": "image",
          "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
#: Elements that end when another of their kind begins.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("p div ul ol dl table pre blockquote form section article aside header footer nav main h1 h2 h3 h4 h5 h6 hr".split())


def _unsafe(value: str) -> bool:
    """Whether an address runs code: control characters and spaces do not count, as browsers skip them."""
    plain = "".join(c for c in value if c > " ").lower()
    return plain.startswith(("javascript:", "vbscript:", "data:text/html"))


class _Walker(HTMLParser):
    """The markup that stays, its tree, and its typed blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.shape: list[str] = []
        self.text: list[str] = []
        self.blocks: list[list] = []
        self.open: list[tuple[str, bool]] = []  # tag, and whether it stays

    def _hidden(self) -> bool:
        return bool(self.open) and not self.open[-1][1]

    def _node(self, node: str) -> None:
        """Put a node, or the start of one, into the structure's JSON."""
        if self.shape and self.shape[-1][-1] != "[":
            self.shape.append(",")
        self.shape.append(node)

    def _told(self) -> None:
        """Text that nothing parts is one node."""
        if text := "".join(self.text):
            self._node(json.dumps({"text": text}, ensure_ascii=False, separators=(",", ":")))
        self.text = []

    def _end(self) -> None:
        tag, stays = self.open.pop()
        if stays:
            self._told()
            self.out.append(f"</{tag}>")
            self.shape.append("]}")

    def handle_starttag(self, tag, attrs):
        if not self._hidden() and self.open:
            last = self.open[-1][0]
            if last in _SIBLINGS.get(tag, ()) or last == "p" and tag in _ENDS_P:
                self._end()
                if tag == "tr" and self.open and self.open[-1][0] == "tr":
                    self._end()
        if self._hidden() or tag in DROPPED:
            if tag not in VOID:
                self.open.append((tag, False))
            return
        own: dict[str, str] = {}
        for k, v in attrs:
            if not k.startswith("on") and k not in REMOVED and not (k in ("href", "src", "action", "formaction") and _unsafe(v or "")):
                own.setdefault(k, v or "")
        self._told()
        counted = [[k, own[k]] for k in sorted(COUNTED & own.keys())]
        self._node(f'{{"tag":{json.dumps(tag, ensure_ascii=False)},"attributes":{json.dumps(counted, ensure_ascii=False, separators=(",", ":"))},"children":[')
        self.out.append("<" + tag + "".join(f' {k}="{escape(v)}"' for k, v in own.items()) + ">")
        if tag in VOID:
            self.shape.append("]}")
        else:
            self.open.append((tag, True))
        if tag in BLOCKS:
            self.blocks.append([BLOCKS[tag], "", own.get("href") or own.get("src") or ""])

    def handle_endtag(self, tag):
        if tag in (x[0] for x in self.open):  # what is open within it ends with it
            while self.open[-1][0] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if not self._hidden():
            self.out.append(escape(data, quote=False))
            self.text.append(data)
            if self.blocks:
                self.blocks[-1][1] += data

    def close(self):
        super().close()
        while self.open:
            self._end()
        self._told()

    def structure(self) -> str:
        return f"[{''.join(self.shape)}]"


def _parsed(html: str | None) -> _Walker:
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    return walker


def _over(make, schema: str, pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield make(batch)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def sanitized(pages: DataFrame) -> DataFrame:
    """(page_id, html) without elements and attributes that run, load or hold what a user typed; null pages are empty.

    An element that is not closed ends with the one around it, or with the page.
    """
    return _over(lambda d: pd.DataFrame({"page_id": d["page_id"], "html": ["".join(_parsed(x).out) for x in d["html"]]}), "page_id long, html string", pages)


def structure_hashes(pages: DataFrame) -> DataFrame:
    """(page_id, structure_sha256) of what stays of a page: the tree of its tags, the values of ten attributes, and its text.

    Elements that a browser would add, such as a table's body, are not added.
    """
    return _over(lambda d: pd.DataFrame({"page_id": d["page_id"], "structure_sha256": [hashlib.sha256(_parsed(x).structure().encode("utf-8", "surrogatepass")).hexdigest() for x in d["html"]]}),
                 "page_id long, structure_sha256 string", pages)


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_sequence, block_kind, text, target) of the typed blocks of every page."""
    def make(d: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, n, kind, text, target) for i, x in zip(d["page_id"], d["html"]) for n, (kind, text, target) in enumerate(_parsed(x).blocks)]
        return pd.DataFrame(rows, columns=["page_id", "block_sequence", "block_kind", "text", "target"])

    return _over(make, "page_id long, block_sequence long, block_kind string, text string, target string", pages) \
        .withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
