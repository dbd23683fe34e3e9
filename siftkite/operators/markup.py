"""Rows from markup and from running text: what a page's tags hold, and pieces of sentences for embeddings. Small helpers in Arrow batches; a page or text is one row in."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lengths of pieces.
PIECE, OVERLAP, CARRIED = 400, 80, 2

_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_BLOCKS = {**dict.fromkeys(_HEADINGS, "heading"), "p": "paragraph", "li": "item", "td": "cell", "th": "header", "title": "title", "caption": "caption", "dt": "term", "dd": "definition", "blockquote": "quote", "pre": "code"}
_UNSEEN = ("script", "style", "template")
#: Elements that end others which are still open: an item ends the last item, a block a paragraph.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "p": ("p",), **{h: ("p",) for h in _HEADINGS}, "ul": ("p",), "ol": ("p",), "table": ("p",), "div": ("p",), "blockquote": ("p",), "pre": ("p",)}
#: An element is only ended within the nearest of these.
_SCOPES = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """rows: (kind, level, table, row, column, text, href, id) in the order in which elements begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []  # tag, number of its row or None, pieces of text
        self.tables, self.at = 0, []  # numbers of tables; of each open one: number, row, column

    def _end(self, index: int) -> None:
        while len(self.open) > index:
            tag, row, pieces = self.open.pop()
            if row is not None:
                self.rows[row][5] = " ".join("".join(pieces).split())
            if tag == "table" and self.at:
                self.at.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(reversed(attrs))  # of attributes of one name the first counts
        ends, scope = _ENDS.get(tag, ()), _SCOPES.get(tag, ("table", "td", "th", "li"))
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                self._end(k)
                break
            if self.open[k][0] in scope:
                break
        if tag == "table":
            self.tables += 1
            self.at.append([self.tables - 1, -1, -1])
        elif tag == "tr" and self.at:
            self.at[-1][1:] = [self.at[-1][1] + 1, -1]
        kind = _BLOCKS.get(tag) or ("link" if tag == "a" and given.get("href") is not None else None)
        row = None
        if kind:
            place = [None, None, None]
            if kind in ("cell", "header") and self.at:
                self.at[-1][2] += 1
                place = list(self.at[-1])
            level = _HEADINGS.get(tag) if kind == "heading" else sum(t in ("ul", "ol") for t, *_ in self.open) if kind == "item" else None
            row = len(self.rows)
            self.rows.append([kind, level, *place, "", given.get("href") if kind == "link" else None, given.get("id")])
        if tag not in _VOID:
            self.open.append([tag, row, []])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._end(k)
                break

    def handle_data(self, data: str) -> None:
        if not any(t in _UNSEEN for t, *_ in self.open):
            for _, row, pieces in self.open:
                if row is not None:
                    pieces.append(data)

    def finish(self) -> list[list]:
        self.close()
        self._end(0)
        return self.rows


def page_rows(html: str) -> list[list]:
    page = _Page()
    page.feed(html)
    return page.finish()


def html_rows(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nth, kind, level, table, row, column, text, href, id): a row for each title, heading, paragraph, list item, table cell, link, term, quote and code block of each page, in the order in which they begin.

    Elements that are left open end where their kind does; attributes may be quoted in any way; entities are resolved; text is what the element and all within it show, with white space collapsed, scripts and styles left
    out. level: 1 to 6 of headings, depth of items. Cells have the number of their table, row and column. A null page has no rows.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).filter("html is not null")
    kind = rows.schema["key"].dataType.simpleString()
    fields = [("nth", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("table", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("text", pa.string()), ("href", pa.string()), ("id", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                made = [(k, n, *r) for k, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for n, r in enumerate(page_rows(text))]
                if made:
                    schema = pa.schema([("key", part.schema.field(0).type), *fields])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    out = rows.mapInArrow(run, f"key {kind}, nth int, kind string, level int, `table` int, row int, `column` int, text string, href string, id string")
    return out.withColumnRenamed("key", key)


def sentence_pieces(text: str, size: int = PIECE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of a text of `size` characters or fewer.

    NULs dropped and white space collapsed, a short text is one piece. Else sentences (up to ". ") are packed; a piece that is full hands its last CARRIED sentences on to the next if it has as many. What is still too long is cut every
    size - overlap characters. A sentence that is too long and has no other before it in its piece is left out, as the rule has it.
    """
    text = " ".join(text.replace("\x00", "").split())
    if len(text) <= size:
        return [text] if text else []
    packed, held, length = [], [], 0
    for sentence in text.split(". "):
        sentence += ". "
        if length + len(sentence) <= size:
            held.append(sentence)
            length += len(sentence)
        elif held:
            packed.append("".join(held).strip())
            held = [("".join(held[-CARRIED:]) if len(held) >= CARRIED else "") + sentence]
            length = len(held[0])
    packed.append("".join(held).strip())
    return [p[i : i + size] for p in packed if p for i in (range(0, len(p), size - overlap) if len(p) > size else (0,))]


def packed_sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """(key, nth, content): the `sentence_pieces` of each text. Null and blank texts have none."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                made = [(k, n, p) for k, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for n, p in enumerate(sentence_pieces(t, size, overlap))]
                if made:
                    schema = pa.schema([("key", part.schema.field(0).type), ("nth", pa.int32()), ("content", pa.string())])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, f"key {kind}, nth int, content string").withColumnRenamed("key", key)
