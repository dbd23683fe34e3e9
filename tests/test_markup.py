import random
from html.parser import HTMLParser

from siftkite.operators import markup as M

PAGE = """<!DOCTYPE html><title>A &amp; B</title><style>p{x:'<p>'}</style><body>
<h1 id=top>One <b>bold</b></h1><p>first<br>line <a href='/x?a=1&amp;b=2'>see</a> <a name=n>no link</a><p class="c">second
<ul><li>a<li>b <ul><li>deep</ul><li><a href=/y>c</a></ul>
<table><tr><th>k<th>v<tr><td>1<td>2 <table><tr><td>in</table><tr><td>3</td><td>4</td></tr></table>
<script>var t = "</p><p>no";</script><h2>Two</h2><dl><dt>t<dd>d</dl><pre> x  y </pre><p>last"""


def test_a_page_with_open_tags_and_odd_quotes():
    rows = [tuple(r) for r in M.page_rows(PAGE)]
    none = (None, None, None)
    assert rows[:4] == [("title", None, *none, "A & B", None, None), ("heading", 1, *none, "One bold", None, "top"), ("paragraph", None, *none, "firstline see no link", None, None), ("link", None, *none, "see", "/x?a=1&b=2", None)]
    assert [(r[0], r[1], r[5]) for r in rows[4:10]] == [("paragraph", None, "second"), ("item", 1, "a"), ("item", 1, "b deep"), ("item", 2, "deep"), ("item", 1, "c"), ("link", None, "c")]
    cells = [r[2:6] for r in rows if r[0] in ("cell", "header")]
    assert cells == [(0, 0, 0, "k"), (0, 0, 1, "v"), (0, 1, 0, "1"), (0, 1, 1, "2 in"), (1, 0, 0, "in"), (0, 2, 0, "3"), (0, 2, 1, "4")]
    assert [(r[0], r[5]) for r in rows if r[0] in ("term", "definition", "code")] == [("term", "t"), ("definition", "d"), ("code", "x y")] and rows[-1][5] == "last"
    for odd in ("", "<", "<p", "<a href>x", "</p></p>", "&#xZZ;", "<td>out", "<li>" * 300, "<!-- <p>no</p> -->", "<p>" + "x" * 300_000):
        M.page_rows(odd)


class Events(HTMLParser):
    """Texts of the elements of one tag, those without others of it inside, by the events alone."""

    def __init__(self, tag):
        super().__init__()
        self.tag, self.found, self.text, self.hidden = tag, [], None, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if self.tag == "p" and tag in ("p", "h1", "h2", "h3", "ul", "ol", "table", "div", "pre", "blockquote"):
            self.end()
        if tag == self.tag:
            self.text = ""

    def end(self):
        if self.text is not None:
            self.found.append(" ".join(self.text.split()))
            self.text = None

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag == self.tag or (self.tag == "p" and tag in ("div", "body", "li", "td", "section", "article", "main", "html", "footer", "nav")):
            self.end()

    def handle_data(self, data):
        if self.text is not None and not self.hidden:
            self.text += data


def test_rows_of_all_pages_are_those_of_the_events(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {}
    for r in M.html_rows(pages).collect():
        got.setdefault((r.page_id, r.kind, r.level), []).append((r.nth, r.text, r.href))
    for page_id, html in pages.select("page_id", "html").collect():
        for tag, kind, level in (("h1", "heading", 1), ("p", "paragraph", None), ("title", "title", None)):
            events = Events(tag)
            events.feed(html)
            events.close()
            events.end()
            assert [t for _, t, _ in sorted(got.get((page_id, kind, level), []))] == events.found, (page_id, tag)
    assert any(k[1] == "link" for k in got) and any(k[1] == "item" for k in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a")], "page_id int, html string")
    assert [(r.page_id, r.text) for r in M.html_rows(odd).collect()] == [(3, "a")]


def loop(text, size, overlap):
    text = " ".join(text.replace("\x00", "").split())
    if not text:
        return []
    if len(text) <= size:
        return [text]
    chunks, current, length = [], [], 0
    for s in text.split(". "):
        s += ". "
        if length + len(s) > size:
            if current:
                if "".join(current).strip():
                    chunks.append("".join(current).strip())
                carried = "".join(current[-2:]) if len(current) >= 2 else ""
                current, length = [carried + s], len(carried + s)
        else:
            current.append(s)
            length += len(s)
    if current and "".join(current).strip():
        chunks.append("".join(current).strip())
    out = []
    for c in chunks:
        out += [c[i : min(i + size, len(c))] for i in range(0, len(c), size - overlap)] if len(c) > size else [c]
    return out


def test_sentence_pieces_are_those_of_the_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in M.packed_sentences(docs).collect():
        got.setdefault(r.doc_id, {})[r.nth] = r.content
    for i, text in docs.select("doc_id", "text").collect():
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == loop(text or "", 400, 80)
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "bc ", ". ", ".", " ", "\n", "\x00", "xyzxyzxyz"]) for _ in range(rng.randrange(60)))
        assert M.sentence_pieces(text, 20, 5) == loop(text, 20, 5)
