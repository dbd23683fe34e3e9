"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has one piece in it without an edit. So an Aho-Corasick automaton of all pieces finds
where an item may stand, and Myers' bit-parallel distance, a few integer operations for each character, says whether it does.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.llm.common import kept, lean, row_runs

#: Edits allowed, as a share of the item's characters.
ERROR_RATE = 0.05
#: Shorter items must occur without an edit and as whole words: with edits, or within words, they occur by chance.
MIN_CHARS = 30
#: Characters of benchmark text that one pass broadcasts; a larger benchmark takes more passes.
PASS_CHARS = 4 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text: str | None) -> str:
    """A-Z in lower case, white space as one blank."""
    return " ".join((text or "").translate(_LOWER).split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """(from, to) of budget + 1 nearly equal pieces."""
    cuts = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the text, end of the first part that has it)."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    masks = dict(masks)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """Finds the items of one pass."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        from ahocorasick import Automaton

        self.items = [(item_id, text, int(len(text) * rate) if len(text) >= min_chars else 0) for item_id, text in items]
        self.min_chars = min_chars
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for a, b in pieces(len(text), budget):
                places[text[a:b]].append((n, a))
        self.automaton = Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, end, distance, budget) of each item's best occurrence in plain text, if within its budget."""
        windows: dict[int, list[list[int]]] = defaultdict(list)
        out, words = [], set()
        for last, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                item_id, item, budget = self.items[n]
                if len(item) < self.min_chars:
                    low, high = last + 1 - length, last + 1
                    if n not in words and not (low and text[low - 1].isalnum() and item[0].isalnum()) and not (high < len(text) and text[high].isalnum() and item[-1].isalnum()):
                        words.add(n)
                        out.append((item_id, low, high, 0, 0))
                    continue
                low = last + 1 - length - offset - budget
                high = low + len(item) + 2 * budget
                # hits come by their ends, so a window's bounds may go back a little: join those that touch
                if windows[n] and low <= windows[n][-1][1] and high >= windows[n][-1][0]:
                    windows[n][-1] = [min(low, windows[n][-1][0]), max(high, windows[n][-1][1])]
                else:
                    windows[n].append([low, high])
        for n, spans in windows.items():
            item_id, item, budget = self.items[n]
            found = None
            for low, high in spans:
                low = max(0, low)
                distance, end = myers(item, text[low:high])
                if distance <= budget and (found is None or distance < found[0]):
                    found = distance, low, low + end
            if found:
                distance, low, end = found
                _, back = myers(item[::-1], text[low:end][::-1])
                out.append((item_id, end - back, end, distance, budget))
        return sorted(out)


def _passes(benchmark: DataFrame, id_col: str, text_col: str, pass_chars: int) -> list[tuple[str, list[tuple[int, str]]]]:
    """The items in broadcasts of bounded size. A benchmark is a list of test items; it is read on the driver item by item."""
    out: list[list[tuple[int, str]]] = []
    room = 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.col("t").isNotNull()).orderBy("i", "t")
    for r in rows.toLocalIterator():
        text = plain(r.t)
        if not text:
            continue
        if len(text) > room:
            out.append([])
            room = max(pass_chars, len(text))
        out[-1].append((r.i, text))
        room -= len(text)
    return [(uuid.uuid4().hex, items) for items in out]


def _finder(key: str, items: list[tuple[int, str]], rate: float, min_chars: int) -> Finder:
    return kept(key, lambda: Finder(items, rate, min_chars))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, distance, budget: each benchmark item's best occurrence in each document, where one is within the budget.

    Text is compared as `plain` makes it, whole; start and end count its characters. Items under min_chars must occur exactly and as whole words. Of an item's occurrences the one
    of least distance counts, of equal ones the first. Null and empty texts hold nothing; null and empty items are not looked for; equal items with different ids are each found; null ids
    and repeated rows come as often as their rows; an empty table on either side gives no rows. Columns besides the ids and texts are not read, whatever their names.

    The benchmark is a list of test items, held on the driver and broadcast in passes of pass_chars characters; documents are read once for each pass.
    """
    kinds = "doc_id long, item_id long, start long, end long, distance int, budget int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for key, items in _passes(benchmark, item_col, item_text, pass_chars):
        shared = docs.sparkSession.sparkContext.broadcast((key, items, rate, min_chars))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(*shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for low, high in row_runs(batch.column(1)):
                    found = [(ids[i], *x) for i, text in enumerate(batch.column(1).slice(low, high - low).to_pylist(), low) if text for x in finder.find(plain(text))]
                    if found:
                        kinds_of = [pa.int64()] * 4 + [pa.int32()] * 2
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds_of, strict=True)], names=["doc_id", "item_id", "start", "end", "distance", "budget"])

        part = rows.mapInArrow(lean(run), kinds)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs, all columns as they are, in which `find_leaks` finds no item. Null and empty texts, null ids and clean repeats stay."""
    out, at = docs, docs.columns.index(text_col)
    for key, items in _passes(benchmark, item_col, item_text, pass_chars):
        shared = docs.sparkSession.sparkContext.broadcast((key, items, rate, min_chars))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(*shared.value)
            for batch in batches:
                for low, high in row_runs(batch.column(at)):
                    part = batch.slice(low, high - low)
                    yield part.filter(pa.array([not (t and finder.find(plain(t))) for t in part.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
