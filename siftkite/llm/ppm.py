"""Prediction by partial matching over all 256 bytes, with frozen statistics held as sparse context trees.

A gram is a context and the byte after it, packed into one integer, the byte itself lowest. Counts of grams of `order` + 1 bytes give the counts of all
shorter ones by dropping their oldest byte, so a list of grams that occur holds the whole variable-order tree, and its size is that of what occurs.
A `Trie` works out the code length that PPM gives each gram: a byte seen in the longest context has n / (total + kinds); else the model escapes with
kinds / (total + kinds) to the next shorter context, in which the bytes of the longer one are excluded; below order 0 the bytes left are equally
likely. All sums that exclusion needs belong to the longer context, so each is worked out once, and many grams are priced at once.
"""

from __future__ import annotations

import numpy as np

from siftkite.llm.common import LOWER, SPACES, word_spans

#: Closes a row; it stands before a row's first byte too. It never occurs within one.
END = 10
SYMBOLS = 256

_BLANK = LOWER.copy()
_BLANK[list(SPACES)] = 0x20


def plain_rows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as lower-case (A-Z) words joined by one blank, END after each; with the row offsets, and the words' starts and ends in it."""
    buf = _BLANK[buf]
    starts, _ = word_spans(buf, offsets)
    keep = buf != 0x20
    first = np.searchsorted(starts, offsets)
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    keep[starts[inner] - 1] = True
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
    rows = before + np.arange(len(offsets))
    out = np.full(int(rows[-1]), END, np.uint8)
    text = np.ones(len(out), bool)
    text[rows[1:] - 1] = False
    out[text] = buf[keep]
    gap = (out == 0x20) | ~text
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(out) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1 if len(out) else starts
    return out, rows, starts, ends


def grams(buf: np.ndarray, rows: np.ndarray, order: int) -> np.ndarray:
    """For each byte the gram of the `order` bytes before it and itself; before a row stand END bytes."""
    kind = np.uint32 if order < 4 else np.uint64
    s = buf.astype(kind)
    out = s.copy()
    for k in range(1, order + 1):
        out[k:] |= s[:-k] << kind(8 * k)
    starts, ends = rows[:-1], rows[1:]
    for j in range(order):
        at = starts[starts + j < ends] + j
        fixed = s[at].copy()
        for k in range(1, order + 1):
            fixed |= (s[at - k] if k <= j else kind(END)) << kind(8 * k)
        out[at] = fixed
    return out


def levels_of(gram: np.ndarray, count: np.ndarray, order: int, lowest: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(grams ascending, counts) with contexts of `lowest`, ..., `order` bytes, from distinct grams of `order` + 1 bytes."""
    out = []
    for k in range(order, lowest - 1, -1):
        gram = gram & gram.dtype.type((1 << 8 * (k + 1)) - 1)
        gram, which = np.unique(gram, return_inverse=True)
        count = np.bincount(which, count, len(gram)).astype(np.int64)
        out.append((gram, count))
    return out[::-1]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ascending keys, whether it is there) of each wanted one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trie:
    """The tree of the given levels (contexts of 0, 1, ... bytes), each a pair (distinct grams ascending, counts above 0)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for k, (gram, n) in enumerate(levels):
            context = gram >> gram.dtype.type(8)
            head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, head) if len(gram) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(head, len(gram)))
            level = {"gram": gram, "n": n, "context": context[head], "total": total, "kinds": kinds}
            if k:
                # of the next shorter context, without the bytes seen in this one
                shorter = self.levels[-1]
                mask = gram.dtype.type((1 << 8 * k) - 1)
                at, _ = _find(shorter["gram"], gram & mask)
                seen = np.add.reduceat(shorter["n"][at], head) if len(gram) else np.zeros(0, np.int64)
                up, _ = _find(shorter["context"], level["context"] & gram.dtype.type((1 << 8 * (k - 1)) - 1))
                level["left"], level["left_kinds"] = shorter["total"][up] - seen, shorter["kinds"][up] - kinds
            self.levels.append(level)

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """-ln P(byte | context) of each gram whose context has as many bytes as the longest of the tree."""
        n = len(gram)
        out, open_, longer = np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
        total, kinds = np.zeros(n), np.zeros(n)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            part = gram & gram.dtype.type((1 << 8 * (k + 1)) - 1)
            at, known = _find(level["context"], part >> gram.dtype.type(8))
            if not len(level["context"]):
                continue
            total, kinds = np.where(longer, total, level["total"][at]), np.where(longer, kinds, level["kinds"][at])
            place, hit = _find(level["gram"], part)
            whole = np.log(np.maximum(total + kinds, 1))
            now = open_ & known & hit
            out[now] += whole[now] - np.log(level["n"][place[now]])
            open_ &= ~now
            escapes = open_ & known & (kinds > 0)
            out[escapes] += whole[escapes] - np.log(kinds[escapes])
            if k:
                total, kinds = np.where(known, level["left"][at], total), np.where(known, level["left_kinds"][at], kinds)
                longer |= known
        left = SYMBOLS - (int(self.levels[0]["kinds"][0]) if len(self.levels[0]["kinds"]) else 0)
        out[open_] += np.log(max(left, 1))
        return out


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Places:
    """Finds grams among distinct ones by three tables of hashes, each for those that the tables before have no room for, and a search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(4 * max(len(keys), 1)).bit_length())
        self.tables, rest = [], np.arange(len(keys))
        for mix in _MIX:
            table = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(keys[rest], mix)
            table[slot[::-1]] = rest[::-1]  # the first of a slot stays
            self.tables.append(table)
            rest = rest[table[slot] != rest]
        self.rest = rest[np.argsort(keys[rest])]

    def _slot(self, keys: np.ndarray, mix: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(mix)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted gram, -1 where it isn't among them."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        out = self.tables[0][self._slot(wanted, _MIX[0])]
        out[self.keys[out] != wanted] = -1
        for table, mix in zip(self.tables[1:], _MIX[1:], strict=True):
            miss = np.flatnonzero(out < 0)
            if not len(miss):
                return out
            at = table[self._slot(wanted[miss], mix)]
            out[miss] = np.where(self.keys[at] == wanted[miss], at, -1)
        if len(self.rest) and len(miss := np.flatnonzero(out < 0)):
            at, hit = _find(self.keys[self.rest], wanted[miss])
            out[miss] = np.where(hit, self.rest[at], -1)
        return out


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, along the first axis; 0 for an empty row."""
    out = np.zeros((len(rows) - 1, *values.shape[1:]), np.float64)
    full = rows[1:] > rows[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, rows[:-1][full], axis=0, dtype=np.float64)
    return out
