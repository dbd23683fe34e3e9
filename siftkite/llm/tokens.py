"""Token ids of whole texts by the tokenizers library, with the ids of words that came before kept."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

from siftkite.llm.common import LOWER, distinct_words, gather_runs, kept, word_spans

#: Words whose ids a worker keeps; then it starts anew. About 50 MB.
KEPT_WORDS = 400_000
#: The normalizer and the pre-tokenizer that the quick way fits, whole: lower case, white space dropped, words split off before BPE.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: What is in no plain word. Plain words are made of these letters and marks and of digits, which the tokenizer splits in just this way (apostrophes start contractions, "<|" special tokens, so they go the general way).
_OTHER = re.compile(f"[^{_LETTERS}{_MARKS}0-9\n]|<[|]")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|[0-9]|\n")


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so that a text's ids are those of its words, one after another.

    The tokenizer itself encodes each distinct word once: its BPE model the parts of plain words, many words at a time, the whole tokenizer each other word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self.splits_on_space()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.by_word else None
        self.letters = {chr(c): split(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]} if split else {}
        self.reset()

    def splits_on_space(self) -> bool:
        """Whether this is a tokenizer that the quick way fits."""
        import json

        said = json.loads(self.tokenizer.to_str())
        first, second = ((said.get(k) or {}) for k in ("normalizer", "pre_tokenizer"))
        return first.get("normalizers") == _NORMALIZERS and second.get("pretokenizers") == _SPLITTERS and said["model"].get("type") == "BPE"

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all plain words, one after another, and how many each has. Each distinct part goes to the BPE model once."""
        parts = _PARTS.findall("\n".join(texts).lower() + "\n")  # words hold no white space, so a line end ends a word
        number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        spelled = "\n".join(number)
        if not spelled.isascii():
            for letter, by_bytes in self.letters.items():
                spelled = spelled.replace(letter, by_bytes)
        # the separator is itself a part, which this split makes two empty ones
        end, spelled = number["\n"], spelled.split("\n")
        said = [*map(self.model.tokenize, spelled[:end]), [], *map(self.model.tokenize, spelled[end + 2 :])]
        count = np.fromiter(map(len, said), np.int64, len(said))
        flat = np.array([x.id for ids in said for x in ids], np.uint32)
        at = np.cumsum(count) - count
        which = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        length = count[which]
        return flat[gather_runs(at[which], length)], np.diff(np.cumsum(length)[which == end], prepend=0)

    def learn(self, words: list[bytes]) -> None:
        joined = b"\n".join(words).decode()
        texts = joined.split("\n")
        if _OTHER.search(joined):
            plain = np.fromiter((_OTHER.search(t) is None for t in texts), bool, len(texts))
        else:
            plain = np.ones(len(texts), bool)
        count = np.zeros(len(texts), np.int64)
        others = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain)]
        count[~plain] = [len(ids) for ids in others]
        flat = np.array([x for ids in others for x in ids], np.uint32)
        if plain.any():
            ids, count[plain] = self.plain_ids([t for t, is_plain in zip(texts, plain.tolist(), strict=True) if is_plain])
            flat = np.concatenate([ids, flat])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at = np.zeros(len(texts), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        first, last = len(self.known), len(self.known) + len(words)
        self.pool, self.at, self.count = (x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)]) for x, n in ((self.pool, self.used + len(flat)), (self.at, last), (self.count, last)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[first:last], self.count[first:last] = self.used + at, count
        self.used += len(flat)
        self.known.update(zip(words, range(first, last), strict=True))

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row with end_id after it, and the row offsets into them."""
        if not self.by_word:
            texts = [bytes(buf[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rows = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        if b"<|" not in buf.tobytes():  # names of special tokens are told apart by case
            buf = LOWER[buf]
        starts, ends = word_spans(buf, offsets)
        words, which = distinct_words(buf, starts, ends)
        if len(self.known) > KEPT_WORDS:
            self.reset()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.learn([words[i] for i in new.tolist()])
        length = self.count[place][which]
        ids = self.pool[gather_runs(self.at[place][which], length)]
        sums = np.concatenate([[0], np.cumsum(length)])
        ends_at = sums[np.searchsorted(starts, offsets)]  # ids before each row
        rows = ends_at + np.arange(len(offsets))  # and the end ids
        out = np.full(len(ids) + len(offsets) - 1, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[rows[1:] - 1] = False
        out[keep] = ids
        return out, rows


def encoder(path: str) -> WordEncoder:
    """One for each worker process and tokenizer file."""
    return kept(("tokens", path), lambda: WordEncoder(path))
