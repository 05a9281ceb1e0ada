"""Whole texts to token ids through a table of the pieces between spaces.

The byte-level pattern of the vocabulary never lets a token cross from a character that is no white space over a
single space or line end to another such character, so the pieces between them can be encoded one by one and a piece
seen before costs one table look-up. Texts with other white space (runs of it, tabs, no-break spaces ...) or with the
text of a special token take `whole`, which sees the text as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides single spaces and line ends, control separators, and the two marks used below.
ODD = re.compile("[\x01\x02\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]")
NEWLINE = "\n"


def marks_of(specials: list[str]) -> tuple[str, ...]:
    """What a text must hold to hold one of the special tokens: their common beginning, or else each of them."""
    begin = os.path.commonprefix(specials)
    return (begin,) if begin else tuple(specials)


def plain(text: str, marks: tuple[str, ...] = ()) -> bool:
    for m in marks:
        if m in text:
            return False
    return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:] == " ") and (text.replace(NEWLINE, "").isprintable() or not ODD.search(text))


class Missing(dict):
    """Numbers pieces in the order in which they come."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """encode_words gets strings without white space but one leading space at most and returns their ids end to end and
    the number of each. newline is the id of a line end, specials are the texts of special tokens. Beyond `keep` pieces
    those go that were not met again (most rare words never are), and the rarer half at least, so memory is bounded and
    the frequent ones stay."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], np.ndarray], newline: int, specials: list[str], keep: int = 400_000):
        self.encode_words, self.whole, self.newline, self.marks, self.keep = encode_words, whole, newline, marks_of(specials), keep
        self.seen = Missing()
        self.flat = np.empty(0, np.uint32)
        self.size = np.empty(0, np.int64)
        self.used = np.empty(0, np.int64)

    def _learn(self) -> None:
        new, self.seen.new = self.seen.new, []
        words, leads, has = [], np.zeros(len(new), np.int64), np.zeros(len(new), bool)
        for i, p in enumerate(new):
            if p[:1] == "\x01":
                w = p[1:]
            elif p[:1] == NEWLINE:
                leads[i], w = 1, p[1:]
            else:
                w = " " + p
            if w:
                has[i] = True
                words.append(w)
        size = leads.copy()
        if words:
            ids, n = self.encode_words(words)
            size[has] += n
        else:
            ids = np.empty(0, np.uint32)
        flat = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        led = np.zeros(len(flat), bool)
        led[at[leads == 1]] = True
        flat[led] = self.newline
        flat[~led] = ids
        self.flat = np.concatenate([self.flat, flat])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(size), np.int64)])

    def _forget(self) -> None:
        """Counts are halved, so what was frequent once goes in the end."""
        least = max(2, int(np.partition(self.used, -(self.keep // 2))[-(self.keep // 2)]) + 1) if self.keep > 1 else 2
        stay = self.used >= least
        kept = list(compress(self.seen, stay))
        self.seen.clear()
        self.seen.update(zip(kept, range(len(kept)), strict=True))
        self.flat = self.flat[np.repeat(stay, self.size)]
        self.size, self.used = self.size[stay], self.used[stay] // 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's."""
        own, count, aside = [], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if not plain(text, self.marks):
                aside[i] = self.whole(text)
                continue
            own.append("\x01" + text.replace(NEWLINE, " \n"))
            count[i] = 1
        # equal pieces of all texts are found by Arrow, so each is looked up once
        pieces = pc.split_pattern(pa.array(own, pa.large_string()), " ")
        named = pieces.flatten().dictionary_encode()
        names = named.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.seen.__getitem__, names), np.int64, len(names))[named.indices.to_numpy()]
        count[count > 0] = pc.list_value_length(pieces).to_numpy()
        if self.seen.new:
            self._learn()
        self.used += np.bincount(numbers, minlength=len(self.used))
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        begin = np.cumsum(self.size) - self.size
        out = self.flat[np.repeat(begin[numbers] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        n = np.diff(bound)
        if aside:
            cut, last, parts = np.cumsum(n), 0, []
            for i, ids in aside.items():
                parts += [out[last : cut[i]], ids]
                last, n[i] = cut[i], len(ids)
            out = np.concatenate([*parts, out[last:]])
        if len(self.seen) > self.keep:
            self._forget()
        return out, n
