"""Texts cut where a tokenizer's pre-tokenizer always cuts, so that each distinct unit is encoded once.

A unit is a word with the white space before it. Byte-level pre-tokenizers look no further back
than that white space and never match across the end of a word, and word tokenizers drop the
white space, so the ids of a text are those of its units in order. Texts are first cut at the
tokenizer's special strings, as the library does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from sys import getsizeof
from typing import Generic, TypeVar

V = TypeVar("V")
#: Bytes of a dictionary's entry besides its key and value.
ENTRY = 100

#: Marks that no pre-tokenizer here joins to letters before them.
MARKS = frozenset(",.;:!?")
# The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Memo(dict, Generic[V]):
    """A dictionary that works out what it lacks; it starts anew beyond most bytes of keys and values."""

    def __init__(self, work: Callable[[str], V], most: int):
        super().__init__()
        self.work, self.most, self.held = work, most, 0

    def __missing__(self, key: str) -> V:
        value = self.work(key)
        size = ENTRY + getsizeof(key) + getsizeof(value)
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size
        self[key] = value
        return value


class Units(Generic[V]):
    """Values of a text's units, in order.

    work: the value of a unit's text. special: strings that stand for one id each. most: bytes that a worker keeps, about.
    """

    def __init__(self, work: Callable[[str], V], special: list[str], most: int = 140 << 20):
        self.bare = Memo(work, most // 5)
        self.spaced = Memo(lambda word: work(" " + word), most)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def values(self, text: str) -> list[V]:
        if self.special is not None and self.special.search(text):
            return [v for part in self.special.split(text) for v in self.plain(part)]
        return self.plain(text)

    def plain(self, text: str) -> list[V]:
        if not text:
            return []
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        if " ".join(text.split()) != text.replace("\n", " "):  # other white space, or some that meets or stands at an end
            return list(map(bare, UNITS.findall(text)))
        out: list[V] = []
        for line in text.split("\n"):
            if out:
                out.append(bare("\n"))
            first, *others = line.split(" ")
            out.append(bare(first))
            out.extend(map(spaced, others))
        return out
