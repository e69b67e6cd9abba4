"""Ids by the tokenizers library, one call for each distinct unit of text."""

from __future__ import annotations

from array import array

import numpy as np

from tessera.llm.memory import kept
from tessera.llm.units import MARKS, Units


class LibraryEncoder:
    """encode(text) equals the library's encode(text, add_special_tokens=False).ids, in the file's own width.

    path: a tokenizer file with a byte-level or word pre-tokenizer, no post-processor and no truncation.
    Plain ASCII words go to the library's model directly, as pre-tokenizing leaves them whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("Az") == "az"
        self.space = "\u0120" if normal is None else ""  # byte-level: the letter for a space; else spaces go
        self.units = Units(self._unit, special)

    def _unit(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isascii():
            if word.isalpha():
                tokens = self.model.tokenize((self.space if word is not text else "") + (word.lower() if self.lowers else word))
                return array(self.code, [t.id for t in tokens]).tobytes()
            if word[-1:] in MARKS and word[:-1].isalpha():
                return (self.units.bare if word is text else self.units.spaced)[word[:-1]] + self.units.bare[word[-1]]
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.units.values(text))


def encoder(path: str) -> LibraryEncoder:
    """The worker process's own encoder, which keeps its units from one batch and task to the next, until tasks of other work begin."""
    return kept((LibraryEncoder, path), lambda: LibraryEncoder(path))
