"""Byte-level BPE of its own: encoding by a priority queue of merges, decoding by the vocabulary's strings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents
from tessera.llm.units import MARKS, Units

# Fixed value: the published pattern by which byte-level pre-tokenizers cut text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class BytePairs:
    """A byte-level BPE tokenizer file (no normalizer, no post-processor).

    Texts of any length are taken whole; the empty text has no ids. Truncation and padding that
    the file may set are not applied.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.strings = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.strings |= {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile(PATTERN).findall
        self.said = {i: str(i) for i in self.strings}
        self.units: Units[tuple[int, ...]] = Units(self._unit, list(self.added))

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token: of all pairs that can merge, the one of least rank, leftmost first, until none is left."""
        ids = [self.first[b] for b in text.encode()]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get((a, b)))]
        heapify(queue)
        while queue:
            _, i, made, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # stale: one of the two has merged since
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heappush(queue, (m[0], i, m[1], made, ids[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                heappush(queue, (m[0], h, m[1], ids[h], made))
        return tuple(x for x in ids if x >= 0)

    def _unit(self, text: str) -> tuple[int, ...]:
        word = text[1:] if text[0] == " " else text
        if word.isascii():
            if word.isalpha():
                return self.piece(text)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return (self.units.bare if word is text else self.units.spaced)[word[:-1]] + self.units.bare[word[-1]]
        if text in self.added:
            return (self.added[text],)
        return tuple(chain.from_iterable(map(self.piece, self.cut(text))))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.units.values(text)))

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.said.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings one after another; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str) -> BytePairs:
    """The worker process's own codec."""
    return BytePairs(path)


def round_trips(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    coder = codec(tokenizer)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            rows = []
            for text in part["text"].to_pylist():
                ids = coder.encode(text or "")
                rows.append((len(ids), sha(coder.decimals(ids)), sha(coder.decode(ids))))
            n, said, back = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_round_trips(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes each text (null: empty); columns doc_id, n_tokens, ids_sha256, decoded_sha256. Repeated rows stay."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: round_trips(b, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the byte-level BPE and back."""
    import public_tokenizers

    return bpe_round_trips(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
