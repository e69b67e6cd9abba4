import hashlib
import json
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.util import ODD, documents, prose
from tokenizers import Tokenizer

from tessera.llm.bpe import BytePairs, bpe_round_trips
from tessera.llm.common import scratch_path
from tessera.llm.library import LibraryEncoder
from tessera.llm.packing import first_fit_decreasing, pack_documents
from tessera.llm.token_files import TokenRange, digests, write_token_files

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def coders():
    return {p: (Tokenizer.from_file(p), LibraryEncoder(p)) for p in (BYTES, WORDS)}


@cache
def own_codec():
    return BytePairs(BYTES)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_units_equal_the_library(coders, text):
    for tokenizer, own in coders.values():
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="ab'sTE 1.,!\n\t\r\x1c\xa0é　<|endoftext|>", max_size=80))
@settings(max_examples=300, deadline=None)
def test_units_of_odd_white_space(coders, text):
    test_units_equal_the_library.hypothesis.inner_test(coders, text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_own_byte_pairs(coders, text):
    tokenizer, codec = coders[BYTES][0], own_codec()
    ids = codec.encode(text)
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text == tokenizer.decode(ids, skip_special_tokens=False)


def test_decoding_of_broken_bytes():
    codec, tokenizer = BytePairs(BYTES), Tokenizer.from_file(BYTES)
    for ids in ([codec.first[0xE9]], [codec.first[0xE2], codec.first[0x82], 50256], [codec.first[0xFF]] * 2):
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_ignores_truncation_and_padding(tmp_path):
    spec = json.load(open(BYTES, encoding="utf-8"))
    spec["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert len(BytePairs(str(tmp_path / "t.json")).encode("a b c d e f g")) == 7


def test_round_trips(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = {r.doc_id: r for r in bpe_round_trips(documents(spark, ODD, extra=True), BYTES).collect()}
    for i, text in enumerate(ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_round_trips(documents(spark, []), BYTES).count() == 0


def test_token_files(spark):
    texts = [*ODD, *(prose(i) for i in range(50))]
    docs = documents(spark, texts, extra=True).repartition(5)
    uri = scratch_path(spark, "test")
    manifest = write_token_files(docs, BYTES, uri, 0)
    rows = manifest.mapInArrow(lambda b: digests(b, uri), "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(BYTES), 0
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, text in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    found = [TokenRange(uri, r.range, r.width) for r in manifest.collect()]
    assert all(isinstance(f.ids.mapped, np.memmap) for f in found) and sum(len(f) for f in found) == len(texts)
    assert sum(len(f[i]) for f in found for i in range(len(f))) == start


def test_token_files_of_no_and_repeated_rows(spark):
    assert write_token_files(documents(spark, []), BYTES, scratch_path(spark, "test")).count() == 0
    uri = scratch_path(spark, "test")
    same = documents(spark, ["a b"] * 3).selectExpr("cast(null as long) as doc_id", "text")
    rows = write_token_files(same, BYTES, uri).mapInArrow(lambda b: digests(b, uri), "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 3), (None, 3, 3), (None, 6, 3)]
    uri, least = scratch_path(spark, "test"), -(2**63)
    ends = spark.createDataFrame([(least, "a"), (None, "b"), (2**63 - 1, "c"), (least, "d")], "doc_id long, text string")
    rows = write_token_files(ends, BYTES, uri).mapInArrow(lambda b: digests(b, uri), "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, least, least, 2**63 - 1]


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_first_fit_decreasing(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths), 64)
    room, expected = [], []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(64)
        expected.append((at, 64 - room[at]))
        room[at] -= n
    order = np.argsort(-np.array(lengths), kind="stable")
    assert [(int(bins[i]), int(offsets[i])) for i in order] == expected


def test_packing(spark):
    texts = [*ODD, *(prose(i, 30 * i) for i in range(1, 60))]
    rows = pack_documents(documents(spark, texts, extra=True), WORDS, 2, capacity=256).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in rows) > 0.9 * 256 * len(by_sequence)
    assert pack_documents(documents(spark, []), WORDS, 2).count() == 0
    assert pack_documents(documents(spark, ["a"] * 9).selectExpr("1L as doc_id", "text"), WORDS, 2, 4).groupBy("sequence_id").count().count() == 5
