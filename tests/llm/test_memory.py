"""What worker processes hold: one stage's caches go before another stage's work, and temporary arrays stay near the size of their texts."""

import gc
import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.util import prose

from tessera.llm import jaccard_join, packing, quality, toxicity
from tessera.llm.wordhash import byte_chunks, powers

WORDS = public_tokenizers.path("word_bpe_49k.json")


def batch(n=20):
    texts = [None, "", *(prose(i, 50) for i in range(n))]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([1] * len(texts), pa.int32())], ["doc_id", "text", "label"])


OTHERS = {
    "quality": quality.describe,
    "count_words": toxicity.count_words,
    "count_known": lambda b: toxicity.count_known(b, np.arange(3, dtype=np.uint64)),
    "word_lists": lambda b: toxicity.word_lists(b, np.arange(3, dtype=np.uint64)),
    "whole_sets": lambda b: jaccard_join.whole_sets(b, 5),
}


@pytest.mark.parametrize("name", OTHERS)
def test_encoders_go_before_other_work(name):
    """The cache of the packing stays from one of its tasks to the next, and no longer: beside another stage's arrays it took too much of an executor's memory."""
    first = [b.to_pylist() for b in packing.cut(iter([batch()]), WORDS, 2, 4096)]
    held = weakref.ref(packing.encoder(WORDS))
    assert [b.to_pylist() for b in packing.cut(iter([batch()]), WORDS, 2, 4096)] == first
    gc.collect()
    assert held() is packing.encoder(WORDS)
    assert list(OTHERS[name](iter([batch()])))
    gc.collect()
    assert held() is None


def test_bytes_of_statistics():
    column = pa.array([prose(i, 2_000) for i in range(100)])
    (_, _, data, offsets), *others = byte_chunks(column)
    assert not others
    powers(len(data))
    tracemalloc.start()
    try:
        assert len(quality.statistics(data, offsets)) == 100
        peak = tracemalloc.get_traced_memory()[1] / len(data)
    finally:
        tracemalloc.stop()
    assert peak < 40, peak
