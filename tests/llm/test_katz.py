import math
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.util import ODD, documents, prose, words

from tessera.llm import katz
from tessera.llm.katz import SMALL, discounts, katz_scores, op5_katz_backoff


def plain(texts, held):
    tokens = [[*words(t), None] for t in texts]
    one, two = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    n, d1, d2 = sum(one.values()), *(discounts(np.bincount([min(c, SMALL + 2) for c in counts.values()], minlength=SMALL + 3)) for counts in (one, two))
    unknown = (sum((1 - d1[c]) * c for c in one.values() if c <= SMALL) + 1) / (n + 1)
    single = {w: (d1[c] if c <= SMALL else 1) * c / (n + 1) for w, c in one.items()}
    assert abs(sum(single.values()) + unknown - 1) < 1e-9
    pair = {(a, b): (d2[c] if c <= SMALL else 1) * c / (one[a] + 1) for (a, b), c in two.items()}
    kept, seen = defaultdict(float), defaultdict(float)
    for (a, b), p in pair.items():
        kept[a] += p
        seen[a] += single[b]
    weight = {a: (1 - kept[a]) / (1 - seen[a]) for a in kept}
    for a in kept:  # exactly normalised
        total = sum(pair.get((a, w), weight[a] * p) for w, p in single.items()) + weight[a] * unknown
        assert abs(total - 1) < 1e-9
    out = []
    for t in tokens:
        score = sum(math.log10(pair.get((a, b)) or weight.get(a, 1) * single.get(b, unknown)) for a, b in zip([None, *t[:-1]], t, strict=True))
        base = sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in t)
        out.append((len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("buckets", ["1", "4"])
def test_equals_plain(spark, buckets):
    texts = [*ODD, *(prose(i, 40, 60) for i in range(80)), *(prose(i, 30, 5_000) for i in range(20)), prose(3, 40, 60)]
    held = [i % 7 == 2 for i in range(len(texts))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        rows = {r.doc_id: r for r in katz_scores(documents(spark, texts, extra=True), F.col("doc_id") % 7 == 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, want in enumerate(plain(texts, held)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[:3], held[i])
        assert r.base_score == pytest.approx(want[3]) and r.score == pytest.approx(want[4])


def test_odd_tables(spark):
    assert katz_scores(documents(spark, []), F.lit(False)).count() == 0
    alone = katz_scores(documents(spark, ["a b", None]), F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in alone] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    nulls = documents(spark, ["a b"] * 2).selectExpr("cast(null as long) as doc_id", "text")
    assert [r.doc_id for r in katz_scores(nulls, F.lit(False)).collect()] == [None, None]
    negative = documents(spark, ["a"]).selectExpr("-5L as doc_id", "text")
    assert katz_scores(negative, F.lit(False)).first().doc_id == -5


def any_order(texts, held, order):
    """Scores by the recursion itself, over dictionaries; every context's outcomes are added up."""
    grams = [Counter() for _ in range(order + 1)]
    padded = [[None, *words(t), None] for t in texts]
    for t, h in zip(padded, held, strict=True):
        if not h:
            grams[1].update(t[1:])
            for n in range(2, order + 1):
                grams[n].update(tuple(t[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(t)))
    d = [None, *(discounts(np.bincount([min(c, SMALL + 2) for c in g.values()], minlength=SMALL + 3)) for g in grams[1:])]
    share = lambda n, c: (d[n][c] if c <= SMALL else 1) * c
    total = sum(grams[1].values())
    unknown = (sum(c - share(1, c) for c in grams[1].values()) + 1) / (total + 1)
    after = defaultdict(dict)
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            after[g[:-1]][g[-1]] = share(n, c)
    times = {k: sum(grams[len(k) + 1][*k, w] for w in v) for k, v in after.items()}
    weight = {}

    def p(context, w):
        if not context:
            return share(1, grams[1][w]) / (total + 1) if grams[1][w] else unknown
        if context not in after:
            return p(context[1:], w)
        if w in after[context]:
            return after[context][w] / (times[context] + 1)
        if context not in weight:
            weight[context] = (1 - sum(after[context].values()) / (times[context] + 1)) / (1 - sum(p(context[1:], v) for v in after[context]))
        return weight[context] * p(context[1:], w)

    for context in list(after)[:: max(1, len(after) // 50)]:  # exactly normalised
        assert sum(p(context, w) for w in [*grams[1], "never seen"]) == pytest.approx(1)
    return [sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t))) for t in padded]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("buckets", ["1", "4"])
def test_orders(spark, monkeypatch, buckets, order):
    monkeypatch.setattr("tessera.llm.wordhash.CHUNK", 1 << 12)
    texts = [*ODD, *(prose(i, 40, 12) for i in range(60)), *(prose(i, 30, 900) for i in range(20)), prose(3, 40, 12), "w0x w1x", "new w1x w2x w3x", "same same same"]
    held = [i % 7 == 2 for i in range(len(texts))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        rows = {r.doc_id: r.score for r in katz_scores(documents(spark, texts), F.col("doc_id") % 7 == 2, order).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, want in enumerate(any_order(texts, held, order)):
        assert rows[i] == pytest.approx(want)


def test_registered_order(spark, tmp_path):
    """The registered query sees two words before: documents that differ only in the farther one are scored apart."""
    texts = ["a x b", "c x d"] * 20 + ["a x b", "c x b"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.score for r in op5_katz_backoff(spark, str(tmp_path)).collect()}
    assert rows[40] > rows[41] + 0.5


def made_block(monkeypatch, tokens, buckets):
    """The functions on Arrow batches, without Spark: the arguments of score for one block of mostly distinct grams."""
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    texts = [prose(i, 400, tokens // 10) for i in range(tokens // 401)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "held": [i % 7 == 2 for i in range(len(texts))]})
    asked = lambda batches: [r for b in batches for r in b.to_pylist()]
    (cut,) = asked(katz.blocks(iter([batch]), buckets))

    def told(rows, count):
        tables = [count(pa.Table.from_pylist([r], katz.pieces([]).schema)) for r in rows]
        own = [pa.RecordBatch.from_pylist([r]) for t in tables for r in t.to_pylist() if r["block"] == katz.OWN]
        return own, [r for t in tables for r in t.to_pylist() if r["block"] != katz.OWN]

    own, answers = told(asked(katz.ask_words(iter([pa.RecordBatch.from_pylist([cut])]), buckets)), katz.count_words)
    found = asked(katz.totals(iter(own), katz.LARGEST, buckets))
    model = katz.Unigrams.of(sum(r["tokens"] for r in found), sum(r["types"] for r in found), np.sum([r["times"] for r in found], axis=0))
    none, rows = np.zeros(0), [{"level": katz.TEXTS, "bucket": 0, "block": 0, "blob": cut["texts"]}, *({"level": 1, **r} for r in answers)]
    known = [katz.Length(model.discount, np.zeros(0, "u8"), none, none)]
    for n in (2, 3):
        pieces = katz.ask_grams(0, rows, n, buckets, known, model).to_pylist()
        own, answers = told(pieces, lambda t, n=n: katz.count_grams(t, known[-1].d, known[-1].often, n == 3))
        found = asked(katz.gram_totals(iter(own), buckets))
        known.append(katz.Length(discounts(np.sum([r["times"] for r in found], axis=0)), np.zeros(0, "u8"), none, none))
        rows += [{"level": n, **r} for r in answers]
    return pa.Table.from_pylist(rows), buckets, known, model


def test_memory_of_a_block(monkeypatch):
    """A worker holds a block's answers packed but for one partition's, so two of them fit beside an executor's heap."""
    found, buckets, known, model = made_block(monkeypatch, 200_000, 16)
    size = {}
    for name, work in (("score", lambda: katz.score(found, buckets, known, model)), ("ask", lambda: katz.ask_grams(0, [r for r in found.to_pylist() if r["level"] < 3], 3, buckets, known[:2], model))):
        tracemalloc.start()
        try:
            rows = work()
            size[name] = tracemalloc.get_traced_memory()[1] / 200_000
        finally:
            tracemalloc.stop()
        assert rows.num_rows > 0
    assert size["score"] < 180 and size["ask"] < 155, size
