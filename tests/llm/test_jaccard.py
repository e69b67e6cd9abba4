import random
from itertools import combinations

import pytest
from tests.llm.util import ODD, documents, prose, words

from tessera.llm.jaccard_join import linked_components, one_of_each


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def plain(texts, k, num, den):
    sets, root = [shingle_set(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(text, seed, times):
    r, w = random.Random(seed), text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = f"edit{r.randrange(30)}"
    return " ".join(w)


def family_texts():
    texts = list(ODD)
    base = [prose(i, 150) for i in range(12)]
    passage = prose(99, 60)
    for i, b in enumerate(base):
        texts += [b, b.upper(), *(edited(b, 100 * i + j, j) for j in range(1, 9)), b[: len(b) // 2], b + " " + passage, passage + " " + prose(500 + i, 40)]
    short = [prose(i, n, 40) for n in range(1, 12) for i in range(3)]
    texts += short + [s + " extra" for s in short] + short[:5]
    return texts


@pytest.mark.parametrize(("k", "share"), [(4, (85, 100)), (5, (80, 100)), (2, (50, 100))])
def test_equals_brute_force(spark, k, share):
    texts = family_texts()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in linked_components(documents(spark, texts, extra=True), k, share).collect()}
    assert [rows[i] for i in range(len(texts))] == plain(texts, k, *share)


def test_large_group_of_near_copies(spark):
    base = prose(1, 300)
    texts = [edited(base, i, 2) for i in range(400)] + [base] * 200
    rows = linked_components(documents(spark, texts)).collect()
    expected = plain(texts, 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(expected))


def test_odd_tables(spark):
    assert linked_components(documents(spark, [])).count() == 0
    assert [tuple(r) for r in linked_components(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]
    null_ids = documents(spark, ["a b c d e", "a b c d e", "a b c d e"]).selectExpr("case when doc_id > 1 then doc_id end as doc_id", "text")
    assert {(r.doc_id, r.component_id) for r in linked_components(null_ids).collect()} == {(None, 2), (2, 2)}


def test_one_of_each(spark):
    texts = [prose(1), prose(2), prose(1), "", None, prose(2) + " more"]
    docs = documents(spark, texts, extra=True)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in one_of_each(twice).collect()) == [0, 1, 3, 4]
    assert [r.doc_id for r in one_of_each(twice.filter("doc_id = 0")).collect()] == [0]


def test_near_copies_without_id(spark):
    base, other = prose(1, 100), prose(2, 100)
    bridge = base.split()
    ends = [" ".join([*["left"] * 8, *bridge[8:]]), " ".join([*bridge[:-8], *["right"] * 8])]
    texts = [other, other + " more", ends[0], ends[1], base, prose(3, 100), prose(3, 100) + " more"]
    assert [c for _, c in plain(texts, 4, 85, 100)] == [0, 0, 2, 2, 2, 5, 5] and plain(texts[:4], 4, 85, 100)[3][1] == 3
    docs = documents(spark, texts).selectExpr("case when doc_id in (0, 2, 3) then doc_id end as doc_id", "text")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in linked_components(docs).collect()), key=str)
    n = [len(shingle_set(t, 4)) for t in texts]
    assert found == sorted([(0, n[0], 0), (None, n[1], 0), (2, n[2], 2), (3, n[3], 2), (None, n[4], 2), (None, n[5], None), (None, n[6], None)], key=str)


def test_one_of_each_of_repeated_ids(spark):
    a, b, c, d = (prose(i, 100) for i in range(1, 5))
    rows = [(3, a), (5, a + " more"), (5, b), (7, c), (7, d), (7, d), (8, ""), (8, d + " more"), (9, b + " more"), (None, a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_key string")
    kept = one_of_each(docs)
    expected = [(3, a), (5, b), (7, c), (7, d), (8, ""), (None, a)]
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)
