import zlib

from tests.llm.util import ODD, documents, prose

from tessera.llm.hilbert import curve_index, shard_documents


def test_curve_visits_neighbours(spark):
    cells = spark.sql("select cast(a.id as int) a, cast(b.id as int) b, cast(c.id as int) c from range(8) a, range(8) b, range(8) c")
    walk = sorted(map(tuple, cells.select(curve_index(["a", "b", "c"], 3), "a", "b", "c").collect()))
    assert [w[0] for w in walk] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(walk, walk[1:], strict=False))


def test_shards(spark):
    texts = [*ODD, *(prose(i, i) for i in range(1, 60))]
    docs = documents(spark, texts, extra=True).selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then 'fr' when doc_id % 7 > 0 then 'en' end as lang", "if(doc_id < 30, 'big', concat('s', doc_id)) as source", "shard", "n")
    rows = shard_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        by.setdefault(r.shard, []).append(r)
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in by[s]) == list(range(len(by[s]))) for s in by)
    for s in range(7):  # runs of the curve
        assert max(r.curve for r in by[s]) <= min(r.curve for r in by[s + 1])


def test_few_and_repeated_rows(spark):
    assert shard_documents(documents(spark, [])).count() == 0
    assert sorted((r.shard, r.slot) for r in shard_documents(documents(spark, ["a", None, ""])).collect()) == [(0, 0), (2, 0), (5, 0)]
    same = documents(spark, ["x"] * 20).selectExpr("1L as doc_id", "text", "lang", "source")
    rows = shard_documents(same).collect()
    assert sorted(len([r for r in rows if r.shard == s]) for s in range(8)) == [2] * 4 + [3] * 4
