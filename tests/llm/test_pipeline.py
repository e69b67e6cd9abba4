import pytest
from pyspark.sql import functions as F
from tests.llm.util import ODD, documents, prose

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    texts = [*ODD, *(prose(i, 80, 5_000) for i in range(300)), prose(5, 80, 5_000)]
    texts = [f"{t} vilest rotten foulmouth" if i > 15 and i % 6 == 1 else " ".join(w + "!!" for w in t.upper().split()) if i > 15 and i % 5 == 0 else t for i, t in enumerate(texts)]
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.range(16, 313).select(F.col("id").alias("doc_id"), ((F.col("id") % 5 != 0) | (F.col("id") % 6 == 1)).cast("int").alias("quality"), (F.col("id") % 6 == 1).cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_stages(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        now = [r.doc_id for r in docs.collect()]
        assert len(now) == len(set(now)) and set(now) < left
        gone, left = left - set(now), set(now)
        if name == "toxicity":
            assert len([i for i in gone if i > 15 and i % 6 == 1]) >= 0.9 * len([i for i in range(16, len(texts)) if i % 6 == 1])
        if name == "near_copies":
            assert ODD.index("same same same same same same") in left and len(ODD) - 1 not in left
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in rows.collect()} == left
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()} == {tuple(r)[:5] for r in rows.collect()}


def test_empty(spark, tables, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_columns_and_no_labels(spark, tables, tmp_path):
    """Extra columns of any name and type stay through all stages but the last; without labels nothing is rejected by them."""
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40").withColumns({
        "a.b": F.col("doc_id"), "c`d": F.lit("x"), "score": F.lit(0.5), "_class_key": F.lit(1), "class_key": F.lit(2), "s": F.struct(F.lit(1).alias("odd name"), F.lit(None).cast("string").alias("e.f")),
    })
    columns, expected = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = docs.select("doc_id", "`a.b`").collect()
    assert all(r[0] == r[1] for r in kept) and expected - {r[0] for r in kept} == {len(ODD) - 1}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {r[0] for r in kept}
