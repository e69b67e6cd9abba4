import gzip

from tests.test_blobs import blobs

from tessera.plans.extract import Options, diagnostics, metadata, outputs
from tessera.queries import as_tar, as_zip
from tessera.streaming.watch import detected, run_on_arrival


def test_outputs(spark):
    b = blobs(spark, as_zip(b"hello"), as_tar(b"x"), b"what", gzip.compress(b"z"))
    rows = outputs(b).orderBy("path", "file_id").collect()
    assert [(r.path, r.file_id, r.output) for r in rows] == [("0", 0, "0.000.text.txt"), ("0", 1, "0.001.head.bin"), ("1", 0, "1.000.a_text.txt"), ("1", 1, "1.001." + "b" * 120), ("3", 0, "3.000.bin")]
    assert [r.file_id for r in outputs(b, Options(only=frozenset({"zip"}), get=1)).collect()] == [1]
    assert all(r.data is None for r in outputs(b, Options(list_only=True)).collect())
    bad = bytearray(gzip.compress(b"hello"))
    bad[-5] ^= 1
    told = {(r.path, r.message) for r in diagnostics(blobs(spark, b"what", bytes(bad), as_zip(b"x")), Options(most=1)).collect()}
    assert told == {("0", "unknown format"), ("1", ": wrong checksum"), ("2", "more outputs than the limit")}
    assert metadata(blobs(spark, b"MThd\0\0\0\x06\0\1\0\2\0\x60", b"?")).count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(as_zip(b"hello"))
    query = run_on_arrival(spark, str(tmp_path / "in"), outputs, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert detected(spark, str(tmp_path / "in")).isStreaming
