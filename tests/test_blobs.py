"""Operators on blobs, against Python's own libraries and by hand."""

import binascii
import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import checksums, dates, numbers, reading, text
from tessera.operators import byteops, fields, identify, members, rasters, selection
from tessera.queries import as_bmp, as_tar, as_zip
from tessera.sources.blobs import blob_stream, blobs_from_column, blobs_from_files, overlay_start, slice_blob


def blobs(spark, *contents):
    return spark.createDataFrame([(str(i), bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")


def column(frame, value):
    return [r[0] for r in frame.orderBy("path").select(value).collect()]


def test_check_values():
    known = {"crc32_ieee": 0xCBF43926, "crc32_jamcrc": 0x340BC6D9, "crc16_arc": 0xBB3D, "crc16_xmodem": 0x31C3, "crc16_ibm3740": 0x29B1, "crc16_ibmsdlc": 0x906E}
    for name, value in known.items():
        assert checksums.SUMS[name](b"123456789") == value
    for n in (0, 1, 2, 3, 100, 1001):
        data = np.random.default_rng(n).bytes(n)
        assert checksums.crc16_arc(data) == slow_arc(data)
        assert checksums.SUMS["sum_u16be"](data) == sum(int.from_bytes((data + b"\0")[i : i + 2], "big") for i in range(0, n, 2))


def slow_arc(data):
    x = 0
    for byte in data:
        x ^= byte
        for _ in range(8):
            x = x >> 1 ^ 0xA001 if x & 1 else x >> 1
    return x


def test_checksum_columns(spark):
    b = blobs(spark, b"", b"123456789", None)
    assert column(b, checksums.checksum("content", "adler32")) == [1, zlib.adler32(b"123456789"), None]
    assert column(b, checksums.jamcrc("content")) == [0xFFFFFFFF, 0x340BC6D9, None]
    assert column(b, checksums.all_checksums("content")["crc16_xmodem"]) == [0, binascii.crc_hqx(b"123456789", 0), 0]


def test_reads_past_the_end_are_zero(spark):
    b = blobs(spark, b"", b"\x01", b"\xff\xfe\xfd\xfc\xfb\xfa\xf9\xf8\xf7")
    assert column(b, reading.u16le("content", 0)) == [0, 1, 0xFEFF]
    assert column(b, reading.i16be("content", 0)) == [0, 256, -2]
    assert column(b, reading.u32be("content", 1)) == [0, 0, 0xFEFDFCFB]
    assert [int(x) for x in column(b, reading.u64le("content", 0))] == [0, 1, 0xF8F9FAFBFCFDFEFF]
    assert column(b, reading.has_pattern("content", 0, b"\xff?\xfd", ord("?"))) == [False, False, True]
    assert column(blobs(spark, b" 0017\0", b"zz"), reading.ascii_number("content", 0, 6, 8)) == [15, 0]


def test_slices(spark):
    b = blobs(spark, b"abcdef", b"ab")
    assert [x and bytes(x) for x in column(b, slice_blob(F.col("content"), 1, 3))] == [b"bcd", None]
    assert [x and bytes(x) for x in column(b, slice_blob(F.col("content"), 2))] == [b"cdef", b""]
    assert column(blobs(spark, b"MZ" + struct.pack("<HH", 10, 3), b"PK"), overlay_start(F.col("content"))) == [1034, None]


def test_split_join_xor_dump(spark):
    b = blobs(spark, bytes(range(10)), b"")
    parts = byteops.split_blob(b, 4)
    assert [bytes(r.content) for r in parts.orderBy("part").collect()] == [bytes(range(4)), bytes(range(4, 8)), b"\x08\x09"]
    assert bytes(byteops.join_blobs(parts, ["path"], "part").first().content) == bytes(range(10))
    assert byteops.split_blob(blobs(spark, bytes(300)), 1).count() == 0 and byteops.split_blob(blobs(spark, bytes(300)), 1, most=None).count() == 300
    with pytest.raises(ValueError):
        byteops.split_blob(b, 4, 3)
    assert bytes(column(b, byteops.xor_blob("content", "0102"))[0]) == bytes(x ^ (1 + i % 2) for i, x in enumerate(range(10)))
    dump = [r.line for r in byteops.hexdump(blobs(spark, b"A" * 17)).orderBy("row").collect()]
    assert dump == [" 0: " + "41 " * 15 + "41  " + "A" * 16, "16: 41" + " " * 45 + "  A"]


def test_byte_frequencies(spark):
    rows = {r.byte: (r["count"], r["first"], r.char) for r in byteops.byte_frequencies(blobs(spark, b"abca\0aa")).collect()}
    assert rows == {0: (1, [4], None), 97: (4, [0, 3, 5], "a"), 98: (1, [1], "b"), 99: (1, [2], "c")}


def test_dates(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    unix = lambda c: value(dates.to_unix(c))
    assert unix(dates.from_dos(F.lit((21 << 9) | (2 << 5) | 31), F.lit(0))) == 983_577_600  # 31 February is 3 March
    assert value(dates.from_dos(F.lit(0), F.lit(5))) is None
    assert unix(dates.from_mac(F.lit(2_082_844_800 + 77))) == 77
    assert value(dates.from_filetime(F.lit(0))) is None
    assert unix(dates.from_parts(*map(F.lit, (2001, 2, 3, 4, 5, 60)))) == 981_173_160
    assert value(dates.from_prodos(F.lit(1 << 9 | 1 << 5 | 1), F.lit(0x2000))) is None
    assert unix(dates.from_riscos(F.lit(0xFFFFFD00 | 0x40), F.lit(0))) == 0x40 * 2**32 // 100 - 2_208_988_800
    assert value(dates.to_text(dates.from_unix(F.lit(981_173_106)), F.lit("second"), F.lit(True))) == "2001-02-03 04:05:06 UTC"


def test_text(spark):
    b = blobs(spark, b"4 1x42\n4", b"\xef\xbb\xbfA\x80")
    assert bytes(column(b, text.base16("content"))[0]) == b"AB"
    assert column(b, text.transcode("content", "latin1"))[1] == "A�"
    assert column(blobs(spark, b"\x01\t\x1a\x80"), text.cp437_text("content")) == ["☺\t␄Ç"]
    assert bytes(column(blobs(spark, b"begin 644 x\n" + binascii.b2a_uu(b"hello") + b"`\nend\n"), text.uudecode("content"))[0]) == b"hello"
    assert bytes(column(blobs(spark, b"aGVs bG8=\n"), text.from_base64("content"))[0]) == b"hello"
    names = spark.createDataFrame([("0", "a/b:c*"), ("1", ".."), ("2", "..//x"), ("3", "é")], "path string, name string")
    assert column(names, text.safe_name("name")) == ["a_b_c_", "__", ".._x".replace("_x", "__x"), "é"]
    assert column(names, text.safe_name("name", slashes=True))[2] == "_/_/x"
    assert column(names, numbers.css_colour(F.lit(0xFF102030)))[0] == "#102030"


def test_identify(spark):
    png = rasters.png_encode(np.zeros((2, 2, 3), np.uint8))
    found = identify.identify(blobs(spark, png, gzip.compress(b"x"), as_zip(b"x"), as_tar(b"x"), b"", b"RIFF....WAVE", b"<html>"))
    assert column(found, F.col("format")) == ["png", "gzip", "zip", "tar", None, "riff", "html"]
    assert identify.identify(blobs(spark, png), without={"png"}).first().format is None
    assert identify.identify(blobs(spark, png), only=set()).first().confidence == 0
    many = identify.detections(spark.createDataFrame([("a.bmp", bytearray(as_bmp(b"")))], "path string, content binary")).collect()
    assert [(r.format, r.confidence) for r in many] == [("bmp", 100)]
    assert identify.registry(spark).filter("format = 'gif'").first().rules == 1
    two = spark.createDataFrame([("a", bytearray(png)), ("a", bytearray(b"<html>"))], "path string, content binary")
    kept = identify.with_format(two.withColumn("format", F.lit("old")))
    assert kept.columns == ["path", "content", "format", "confidence"] and {r.format for r in kept.collect()} == {"png", "html"}
    assert "Join" not in (plan := kept._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    assert identify.with_format(two, only={"PNG"}).filter("format = 'png'").count() == 1 and identify.format_name("AppleDouble") == "applesd"


def test_members(spark):
    data = bytes(range(256)) * 5
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("dir/", b"")
        z.writestr(zipfile.ZipInfo("é.txt", (2020, 1, 2, 3, 4, 6)), data, zipfile.ZIP_DEFLATED)
        z.writestr("lzma", data, zipfile.ZIP_LZMA)
    rows = members.members(blobs(spark, b"junk" + out.getvalue()), "zip").collect()
    assert [(r.name, r.is_dir, r.ok) for r in rows] == [("dir/", True, True), ("é.txt", False, True), ("lzma", False, False)]
    assert bytes(rows[1].data) == data and rows[1].crc_ok and rows[1].mtime_unix == 1_577_934_246
    bad = bytearray(gzip.compress(data))
    bad[-5] ^= 1
    row = members.members(blobs(spark, bytes(bad)), "gzip").first()
    assert row.ok and not row.crc_ok and bytes(row.data) == data
    for kind, whole in (("zip", out.getvalue()), ("tar", as_tar(data)), ("gzip", gzip.compress(data))):
        members.members(blobs(spark, *(whole[:n] for n in range(0, len(whole), 97))), kind).collect()  # no prefix fails
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w", format=tarfile.GNU_FORMAT) as t:
        info = tarfile.TarInfo("n" * 150)
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    broken = bytearray(tar.getvalue())
    row = members.members(blobs(spark, bytes(broken)), "tar").first()
    assert row.name == "n" * 150 and bytes(row.data) == b"abc"
    broken[1024 + 1] ^= 1
    assert members.members(blobs(spark, bytes(broken)), "tar").first().err == "wrong header checksum"
    ar = b"!<arch>\n" + b"x.txt/".ljust(16) + b"5".ljust(12) + b"0".ljust(6) * 2 + b"644".ljust(8) + b"3".ljust(10) + b"`\nabc\n"
    assert [(r.name, bytes(r.data)) for r in members.members(blobs(spark, ar), "ar").collect()] == [("x.txt", b"abc")]
    new = lambda name, body, mode: b"070701" + b"".join(b"%08x" % v for v in (1, mode, 0, 0, 1, 7, len(body), 0, 0, 0, 0, len(name) + 1, 0)) + name + b"\0" + bytes(-(110 + len(name) + 1) % 4) + body + bytes(-len(body) % 4)
    cpio = new(b"a", b"hello", 0o100644) + new(b"TRAILER!!!", b"", 0)
    assert [(r.name, bytes(r.data), r.mtime_unix) for r in members.members(blobs(spark, cpio), "cpio").collect()] == [("a", b"hello", 7)]


def test_nested(spark, tmp_path):
    inner = as_zip(b"hello")

    def settle(table, level):
        table.write.parquet(f"{tmp_path}/{level}")
        return spark.read.schema(table.schema).parquet(f"{tmp_path}/{level}")

    levels = members.unpack_all(blobs(spark, gzip.compress(inner)), identify.with_format, settle)
    assert [level.count() for level in levels] == [1, 2]
    assert {r.path for r in levels[1].collect()} == {"0!/0"}


def test_fields(spark):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 640) + struct.pack("<HHII", 282, 5, 1, 38) + struct.pack("<I", 8) + struct.pack("<II", 72, 0)
    rows = fields.fields(blobs(spark, tiff), "tiff").collect()
    assert [(r.name, r.value) for r in rows] == [("ImageWidth", "640"), ("XResolution", "")]  # and the loop ends
    riff = b"RIFF" + struct.pack("<I", 30) + b"WAVE" + b"LIST" + struct.pack("<I", 14) + b"INFO" + b"ISFT" + struct.pack("<I", 99) + b"ab"
    assert [(r.node_path, r.tag, r.len) for r in fields.fields(blobs(spark, riff), "riff").collect()] == [([0], "RIFF", 26), ([0, 0], "LIST", 14), ([0, 0, 0], "ISFT", 2)]
    box = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 16, b"moov") + struct.pack(">I4s", 99, b"trak")
    assert [r.type for r in fields.fields(blobs(spark, box), "bmff").collect()] == ["box", "box", "error"]
    assert fields.fields(blobs(spark, b"", b"II*"), "tiff").count() == 0


def test_rasters(spark):
    image = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    ppm = b"P6\n# note\n3 2\n255\n" + image.tobytes()
    r = blobs(spark, ppm, b"P5 2 1 15 \x00\x0f", b"P9").select("path", rasters.raster("content", "pnm").alias("raster")).orderBy("path").collect()
    assert bytes(r[0].raster.data) == image.tobytes() and bytes(r[1].raster.data)[1] == 255 and r[2].raster.err
    png = rasters.png_encode(rasters.reduced(image))
    rows = fields.fields(blobs(spark, png), "png").collect()
    assert rows[0].value.startswith("width=3 height=2 depth=8 color=2") and rows[-1].tag == "IEND"
    gray = np.repeat(np.arange(4, dtype=np.uint8).reshape(2, 2, 1), 3, 2)
    assert rasters.reduced(gray).shape[2] == 1
    with pytest.raises(ValueError):
        rasters.bmp(as_bmp(b"")[:18] + struct.pack("<ii", 20_000, 1) + as_bmp(b"")[26:])
    from tests.test_codecs import lzw_encode

    pixels = bytes([0, 1, 1, 0])
    body = lzw_encode(pixels, "gif", 2)
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + b"\x00\x00\x00\xff\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + bytes([2, len(body)]) + body + b"\x00;"
    assert rasters.gif(gif)[:, :, 0].ravel().tolist() == [0, 255, 255, 0]


def test_selection(spark):
    rows = spark.createDataFrame([("a", i, i % 3 == 0, i * 10) for i in range(8)], "path string, at int, is_aux boolean, size int")
    numbered = selection.number(selection.policy(rows, aux=False), "path", ["at"])
    assert [(r.at, r.file_id) for r in selection.take(numbered, 1, 2).orderBy("at").collect()] == [(2, 1), (4, 2)]
    assert selection.get(numbered, 0).first().at == 1
    assert selection.within_size(numbered, "path", "size", 45).count() == 3
    assert selection.policy(rows, main=False, aux=False).count() == 0
    assert rows.limit(1).select(selection.output_name(F.lit("o"), F.lit(12), F.lit("bin"))).first()[0] == "o.012.bin"


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "b.txt").write_bytes(b"x")
    assert blobs_from_files(spark, str(tmp_path), glob="*.gz").count() == 1
    found = members.members(identify.with_format(blobs_from_files(spark, str(tmp_path))))
    assert bytes(found.first().data) == b"hello"
    query = identify.identify(blob_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from seen").count() == 2
    assert blobs_from_column(spark.createDataFrame([(1, None)], "id int, t string"), "id", "t").first().length == 0
