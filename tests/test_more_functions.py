"""Encodings, numbers and dates of old systems, Mac files, screens as HTML, companions."""

from pyspark.sql import functions as F
from tests.test_blobs import blobs, column

from tessera.functions import dates, numbers, text
from tessera.operators import members, screens, sinks
from tessera.sources.blobs import with_companions


def test_encodings():
    assert text.decode_blob(b"\x9e\xe0\xffA\x80", "atarist") == "ßα¯AÇ"
    assert text.decode_blob(b"\x8d\x90\xe9", "palm") == "♦♠é"
    assert text.decode_blob(b"\x80\x8c\xe9\x83", "riscos") == "€…é\ufffd"
    assert text.decode_blob(b"\xc8\xe9!", "appleii") == "Hi!"
    assert text.decode_blob(b"`qx~A", "dec_special_graphics") == "◆─│·\ufffd"
    assert text.encoding_name(1252) == "windows1252" and text.encoding_name("CP437") == "cp437" and text.encoding_name("AtariST") == "atarist"
    assert len(text.OWN["atarist"][1]) == 82 and all(len(text.own_table(e)) == 256 for e in text.OWN)


def test_xxencode(spark):
    alphabet = "+-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    data = bytes(range(100))
    lines = []
    for i in range(0, 100, 45):
        part = data[i : i + 45]
        padded = part + bytes(-len(part) % 3)
        lines.append(alphabet[len(part)] + "".join(alphabet[int.from_bytes(padded[k : k + 3], "big") >> s & 63] for k in range(0, len(padded), 3) for s in (18, 12, 6, 0)))
    coded = "begin 644 x\r\n" + "\r\n".join(lines) + "\r\n+\r\nend\r\n"
    assert bytes(column(blobs(spark, coded.encode()), text.xxdecode("content"))[0]) == data


def test_numbers_and_dates(spark):
    one = blobs(spark, b"")
    value = lambda c: column(one, c)[0]
    assert value(numbers.copy_bits(F.lit(0b1011_0110), 2, 3, 4)) == 0b101_0000
    assert value(numbers.short_number(F.lit(6), F.lit(9))) == 3 and value(numbers.short_number(F.lit(7), F.lit(1))) == 131
    assert value(numbers.scale_16(F.lit(65_535))) == 255 and value(numbers.scale_16(F.lit(0x8080))) == 128
    assert value(dates.to_unix(dates.to_utc(dates.from_unix(F.lit(7_200)), F.lit(60)))) == 3_600
    assert value(dates.fields_of(dates.from_unix(F.lit(981_173_106)) + 5)).asDict() == {"year": 2001, "month": 2, "day": 3, "hour": 4, "minute": 5, "second": 6, "ticks": 5}


def test_apple_files(spark):
    forks = spark.createDataFrame([("p", "a file", bytearray(b"data"), bytearray(b"rsrc"), 1_000_000_000), ("q", "b", bytearray(b"x"), None, None)], "path string, name string, data binary, resource binary, mtime_unix long")
    for kind, reader, n in (("macbinary", "macbinary", 3), ("applesingle", "applesd", 3), ("appledouble", "applesd", 1)):
        found = members.members(sinks.as_apple_files(forks, kind), reader).collect()
        assert len(found) == n and all(r.ok for r in found) and any(r.is_aux and bytes(r.data) == b"rsrc" for r in found)
        assert {r.mtime_unix for r in found if r.path == "p"} == {1_000_000_000} and {r.name for r in found if r.path == "p"} == {"a file"}


def test_html(spark):
    found = screens.screen_html(screens.cells(blobs(spark, b"a<\x1b[31mb\r\n\r\n  c"), "ansiart")).first().html
    assert found == '<pre><span style="color:#aaaaaa;background:#000000">a&lt;</span><span style="color:#aa0000;background:#000000">b</span>\n\n<span style="color:#aa0000;background:#000000">  c</span></pre>'


def test_companions(spark):
    two = blobs(spark, b"x", b"y")
    others = spark.createDataFrame([("0", bytearray(b"2")), ("0", bytearray(b"1"))], "path string, content binary")
    for most in (0, 100):
        assert [(r.path, r.companion and bytes(r.companion)) for r in with_companions(two, others, most=most).orderBy("path").collect()] == [("0", b"1"), ("1", None)]
