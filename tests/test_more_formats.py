"""Screens, fonts, sinks and more containers and fields."""

import binascii
import io
import plistlib
import struct
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.test_blobs import blobs
from tests.test_codecs import lh5_encode

from tessera.functions.checksums import crc16_arc
from tessera.operators import fields, members, screens, sinks


def test_screens(spark):
    art = b"A\x1b[1;31;44mB\x1b[0m\r\n\x1b[2CC\x1b[1;5HD\x1aignored"
    rows = {(r.row, r.col): (r.char, r.fg, r.bg) for r in screens.cells(blobs(spark, art), "ansiart").collect()}
    assert rows == {(0, 0): ("A", 7, 0), (0, 1): ("B", 12, 1), (1, 2): ("C", 7, 0), (0, 4): ("D", 7, 0)}
    lines = screens.screen_lines(screens.cells(blobs(spark, art), "ansiart")).orderBy("row").collect()
    assert [r.line for r in lines] == ["AB  D", "  C"]
    plain = b"XBIN\x1a" + struct.pack("<HHBB", 2, 2, 16, 0) + b"a\x1fb\x9fc\x01d\x02"
    packed = b"XBIN\x1a" + struct.pack("<HHBB", 2, 2, 16, 4) + b"\x01a\x1fb\x9f" + b"\x00c\x01" + b"\xc0d\x02"
    one, two = (screens.cells(blobs(spark, b), "xbin").collect() for b in (plain, packed))
    assert one == two and [(r.char, r.fg, r.bg, r.blink) for r in one[:2]] == [("a", 15, 1, False), ("b", 15, 1, True)]
    assert screens.cells(blobs(spark, b"XB", b""), "xbin").count() == 0


def test_fonts(spark):
    one = b"\x36\x04\x02\x02" + bytes(range(256)) * 2 + b"".join(struct.pack("<HH", 65 + i % 26, 0xFFFF) for i in range(256))
    two = b"\x72\xb5\x4a\x86" + struct.pack("<7I", 0, 32, 1, 2, 6, 3, 9) + bytes(12) + b"x\xffy\xff"
    rows = screens.glyphs(blobs(spark, one), "psf").collect()
    assert len(rows) == 256 and (rows[3].codepoint, rows[3].height, bytes(rows[3].bitmap)) == (68, 2, b"\x06\x07")
    rows = screens.glyphs(blobs(spark, two), "psf").orderBy("idx").collect()
    assert [(r.codepoint, r.width) for r in rows] == [(120, 9), (121, 9)]
    font = screens.glyphs(blobs(spark, bytes(range(256)) * 2), "vgafont")
    text = {r.idx: r.t for r in font.select("idx", screens.glyph_lines(font).alias("t")).collect()}
    assert text[2] == ".....#..\n.....#.#"


def test_archives_round_trip(spark):
    rows = spark.createDataFrame([("p", 0, "d", True, None, None), ("p", 1, "d/é.txt", False, 1_000_000_001, bytearray(b"hello" * 99))], "path string, file_id int, name string, is_dir boolean, mtime_unix long, data binary")
    for kind in ("zip", "tar"):
        packed = sinks.as_archives(rows, kind)
        assert packed.first() == sinks.as_archives(rows, kind).first()
        found = members.members(packed, kind).orderBy("file_id").collect()
        assert [(r.name.rstrip("/"), r.is_dir, r.ok) for r in found] == [("d", True, True), ("d/é.txt", False, True)]
        assert bytes(found[1].data) == b"hello" * 99 and found[1].mtime_unix == 1_000_000_001
    assert zipfile.ZipFile(io.BytesIO(sinks.as_archives(rows).first().content)).testzip() is None
    assert tarfile.open(fileobj=io.BytesIO(sinks.as_archives(rows, "tar").first().content)).getnames() == ["d", "d/é.txt"]
    listed = sinks.output_list(rows).orderBy("file_id").collect()[1]
    assert (listed.crc32, listed.size) == (binascii.crc32(b"hello" * 99), 495)


def test_wav(spark):
    wav = bytes(blobs(spark, b"\x01\x02\x03").select(sinks.as_wav("content", 8_000)).first()[0])
    assert wav == b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 3) + b"\x01\x02\x03\0"


def test_lha(spark):
    data = b"some text, some text" * 50
    coded = lh5_encode(data)
    head = b"-lh5-" + struct.pack("<IIIBB", len(coded), len(data), (41 << 25 | 2 << 21 | 3 << 16), 0x20, 0) + b"\x05a.txt" + struct.pack("<H", crc16_arc(data))
    blob = bytes([len(head), sum(head) & 255]) + head + coded + b"\0"
    row = members.members(blobs(spark, blob), "lha").first()
    assert (row.name, row.ok, row.crc_ok, bytes(row.data)) == ("a.txt", True, True, data)


def test_mac_files(spark):
    head = bytearray(128)
    head[1:5] = b"\x03abc"
    struct.pack_into(">II", head, 83, 5, 2)
    rows = members.members(blobs(spark, bytes(head) + b"hello".ljust(128, b"\0") + b"rs"), "macbinary").collect()
    assert [(r.name, r.is_aux, bytes(r.data)) for r in rows] == [("abc", False, b"hello"), ("abc", True, b"rs")]
    single = b"\x00\x05\x16\x00\x00\x02\x00\x00" + bytes(16) + struct.pack(">H", 2) + struct.pack(">IIIIII", 1, 50, 3, 3, 53, 1) + b"xyzn"
    assert [(r.name, bytes(r.data)) for r in members.members(blobs(spark, single), "applesd").collect()] == [("n", b"xyz")]
    body = b"\x01x\0" + b"TEXTttxt" + b"\0\0" + struct.pack(">II", 3, 0)
    raw = body + struct.pack(">H", binascii.crc_hqx(body, 0)) + b"abc" + struct.pack(">H", binascii.crc_hqx(b"abc", 0)) + b"\0\0"
    raw = raw.replace(b"\x90", b"\x90\0")
    alphabet = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
    bits = "".join(f"{b:08b}" for b in raw)
    bits += "0" * (-len(bits) % 6)
    digits = bytes(alphabet[int(bits[i : i + 6], 2)] for i in range(0, len(bits), 6))
    row = members.members(blobs(spark, b"(This file must be converted with BinHex 4.0)\r\n:" + digits + b":"), "binhex").first()
    assert (row.name, bytes(row.data), row.crc_ok, row.ok) == ("x", b"abc", True, True)
    wad = b"PWAD" + struct.pack("<ii", 1, 15) + b"abc" + struct.pack("<ii", 12, 3) + b"LUMP\0\0\0\0"
    assert [(r.name, bytes(r.data)) for r in members.members(blobs(spark, wad), "wad").collect()] == [("LUMP", b"abc")]


def test_more_fields(spark):
    tag = b"ID3\x03\0\0" + bytes([0, 0, 0, 16]) + b"TIT2" + struct.pack(">IH", 6, 0) + b"\0title"
    assert [(r.tag, r.value) for r in fields.fields(blobs(spark, tag), "id3").collect()] == [("TIT2", "title")]
    rows = fields.fields(blobs(spark, plistlib.dumps({"a": [1, "x"], "b": b"\x01"}, fmt=plistlib.FMT_BINARY)), "plist").collect()
    assert [(r.node_path, r.tag, r.type, r.value) for r in rows] == [([0], "", "dict", None), ([0, 0], "a", "array", None), ([0, 0, 0], "0", "int", "1"), ([0, 0, 1], "1", "str", "x"), ([0, 1], "b", "bytes", "01")]
    ebml = b"\x1a\x45\xdf\xa3\x8b" + b"\x42\x82\x84webm" + b"\x42\x86\x81\x01"
    assert [(r.name, r.value) for r in fields.fields(blobs(spark, ebml), "ebml").collect()] == [("EBML", None), ("DocType", "webm"), ("EBMLVersion", "1")]
    page = b"OggS\0\x02" + struct.pack("<qIII", 0, 7, 0, 0) + b"\x01\x03abc"
    assert [(r.name, r.len) for r in fields.fields(blobs(spark, page), "ogg").collect()] == [("7", 31)]
    flac = b"fLaC\x84" + (4 + 4 + 4 + 3).to_bytes(3, "big") + struct.pack("<III", 0, 1, 3) + b"A=b"
    assert [(r.name or r.tag, r.value) for r in fields.fields(blobs(spark, flac), "flac").collect()] == [("VORBIS_COMMENT", None), ("A", "b")]
    assert fields.fields(blobs(spark, b"MThd" + struct.pack(">IHHH", 6, 1, 2, 96)), "midi").first().value == "format=1 tracks=2 division=96"


@pytest.mark.parametrize("kind", sorted(members.HANDLERS))
@given(data=st.binary(max_size=200))
@settings(max_examples=60, deadline=None)
def test_no_bytes_break_members(kind, data):
    starts = {"zip": b"PK\x05\x06", "tar": b"", "ar": b"!<arch>\n", "gzip": b"\x1f\x8b\x08", "cpio": b"070701", "applesd": b"\x00\x05\x16\x00", "binhex": b":"}
    list(members.rows_of("p", kind, starts.get(kind, b"") + data, True))


@pytest.mark.parametrize("kind", sorted(fields.HANDLERS))
@given(data=st.binary(max_size=200))
@settings(max_examples=60, deadline=None)
def test_no_bytes_break_fields(kind, data):
    starts = {"tiff": b"II*\0\x08\0\0\0", "png": b"\x89PNG\r\n\x1a\n", "ogg": b"OggS", "id3": b"ID3\x03\0\0", "flac": b"fLaC", "plist": b"bplist00"}
    try:
        list(fields.HANDLERS[kind](starts.get(kind, b"") + data))
    except (struct.error, ValueError, IndexError):
        pass  # fields() makes a row of these


def test_more_archives(spark):
    import zlib

    from tests.test_codecs import lzss_encode, lzw_encode

    data = b"some data, some data, " * 40
    read = lambda kind, blob: members.members(blobs(spark, blob), kind).collect()
    arc = b"\x1a\x09" + struct.pack("<13sIHHHI", b"A.TXT", len(c := lzw_encode(data, "compress", most=13)), 0x2A21, 0, crc16_arc(data), len(data)) + c + b"\x1a\x02" + struct.pack("<13sIHHHI", b"B", 3, 0, 0, 0, 3) + b"xyz\x1a\0"
    assert [(r.name, r.ok, r.crc_ok, bytes(r.data)) for r in read("arc", arc)] == [("A.TXT", True, True, data), ("B", True, False, b"xyz")]
    packed = read("compress", b"\x1f\x9d\x90" + lzw_encode(data, "compress"))[0]
    assert bytes(packed.data)[: len(data)] == data
    assert bytes(read("mscompress", b"SZDD\x88\xf0\x273AT" + struct.pack("<I", len(data)) + lzss_encode(data, 4080, 0x20))[0].data) == data
    dcx = b"\xb1\x68\xde\x3a" + struct.pack("<3I", 16, 20, 0) + b"aaaabbb"
    assert [bytes(r.data) for r in read("dcx", dcx)] == [b"aaaa", b"bbb"]
    lbr = (b"\0" + b" " * 11 + struct.pack("<HH", 0, 1)).ljust(32, b"\0") + (b"\0" + b"READ    ME " + struct.pack("<HH", 1, 1)).ljust(26, b"\0") + bytes([120]) + bytes(5)
    assert [(r.name, bytes(r.data)) for r in read("lbr", lbr.ljust(128, b"\xff") + b"12345678".ljust(128, b"\x1a"))] == [("READ.ME", b"12345678")]
    coder = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = b"CK" + coder.compress(data) + coder.flush()
    entry = struct.pack("<IIHHHH", len(data), 0, 0, 0x2A21, 0, 0) + b"dir\\a.txt\0"
    cab = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, 0, 0, 44, 0, 3, 1, 1, 1, 0, 0, 0) + struct.pack("<IHH", 44 + len(entry), 1, 1) + entry + struct.pack("<IHH", 0, len(body), len(data)) + body
    assert [(r.name, r.ok, bytes(r.data)) for r in read("cab", cab)] == [("dir/a.txt", True, data)]


def test_more_images():
    import numpy as np

    from tessera.operators import rasters

    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3) * 20
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 2, 2, 24, 32)
    assert (rasters.tga(head + rgb[:, :, ::-1].tobytes()) == rgb).all()
    coded = head[:2] + b"\x0a" + head[3:] + b"\x81\x03\x02\x01" + b"\x01" + rgb[1, :, ::-1].tobytes()
    assert (rasters.tga(coded)[0] == [1, 2, 3]).all() and (rasters.tga(coded)[1] == rgb[1]).all()
    sun = struct.pack(">8I", 0x59A66A95, 2, 2, 24, 12, 1, 0, 0)
    assert (rasters.sun_raster(sun + rgb[:, :, ::-1].tobytes()) == rgb).all()
    sun = struct.pack(">8I", 0x59A66A95, 4, 1, 8, 0, 2, 0, 0)
    assert rasters.sun_raster(sun + b"\x80\x02\x07\x80\x00").ravel().tolist() == [7, 7, 7, 128]
    field = b"farbfeld" + struct.pack(">II", 1, 1) + bytes([10, 0, 20, 0, 30, 0, 255, 255])
    assert rasters.farbfeld(field).ravel().tolist() == [10, 20, 30, 255]
    assert rasters.macpaint(bytes(512) + b"\xb9\xff" * 720).sum() == 0
    chunk = lambda tag, body: tag + struct.pack(">I", len(body)) + body + bytes(len(body) % 2)
    bmhd = struct.pack(">HHhhBBBBHBBhh", 4, 1, 0, 0, 2, 0, 0, 0, 0, 1, 1, 4, 1)
    body = b"ILBM" + chunk(b"BMHD", bmhd) + chunk(b"CMAP", bytes(range(12))) + chunk(b"BODY", b"\x50\x00\x30\x00")
    assert rasters.ilbm(b"FORM" + struct.pack(">I", len(body)) + body)[0, :, 0].tolist() == [0, 3, 6, 9]
    icon = struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 2, 1, 0, 0, 1, 24, 52, 22) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([3, 2, 1, 6, 5, 4, 0, 0]) + bytes(4)
    icon_image = list(members.ico_members(icon))[0]
    assert rasters.bmp(icon_image.data).ravel().tolist() == [1, 2, 3, 4, 5, 6]
