"""Fields of files that are built here."""

import random
import struct

import numpy as np

from tessera.operators import fields, metadata, rasters


def rows(kind, blob):
    return [(r[0], r[3], r[4], r[6]) for r in fields.readers()[kind](blob)]


TIFF = b"II*\0" + struct.pack("<IHHHII", 8, 1, 256, 3, 1, 640) + bytes(4)
IPTC = b"\x1c\x01\x5a\0\3\x1b%G\x1c\x02\x78\0\3\xc3\xa9!" + b"\x1c\x02\x00\0\2\0\4"
RESOURCES = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + struct.pack(">I", 16) + struct.pack(">IHHIHH", 72 << 16, 1, 1, 96 << 16, 1, 1) + b"8BIM" + struct.pack(">H", 1028) + b"\3abc" + struct.pack(">I", len(IPTC)) + IPTC + bytes(len(IPTC) % 2)
ICC = (struct.pack(">I", 160) + bytes(4) + b"\2\x20" + bytes(2) + b"mntrRGB XYZ ").ljust(36, b"\0") + b"acsp" + bytes(88) + struct.pack(">I", 2) + struct.pack(">4sII4sII", b"cprt", 156, 12, b"copy", 156, 12) + b"text\0\0\0\0me!\0"


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def test_jpeg():
    blob = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0") + segment(0xE1, b"Exif\0\0" + TIFF) + segment(0xED, b"Photoshop 3.0\0" + RESOURCES) + segment(0xE2, b"ICC_PROFILE\0\1\1" + ICC)
    blob += segment(0xC0, struct.pack(">BHHB", 8, 20, 30, 3)) + segment(0xFE, b"hello") + segment(0xDA, b"\1") + b"ab\xff\0c\xff\xd0d" + b"\xff\xd9" + b"rest"
    found = rows("jpeg", blob)
    assert [f[2] for f in found if len(f[0]) == 1] == ["SOI", "APP0", "APP1", "APP13", "APP2", "SOF0", "COM", "SOS", "EOI"]
    said = {(f[1], f[2]): f[3] for f in found}
    assert said["FFE0", "APP0"] == "JFIF version=1.02 units=1 x=72 y=72" and said["256", "ImageWidth"] == "640" and said["1005", "ResolutionInfo"] == "x=72 y=96"
    assert said["2:120", "Caption"] == "é!" and said["2:0", None] == "4" and said["FFC0", "SOF0"] == "precision=8 height=20 width=30 components=3" and said["cprt", "text"] == "me!" and said["copy", "text"] == "(repeated)"
    place = next(r for r in metadata.jpeg(blob) if r[3] == "256")
    assert blob[place[1] : place[1] + 2] == b"\0\1"


def test_others():
    psd = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 5, 6, 8, 3) + struct.pack(">I", 2) + b"xx" + struct.pack(">I", len(RESOURCES)) + RESOURCES + struct.pack(">I", 0) + struct.pack(">H", 1) + b"data"
    said = rows("psd", psd)
    assert said[0][3] == "version=1 channels=3 height=5 width=6 depth=8 mode=3" and said[-1][3] == "compression=1" and any(f[3] == "é!" for f in said)
    pe = struct.pack("<2s12H", b"MZ", 0, 1, 1, 4, 0, 0xFFFF, 0, 0, 0, 0, 0, 64).ljust(60, b"\0") + struct.pack("<I", 128) + struct.pack("<HH", 5, 7)
    pe = pe.ljust(128, b"\0") + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 9, 0, 0, 0, 2) + struct.pack("<8sIIII", b".text", 10, 0x1000, 512, 512) + bytes(20)
    said = rows("exe", pe.ljust(600, b"\0"))
    assert said[1][3] == "0007:0005" and [f[1] for f in said] == ["MZ", "relocation", "overlay", "PE", ".text"]
    wmf = b"\xd7\xcd\xc6\x9a" + struct.pack("<HhhhhHIH", 0, 1, 2, 3, 4, 96, 0, 0) + struct.pack("<HHHIHIH", 1, 9, 0x300, 20, 0, 5, 0) + struct.pack("<IHHH", 5, 0x020B, 0, 0) + struct.pack("<IH", 3, 0)
    assert [f[2] for f in rows("wmf", wmf)][2:] == ["SETWINDOWORG", "EOF"]
    emf = struct.pack("<II4i", 1, 88, 1, 2, 3, 4).ljust(88, b"\0") + struct.pack("<II", 14, 20) + bytes(12)
    assert [(f[2], f[3]) for f in rows("emf", emf)] == [("HEADER", "left=1 top=2 right=3 bottom=4"), ("EOF", None)]
    record = b"SAUCE00" + b"Title".ljust(35) + b"Me".ljust(20) + b"Us".ljust(20) + b"20010203" + struct.pack("<IBB4H", 5, 1, 1, 80, 25, 0, 0) + b"\1\0" + b"IBM VGA".ljust(22, b"\0")
    said = {f[1]: f[3] for f in rows("sauce", b"text\x1a" + b"COMNT" + b"note".ljust(64) + record)}
    assert said["Title"] == "Title" and said["Comment"] == "note" and "info=80,25,0,0" in said["Type"]
    store = b"name\0" + b"\0" * 3 + struct.pack(">I", 7)
    part = b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", 2, len(store)) + struct.pack(">8I", 1000, 6, 0, 1, 1009, 4, 8, 1) + store
    rpm = (b"\xed\xab\xee\xdb\3\0" + bytes(4) + b"pack").ljust(96, b"\0") + part + bytes(-(96 + len(part)) % 8) + part + b"payload"
    assert [f[3] for f in rows("rpm", rpm)][1:5] == ["name", "7", "name", "7"]


def test_bmp():
    r = np.random.default_rng(1)
    index, table = r.integers(0, 16, (3, 5)), r.integers(0, 256, (16, 3)).astype(np.uint8)
    colours = b"".join(bytes([b, g, red, 0]) for red, g, b in table.tolist())
    head = lambda bits, packed, body, extra=b"", used=16: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(extra)) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, bits, packed, len(body), 0, 0, used, 0) + extra + body
    runs = b"".join(b"\2" + bytes([row[0]]) + b"\0\3" + bytes(row[2:].tolist()) + b"\0" + b"\0\0" for row in index[::-1])
    expected = index.copy()
    expected[:, 1] = index[:, 0]
    assert (rasters.bmp(head(8, 1, runs + b"\0\1", colours)) == table[expected]).all()
    four = b"".join(bytes([5, int(row[0]) << 4 | int(row[1])]) + b"\0\0" for row in index[::-1])
    assert (rasters.bmp(head(4, 2, four + b"\0\1", colours)) == table[np.stack([index[:, [0, 1, 0, 1, 0][k]] for k in range(5)], 1)]).all()
    skip = b"\0\2\1\1\1\7\0\1"
    assert (rasters.bmp(head(8, 1, skip, colours))[1, 1] == table[7]).all() and (rasters.bmp(head(8, 1, skip, colours))[2, 0] == table[0]).all()
    sixteen = np.array([[0x7C00, 0x3E0, 0x1F, 0, 0x7FFF]] * 3, "<u2")
    image = rasters.bmp(head(16, 0, np.pad(sixteen, ((0, 0), (0, 1))).tobytes()))
    assert image[0].tolist() == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0], [255, 255, 255]]
    image = rasters.bmp(head(16, 3, np.pad(sixteen, ((0, 0), (0, 1))).tobytes(), struct.pack("<3I", 0xF800, 0x7E0, 0x1F)))
    assert image[0, 2].tolist() == [0, 0, 255] and image[0, 0].tolist() == [123, 130, 0]
    old = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26 + 6) + struct.pack("<IHHHH", 12, 9, 2, 1, 1) + bytes([1, 2, 3, 4, 5, 6]) + b"\x80\x80\0\0" + b"\x7f\0\0\0"
    image = rasters.bmp(old)
    assert image.shape == (2, 9, 3) and image[1, 0].tolist() == [6, 5, 4] and image[0, 0].tolist() == [3, 2, 1] and image[1, 8].tolist() == [6, 5, 4]


def test_damage():
    for kind, read in fields.readers().items():
        for seed in range(100):
            r = random.Random(seed)
            blob = r.choice([b"", TIFF, RESOURCES, b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + TIFF), ICC])[: r.randrange(200)] + r.randbytes(r.choice([0, 9, 200]))
            try:
                assert len(list(read(blob))) < 100_000, kind
            except fields.DAMAGE:
                pass
