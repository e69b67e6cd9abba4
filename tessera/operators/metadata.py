"""Fields of image, document and program files: segments, resources, profiles and records."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from tessera.functions.text import decode_blob
from tessera.operators.fields import Row, four, tiff

# Names of JPEG markers other than APP0 to APP15.
JPEG_NAMES = {
    0xC0: "SOF0", 0xC1: "SOF1", 0xC2: "SOF2", 0xC3: "SOF3", 0xC4: "DHT", 0xC5: "SOF5", 0xC6: "SOF6", 0xC7: "SOF7", 0xC8: "JPG", 0xC9: "SOF9", 0xCA: "SOF10", 0xCB: "SOF11", 0xCC: "DAC", 0xCD: "SOF13", 0xCE: "SOF14", 0xCF: "SOF15",
    0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM",
}
FRAMES = frozenset([*range(0xC0, 0xD0)]) - {0xC4, 0xC8, 0xCC}


def inside(rows: Iterator[Row], node: tuple[int, ...], at: int) -> Iterator[Row]:
    """Rows of a part of a blob, as rows of the blob."""
    for own, place, *rest in rows:
        yield ((*node, *own), place + at, *rest)


def jpeg(blob: bytes) -> Iterator[Row]:
    """Segments up to the end of the image, with what JFIF, Exif, ICC, Photoshop, Adobe and comment segments say."""
    at, n = 0, 0
    while at + 2 <= len(blob):
        if blob[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        kind = blob[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        name = JPEG_NAMES.get(kind) or (f"APP{kind - 0xE0}" if 0xE0 <= kind <= 0xEF else f"RST{kind - 0xD0}" if 0xD0 <= kind <= 0xD7 else None)
        if kind in (0xD8, 0xD9, 0x01) or 0xD0 <= kind <= 0xD7:
            yield (n,), at, 2, f"FF{kind:02X}", name, "marker", None
            if kind == 0xD9:
                return
            at, n = at + 2, n + 1
            continue
        size = int.from_bytes(blob[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(blob):
            raise ValueError(f"segment of {size} bytes at {at}")
        body, value = blob[at + 4 : at + 2 + size], None
        if kind in FRAMES and len(body) >= 6:
            value = "precision=%d height=%d width=%d components=%d" % struct.unpack_from(">BHHB", body)
        elif kind == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            value = "JFIF version=%d.%02d units=%d x=%d y=%d" % struct.unpack_from(">BBBHH", body, 5)
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            value = "Exif"
        elif kind == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            value = "XMP"
        elif kind == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) >= 14:
            value = f"ICC part={body[12]} of={body[13]}"
        elif kind == 0xED and body.startswith(b"Photoshop 3.0\0"):
            value = "Photoshop"
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            value = f"Adobe transform={body[11]}"
        elif kind == 0xFE:
            value = decode_blob(body, "latin1")
        yield (n,), at, size + 2, f"FF{kind:02X}", name, "segment", value
        if value == "Exif":
            yield from inside(tiff(body[6:]), (n,), at + 10)
        elif value == "Photoshop":
            yield from inside(resources(body[14:]), (n,), at + 18)
        elif value and value.startswith("ICC part=1 of=1"):
            yield from inside(icc(body[14:]), (n,), at + 18)
        at, n = at + 2 + size, n + 1
        if kind == 0xDA:
            while at + 1 < len(blob) and not (blob[at] == 0xFF and blob[at + 1] and not 0xD0 <= blob[at + 1] <= 0xD7):
                at = blob.find(b"\xff", at + 1)
                if at < 0:
                    raise ValueError("no end of the image")


# Names of some of Photoshop's image resources.
RESOURCE_NAMES = {1005: "ResolutionInfo", 1028: "IPTC", 1034: "CopyrightFlag", 1035: "URL", 1036: "Thumbnail", 1039: "ICC", 1050: "Slices", 1057: "VersionInfo", 1058: "Exif", 1060: "XMP"}


def resources(blob: bytes) -> Iterator[Row]:
    """Photoshop's image resources, with IPTC datasets, Exif and resolution inside."""
    at, n = 0, 0
    while at + 12 <= len(blob) and blob[at : at + 4] in (b"8BIM", b"MeSa", b"AgHg", b"PHUT", b"DCSR"):
        number, long = struct.unpack_from(">HB", blob, at + 4)
        name = blob[at + 7 : at + 7 + long].decode("mac-roman")
        start = at + 6 + (long + 2) // 2 * 2
        size = struct.unpack_from(">I", blob, start)[0]
        body = blob[start + 4 : start + 4 + size]
        value = name or None
        if number == 1005 and len(body) >= 16:
            x, y = struct.unpack_from(">I", body)[0], struct.unpack_from(">I", body, 8)[0]
            value = f"x={x / 65536:g} y={y / 65536:g}"
        elif number in (1035, 1060):
            value = body.decode("utf-8", "replace")
        yield (n,), at, size, str(number), RESOURCE_NAMES.get(number), "resource", value
        if number == 1028:
            yield from inside(iptc(body), (n,), start + 4)
        elif number == 1058:
            yield from inside(tiff(body), (n,), start + 4)
        at, n = start + 4 + size + size % 2, n + 1


# Names of some of IPTC's datasets of records 1 and 2.
IPTC_NAMES = {(1, 90): "CodedCharacterSet", (2, 5): "ObjectName", (2, 25): "Keywords", (2, 55): "DateCreated", (2, 60): "TimeCreated", (2, 80): "Byline", (2, 90): "City", (2, 101): "Country", (2, 105): "Headline", (2, 110): "Credit", (2, 116): "Copyright", (2, 120): "Caption"}


def iptc(blob: bytes) -> Iterator[Row]:
    at, n, coding = 0, 0, "latin1"
    while at + 5 <= len(blob) and blob[at] == 0x1C:
        record, number, size = struct.unpack_from(">BBH", blob, at + 1)
        start = at + 5
        if size & 0x8000:
            wide = size & 0x7FFF
            size, start = int.from_bytes(blob[start : start + wide], "big"), start + wide
        body = blob[start : start + size]
        if len(body) < size:
            raise ValueError(f"dataset of {size} bytes at {at}")
        if (record, number) == (1, 90) and body == b"\x1b%G":
            coding = "utf8"
        value = str(int.from_bytes(body, "big")) if number == 0 else decode_blob(body, coding)
        yield (n,), at, size, f"{record}:{number}", IPTC_NAMES.get((record, number)), "dataset", value
        at, n = start + size, n + 1


def icc(blob: bytes) -> Iterator[Row]:
    """The header's facts and the tags of a colour profile, with plain texts; tags that repeat a place are told as such."""
    if len(blob) < 132 or blob[36:40] != b"acsp":
        raise ValueError("no profile")
    size, version = struct.unpack_from(">I", blob)[0], blob[8]
    yield (0,), 0, 128, "header", None, "header", f"size={size} version={version}.{blob[9] >> 4} class={four(blob[12:16]).strip()} space={four(blob[16:20]).strip()} connection={four(blob[20:24]).strip()}"
    seen: set[tuple[int, int]] = set()
    for i in range(struct.unpack_from(">I", blob, 128)[0]):
        tag, place, long = struct.unpack_from(">4sII", blob, 132 + 12 * i)
        body, kind = blob[place : place + long], blob[place : place + 4]
        value = None
        if (place, long) in seen:
            value = "(repeated)"
        elif kind == b"text":
            value = body[8:].split(b"\0")[0].decode("latin-1")
        elif kind == b"desc" and len(body) >= 12:
            value = body[12 : 12 + max(0, struct.unpack_from(">I", body, 8)[0] - 1)].decode("latin-1")
        elif kind == b"mluc" and len(body) >= 28:
            n, at = struct.unpack_from(">II", body, 20)
            value = body[at : at + n].decode("utf-16-be", "replace")
        elif kind == b"XYZ " and len(body) >= 20:
            value = " ".join(f"{v / 65536:.5f}" for v in struct.unpack_from(">3i", body, 8))
        seen.add((place, long))
        yield (1 + i,), place, long, four(tag), four(kind).strip() or None, "tag", value


def psd(blob: bytes) -> Iterator[Row]:
    """The header, the image resources and the sizes of the other sections."""
    if blob[:4] != b"8BPS":
        raise ValueError("no header")
    version, channels, height, width, depth, mode = struct.unpack_from(">H6xHIIHH", blob, 4)
    yield (0,), 0, 26, "header", None, "header", f"version={version} channels={channels} height={height} width={width} depth={depth} mode={mode}"
    at, wide = 26, 8 if version == 2 else 4
    for i, name in enumerate(("color", "resources", "layers"), 1):
        n = wide if name == "layers" else 4
        size = int.from_bytes(blob[at : at + n], "big")
        yield (i,), at, size, name, None, "section", None
        if name == "resources":
            yield from inside(resources(blob[at + n : at + n + size]), (i,), at + n)
        at += n + size
    yield (4,), at, max(0, len(blob) - at), "image", None, "section", f"compression={int.from_bytes(blob[at : at + 2], 'big')}"


def exe(blob: bytes) -> Iterator[Row]:
    """Facts of DOS programs and of the newer headers behind them, and the sections of PE files."""
    if blob[:2] not in (b"MZ", b"ZM"):
        raise ValueError("no header")
    last, pages, relocations, head, low, high, ss, sp, _, ip, cs, table = struct.unpack_from("<12H", blob, 2)
    end = (pages - 1) * 512 + last if last else pages * 512
    yield (0,), 0, head * 16, "MZ", None, "header", f"end={end} relocations={relocations} header={head * 16} min={low} max={high} ss={ss:04X} sp={sp:04X} cs={cs:04X} ip={ip:04X}"
    for i in range(min(relocations, max(0, len(blob) - table) // 4)):
        offset, segment = struct.unpack_from("<HH", blob, table + 4 * i)
        yield (0, i), table + 4 * i, 4, "relocation", None, "address", f"{segment:04X}:{offset:04X}"
    if end < len(blob):
        yield (1,), end, len(blob) - end, "overlay", None, "section", None
    new = struct.unpack_from("<I", blob, 60)[0] if table >= 64 and len(blob) >= 64 else 0
    kind = blob[new : new + 4] if new else b""
    if kind == b"PE\0\0":
        machine, n, stamp, _, _, optional, flags = struct.unpack_from("<HHIIIHH", blob, new + 4)
        yield (2,), new, 24, "PE", None, "header", f"machine={machine:04X} sections={n} time={stamp} flags={flags:04X}"
        for i in range(n):
            name, virtual, address, size, place = struct.unpack_from("<8sIIII", blob, new + 24 + optional + 40 * i)
            yield (2, i), place, size, name.split(b"\0")[0].decode("latin-1"), None, "section", f"address={address:X} size={virtual}"
    elif kind[:2] in (b"NE", b"LE", b"LX"):
        yield (2,), new, 64, kind[:2].decode(), None, "header", None


# Names of some records of metafiles.
WMF_NAMES = {0x0103: "SETMAPMODE", 0x020B: "SETWINDOWORG", 0x020C: "SETWINDOWEXT", 0x0324: "POLYGON", 0x0325: "POLYLINE", 0x041B: "RECTANGLE", 0x0626: "ESCAPE", 0x0A32: "EXTTEXTOUT", 0x0B41: "DIBSTRETCHBLT", 0x0F43: "STRETCHDIB", 0x0000: "EOF"}
EMF_NAMES = {1: "HEADER", 9: "SETWINDOWEXTEX", 10: "SETWINDOWORGEX", 14: "EOF", 70: "GDICOMMENT", 76: "BITBLT", 77: "STRETCHBLT", 81: "STRETCHDIBITS", 84: "EXTTEXTOUTW"}


def wmf(blob: bytes) -> Iterator[Row]:
    at, n = 0, 0
    if blob[:4] == b"\xd7\xcd\xc6\x9a":
        left, top, right, bottom, inch = struct.unpack_from("<hhhhH", blob, 6)
        yield (n,), 0, 22, "placeable", None, "header", f"left={left} top={top} right={right} bottom={bottom} inch={inch}"
        at, n = 22, 1
    kind, words, version, size, objects, most = struct.unpack_from("<HHHIHI", blob, at)
    yield (n,), at, 2 * words, "header", None, "header", f"version={version:04X} size={2 * size} objects={objects} largest={2 * most}"
    at, n = at + 2 * words, n + 1
    while at + 6 <= len(blob):
        size, kind = struct.unpack_from("<IH", blob, at)
        if size < 3:
            raise ValueError(f"record of {size} words at {at}")
        yield (n,), at, 2 * size, f"{kind:04X}", WMF_NAMES.get(kind), "record", None
        if kind == 0:
            return
        at, n = at + 2 * size, n + 1
    raise ValueError("no last record")


def emf(blob: bytes) -> Iterator[Row]:
    at, n = 0, 0
    while at + 8 <= len(blob):
        kind, size = struct.unpack_from("<II", blob, at)
        if size < 8:
            raise ValueError(f"record of {size} bytes at {at}")
        value = None
        if n == 0 and size >= 88:
            value = "left=%d top=%d right=%d bottom=%d" % struct.unpack_from("<4i", blob, at + 8)
        elif kind == 70 and size >= 16:
            value = four(blob[at + 12 : at + 16])
        yield (n,), at, size, str(kind), EMF_NAMES.get(kind), "record", value
        if kind == 14:
            return
        at, n = at + size, n + 1
    raise ValueError("no last record")


def sauce(blob: bytes) -> Iterator[Row]:
    """The record at the end of texts and pictures of the ANSI scene, and its comments."""
    at = len(blob) - 128
    if at < 0 or blob[at : at + 7] != b"SAUCE00":
        raise ValueError("no record")
    clean = lambda a, n: blob[at + a : at + a + n].split(b"\0")[0].decode("cp437").rstrip()
    for i, (name, a, n) in enumerate((("Title", 7, 35), ("Author", 42, 20), ("Group", 62, 20), ("Date", 82, 8))):
        yield (i,), at + a, n, name, None, "text", clean(a, n)
    size, kind, own, *numbers = struct.unpack_from("<IBB4H", blob, at + 90)
    n, flags = blob[at + 104], blob[at + 105]
    yield (4,), at + 90, 16, "Type", None, "numbers", f"size={size} type={kind} kind={own} info={','.join(map(str, numbers))} comments={n} flags={flags}"
    yield (5,), at + 106, 22, "Info", None, "text", clean(106, 22)
    start = at - 64 * n - 5
    if n and start >= 0 and blob[start : start + 5] == b"COMNT":
        for k in range(n):
            line = blob[start + 5 + 64 * k : start + 69 + 64 * k]
            yield (6, k), start + 5 + 64 * k, 64, "Comment", None, "text", line.split(b"\0")[0].decode("cp437").rstrip()


def rpm(blob: bytes) -> Iterator[Row]:
    """Tags of the signature and the header of an RPM package, with texts and numbers."""
    if blob[:4] != b"\xed\xab\xee\xdb":
        raise ValueError("no lead")
    yield (0,), 0, 96, "lead", None, "header", f"version={blob[4]}.{blob[5]} name={blob[10:76].split(bytes(1))[0].decode('latin-1')}"
    at = 96
    for part, name in enumerate(("signature", "header"), 1):
        if blob[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError(f"no {name}")
        n, size = struct.unpack_from(">II", blob, at + 8)
        store = at + 16 + 16 * n
        for i in range(n):
            tag, kind, place, count = struct.unpack_from(">IIII", blob, at + 16 + 16 * i)
            start, value = store + place, None
            if kind in (6, 8, 9):
                value = ", ".join(s.decode("utf-8", "replace") for s in blob[start : store + size].split(b"\0")[: count if kind == 8 else 1])
            elif kind in (2, 3, 4):
                unit = {2: "B", 3: "H", 4: "I"}[kind]
                if start + count * struct.calcsize(unit) <= len(blob):
                    value = ", ".join(map(str, struct.unpack_from(f">{count}{unit}", blob, start)))
            yield (part, i), start, count, str(tag), name, str(kind), value
        at = store + size
        at += -at % 8 if part == 1 else 0
    yield (3,), at, len(blob) - at, "payload", None, "data", None


MORE: dict[str, Callable[[bytes], Iterator[Row]]] = {
    "jpeg": jpeg, "psd": psd, "iccprofile": icc, "iptc": iptc, "exe": exe, "wmf": wmf, "emf": emf, "sauce": sauce, "rpm": rpm,
}
