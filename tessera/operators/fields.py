"""Typed fields of self-describing formats: chunks, boxes, tags."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, node_path array<int>, pos long, len long, tag string, name string, type string, value string"
#: Of a chunk or box tree, how deep it is followed.
DEEPEST_CHUNK, DEEPEST_BOX = 16, 32
#: Of a TIFF file, so many directories are read; more are an error.
MOST_DIRECTORIES = 1_000
Row = tuple[tuple[int, ...], int, int, str, str | None, str, str | None]


def four(raw: bytes) -> str:
    return raw.decode("latin-1")


def iff_chunks(blob: bytes, at: int, end: int, little: bool, node: tuple[int, ...]) -> Iterator[Row]:
    """Chunks of an IFF or RIFF file; one that says to be longer than its parent ends with it."""
    n = 0
    while at + 8 <= end:
        tag, size = blob[at : at + 4], int.from_bytes(blob[at + 4 : at + 8], "little" if little else "big")
        size = min(size, end - at - 8)
        own = (*node, n)
        lists = (b"RIFF", b"RIFX", b"LIST") if little or tag == b"RIFX" else (b"FORM", b"LIST", b"CAT ", b"PROP")
        if tag in lists and size >= 4 and len(own) < DEEPEST_CHUNK:
            yield own, at, size, four(tag), four(blob[at + 8 : at + 12]), "list", None
            yield from iff_chunks(blob, at + 12, at + 8 + size, little, own)
        else:
            yield own, at, size, four(tag), None, "chunk", None
        at += 8 + size + size % 2
        n += 1


def iff(blob: bytes) -> Iterator[Row]:
    yield from iff_chunks(blob, 0, len(blob), blob[:4] == b"RIFF", ())


def png(blob: bytes) -> Iterator[Row]:
    """Chunks up to IEND, with the header's fields and plain texts."""
    at, n = 8, 0
    while at + 12 <= len(blob):
        size, tag = struct.unpack_from(">I4s", blob, at)
        body = blob[at + 8 : at + 8 + size]
        value = None
        if tag == b"IHDR" and len(body) >= 13:
            value = "width=%d height=%d depth=%d color=%d compression=%d filter=%d interlace=%d" % struct.unpack(">IIBBBBB", body[:13])
        elif tag == b"tEXt":
            value = body.replace(b"\0", b"=", 1).decode("latin-1")
        elif tag == b"pHYs" and len(body) >= 9:
            value = "x=%d y=%d unit=%d" % struct.unpack(">IIB", body[:9])
        elif tag == b"gAMA" and len(body) >= 4:
            value = str(struct.unpack(">I", body[:4])[0])
        yield (n,), at, size, four(tag), None, "chunk", value
        if tag == b"IEND":
            return
        at += 12 + size
        n += 1


#: Boxes that hold boxes.
PARENTS = frozenset({"moov", "trak", "mdia", "minf", "stbl", "udta", "edts", "dinf", "jp2h", "res ", "meta", "iprp", "ipco", "moof", "traf", "mvex"})


def boxes(blob: bytes, at: int = 0, end: int | None = None, node: tuple[int, ...] = ()) -> Iterator[Row]:
    """Boxes of ISO media and JPEG 2000 files; one longer than its parent ends the reading."""
    end = len(blob) if end is None else end
    n = 0
    while at + 8 <= end:
        size, tag, head = int.from_bytes(blob[at : at + 4], "big"), four(blob[at + 4 : at + 8]), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(blob[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            yield (*node, n), at, size, tag, None, "error", "larger than its parent"
            return
        own = (*node, n)
        brand = four(blob[at + head : at + head + 4]) if tag == "ftyp" else None
        yield own, at, size, tag, brand, "box", None
        if tag in PARENTS and len(own) < DEEPEST_BOX:
            yield from boxes(blob, at + head + (4 if tag == "meta" else 0), at + size, own)
        at += size
        n += 1


# TIFF's types: name, bytes, struct code; and the names of common tags.
TIFF_TYPES = {
    1: ("BYTE", 1, "B"), 2: ("ASCII", 1, "s"), 3: ("UINT16", 2, "H"), 4: ("UINT32", 4, "I"), 5: ("RATIONAL", 8, "II"), 6: ("SBYTE", 1, "b"), 7: ("UNDEF", 1, "B"),
    8: ("SINT16", 2, "h"), 9: ("SINT32", 4, "i"), 10: ("SRATIONAL", 8, "ii"), 11: ("FLOAT32", 4, "f"), 12: ("FLOAT64", 8, "d"), 13: ("IFD32", 4, "I"),
}
TIFF_TAGS = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model",
    273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software",
    306: "DateTime", 315: "Artist", 320: "ColorMap", 330: "SubIFD", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34665: "ExifIFD", 34853: "GPSIFD", 36867: "DateTimeOriginal", 37386: "FocalLength",
}
TIFF_INNER = (330, 34665, 34853)


def tiff(blob: bytes) -> Iterator[Row]:
    """Tags of all directories; each directory is read once, so loops end. A ratio with denominator 0 has no value."""
    order = "<" if blob[:2] == b"II" else ">"
    if len(blob) < 8:
        return
    queue, seen, number = [struct.unpack_from(order + "I", blob, 4)[0]], set(), 0
    while queue:
        at = queue.pop(0)
        if at in seen or at == 0 or at + 2 > len(blob):
            continue
        if number == MOST_DIRECTORIES:
            raise ValueError(f"more than {MOST_DIRECTORIES} directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", blob, at)[0]
        for i in range(n):
            entry = at + 2 + 12 * i
            if entry + 12 > len(blob):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", blob, entry)
            name, unit, code = TIFF_TYPES.get(kind, ("UNKNOWN", 0, ""))
            size = unit * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", blob, entry + 8)[0]
            raw, value = blob[place : place + size], None
            if unit and len(raw) == size:
                if kind == 2:
                    value = raw.split(b"\0")[0].decode("utf-8", "replace")
                else:
                    numbers = struct.unpack(order + code * count, raw)
                    if kind in (5, 10):
                        value = ", ".join(str(a / b) if b else "" for a, b in zip(numbers[::2], numbers[1::2], strict=True))
                    else:
                        value = ", ".join(map(str, numbers))
                    if tag in TIFF_INNER:
                        queue += numbers
            yield (number, i), entry, size, str(tag), TIFF_TAGS.get(tag), name, value
        follow = at + 2 + 12 * n
        if follow + 4 <= len(blob):
            queue.append(struct.unpack_from(order + "I", blob, follow)[0])
        number += 1


def flac(blob: bytes) -> Iterator[Row]:
    """Metadata blocks, with the stream's numbers and the comments."""
    names = {0: "STREAMINFO", 1: "PADDING", 2: "APPLICATION", 3: "SEEKTABLE", 4: "VORBIS_COMMENT", 5: "CUESHEET", 6: "PICTURE"}
    at, n, last = 4, 0, False
    while not last and at + 4 <= len(blob):
        kind, last, size = blob[at] & 127, blob[at] >> 7 == 1, int.from_bytes(blob[at + 1 : at + 4], "big")
        body, value = blob[at + 4 : at + 4 + size], None
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18], "big")
            value = f"rate={packed >> 44} channels={(packed >> 41 & 7) + 1} bits={(packed >> 36 & 31) + 1} samples={packed & (1 << 36) - 1}"
        yield (n,), at, size, str(kind), names.get(kind), "block", value
        if kind == 4:
            yield from (((n, i), *row) for i, row in enumerate(comments(body, at + 4)))
        at += 4 + size
        n += 1


def comments(body: bytes, at: int) -> Iterator[tuple[int, int, str, str | None, str, str | None]]:
    """Vorbis comments: position, length, tag, name, type, value."""
    place = 4 + int.from_bytes(body[:4], "little")
    for _ in range(int.from_bytes(body[place : place + 4], "little")):
        size = int.from_bytes(body[place + 4 : place + 8], "little")
        raw = body[place + 8 : place + 8 + size]
        if len(raw) < size or place + 8 > len(body):
            raise ValueError("comments end early")
        key, _, value = raw.decode("utf-8", "replace").partition("=")
        yield at + place + 8, size, key, None, "comment", value
        place += 4 + size


def ogg(blob: bytes) -> Iterator[Row]:
    """Pages, with the stream that each belongs to."""
    at, n = 0, 0
    while blob[at : at + 4] == b"OggS" and at + 27 <= len(blob):
        flags, granule, serial, page = struct.unpack_from("<BqII", blob, at + 5)
        segments = blob[at + 27 : at + 27 + blob[at + 26]]
        size = 27 + len(segments) + sum(segments)
        yield (n,), at, size, "OggS", str(serial), "page", f"number={page} granule={granule} first={flags >> 1 & 1} last={flags >> 2 & 1}"
        at += size
        n += 1


def midi(blob: bytes) -> Iterator[Row]:
    at, n = 0, 0
    while at + 8 <= len(blob):
        tag, size = struct.unpack_from(">4sI", blob, at)
        value = "format=%d tracks=%d division=%d" % struct.unpack_from(">HHH", blob, at + 8) if tag == b"MThd" else None
        yield (n,), at, min(size, len(blob) - at - 8), four(tag), None, "chunk", value
        at += 8 + size
        n += 1


def id3(blob: bytes) -> Iterator[Row]:
    """Frames of ID3v2.2 to 2.4 tags at the start of a file."""
    if blob[:3] != b"ID3" or len(blob) < 10:
        return
    version, seven = blob[3], lambda b: sum((x & 127) << 7 * i for i, x in enumerate(reversed(b)))
    end, at, n = min(len(blob), 10 + seven(blob[6:10])), 10, 0
    wide = 3 if version == 2 else 4
    if version > 2 and blob[5] & 0x40:
        at += seven(blob[10:14]) if version == 4 else 4 + int.from_bytes(blob[10:14], "big")
    while at + wide * 2 + (2 if version > 2 else 0) <= end and blob[at]:
        tag, raw = four(blob[at : at + wide]), blob[at + wide : at + 2 * wide]
        size = seven(raw) if version == 4 else int.from_bytes(raw, "big")
        start = at + 2 * wide + (2 if version > 2 else 0)
        body, value = blob[start : min(start + size, end)], None
        if tag.startswith("T") and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            value = body[1:].decode(codec, "replace").rstrip("\0")
        yield (n,), at, size, tag, None, "frame", value
        at = start + size
        n += 1


#: EBML elements that hold others, and names of some.
EBML_PARENTS = {0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x114D9B74: "SeekHead", 0x4DBB: "Seek", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xE0: "Video", 0xE1: "Audio", 0x1254C367: "Tags", 0x7373: "Tag", 0x67C8: "SimpleTag", 0x1941A469: "Attachments", 0x61A7: "AttachedFile"}
EBML_NAMES = {0x4282: ("DocType", "s"), 0x4286: ("EBMLVersion", "u"), 0x2AD7B1: ("TimestampScale", "u"), 0x4489: ("Duration", "f"), 0x4D80: ("MuxingApp", "s"), 0x5741: ("WritingApp", "s"), 0x7BA9: ("Title", "s"), 0xD7: ("TrackNumber", "u"), 0x86: ("CodecID", "s"), 0xB0: ("PixelWidth", "u"), 0xBA: ("PixelHeight", "u"), 0xB5: ("SamplingFrequency", "f"), 0x45A3: ("TagName", "s"), 0x4487: ("TagString", "s"), 0x466E: ("FileName", "s")}


def ebml(blob: bytes, at: int = 0, end: int | None = None, node: tuple[int, ...] = ()) -> Iterator[Row]:
    """Elements of EBML files; one of unknown size reaches to the end of its parent."""
    end, n = len(blob) if end is None else end, 0

    def number(place: int, keep: bool) -> tuple[int, int]:
        first = blob[place]
        size = 9 - first.bit_length() if first else 9
        value = int.from_bytes(blob[place : place + size], "big")
        return size, value if keep else value & (1 << 7 * size) - 1

    while at + 2 <= end:
        a, tag = number(at, True)
        if a > 4 or at + a >= end:
            return
        b, size = number(at + a, False)
        if b > 8:
            return
        start = at + a + b
        size = end - start if size == (1 << 7 * b) - 1 else min(size, end - start)
        name, kind = (EBML_PARENTS[tag], "m") if tag in EBML_PARENTS else EBML_NAMES.get(tag, (None, ""))
        raw = blob[start : start + size]
        value = {"s": lambda: raw.decode("utf-8", "replace").rstrip("\0"), "u": lambda: str(int.from_bytes(raw, "big")), "f": lambda: str(struct.unpack({4: ">f", 8: ">d"}.get(size, ">0s"), raw)[0])}.get(kind, lambda: None)()
        yield (*node, n), at, size, f"{tag:X}", name, "master" if kind == "m" else "element", value
        if kind == "m" and len(node) < 10:
            yield from ebml(blob, start, start + size, (*node, n))
        at = start + size
        n += 1


def plist(blob: bytes) -> Iterator[Row]:
    """Values of binary property lists, each at its path of keys."""
    import plistlib

    try:
        root = plistlib.loads(blob, fmt=plistlib.FMT_BINARY)
    except Exception as e:  # the parser has no common base of its errors
        raise ValueError(f"property list: {e}") from e

    def walk(value: object, node: tuple[int, ...], name: str) -> Iterator[Row]:
        if isinstance(value, (dict, list)) and len(node) <= 10:
            yield node, 0, len(value), name, None, "dict" if isinstance(value, dict) else "array", None
            for i, (k, v) in enumerate(value.items() if isinstance(value, dict) else enumerate(value)):
                yield from walk(v, (*node, i), str(k))
        else:
            yield node, 0, 0, name, None, type(value).__name__, value.hex() if isinstance(value, bytes) else str(value)

    yield from walk(root, (0,), "")


HANDLERS: dict[str, Callable[[bytes], Iterator[Row]]] = {"iff": iff, "riff": iff, "ilbm": iff, "png": png, "tiff": tiff, "jpeg2000": boxes, "bmff": boxes, "flac": flac, "ogg": ogg, "midi": midi, "id3": id3, "ebml": ebml, "plist": plist}


def readers() -> dict[str, Callable[[bytes], Iterator[Row]]]:
    """All formats that have fields."""
    from tessera.operators.metadata import MORE

    return HANDLERS | MORE


#: What reading damaged bytes may raise.
DAMAGE = (ArithmeticError, LookupError, ValueError, RecursionError, struct.error)


def fields(blobs: DataFrame, kind: str | None = None) -> DataFrame:
    """Fields of blobs of the given format, or of that in their column format. Damage ends the rows of a blob with one of type error."""
    typed = blobs.select("path", (F.lit(kind) if kind else F.col("format")).alias("format"), "content")
    names = ["path", "node_path", "pos", "len", "tag", "name", "type", "value"]
    schema = pa.schema([("path", pa.string()), ("node_path", pa.list_(pa.int32())), ("pos", pa.int64()), ("len", pa.int64()), ("tag", pa.string()), ("name", pa.string()), ("type", pa.string()), ("value", pa.string())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = readers()
        for batch in batches:
            for path, own, blob in zip(*(batch[c].to_pylist() for c in ("path", "format", "content")), strict=True):
                rows = []
                try:
                    for row in known[own](blob or b"") if own in known else ():
                        rows.append((path, *row))
                except DAMAGE as e:
                    rows.append((path, (), 0, 0, "", None, "error", str(e)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return typed.mapInArrow(expand, SCHEMA)
