"""Images as arrays of pixels, decoded from simple formats and encoded as PNG."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.codecs import lzw, packbits, pcx_rle
from tessera.operators.parts import column_of, struct_of

LARGEST = 10_000  # of width and height
RASTER = "struct<width: int, height: int, channels: int, data: binary, err: string>"


def checked(width: int, height: int) -> tuple[int, int]:
    if not (1 <= width <= LARGEST and 1 <= height <= LARGEST):
        raise ValueError(f"dimensions {width} x {height}")
    return width, height


def padded(data: bytes, size: int) -> np.ndarray:
    """The first size bytes; what is missing is zero."""
    return np.frombuffer(data[:size] + bytes(max(0, size - len(data))), np.uint8)


def indexed(rows: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Pixel values of bits each, high ones first, from rows of bytes."""
    flat = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (flat @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]


def bmp_runs(data: bytes, bits: int, width: int, height: int) -> np.ndarray:
    """Pixel values of runs of 8 or 4 bits, from the bottom row up; what is skipped is 0."""
    out, at, x, y = bytearray(height * width), 0, 0, 0
    pixels = lambda raw: raw if bits == 8 else bytes(v for b in raw for v in (b >> 4, b & 15))
    last = len(data) - 1
    while at < last and y < height:
        n, value = data[at], data[at + 1]
        at += 2
        if n == 1 and bits == 8:
            if x < width:
                out[y * width + x] = value
            x += 1
            continue
        if n:
            part = (pixels(bytes([value])) * n)[:n]
        elif value == 0:
            x, y = 0, y + 1
            continue
        elif value == 1:
            break
        elif value == 2:
            x, y = x + data[at], y + data[at + 1]
            at += 2
            continue
        else:
            size = (value * bits + 7) // 8
            part = pixels(data[at : at + size])[:value]
            at += size + size % 2
        part = part[: max(0, width - x)]
        here = y * width + x
        out[here : here + len(part)] = part
        x += n or value
    return np.frombuffer(out, np.uint8).reshape(height, width)


def masked(values: np.ndarray, mask: int) -> np.ndarray:
    """The samples under a mask, as 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return ((((values & mask) >> shift) * 510 + top) // (2 * top)).astype(np.uint8)


def bmp(blob: bytes) -> np.ndarray:
    """Windows and OS/2 bitmaps of 1 to 32 bits: plain, in runs, or with masks."""
    start, size = struct.unpack_from("<II", blob, 10)
    packed = 0
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", blob, 18)
    elif size >= 16:
        width, height, _, bits = struct.unpack_from("<iiHH", blob, 18)
        packed = struct.unpack_from("<I", blob, 30)[0] if size >= 20 else 0
    else:
        raise ValueError(f"header {size}")
    width, tall = checked(width, abs(height))
    unit = 3 if size == 12 else 4
    palette = np.zeros((256, 3), np.uint8)
    if bits <= 8:
        used = (struct.unpack_from("<I", blob, 46)[0] if size >= 36 else 0) or 1 << bits
        known = padded(blob[14 + size :], unit * min(used, 256)).reshape(-1, unit)[:, 2::-1]
        palette[: len(known)] = known
    if packed in (1, 2) and bits == (8 if packed == 1 else 4):
        image = palette[bmp_runs(blob[start:], bits, width, tall)]
        return image[::-1]
    if packed not in (0, 3, 6):
        raise ValueError(f"compression {packed}")
    stride = (width * bits + 31) // 32 * 4
    rows = padded(blob[start:], stride * tall).reshape(tall, stride)
    if bits <= 8:
        image = palette[indexed(rows, bits, width)]
    elif bits == 24 or bits == 32 and packed == 0:
        image = rows[:, : width * bits // 8].reshape(tall, width, bits // 8)[:, :, 2::-1]
    elif bits in (16, 32):
        values = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        masks = struct.unpack_from("<3I", blob, 54) if packed else (0x7C00, 0x3E0, 0x1F)
        image = np.stack([masked(values, m) for m in masks], 2)
    else:
        raise ValueError(f"{bits} bits")
    return image if height < 0 else image[::-1]


def pnm(blob: bytes) -> np.ndarray:
    """PBM, PGM and PPM, as text or binary, with samples up to 65535."""
    head = re.match(rb"P([1-6])" + rb"(?:\s+|#[^\n]*\n)+(\d+)" * 2, blob)
    if not head:
        raise ValueError("header")
    kind, (width, height), at, top = int(head[1]), checked(int(head[2]), int(head[3])), head.end(), 1
    if kind not in (1, 4):
        more = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(blob, at)
        if not more:
            raise ValueError("no largest value")
        top, at = int(more[1]), more.end()
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"[^01]", b"", blob[at:]), np.uint8) - 48
        values = 1 - padded(digits.tobytes(), n)
    elif kind < 4:
        values = np.zeros(n, np.int64)
        found = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:n], dtype=np.int64)
        values[: len(found)] = found
    elif kind == 4:
        stride = (width + 7) // 8
        values = 1 - np.unpackbits(padded(blob[at + 1 :], stride * height).reshape(height, stride), axis=1)[:, :width]
    elif top > 255:
        values = padded(blob[at + 1 :], 2 * n).view(">u2")
    else:
        values = padded(blob[at + 1 :], n)
    scaled = (np.minimum(values.astype(np.int64), top) * 510 + top) // (2 * top)
    return scaled.astype(np.uint8).reshape(height, width, channels)


def pcx(blob: bytes) -> np.ndarray:
    """PCX of 8-bit palette or 24 bits in planes, and of 1 to 4 planes of 1 bit."""
    bits = blob[3]
    x0, y0, x1, y1 = struct.unpack_from("<4H", blob, 4)
    planes, stride = blob[65], struct.unpack_from("<H", blob, 66)[0]
    width, height = checked(x1 - x0 + 1, y1 - y0 + 1)
    size = stride * planes * height
    body = pcx_rle(blob[128:], size).data if blob[2] == 1 else blob[128 : 128 + size]
    rows = padded(body, size).reshape(height, planes, stride)
    if bits == 8 and planes == 3:
        return rows[:, :, :width].transpose(0, 2, 1)
    if bits == 8 and planes == 1:
        own = blob[-769:] if len(blob) >= 769 and blob[-769] == 12 else b""
        palette = padded(own[1:], 768).reshape(256, 3) if own else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        return palette[rows[:, 0, :width]]
    if bits == 1 and planes <= 4:
        values = sum(np.unpackbits(rows[:, p], axis=1)[:, :width].astype(int) << p for p in range(planes))
        palette = np.array([[0, 0, 0], [255, 255, 255]], np.uint8) if planes == 1 else padded(blob[16:64], 48).reshape(16, 3)
        return palette[values]
    raise ValueError(f"{bits} bits in {planes} planes")


def gif(blob: bytes) -> np.ndarray:
    """The first image, on its own; transparent pixels have opacity 0."""
    flags, at = blob[10], 13
    table = lambda f, p: padded(blob[p:], 3 << (f & 7) + 1).reshape(-1, 3)
    colours, clear = np.zeros((256, 3), np.uint8), None
    if flags & 0x80:
        colours = table(flags, at)
        at += colours.size
    while at < len(blob):
        if blob[at] == 0x21:
            if blob[at + 1] == 0xF9 and blob[at + 3] & 1:
                clear = blob[at + 6]
            at += 2
            while at < len(blob) and blob[at]:
                at += 1 + blob[at]
            at += 1
        elif blob[at] == 0x2C:
            width, height = checked(*struct.unpack_from("<HH", blob, at + 5))
            own = blob[at + 9]
            at += 10
            if own & 0x80:
                colours = table(own, at)
                at += colours.size
            root, body = blob[at], bytearray()
            at += 1
            while at < len(blob) and blob[at]:
                body += blob[at + 1 : at + 1 + blob[at]]
                at += 1 + blob[at]
            values = padded(lzw(bytes(body), width * height, "gif", root).data, width * height).reshape(height, width)
            if own & 0x40:
                order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
                values = values[np.argsort(order)]
            full = np.zeros((256, 4), np.uint8)
            full[: len(colours), :3], full[:, 3] = colours, 255
            if clear is None:
                return full[values][:, :, :3]
            full[clear, 3] = 0
            return full[values]
        else:
            break
    raise ValueError("no image")


def tga(blob: bytes) -> np.ndarray:
    """Truevision images: palette, colour or gray, plain or run-length coded, of 8, 16, 24 or 32 bits."""
    n_id, has_palette, kind, first, n_palette, palette_bits = struct.unpack_from("<BBBHHB", blob)
    width, height, bits, flags = struct.unpack_from("<HHBB", blob, 12)
    width, height = checked(width, height)
    unit, at = (bits + 7) // 8, 18 + n_id
    if kind & ~8 not in (1, 2, 3) or unit not in (1, 2, 3, 4):
        raise ValueError(f"type {kind} of {bits} bits")
    palette = blob[at : at + n_palette * ((palette_bits + 7) // 8)] if has_palette else b""
    at += len(palette)
    size = width * height * unit
    if kind & 8:
        body = bytearray()
        while at < len(blob) and len(body) < size:
            n = (blob[at] & 127) + 1
            if blob[at] & 128:
                body += blob[at + 1 : at + 1 + unit] * n
                at += 1 + unit
            else:
                body += blob[at + 1 : at + 1 + unit * n]
                at += 1 + unit * n
    else:
        body = blob[at : at + size]
    pixels = padded(bytes(body), size).reshape(height * width, unit)
    colour = lambda x, b: np.stack([(x.astype(int) @ (1 << 8 * np.arange(x.shape[1])) >> s & 31) * 255 // 31 for s in (10, 5, 0)], 1).astype(np.uint8) if b <= 16 else x[:, [2, 1, 0]]
    if kind & 7 == 1:
        table = np.zeros((1 << 16, 3), np.uint8)
        wide = (palette_bits + 7) // 8
        known = colour(np.frombuffer(palette[: len(palette) // wide * wide], np.uint8).reshape(-1, wide), palette_bits)
        table[first : first + len(known)] = known
        image = table[pixels.astype(int) @ (1 << 8 * np.arange(unit))]
    elif kind & 7 == 3:
        image = pixels[:, :1]
    else:
        image = np.concatenate([colour(pixels, bits), pixels[:, 3:4]], 1) if unit == 4 and flags & 15 == 8 else colour(pixels, bits)
    image = image.reshape(height, width, -1)
    image = image if flags & 32 else image[::-1]
    return image[:, ::-1] if flags & 16 else image


def sun_raster(blob: bytes) -> np.ndarray:
    """Sun rasters of 1, 8, 24 and 32 bits, plain or run-length coded (byte 80 hexadecimal, count - 1, value)."""
    width, height, bits, _, kind, map_kind, map_size = struct.unpack_from(">7I", blob, 4)
    width, height = checked(width, height)
    if bits not in (1, 8, 24, 32) or kind > 3:
        raise ValueError(f"type {kind} of {bits} bits")
    table, body = blob[32 : 32 + map_size], blob[32 + map_size :]
    stride = (width * bits + 15) // 16 * 2
    if kind == 2:
        out, at = bytearray(), 0
        while at < len(body) and len(out) < stride * height:
            if body[at] == 0x80 and body[at + 1 : at + 2] != b"\0":
                out += body[at + 2 : at + 3] * (body[at + 1] + 1 if at + 1 < len(body) else 0)
                at += 3
            else:
                out.append(body[at])
                at += 2 if body[at] == 0x80 else 1
        body = bytes(out)
    rows = padded(body, stride * height).reshape(height, stride)
    if bits == 1:
        return (1 - np.unpackbits(rows, axis=1)[:, :width, None]) * np.uint8(255)
    if bits == 8:
        values = rows[:, :width]
        if map_kind == 1 and map_size >= 3:
            n = map_size // 3
            palette = np.zeros((256, 3), np.uint8)
            palette[: min(n, 256)] = padded(table, 3 * n).reshape(3, n).T[:256]
            return palette[values]
        return values[:, :, None]
    pixels = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, bits == 32 :]
    return pixels if kind == 3 else pixels[:, :, ::-1]


def farbfeld(blob: bytes) -> np.ndarray:
    """16-bit RGBA, cut to 8 bits."""
    if blob[:8] != b"farbfeld":
        raise ValueError("no header")
    width, height = checked(*struct.unpack_from(">II", blob, 8))
    return padded(blob[16:], width * height * 8).reshape(height, width, 4, 2)[:, :, :, 0]


def macpaint(blob: bytes) -> np.ndarray:
    """576 x 720 pixels in PackBits after a header of 512 bytes, and after a MacBinary header if there is one."""
    start = 128 if blob[65:69] == b"PNTG" else 0
    rows = padded(packbits(blob[start + 512 :], 72 * 720).data, 72 * 720).reshape(720, 72)
    return ((1 - np.unpackbits(rows, axis=1)) * np.uint8(255))[:, :, None]


def ilbm(blob: bytes) -> np.ndarray:
    """Amiga images of up to 8 planes with a palette (half-bright and hold-and-modify too), or of 24 planes."""
    if blob[:4] != b"FORM" or blob[8:12] not in (b"ILBM", b"PBM "):
        raise ValueError("no ILBM")
    chunky, at, head, table, mode, body = blob[8:12] == b"PBM ", 12, b"", b"", 0, b""
    while at + 8 <= len(blob):
        tag, size = blob[at : at + 4], int.from_bytes(blob[at + 4 : at + 8], "big")
        part = blob[at + 8 : at + 8 + size]
        head, table, body = part if tag == b"BMHD" else head, part if tag == b"CMAP" else table, part if tag == b"BODY" else body
        mode = int.from_bytes(part[:4], "big") if tag == b"CAMG" else mode
        at += 8 + size + size % 2
    if len(head) < 20:
        raise ValueError("no header")
    width, height = checked(*struct.unpack_from(">HH", head))
    planes, mask, packed = head[8], head[9], head[10]
    stride = (width + 15) // 16 * 2 if not chunky else (width + 1) // 2 * 2
    each = 1 if chunky else planes + (mask == 1)
    size = stride * each * height
    rows = padded(packbits(body, size).data if packed == 1 else body, size).reshape(height, each, stride)
    palette = np.zeros((256, 3), np.uint8)
    known = padded(table, len(table) // 3 * 3).reshape(-1, 3)[:256]
    palette[: len(known)] = known
    if chunky:
        return palette[rows[:, 0, :width]]
    bits = np.unpackbits(rows[:, :planes], axis=2)[:, :, :width].astype(np.int64)
    values = (bits << np.arange(planes)[None, :, None]).sum(1)
    if planes == 24:
        return np.stack([values >> s & 255 for s in (0, 8, 16)], 2).astype(np.uint8)
    if mode & 0x800 and planes in (6, 8):  # hold the pixel to the left and modify one of its colours
        keep, out = planes - 2, np.zeros((height, width, 3), np.uint8)
        left = np.repeat(palette[:1], height, 0)
        low = values & (1 << keep) - 1
        scaled = (low * 255 // ((1 << keep) - 1)).astype(np.uint8)
        for x in range(width):
            code = values[:, x] >> keep
            left = np.where((code == 0)[:, None], palette[low[:, x]], left)
            for wanted, channel in ((1, 2), (2, 0), (3, 1)):
                left[:, channel] = np.where(code == wanted, scaled[:, x], left[:, channel])
            out[:, x] = left
        return out
    if mode & 0x80 and planes == 6:
        palette[32:64] = palette[:32] // 2
    if planes > 8:
        raise ValueError(f"{planes} planes")
    return palette[values]


def png_encode(image: np.ndarray, level: int = 9) -> bytes:
    """A PNG of 8 bits: gray, gray and opacity, RGB or RGBA by the number of channels."""
    height, width, channels = image.shape
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def reduced(image: np.ndarray) -> np.ndarray:
    """The same pixels in the fewest channels: no opacity where all is opaque, no colour where all is gray."""
    colour, alpha = (image[:, :, :-1], image[:, :, -1:]) if image.shape[2] in (2, 4) else (image, None)
    if colour.shape[2] == 3 and (colour[:, :, 0] == colour[:, :, 1]).all() and (colour[:, :, 1] == colour[:, :, 2]).all():
        colour = colour[:, :, :1]
    return colour if alpha is None or (alpha == 255).all() else np.concatenate([colour, alpha], axis=2)


def flip(image: np.ndarray) -> np.ndarray:
    return image[::-1]


def mirror(image: np.ndarray) -> np.ndarray:
    return image[:, ::-1]


def transpose(image: np.ndarray) -> np.ndarray:
    return image.transpose(1, 0, 2)


def with_mask(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """RGB with the first channel of mask as opacity."""
    return np.concatenate([image[:, :, :3], mask[:, :, :1]], axis=2)


HANDLERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "bmp": bmp, "pnm": pnm, "pcx": pcx, "gif": gif, "tga": tga, "sunras": sun_raster, "farbfeld": farbfeld, "macpaint": macpaint, "ilbm": ilbm,
}


def readers() -> dict[str, Callable[[bytes], Iterator[np.ndarray]]]:
    """All formats, each with the images that a blob of it holds."""
    from tessera.operators import old_rasters, tiff_rasters

    one = lambda read: lambda blob: iter((read(blob),))
    return {k: one(f) for k, f in (HANDLERS | old_rasters.ONE).items()} | old_rasters.SEVERAL | {"tiff": tiff_rasters.tiff_images}


#: What reading damaged images may raise.
DAMAGE = (ArithmeticError, LookupError, ValueError, struct.error, zlib.error, RecursionError)


def raster(content: Column | str, kind: str) -> Column:
    """The (first) image of each blob of the format as a struct of width, height, channels and rows of pixels; err tells why there is none."""
    read = readers()[kind]

    def each(blob: bytes | None) -> tuple[tuple, int]:
        try:
            image = next(read(blob or b""), None)
            if image is None:
                raise ValueError("no image")
            return (image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None), image.size
        except DAMAGE as e:
            return (None, None, None, None, str(e) or type(e).__name__), 0

    build = struct_of([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("err", pa.string())])
    return column_of(each, build, RASTER, content)


PICTURES = "path string, file_id int, width int, height int, channels int, data binary, err string"


def pictures(blobs: DataFrame, kind: str | None = None) -> DataFrame:
    """All images of blobs of the given format, or of that in their column format; one that cannot be read ends those of its blob with the reason."""
    typed = blobs.select("path", (F.lit(kind) if kind else F.col("format")).alias("format"), "content")
    names = [part.split()[0] for part in PICTURES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def images(path: str, own: str | None, blob: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for image in readers()[own](blob) if own in readers() else ():
                yield path, n, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None
                n += 1
        except DAMAGE as e:
            yield path, n, None, None, None, None, str(e) or type(e).__name__

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("path", "format", "content")), strict=True):
                for found in images(row[0], row[1], row[2] or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, kinds, strict=True)], names)

    return typed.mapInArrow(expand, PICTURES)


def png_of(rasters: DataFrame, raster_column: str = "raster") -> Column:
    """The rasters as PNG files, in the fewest channels."""

    @F.pandas_udf("binary")
    def each(frame: pd.DataFrame) -> pd.Series:
        out = []
        for r in frame.itertuples():
            out.append(None if r.data is None else png_encode(reduced(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels)))))
        return pd.Series(out)

    return each(rasters[raster_column])
