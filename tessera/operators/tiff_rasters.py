"""Images of TIFF files: strips or tiles, plain or packed, of gray, palette, RGB or CMYK samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from tessera.operators.codecs import inflate, lzw, packbits
from tessera.operators.fax import decode_fax
from tessera.operators.fields import TIFF_TYPES
from tessera.operators.rasters import checked, indexed, padded

MOST_IMAGES = 1_000


def directories(blob: bytes) -> Iterator[dict[int, list]]:
    """Numbers of each directory's tags."""
    order = "<" if blob[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", blob, 4)[0], set()
    while at and at not in seen and len(seen) < MOST_IMAGES:
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", blob, at)[0], {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            _, unit, code = TIFF_TYPES.get(kind, ("", 0, ""))
            if not unit or kind in (2, 5, 10) or unit * count > len(blob):
                continue
            place = at + 10 + 12 * i
            if unit * count > 4:
                place = struct.unpack_from(order + "I", blob, place)[0]
            if place + unit * count <= len(blob):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", blob, place))
        yield tags
        after = at + 2 + 12 * n
        at = struct.unpack_from(order + "I", blob, after)[0] if after + 4 <= len(blob) else 0


def unpacked(data: bytes, method: int, width: int, height: int, stride: int, tags: dict[int, list]) -> np.ndarray:
    """Rows of bytes of a strip or tile."""
    size = stride * height
    if method in (2, 3, 4):
        options = tags.get({3: 292, 4: 293}.get(method, 0), [0])[0]
        black = decode_fax(data, width, height, method, options, tags.get(266, [1])[0] == 2)
        return np.packbits(black, axis=1)
    if tags.get(266, [1])[0] == 2:
        data = data.translate(bytes(int(f"{b:08b}"[::-1], 2) for b in range(256)))
    if method == 5:
        old = data[:2] == b"\0\1"
        data = lzw(data, size, "gif" if old else "tiff").data
    elif method in (8, 32946):
        data = inflate(data, size, 15).data
    elif method == 32773:
        data = packbits(data, size).data
    elif method != 1:
        raise ValueError(f"compression {method}")
    return padded(data, size).reshape(height, stride)


def samples(rows: np.ndarray, width: int, bits: int, each: int, big: bool, predicted: bool) -> np.ndarray:
    """Samples of rows as height, width, each, of 8 bits where they have more than that."""
    if bits < 8:
        return indexed(rows, bits, width * each).reshape(len(rows), width, each)
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits")
    values = np.ascontiguousarray(rows[:, : width * each * bits // 8]).view((">u2" if big else "<u2") if bits == 16 else "u1")
    values = values.reshape(len(rows), width, each)
    if predicted:
        values = np.cumsum(values.astype(np.uint16 if bits == 16 else np.uint8), axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    return (values >> 8).astype(np.uint8) if bits == 16 else values


def colours(values: np.ndarray, kind: int, bits: int, tags: dict[int, list]) -> np.ndarray:
    """Samples as gray, RGB or RGBA of 8 bits."""
    top = (1 << min(bits, 8)) - 1
    scaled = ((values.astype(np.int64) * 510 + top) // (2 * top)).astype(np.uint8)
    if kind == 3:
        n = 1 << bits
        table = np.array(tags.get(320, [0] * 3 * n), np.int64)[: 3 * n].reshape(3, n).T
        table = table >> 8 if table.max(initial=0) > 255 else table
        return table.astype(np.uint8)[np.minimum(values[:, :, 0], n - 1)]
    if kind in (0, 1):
        gray = 255 - scaled[:, :, :1] if kind == 0 else scaled[:, :, :1]
        return gray
    if kind == 2:
        extra = tags.get(338, [0])
        return scaled[:, :, :4] if values.shape[2] >= 4 and extra[0] in (1, 2) else scaled[:, :, :3]
    if kind == 5:
        ink = 255 - scaled[:, :, :4].astype(np.int64)
        return ((ink[:, :, :3] * ink[:, :, 3:] * 2 + 255) // 510).astype(np.uint8)
    raise ValueError(f"colours of kind {kind}")


def tiff_image(blob: bytes, tags: dict[int, list]) -> np.ndarray:
    width, height = checked(tags[256][0], tags[257][0])
    bits, each, method, kind = tags.get(258, [1])[0], tags.get(277, [1])[0], tags.get(259, [1])[0], tags.get(262, [1])[0]
    big, apart, predicted = blob[:2] == b"MM", tags.get(284, [1])[0] == 2, tags.get(317, [1])[0] == 2
    if not 1 <= each <= 8 or tags.get(317, [1])[0] not in (1, 2):
        raise ValueError("kind of samples")
    tiled = 322 in tags
    wide, tall = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, [height])[0] or height))
    wide, tall = checked(wide, tall)
    together = 1 if apart else each
    stride = (wide * together * bits + 7) // 8
    across, down = -(-width // wide), -(-height // tall)
    places, sizes = tags[324 if tiled else 273], tags.get(325 if tiled else 279)
    out = np.zeros((down * tall, across * wide, each), np.uint8)
    for plane in range(each if apart else 1):
        for n in range(across * down):
            at = plane * across * down + n
            if at >= len(places):
                break
            y, x = n // across * tall, n % across * wide
            high = tall if tiled else min(tall, height - y)
            data = blob[places[at] : places[at] + (sizes[at] if sizes and at < len(sizes) else len(blob))]
            values = samples(unpacked(data, method, wide, high, stride, tags), wide, bits, together, big, predicted)
            part = slice(plane, plane + 1) if apart else slice(0, each)
            out[y : y + high, x : x + wide, part] = values
    if method in (2, 3, 4) and kind not in (0, 1):
        kind = 0
    return colours(out[:height, :width], kind, bits, tags)


def tiff_images(blob: bytes) -> Iterator[np.ndarray]:
    """The images of all directories, in order; directories without an image are passed over."""
    if blob[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no TIFF header")
    for tags in directories(blob):
        if 256 in tags and 257 in tags and (273 in tags or 324 in tags):
            yield tiff_image(blob, tags)
