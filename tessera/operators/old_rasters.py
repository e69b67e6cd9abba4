"""Images of old programs and computers: plain or simply packed pixels behind short headers.

Each reader gives an array of height, width and channels (1 gray, 3 RGB, 4 RGBA); a blob that says
something impossible raises ValueError. Missing bytes are zero.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np

from tessera.operators.codecs import packbits
from tessera.operators.rasters import checked, indexed, padded


def levels(values: np.ndarray, top: int) -> np.ndarray:
    """Samples from 0 to top as 0 to 255."""
    return ((np.minimum(values.astype(np.int64), top) * 510 + top) // (2 * top)).astype(np.uint8)


def bilevel(data: bytes, width: int, height: int, stride: int | None = None, zero_is_white: bool = True, low_first: bool = False) -> np.ndarray:
    width, height = checked(width, height)
    stride = (width + 7) // 8 if stride is None else stride
    rows = padded(data, stride * height).reshape(height, stride)
    bits = np.unpackbits(rows, axis=1, bitorder="little" if low_first else "big")[:, :width, None]
    return (bits ^ zero_is_white) * np.uint8(255)


def rgb_palette(data: bytes, n: int, top: int = 255) -> np.ndarray:
    """256 colours, of which the first n are read from bytes of red, green and blue."""
    out = np.zeros((256, 3), np.uint8)
    known = padded(data, 3 * n).reshape(n, 3)[:256]
    out[: len(known)] = known if top == 255 else levels(known, top)
    return out


def paletted(data: bytes, width: int, height: int, palette: np.ndarray, bits: int = 8, stride: int | None = None) -> np.ndarray:
    width, height = checked(width, height)
    stride = (width * bits + 7) // 8 if stride is None else stride
    return palette[indexed(padded(data, stride * height).reshape(height, stride), bits, width)]


def rgb565(data: bytes, width: int, height: int, big: bool = True) -> np.ndarray:
    width, height = checked(width, height)
    values = padded(data, 2 * width * height).view(">u2" if big else "<u2").reshape(height, width)
    return np.stack([levels(values >> 11, 31), levels(values >> 5 & 63, 63), levels(values & 31, 31)], 2)


def runs_of(data: bytes, size: int, unit: Callable[[int, bytes, int], tuple[bytes, int]]) -> bytes:
    """Unpacks up to size bytes: unit gets the byte at a place and gives what it stands for and the next place."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        part, at = unit(data[at], data, at + 1)
        out += part
    return bytes(out[:size])


def pc16() -> np.ndarray:
    """The 16 colours of PC text screens."""
    out = np.zeros((256, 3), np.uint8)
    for i in range(16):
        out[i] = [(170 if i & bit else 0) + (85 if i & 8 else 0) for bit in (4, 2, 1)]
    out[6] = (170, 85, 0)
    return out


def ega64() -> np.ndarray:
    """Six bits, of which the lower three are two thirds and the upper three one third of each colour."""
    return np.array([[170 * (i >> b & 1) + 85 * (i >> b + 3 & 1) for b in (2, 1, 0)] for i in range(64)], np.uint8)


def cga(number: int = 1) -> np.ndarray:
    """The CGA's palettes of four colours: 0 green, red, brown; 1 cyan, magenta, white (gray); 2 cyan, red, white; from 3 on bright."""
    dim = [(2, 4, 6), (3, 5, 7), (3, 4, 7)][number % 3]
    return pc16()[[0, *(c + 8 * (number >= 3) for c in dim)]]


def vga256() -> np.ndarray:
    """The VGA's first palette: 16 PC colours, 16 grays, and 24 hues in three brightnesses and three saturations."""
    # Levels of gray, and the lowest and highest level of each set of hues, of 63.
    grays = (0, 5, 8, 11, 14, 17, 20, 24, 28, 32, 36, 40, 45, 50, 56, 63)
    sets = ((0, 16, 31, 47, 63), (31, 39, 47, 55, 63), (45, 49, 54, 58, 63), (0, 7, 14, 21, 28), (14, 17, 21, 24, 28), (20, 22, 24, 26, 28), (0, 4, 8, 12, 16), (8, 10, 12, 14, 16), (11, 12, 13, 15, 16))
    colours = [(g, g, g) for g in grays]
    for low, a, b, c, high in sets:
        up = (low, a, b, c, high)
        for rising, falling, still in ((0, None, (None, low, high)), (None, 2, (high, low, None)), (1, None, (high, None, low)), (None, 0, (None, high, low)), (2, None, (low, high, None)), (None, 1, (low, None, high))):
            for k in range(4):
                moving = rising if rising is not None else falling
                value = up[k] if rising is not None else up[4 - k]
                colours.append(tuple(value if i == moving else v for i, v in enumerate(still)))
    out = np.zeros((256, 3), np.uint8)
    out[:16], out[16 : 16 + len(colours)] = pc16()[:16], levels(np.array(colours), 63)
    return out


# --- Atari ---


def atari_palette(data: bytes, n: int, bits: int = 0) -> np.ndarray:
    """Colours of 9, 12 (where the fourth bits are used and nothing else) or 15 bits."""
    values = padded(data, 2 * n).view(">u2").astype(np.int64)
    if not bits:
        bits = 12 if (values & 0x888).any() and not (values & 0xF000).any() else 9
    nibbles = np.stack([values >> s & 15 for s in (8, 4, 0)], 1)
    if bits == 9:
        return levels(nibbles & 7, 7)
    wide = (nibbles & 7) << 1 | nibbles >> 3
    if bits == 12:
        return levels(wide, 15)
    return levels(wide << 1 | np.stack([values >> s & 1 for s in (15, 14, 13)], 1), 31)


def planes(data: bytes, width: int, height: int, bits: int, by_row: bool = False) -> np.ndarray:
    """Pixel values of words of 16 pixels, plane after plane; by_row: whole rows of each plane."""
    width, height = checked(width, height)
    words = (width + 15) // 16
    rows = padded(data, 2 * words * bits * height)
    rows = rows.reshape(height, bits, words, 2) if by_row else rows.reshape(height, words, bits, 2).transpose(0, 2, 1, 3)
    flat = np.unpackbits(np.ascontiguousarray(rows).reshape(height, bits, words * 2), axis=2)[:, :, :width].astype(np.int64)
    return (flat << np.arange(bits)[None, :, None]).sum(1)


def degas(blob: bytes) -> np.ndarray:
    kind = int.from_bytes(blob[:2], "big")
    if kind & 3 == 3:
        raise ValueError(f"resolution {kind & 3}")
    bits, width, height = ((4, 320, 200), (2, 640, 200), (1, 640, 400))[kind & 3]
    palette, packed = atari_palette(blob[2:34], 16), bool(kind & 0x8000)
    if bits == 1 and (palette[0] == palette[1]).all():
        palette[0] = 255 - palette[1]
    body = packbits(blob[34:], 32_000).data if packed else blob[34:]
    return palette[planes(body, width, height, bits, packed)]


def neochrome(blob: bytes) -> np.ndarray:
    if int.from_bytes(blob[2:4], "big"):
        raise ValueError("resolution")
    return atari_palette(blob[4:36], 16)[planes(blob[128:], 320, 200, 4)]


def doodle(blob: bytes) -> np.ndarray:
    return bilevel(blob, 640, 400)


def spectrum512(blob: bytes) -> np.ndarray:
    """48 colours for each line; which of three a value means depends on the place across."""
    colours = atari_palette(blob[32_000:], 199 * 48, 15 if blob[:4] == b"5BIT" else 0)
    values = planes(blob[160:32_000], 320, 199, 4)
    across = np.arange(320)[None, :]
    first = 10 * values + np.where(values % 2, -5, 1)
    values = values + 16 * (across >= first) + 16 * (across >= first + 160)
    return colours[values + 48 * np.arange(199)[:, None]]


def falcon8(width: int, height: int) -> Callable[[bytes], np.ndarray]:
    """256 colours in words of eight planes, behind a palette of four bytes a colour."""

    def read(blob: bytes) -> np.ndarray:
        return padded(blob, 1024).reshape(256, 4)[:, [0, 1, 3]][planes(blob[1024:], width, height, 8)]

    return read


def true_colour(width_at: int, start: int | None = None) -> Callable[[bytes], np.ndarray]:
    """16-bit colours behind a header with width and height; start None: the header tells it."""

    def read(blob: bytes) -> np.ndarray:
        width, height = struct.unpack_from(">HH", blob, width_at)
        return rgb565(blob[struct.unpack_from(">H", blob, width_at + 4)[0] if start is None else start :], width, height)

    return read


def falcon_xga(blob: bytes) -> np.ndarray:
    return rgb565(blob, *((320, 240) if len(blob) == 153_600 else (384, 480)))


def prism_paint(blob: bytes) -> np.ndarray:
    n, width, height, bits, packed = struct.unpack_from(">5H", blob, 6)
    if bits not in (1, 2, 4, 8, 16) or packed > 1:
        raise ValueError(f"{bits} bits, compression {packed}")
    start = 128 + 6 * n
    body = packbits(blob[start:]).data if packed else blob[start:]
    if bits == 16:
        return rgb565(body, width, height)
    stored = levels(padded(blob[128:start], 6 * min(n, 256)).view(">u2").reshape(-1, 3), 1000)
    # The order of the system's colours.
    order = {} if bits == 1 else {1: 2, 2: 3, 3: 6 if bits > 2 else 1, 5: 7, 6: 5, 7: 8, 8: 9, 9: 10, 10: 11, 11: 14, 13: 15, 14: 13, 15: 255 if bits == 8 else 1, 255: 1}
    palette = np.zeros((256, 3), np.uint8)
    for i in range(len(stored)):
        palette[i] = stored[order.get(i, i)] if order.get(i, i) < len(stored) else 0
    return palette[planes(body, width, height, bits, bool(packed))]


# --- Others ---


def vbm(blob: bytes) -> np.ndarray:
    if blob[3] != 2:
        raise ValueError(f"version {blob[3]}")
    return bilevel(blob[8:], *struct.unpack_from(">HH", blob, 4))


def hp_icon(blob: bytes) -> np.ndarray:
    return bilevel(blob[8:], *struct.unpack_from("<HH", blob, 4))


def bob(blob: bytes) -> np.ndarray:
    return paletted(blob[772:], *struct.unpack_from("<HH", blob), rgb_palette(blob[4:], 256))


def rgb24(data: bytes, width: int, height: int) -> np.ndarray:
    width, height = checked(width, height)
    return padded(data, 3 * width * height).reshape(height, width, 3)


def iim(blob: bytes) -> np.ndarray:
    kind, bits, width, height = struct.unpack_from(">4H", blob, 8)
    if (kind, bits) != (4, 24):
        raise ValueError(f"type {kind} of {bits} bits")
    return rgb24(blob[16:], width, height)


def qdv(blob: bytes) -> np.ndarray:
    width, height, n = struct.unpack_from(">HHB", blob)
    return paletted(blob[8 + 3 * n :], width, height, rgb_palette(blob[5:], n + 1))


def animator(blob: bytes) -> np.ndarray:
    return paletted(blob[800:], *struct.unpack_from("<HH", blob, 2), rgb_palette(blob[32:], 256, 63))


def xpuzzle(blob: bytes) -> np.ndarray:
    width, height, n = struct.unpack_from(">IIB", blob)
    n = n or 256
    return paletted(blob[9 + 3 * n :], width, height, rgb_palette(blob[9:], n))


def ybm(blob: bytes) -> np.ndarray:
    """Words of 16 pixels, lowest bit first, in the order of their bytes turned round."""
    width, height = struct.unpack_from(">HH", blob, 2)
    stride = (width + 15) // 16 * 2
    turned = padded(blob[6:], stride * height).reshape(-1, 2)[:, ::-1].tobytes()
    return bilevel(turned, width, height, stride, low_first=True)


def deskmate(blob: bytes) -> np.ndarray:
    body = blob[22:]
    if len(body) != 27_456:
        body = b"".join(body[i : i + 1] * body[i + 1] for i in range(0, len(body) - 1, 2))[:27_456]
    return paletted(body, 312, 176, pc16(), 4)


def dgi(blob: bytes) -> np.ndarray:
    """Four CGA screens, their even and odd lines apart, side by side and one above the other."""
    half = lambda at: padded(blob[at : at + 8000], 8000).reshape(50, 2, 80)
    out = np.zeros((400, 160), np.uint8)
    for n, at in enumerate((0, 16_000, 32_008, 48_008)):
        screen = np.stack([half(at), half(at + 8000)], 2).reshape(200, 80)  # lines 0 and 2 of the even ones, 1 and 3 of the odd ones
        out[200 * (n // 2) :][:200, 80 * (n % 2) :][:, :80] = screen
    return np.concatenate([cga(1), np.zeros((252, 3), np.uint8)])[indexed(out, 2, 640)]


def calamus(blob: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">II", blob, 20)
    if blob[32] != 1:
        raise ValueError(f"compression {blob[32]}")
    width, height = checked(width, height)
    size = struct.unpack_from(">I", blob, 38)[0]
    unit = lambda b, d, at: (d[at : at + b + 1], at + b + 1) if b < 128 else (d[at : at + 1] * (b - 127), at + 1)
    return bilevel(runs_of(blob[42 : 42 + size], (width + 7) // 8 * height, unit), width, height)


def lumena(blob: bytes) -> np.ndarray:
    width, height = checked(*struct.unpack_from("<HH", blob))
    if len(blob) == 4 + 2 * width * height:
        values = padded(blob[4:], 2 * width * height).view("<u2").reshape(height, width)
        return np.stack([levels(values >> s & 31, 31) for s in (10, 5, 0)], 2)[::-1]
    image = padded(blob[4:], 4 * width * height).reshape(height, width, 4)[::-1]
    return image if image[:, :, 3].any() else image[:, :, :3]


def desk_icon(blob: bytes) -> np.ndarray:
    """32 x 32 pixels, column by column."""
    palette = pc16()
    if blob[2]:
        # The colours that differ from the PC's.
        palette[:16] = [(0, 0, 0), (170, 0, 0), (0, 170, 0), (170, 170, 0), (0, 0, 170), (170, 0, 170), (0, 170, 170), (125, 125, 125), (186, 186, 186), (255, 85, 85), (85, 255, 85), (255, 255, 85), (85, 85, 255), (255, 85, 255), (85, 255, 255), (255, 255, 255)]
    return paletted(blob[3:], 32, 32, palette, 4).transpose(1, 0, 2)


def rip_icons(blob: bytes) -> Iterator[np.ndarray]:
    """Images of four planes, row by row, the highest first."""
    at = 0
    while at + 8 <= len(blob):
        width, height = (1 + v for v in struct.unpack_from("<HH", blob, at))
        stride = (width + 7) // 8
        size = 4 * stride * height
        if width > 2048 or height > 2048 or at + 4 + size > len(blob):
            return
        rows = np.unpackbits(padded(blob[at + 4 :], size).reshape(height, 4, stride), axis=2)[:, :, :width].astype(int)
        yield pc16()[(rows << np.arange(4)[None, ::-1, None]).sum(1)]
        at += 6 + size


def hsi_raw(blob: bytes) -> np.ndarray:
    width, height, n = struct.unpack_from(">3H", blob, 8)
    packed, alpha = struct.unpack_from(">HH", blob, 20)
    width = width or struct.unpack_from(">I", blob, 28)[0]
    if n > 256 or packed or alpha:
        raise ValueError("compression or opacity")
    return paletted(blob[32 + 3 * n :], width, height, rgb_palette(blob[32:], n)) if n else rgb24(blob[32:], width, height)


def vitec(blob: bytes) -> np.ndarray:
    second = 4 + struct.unpack_from(">I", blob, 4)[0]
    size, width, height, samples = (struct.unpack_from(">I", blob, second + k)[0] for k in (0, 36, 40, 56))
    width, height = checked(width, height)
    if samples not in (1, 3):
        raise ValueError(f"{samples} samples")
    stride = width + -width % 8
    return padded(blob[second + size :], stride * height * samples).reshape(samples, height, stride)[:, :, :width].transpose(1, 2, 0)


def lss16(blob: bytes) -> np.ndarray:
    """Four-bit pixels, low ones first; a pixel like the last one begins a run."""
    width, height = checked(*struct.unpack_from("<HH", blob, 4))
    nibbles = np.stack([np.frombuffer(blob[56:], np.uint8) & 15, np.frombuffer(blob[56:], np.uint8) >> 4], 1).ravel().tolist()
    out, at = np.zeros((height, width), np.uint8), 0
    for row in range(height):
        x, last = 0, 0
        at += at % 2
        while x < width and at < len(nibbles):
            value, at = nibbles[at], at + 1
            run = 1
            if value == last:
                run, at = (nibbles[at] if at < len(nibbles) else 0), at + 1
                if run == 0:
                    low, high = (nibbles[at + k] if at + k < len(nibbles) else 0 for k in (0, 1))
                    run, at = 16 + (low | high << 4), at + 2
            out[row, x : x + run] = value
            x, last = x + run, value
    return rgb_palette(blob[8:56], 16, 63)[out]


def alias_pix(blob: bytes) -> np.ndarray:
    width, height = checked(*struct.unpack_from(">HH", blob))
    depth = struct.unpack_from(">H", blob, 8)[0]
    if depth not in (8, 24):
        raise ValueError(f"{depth} bits")
    unit = depth // 8

    def run(n: int, data: bytes, at: int) -> tuple[bytes, int]:
        if not n:
            raise ValueError("a run of nothing")
        return data[at : at + unit] * n, at + unit

    pixels = padded(runs_of(blob[10:], unit * width * height, run), unit * width * height).reshape(height, width, unit)
    return pixels if unit == 1 else pixels[:, :, ::-1]


def portfolio(blob: bytes) -> np.ndarray:
    return bilevel(blob, 240, 64)


def portfolio_packed(blob: bytes) -> np.ndarray:
    unit = lambda b, d, at: (d[at : at + 1] * (b & 127), at + 1) if b & 128 else (d[at : at + b], at + b)
    return bilevel(runs_of(blob[3:], 1920, unit), 240, 64)


def mega_blocks(blob: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">hh", blob)
    packed = width < 0
    width, height = checked(abs(width) + 1, height + 1)
    size, body = (width + 7) // 8 * height, blob[4:]
    if packed:
        unit = lambda b, d, at: (bytes([b]) * (1 + (d[at] if at < len(d) else 0)), at + 1) if b in (0, 255) else (bytes([b]), at)
        body = runs_of(body, size, unit)
    return bilevel(body, width, height)


def mega_symbols(blob: bytes) -> Iterator[np.ndarray]:
    for k in range(1 + struct.unpack_from(">H", blob, 12)[0]):
        at = struct.unpack_from(">I", blob, 14 + 4 * k)[0]
        width, height = (1 + v for v in struct.unpack_from(">HH", blob, at))
        yield bilevel(blob[at + 4 :], width, height, (width + 15) // 16 * 2)


def mega_patterns(blob: bytes) -> np.ndarray:
    """32 patterns in a gray frame, 16 in a row."""
    out = np.full((67, 529, 1), 128, np.uint8)
    for k in range(32):
        out[1 + 33 * (k // 16) :][:32, 1 + 33 * (k % 16) :][:, :32] = bilevel(blob[8 + 128 * k :], 32, 32)
    return out


def nokia_text(width_at: int, start: int) -> Callable[[bytes], np.ndarray]:
    """Pixels as digits; 0 is white."""

    def read(blob: bytes) -> np.ndarray:
        width, height = checked(*struct.unpack_from("<HH", blob, width_at))
        return ((padded(blob[start:], width * height) == 0x30) * np.uint8(255)).reshape(height, width, 1)

    return read


def nokia_manager(blob: bytes) -> np.ndarray:
    return bilevel(blob[10:], blob[7], blob[8])


def nokia_message(blob: bytes) -> np.ndarray:
    at = 5 + blob[4] + 1
    return bilevel(blob[at + 5 :], blob[at], blob[at + 1])


def microsoft_paint(blob: bytes) -> np.ndarray:
    """Version 1 plain; version 2 with runs and a table of the rows' sizes."""
    width, height = checked(*struct.unpack_from("<HH", blob, 4))
    stride = (width + 7) // 8
    if blob[0] != 0x4C:
        return bilevel(blob[32:], width, height, zero_is_white=False)
    sizes, at, rows = struct.unpack_from(f"<{height}H", blob, 32), 32 + 2 * height, bytearray()
    unit = lambda b, d, p: (d[p : p + b], p + b) if b else (d[p + 1 : p + 2] * (d[p] if p < len(d) else 0), p + 2)
    for size in sizes:
        rows += runs_of(blob[at : at + size], stride, unit).ljust(stride, b"\0")
        at += size
    return bilevel(bytes(rows), width, height, zero_is_white=False)


def playstation(blob: bytes) -> np.ndarray:
    """Images of 8 bits with a palette."""
    kind = struct.unpack_from("<I", blob, 4)[0]
    if kind & 7 != 1 or not kind & 8:
        raise ValueError(f"type {kind}")
    n, tables = struct.unpack_from("<HH", blob, 16)
    colours = padded(blob[20:], 2 * min(n, 256)).view("<u2")
    palette = np.zeros((256, 3), np.uint8)
    palette[: len(colours)] = np.stack([levels(colours >> s & 31, 31) for s in (0, 5, 10)], 1)
    at = 20 + 2 * n * tables
    words, height = struct.unpack_from("<HH", blob, at + 8)
    return paletted(blob[at + 12 :], 2 * words, height, palette)


def x_window(blob: bytes) -> np.ndarray:
    """Dumps of X windows: gray or palette of 1, 2, 4 or 8 bits, or 16 to 32 bits by masks."""
    head = struct.unpack_from(">25I", blob)
    size, kind, width, height, low_bytes, low_bits, bits, stride, visual, n = head[0], head[2], head[4], head[5], not head[7], not head[9], head[11], head[12], head[13], head[18]
    width, height = checked(width, height)
    colours = padded(blob[size : size + 12 * min(n, 256)], 12 * min(n, 256)).reshape(-1, 12)[:, [4, 6, 8]]
    rows = padded(blob[size + 12 * n :], stride * height).reshape(height, stride)
    if kind == 0 or kind == 1 and bits == 1:
        return bilevel(rows.tobytes(), width, height, stride, zero_is_white=False, low_first=low_bits)
    if bits in (2, 4, 8) and visual in (0, 1, 2, 3):
        palette = np.zeros((256, 3), np.uint8)
        if len(colours):
            palette[: len(colours)] = colours
        else:
            palette[: 1 << bits] = levels(np.arange(1 << bits), (1 << bits) - 1)[:, None]
        return palette[indexed(rows, bits, width)]
    if bits not in (16, 24, 32):
        raise ValueError(f"{bits} bits")
    unit = bits // 8
    pixels = rows[:, : width * unit].reshape(height, width, unit).astype(np.int64)
    places = np.arange(unit) if low_bytes else np.arange(unit)[::-1]
    values = (pixels << 8 * places).sum(2)
    out = []
    for mask in head[14:17]:
        shift = (mask & -mask).bit_length() - 1 if mask else 0
        out.append(levels((values & mask) >> shift, max(1, mask >> shift)))
    return np.stack(out, 2)


def silicon_graphics(blob: bytes) -> np.ndarray:
    """One to four channels of 8 or 16 bits, plain or in runs, from the bottom row up."""
    packed, unit = blob[2], blob[3]
    dimensions, width, height, channels = struct.unpack_from(">4H", blob, 4)
    width, height = checked(width, height if dimensions >= 2 else 1)
    channels = channels if dimensions >= 3 else 1
    if packed > 1 or unit not in (1, 2) or not 1 <= channels <= 4 or struct.unpack_from(">I", blob, 104)[0]:
        raise ValueError("kind of image")
    stride, body = width * unit, blob[512:]
    if packed:
        n, rows = height * channels, bytearray()
        places, sizes = struct.unpack_from(f">{n}I", blob, 512), struct.unpack_from(f">{n}I", blob, 512 + 4 * n)
        for place, size in zip(places, sizes, strict=True):
            part, row, at = blob[place : place + size], bytearray(), 0
            while at + unit <= len(part) and len(row) < stride:
                count, literal = part[at + unit - 1] & 127, part[at + unit - 1] & 128
                at += unit
                if not count:
                    break
                row += part[at : at + count * unit] if literal else part[at : at + unit] * count
                at += count * unit if literal else unit
            rows += row[:stride].ljust(stride, b"\0")
        body = bytes(rows)
    samples = padded(body, stride * height * channels)
    if unit == 2:
        samples = samples.view(">u2") >> 8
    image = samples.astype(np.uint8).reshape(channels, height, width).transpose(1, 2, 0)[::-1]
    return image


def psion(blob: bytes) -> Iterator[np.ndarray]:
    """Planes of one bit, or pairs of planes of the same size as four grays."""
    n = struct.unpack_from("<H", blob, 6)[0]
    found = []
    for i in range(n):
        _, width, height, size, place = struct.unpack_from("<HHHHI", blob, 8 + 12 * i)
        found.append((width, height, 20 + 12 * i + place))
    stride = lambda width: (width + 15) // 16 * 2
    paired = lambda part: len(part) >= 2 and len(part) % 2 == 0 and all(a[:2] == b[:2] for a, b in zip(part[::2], part[1::2], strict=True))
    small = bool(found) and found[0][:2] == (24, 24)
    single = 1 if n >= 3 and small and found[1][:2] == (48, 48) and paired(found[1:]) else n if small or not paired(found) else 0
    for width, height, at in found[:single]:
        yield bilevel(blob[at:], width, height, stride(width), low_first=True)
    for (width, height, a), (_, _, b) in zip(found[single::2], found[single + 1 :: 2], strict=False):
        black, gray = (255 - bilevel(blob[at:], width, height, stride(width), low_first=True) for at in (a, b))
        yield np.where(black > 0, np.where(gray > 0, 0, 1), np.where(gray > 0, 128, 255)).astype(np.uint8)


def jovian(blob: bytes) -> np.ndarray:
    kinds = {0x10: 16, 0x11: 24, 0x20: 4, 0x21: 6, 0x22: 8, 0x23: 1, 0x30: 8, 0x31: 4}
    if blob[2] not in kinds:
        raise ValueError(f"type {blob[2]:#x}")
    bits, (width, height) = kinds[blob[2]], struct.unpack_from("<HH", blob, 3)
    table, start = struct.unpack_from("<HH", blob, 12)
    body = blob[start:]
    if bits == 16:
        return rgb565(body, width, height, big=False)
    if bits == 24:
        return rgb24(body, width, height)
    if bits == 1:
        return bilevel(body, width, height, zero_is_white=False)
    palette = np.zeros((256, 3), np.uint8)
    if blob[2] >= 0x30:
        first, n = blob[10], blob[11] or 256
        known = padded(blob[table:], 3 * n).reshape(n, 3)[: 256 - first]
        palette[first : first + len(known)] = levels(known, 63) if blob[9] == 0 else known
    else:
        palette[: 1 << bits] = levels(np.arange(1 << bits), (1 << bits) - 1)[:, None]
    return paletted(body, width, height, palette, 8 if bits == 6 else bits)


ONE: dict[str, Callable[[bytes], np.ndarray]] = {
    "hs2": lambda b: bilevel(b, 840, -(-len(b) // 105), 105, zero_is_white=False), "hr": lambda b: bilevel(b, 640, 240, zero_is_white=False), "vbm": vbm, "hpicn": hp_icon,
    "olpc565": lambda b: rgb565(b[8:], *struct.unpack_from("<HH", b, 4), big=False), "bob": bob, "iim": iim, "qdv": qdv, "animator_pic": animator, "xpuzzle": xpuzzle, "ybm": ybm, "deskmate_pnt": deskmate, "dgi": dgi,
    "crg": calamus, "lumena_cel": lumena, "mdesk_icn": desk_icon, "hsiraw": hsi_raw, "vitec": vitec, "lss16": lss16, "alias_pix": alias_pix, "pf_pgf": portfolio, "pgc": portfolio_packed,
    "indypaint": true_colour(4, 256), "ftc": lambda b: rgb565(b, 384, 240), "godpaint": true_colour(2, 6), "eggpaint": true_colour(4, 8), "coke": true_colour(12), "doodle": doodle, "falcon_xga": falcon_xga,
    "neochrome": neochrome, "spectrum512u": spectrum512, "fpaint_pi4": falcon8(320, 240), "fpaint_pi9": falcon8(320, 200), "atari_pi7": falcon8(640, 480), "prismpaint": prism_paint, "degas": degas,
    "megapaint_pat": mega_patterns, "bld": mega_blocks, "nlm": nokia_manager, "nol": nokia_text(10, 20), "ngg": nokia_text(6, 16), "npm": nokia_message, "msp": microsoft_paint, "tim": playstation, "xwd": x_window,
    "sgiimage": silicon_graphics, "jovianvi": jovian,
}
#: Formats whose blobs hold several images.
SEVERAL: dict[str, Callable[[bytes], Iterator[np.ndarray]]] = {"ripicon": rip_icons, "megapaint_lib": mega_symbols, "psionpic": psion}
