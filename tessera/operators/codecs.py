"""Decompressors of old formats, in plain Python and numpy.

Each takes the compressed bytes and gives a Decoded: what came out before any error, how many bytes
were taken, and the error if there was one. With a limit no more comes out, and that is no error;
without one LIMIT holds, as inputs are not trusted, and reaching it with input left is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.parts import column_of, struct_of

LIMIT = 1 << 28


@dataclass
class Decoded:
    data: bytes
    taken: int
    error: str | None = None


def bounded(decode: Callable[..., Decoded]) -> Callable[..., Decoded]:
    """decode(data, limit, ...) with LIMIT where none is given."""

    @wraps(decode)
    def within(data: bytes, limit: int | None = None, *args, **kwargs) -> Decoded:
        found = decode(data, LIMIT if limit is None else limit, *args, **kwargs)
        if limit is None and found.error is None and len(found.data) >= LIMIT and found.taken < len(data):
            found.error = f"more than {LIMIT} bytes"
        return found

    return within


class Bits:
    """A reader of bits, most or least significant first; zero bits follow the end."""

    def __init__(self, data: bytes, at: int = 0, high_first: bool = True):
        self.data, self.at, self.high, self.held, self.have = data, at, high_first, 0, 0

    def fill(self, n: int) -> None:
        """Holds n bits at least; bytes past the end are zero."""
        while self.have < n:
            part = self.data[self.at : self.at + 8].ljust(8, b"\0")
            self.held = self.held << 64 | int.from_bytes(part, "big") if self.high else self.held | int.from_bytes(part, "little") << self.have
            self.at, self.have = self.at + 8, self.have + 64

    def peek(self, n: int) -> int:
        if self.have < n:
            self.fill(n)
        return self.held >> self.have - n if self.high else self.held & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.have < n:
            self.fill(n)
        self.have -= n
        held = self.held
        if self.high:
            value = held >> self.have
            self.held = held - (value << self.have)
        else:
            value = held & (1 << n) - 1
            self.held = held >> n
        return value

    @property
    def place(self) -> int:
        """How many bytes have been begun."""
        return self.at - self.have // 8

    @property
    def over(self) -> bool:
        """Whether bits past the end have been taken."""
        return self.place > len(self.data)


#: Codes up to this length are looked up at once.
QUICK = 9


class Tree:
    """A prefix code by the lengths of its symbols (0: unused), codes in the order of length, then symbol."""

    def __init__(self, lengths: list[int]):
        self.codes: dict[tuple[int, int], int] = {}
        code = 0
        for size in range(1, max(lengths, default=0) + 1):
            for symbol, own in enumerate(lengths):
                if own == size:
                    self.codes[size, code] = symbol
                    code += 1
            code <<= 1
        self.longest = max(lengths, default=0)
        self.quick: dict[tuple[bool, int], list[tuple[int, int] | None]] = {}

    def lookup(self, high: bool, flip: int, most: int = QUICK) -> list[tuple[int, int] | None]:
        """Length and symbol of the code with which each most bits begin, in the order in which they are held."""
        out: list[tuple[int, int] | None] = [None] * (1 << most)
        for (size, code), symbol in self.codes.items():
            if size <= most:
                code ^= ((1 << size) - 1) * flip
                rest = most - size
                if high:
                    out[code << rest : code + 1 << rest] = [(size, symbol)] * (1 << rest)
                else:
                    turned = int(f"{code:0{size}b}"[::-1], 2)
                    out[turned :: 1 << size] = [(size, symbol)] * (1 << rest)
        return out

    def table(self, high: bool, flip: int = 0) -> list[tuple[int, int] | None]:
        """The lookup of QUICK bits, made once."""
        key = high, flip
        if key not in self.quick:
            self.quick[key] = self.lookup(high, flip)
        return self.quick[key]

    def read(self, bits: Bits, flip: int = 0) -> int:
        """The next symbol; flip 1: the bits of codes are stored inverted."""
        quick = self.quick.get((bits.high, flip)) or self.table(bits.high, flip)
        if bits.have < QUICK:
            bits.fill(QUICK)
        held = bits.held
        known = quick[held >> bits.have - QUICK if bits.high else held & (1 << QUICK) - 1]
        if known is not None:
            size, symbol = known
            bits.have -= size
            bits.held = held & (1 << bits.have) - 1 if bits.high else held >> size
            return symbol
        code = 0
        for size in range(1, self.longest + 1):
            code = code << 1 | bits.take(1) ^ flip
            found = self.codes.get((size, code))
            if found is not None:
                return found
        raise ValueError("no such code")


@lru_cache(64)
def tree_of(lengths: tuple[int, ...]) -> Tree:
    """The code of these lengths, which many blobs may share."""
    return Tree(list(lengths))


def copy_back(out: bytearray, distance: int, length: int) -> None:
    """Repeats what stands distance bytes back; what would lie before the start is zero."""
    if distance < 1:
        raise ValueError("bad distance")
    start = len(out) - distance
    if start < 0:
        gap = min(length, -start)
        out += bytes(gap)
        length -= gap
        start = len(out) - distance
    while length > 0:
        piece = out[start : start + length]
        out += piece
        length -= len(piece)


@bounded
def stored(data: bytes, limit: int) -> Decoded:
    return Decoded(data[:limit], min(len(data), limit))


@bounded
def inflate(data: bytes, limit: int, wbits: int = -15) -> Decoded:
    """Raw deflate; wbits 15 for zlib, 31 for gzip."""
    codec = zlib.decompressobj(wbits)
    try:
        out = codec.decompress(data, limit)
    except zlib.error as e:
        # what precedes the error comes out when the input is fed in small pieces
        codec, out = zlib.decompressobj(wbits), bytearray()
        for at in range(0, len(data), 64):
            try:
                out += codec.decompress(data[at : at + 64], limit - len(out) or 1)
            except zlib.error:
                break
        return Decoded(bytes(out), len(data), str(e))
    cut = f"more than {limit} bytes" if codec.unconsumed_tail else "unexpected end"
    return Decoded(out, len(data) - len(codec.unused_data) - len(codec.unconsumed_tail), None if codec.eof else cut)


@bounded
def packbits(data: bytes, limit: int, unit: int = 1) -> Decoded:
    """Runs of units: 0-127 copies n + 1 of them, 129-255 repeats the next one 257 - n times, 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 1 + (n + 1) * unit]
            at += 1 + (n + 1) * unit
        elif n > 128:
            out += data[at + 1 : at + 1 + unit] * (257 - n)
            at += 1 + unit
        else:
            at += 1
    return Decoded(bytes(out[:limit]), min(at, len(data)), "unexpected end" if at > len(data) else None)


@bounded
def rle90(data: bytes, limit: int) -> Decoded:
    """Byte 90 hexadecimal and n repeat the byte before so that n stand there; with n = 0 it stands for itself."""
    out, at, last = bytearray(), 0, 0
    while at < len(data) and len(out) < limit:
        if data[at] != 0x90:
            last = data[at]
            out.append(last)
            at += 1
            continue
        if at + 1 >= len(data):
            return Decoded(bytes(out), len(data), "unexpected end")
        n = data[at + 1]
        if n == 0:
            last = 0x90
            out.append(last)
        else:
            out += bytes([last]) * (n - 1)
        at += 2
    return Decoded(bytes(out[:limit]), at)


@bounded
def pcx_rle(data: bytes, limit: int) -> Decoded:
    """Bytes from C0 hexadecimal repeat the next byte by their lower six bits."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        if data[at] >= 0xC0:
            out += data[at + 1 : at + 2] * (data[at] & 0x3F)
            at += 2
        else:
            out.append(data[at])
            at += 1
    return Decoded(bytes(out[:limit]), min(at, len(data)))


#: Each byte as bytes.
SINGLES = [bytes([b]) for b in range(256)]


@bounded
def lzw(data: bytes, limit: int, variant: str = "compress", root: int = 8, most: int | None = None, blocks: bool = True) -> Decoded:
    """LZW of three kinds.

    compress: codes from 9 to most bits (16), least significant bit first, in groups of eight codes of a
    size, with a clear code 256 if blocks. gif: from root + 1 to 12 bits, with clear and stop codes.
    tiff: most significant bit first, sizes change one code early.
    """
    high = variant == "tiff"
    most = most or (16 if variant == "compress" else 12)
    clear = 1 << root if variant != "compress" or blocks else -1
    stop = clear + 1 if variant != "compress" else -1
    first = (1 << root) + (2 if variant != "compress" else 1 if blocks else 0)
    # the strings of all codes; None: a code for the decoder itself, or one that is no byte
    begin: list[bytes | None] = [*SINGLES[: 1 << root], *[None] * (first - min(1 << root, 256))]
    strings, last, full = begin.copy(), None, 1 << most
    size, in_group, out, end = root + 1, 0, bytearray(), len(data)
    at, held, have = 0, 0, 0
    while len(out) < limit:
        if have < size:
            part = data[at : at + 8].ljust(8, b"\0")
            held = held << 64 | int.from_bytes(part, "big") if high else held | int.from_bytes(part, "little") << have
            at, have = at + 8, have + 64
        have -= size
        if high:
            code = held >> have
            held -= code << have
        else:
            code = held & (1 << size) - 1
            held >>= size
        in_group += 1
        if code == stop or at - have // 8 > end:
            break
        n, resized = len(strings), False
        if code == clear:
            strings, last, resized = begin.copy(), None, True
        else:
            if code < n:
                entry = strings[code]
                if entry is None:
                    raise ValueError(f"code {code} is no byte")
            elif code == n and last is not None:
                entry = last + last[:1]
            else:
                return Decoded(bytes(out), min(at - have // 8, end), f"bad code {code}")
            out += entry
            if last is not None and n < full:
                strings.append(last + entry[:1])
                n += 1
            last = entry
            resized = size < most and n + high >= 1 << size
        if resized:
            if variant == "compress" and in_group % 8:  # codes of a size come in groups of eight
                skip = (8 - in_group % 8) * size
                while have < skip:
                    held |= int.from_bytes(data[at : at + 8], "little") << have
                    at, have = at + 8, have + 64
                held >>= skip
                have -= skip
            in_group, size = 0, root + 1 if code == clear else size + 1
    return Decoded(bytes(out[:limit]), min(at - have // 8, end))


@bounded
def lzss(data: bytes, limit: int, start: int = 4078, fill: int = 0x20) -> Decoded:
    """Flag bytes, lowest bit first: 1 is a literal, 0 a place (12 bits) and length (4 bits, from 3) in a ring of 4096 that starts full of one byte."""
    out, at, end = bytearray([fill]) * 4096, 0, len(data)  # what the ring holds at first precedes the data
    most, append = limit + 4096, out.append
    while at < end and len(out) < most:
        flags = data[at]
        at += 1
        if flags == 0xFF and at + 8 <= end and len(out) + 8 <= most:
            out += data[at : at + 8]
            at += 8
            continue
        for bit in range(8):
            if at >= end or len(out) >= most:
                break
            if flags >> bit & 1:
                append(data[at])
                at += 1
                continue
            if at + 1 >= end:
                return Decoded(bytes(out[4096:]), end, "unexpected end")
            pair, here = data[at + 1], len(out)
            distance, length = (start + here - (data[at] | (pair & 0xF0) << 4) - 1) % 4096 + 1, (pair & 0x0F) + 3
            at += 2
            if length <= distance:
                out += out[here - distance : here - distance + length]
            else:  # the piece runs into what it writes
                copy_back(out, distance, length)
    return Decoded(bytes(out[4096:most]), at)


@bounded
def szdd(data: bytes, limit: int) -> Decoded:
    return lzss(data, limit, start=4080)


@bounded
def hlp_lz77(data: bytes, limit: int) -> Decoded:
    """Flag bytes, lowest bit first: 0 is a literal, 1 a 16-bit number of distance - 1 (12 bits) and length - 3."""
    at, out, end = 0, bytearray(), len(data)
    append = out.append
    while at < end and len(out) < limit:
        flags = data[at]
        at += 1
        if not flags:
            out += data[at : at + 8]
            at = min(at + 8, end)
            continue
        for bit in range(8):
            if at >= end:
                break
            if not flags >> bit & 1:
                append(data[at])
                at += 1
                continue
            if at + 1 >= end:
                return Decoded(bytes(out), end, "unexpected end")
            pair = data[at] | data[at + 1] << 8
            at += 2
            distance, length = (pair & 0xFFF) + 1, (pair >> 12) + 3
            from_ = len(out) - distance
            if from_ >= 0 and length <= distance:
                out += out[from_ : from_ + length]
            else:
                copy_back(out, distance, length)
    return Decoded(bytes(out[:limit]), at)


@bounded
def lzs(data: bytes, limit: int) -> Decoded:
    """Stac LZS: literals, and copies with distances of 7 or 11 bits and lengths in growing steps; distance 0 of 7 bits ends."""
    bits, out = Bits(data), bytearray()
    while len(out) < limit and not bits.over:
        if not bits.take(1):
            byte = bits.take(8)
            if bits.over:
                break
            out.append(byte)
            continue
        distance = bits.take(7) if bits.take(1) else bits.take(11) + (1 << 31)
        if distance == 0:
            return Decoded(bytes(out), min(bits.place, len(data)))
        distance &= (1 << 31) - 1
        if not distance:
            return Decoded(bytes(out), min(bits.place, len(data)), "bad distance")
        length = 2 + bits.take(2)
        if length == 5:
            length += bits.take(2)
            if length == 8:
                while (more := bits.take(4)) == 15 and not bits.over:
                    length += 15
                length += more
        if bits.over:
            break
        copy_back(out, distance, length)
    return Decoded(bytes(out[:limit]), len(data), "unexpected end")


def lh_lengths(bits: Bits, width: int, special: int) -> Tree | int:
    """Lengths of a small code: 3 bits each, 7 and above in ones; after the place special, two bits of zeros to skip. Of no symbols: the only one."""
    n = bits.take(width)
    if n == 0:
        return bits.take(width)
    lengths: list[int] = []
    while len(lengths) < n:
        own = bits.take(3)
        if own == 7:
            while bits.take(1) and own < 32:
                own += 1
        lengths.append(own)
        if len(lengths) == special:
            lengths += [0] * bits.take(2)
    return tree_of(tuple(lengths))


def lh_block(bits: Bits, out: bytearray, left: int, limit: int, codes: Tree | int, places: Tree | int) -> None:
    """Appends the next left symbols, held here in variables; codes longer than QUICK are read by their trees."""
    data, end, at, held, have = bits.data, len(bits.data), bits.at, bits.held, bits.have
    quick, near = (t.table(True) if isinstance(t, Tree) else None for t in (codes, places))
    top = (1 << QUICK) - 1
    append = out.append
    while left and len(out) < limit and (at <= end or at - have // 8 <= end):
        left -= 1
        if have < 64:
            held, have = (held & (1 << have) - 1) << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big"), have + 64
            at += 8
        if quick is None:
            code = codes
        elif (known := quick[held >> have - QUICK & top]) is not None:
            have -= known[0]
            code = known[1]
        else:
            bits.at, bits.held, bits.have = at, held & (1 << have) - 1, have
            code = codes.read(bits)
            at, held, have = bits.at, bits.held, bits.have
        if code < 256:
            append(code)
            continue
        if near is None:
            place = places
        elif (known := near[held >> have - QUICK & top]) is not None:
            have -= known[0]
            place = known[1]
        else:
            bits.at, bits.held, bits.have = at, held & (1 << have) - 1, have
            place = places.read(bits)
            at, held, have = bits.at, bits.held, bits.have
        if place < 2:
            distance = place + 1
        else:
            have -= place - 1
            distance = (1 << place - 1) + (held >> have & (1 << place - 1) - 1) + 1
        length, start = code - 253, len(out) - distance
        if start >= 0 and length <= distance:
            out += out[start : start + length]
        else:
            copy_back(out, distance, length)
    bits.at, bits.held, bits.have = at, held & (1 << have) - 1, have


def lh_new(data: bytes, limit: int, window: int) -> Decoded:
    """LHA's static Huffman codes over LZ77 (methods 5 to 7); window: bits of the largest distance. Ends at limit bytes."""
    width = 4 if window <= 13 else 5
    bits, out = Bits(data), bytearray()
    read = lambda tree: tree if isinstance(tree, int) else tree.read(bits)
    try:
        while len(out) < limit and not bits.over:
            left = bits.take(16)
            small = lh_lengths(bits, 5, 3)
            n = bits.take(9)
            if n == 0:
                codes: Tree | int = bits.take(9)
            else:
                lengths: list[int] = []
                while len(lengths) < n and not bits.over:
                    own = read(small)
                    lengths += [0] * (1 if own == 0 else bits.take(4) + 3 if own == 1 else bits.take(9) + 20) if own <= 2 else [own - 2]
                codes = tree_of(tuple(lengths))
            places = lh_lengths(bits, width, -1)
            lh_block(bits, out, left, limit, codes, places)
    except ValueError as e:
        return Decoded(bytes(out), min(bits.place, len(data)), str(e))
    return Decoded(bytes(out[:limit]), min(bits.place, len(data)), "unexpected end" if len(out) < limit and limit < LIMIT else None)


@bounded
def lh5(data: bytes, limit: int) -> Decoded:
    return lh_new(data, limit, 13)


@bounded
def lh6(data: bytes, limit: int) -> Decoded:
    return lh_new(data, limit, 15)


@bounded
def lh7(data: bytes, limit: int) -> Decoded:
    return lh_new(data, limit, 16)


@bounded
def squeeze(data: bytes, limit: int) -> Decoded:
    """A static Huffman tree of 16-bit node pairs (negative: a byte, -257: the end), read from the root by bits, lowest first; then RLE90."""
    nodes = int.from_bytes(data[:2], "little")
    if nodes == 0 or nodes > 257 or len(data) < 2 + 4 * nodes:
        return Decoded(b"", min(2, len(data)), None if nodes == 0 else "bad tree")
    tree = [[int.from_bytes(data[2 + 4 * i + 2 * k : 4 + 4 * i + 2 * k], "little", signed=True) for k in (0, 1)] for i in range(nodes)]
    bits, out = Bits(data, 2 + 4 * nodes, False), bytearray()
    while len(out) < limit and not bits.over:
        at = 0
        while at >= 0:
            at = tree[at][bits.take(1)]
            if at >= nodes or bits.over:
                return Decoded(rle90(bytes(out), limit).data, len(data), "unexpected end")
        if at == -257:
            break
        out.append(-(at + 1) & 0xFF)
    return Decoded(rle90(bytes(out), limit).data, min(bits.place, len(data)))


def code_lengths(runs: str) -> list[int]:
    """Code lengths from text: "5" or, for several symbols in a row, "5x12"."""
    out: list[int] = []
    for part in runs.split():
        size, _, times = part.partition("x")
        out += [int(size)] * int(times or 1)
    return out


# Fixed values of PKWARE's data compression library: code lengths of literals, lengths and distances; bases and extra bits of lengths.
DCL_LITERALS = code_lengths("""
    11 12x8 8 7 12x2 7 12x12 13 12x5 4 10 8 12 10 12 10 8 7x2 8 9 7 6 7 8 7 6 7x4 8 7x2 8x2 12 11 7 9 11 12 6 7 6x2 5 7 8x2 6 11 9 6 7 6x2 7 11 6x3 7 9 8 9x2 11 8 11 9 12
    8 12 5 6x3 5 6x3 5 11 7 5 6 5x2 6 10 5x4 8 7 8x2 10 11x2 12x3 13x16 13x16 13x16 12x16 12x16 12x16 13 12 13x3 12 13x3 12 13x4 12 13x3 12x3 13x11
""")
DCL_LENGTHS = code_lengths("2 3x3 4x3 5x4 6x3 7x2")
DCL_DISTANCES = code_lengths("2 4x2 5x4 6x15 7x26 8x16")
DCL_BASES = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
DCL_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)


@bounded
def implode_dcl(data: bytes, limit: int) -> Decoded:
    """PKWARE's data compression library, with plain or coded literals; code bits are stored inverted."""
    if len(data) < 2 or data[0] > 1 or not 4 <= data[1] <= 6:
        return Decoded(b"", 0, "bad header")
    literals, lengths, distances = dcl_tables()
    coded, wide, end = data[0], data[1], len(data)
    at, held, have, out = 2, 0, 0, bytearray()
    append = out.append
    while len(out) < limit and (at <= end or at - have // 8 <= end):
        if have < 32:  # a copy takes 30 bits at most
            held |= int.from_bytes(data[at : at + 4], "little") << have
            at, have = at + 4, have + 32
        if not held & 1:
            size, symbol = literals[held >> 1 & 0x1FFF] if coded else (8, held >> 1 & 255)
            append(symbol)
            held >>= size + 1
            have -= size + 1
            continue
        size, symbol = lengths[held >> 1 & 127]
        held >>= size + 1
        extra = DCL_EXTRA[symbol]
        length = DCL_BASES[symbol] + (held & (1 << extra) - 1)
        held >>= extra
        have -= size + 1 + extra
        if length == 519:
            return Decoded(bytes(out), min(at - have // 8, end))
        low = 2 if length == 2 else wide
        size, symbol = distances[held & 255]
        held >>= size
        distance = (symbol << low) + (held & (1 << low) - 1) + 1
        held >>= low
        have -= size + low
        start = len(out) - distance
        if start >= 0 and length <= distance:
            out += out[start : start + length]
        else:
            copy_back(out, distance, length)
    return Decoded(bytes(out[:limit]), end, "unexpected end" if at - have // 8 > end else None)


@lru_cache
def dcl_tables() -> tuple[list[tuple[int, int]], ...]:
    """Lookups of literals, lengths and distances by as many bits as the longest code has; all codes are in use."""
    return tuple(Tree(x).lookup(False, 1, max(x)) for x in (DCL_LITERALS, DCL_LENGTHS, DCL_DISTANCES))


#: Method names of decompress().
METHODS: dict[str, Callable[..., Decoded]] = {
    "stored": stored, "deflate": inflate, "zlib": lambda d, limit=None: inflate(d, limit, 15), "gzip": lambda d, limit=None: inflate(d, limit, 31),
    "packbits": packbits, "packbits16": lambda d, limit=None: packbits(d, limit, 2), "rle90": rle90, "pcx_rle": pcx_rle,
    "lzw": lzw, "lzw_gif": lambda d, limit=None: lzw(d, limit, "gif"), "lzw_tiff": lambda d, limit=None: lzw(d, limit, "tiff"), "lzw_zoo": lambda d, limit=None: lzw(d, limit, "zoo", most=13),
    "lzss": lzss, "szdd": szdd, "hlp_lz77": hlp_lz77, "lzs": lzs, "lh5": lh5, "lh6": lh6, "lh7": lh7, "squeeze": squeeze, "implode_dcl": implode_dcl,
}


def _more_methods() -> dict[str, Callable[..., Decoded]]:
    """Those of modules that build on this one."""
    from tessera.operators import adaptive, zip_codecs

    return {
        "lh1": adaptive.lh1, "shrink": zip_codecs.shrink, **{f"reduce{k}": lambda d, limit=None, k=k: zip_codecs.reduce(d, limit, k) for k in (1, 2, 3, 4)}, "implode": zip_codecs.implode,
        "deflate64": zip_codecs.deflate64,
    }


def decompress(content: Column | str, method: str, size: Column | int | None = None) -> Column:
    """A struct of data, taken, ok and err: what the method makes of each blob, at most size bytes (without it, LIMIT, where more is an error). Nulls stay null."""
    work = METHODS[method] if method in METHODS else _more_methods()[method]

    def each(blob: bytes | None, limit: int | None) -> tuple[tuple, int]:
        d = work(blob or b"", limit)
        return (d.data, d.taken, d.error is None, d.error), len(d.data)

    build = struct_of([("data", pa.binary()), ("taken", pa.int64()), ("ok", pa.bool_()), ("err", pa.string())])
    limit = F.lit(size) if size is None or isinstance(size, int) else size
    return F.when(F.col(content).isNotNull() if isinstance(content, str) else content.isNotNull(), column_of(each, build, "struct<data: binary, taken: long, ok: boolean, err: string>", content, limit.cast("long")))
