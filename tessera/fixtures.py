"""Encoders that make the compressed blobs which queries and tests decode again.

They are small and greedy; what matters is that every kind of code occurs: literals, runs, copies, changes of width.
"""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np

from tessera.functions.checksums import crc16_arc
from tessera.operators import codecs


class Writer:
    """Bits written lowest or highest first."""

    def __init__(self, high_first: bool = False):
        self.high, self.value, self.size, self.out = high_first, 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        if self.high:
            self.value, self.size = self.value << n | value, self.size + n
            while self.size >= 8:
                self.size -= 8
                self.out.append(self.value >> self.size & 255)
            self.value &= (1 << self.size) - 1
        else:
            self.value, self.size = self.value | value << self.size, self.size + n
            while self.size >= 8:
                self.out.append(self.value & 255)
                self.value, self.size = self.value >> 8, self.size - 8

    def code(self, code: tuple[int, int], flip: int = 0) -> None:
        """A prefix code (length, bits), its highest bit first."""
        size, bits = code
        for i in reversed(range(size)):
            self.put(bits >> i & 1 ^ flip, 1)

    def bytes(self) -> bytes:
        if self.size:
            self.put(0, 8 - self.size % 8)
        return bytes(self.out)


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """For each symbol, the length and bits of its code, as the decoder's tree assigns them."""
    return {symbol: code for code, symbol in codecs.Tree(lengths).codes.items()}


def digits(value: int, n: int, high_first: bool = False) -> str:
    """The n bits of a value in the order in which they are written."""
    if not n:
        return ""
    found = f"{value:0{n}b}"
    return found if high_first else found[::-1]


def joined(parts: list[str], high_first: bool = False) -> bytes:
    """Bits that parts tell in the order in which they are written, zero-filled to whole bytes."""
    bits = "".join(parts)
    n = -(-len(bits) // 8)
    if not n:
        return b""
    return int(bits.ljust(8 * n, "0"), 2).to_bytes(n, "big") if high_first else int(bits[::-1], 2).to_bytes(n, "little")


@lru_cache
def code_digits(lengths: tuple[int, ...], flip: int = 0) -> dict[int, str]:
    """For each symbol, the bits of its code, highest first."""
    return {symbol: digits(bits ^ ((1 << size) - 1) * flip, size, True) for symbol, (size, bits) in codes_of(list(lengths)).items()}


def copies(data: bytes, window: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """Copies (place, distance, length) of which, with the bytes between them, data is made up, greedily by the last place of each three bytes."""
    return list(map(tuple, copy_rows(data, window, least, most).tolist()))


def copy_rows(data: bytes, window: int, least: int, most: int) -> np.ndarray:
    """The copies as rows of an array. Up to eleven equal bytes are counted at all places at once, more of them where a copy is made."""
    size = len(data)
    if size < 4:
        return np.zeros((0, 3), np.int64)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    keys = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) << 32 | np.arange(size - 2)
    keys.sort()
    same, at = keys[1:] >> 32 == keys[:-1] >> 32, keys & 0xFFFFFFFF
    before = np.full(size - 2, -1)
    before[at[1:][same]] = at[:-1][same]
    at = np.flatnonzero((before >= 0) & (np.arange(size - 2) - before <= window))
    found = before[at]
    eights = np.ndarray(size + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each on
    differ = eights[at + 3] ^ eights[found + 3]
    equal = np.frexp((differ & ~differ + np.uint64(1)).astype(np.float64))[1] - 1 >> 3  # by the lowest bit that differs
    n = np.minimum(np.where(differ == 0, 11, 3 + equal), np.minimum(most, size - at))
    on = (differ == 0) & (n == 11)
    kept = (n >= least) | on
    at, found, n, on = at[kept], found[kept], n[kept], on[kept]
    here = np.zeros(size + 1, np.int64)
    here[at + 1] = 1
    index = np.cumsum(here)  # of the first copy from each place on
    after = index[at + n]
    after[on] = -1
    steps, taken, i, total = memoryview(after), [], 0, len(at)
    while i < total:
        following = steps[i]
        if following < 0:
            place, source, equal = int(at[i]), int(found[i]), 11
            last = min(most, size - place)
            while equal < last and data[source + equal] == data[place + equal]:
                equal += 1
                if equal == 16:
                    while equal + 64 <= last and data[source + equal : source + equal + 64] == data[place + equal : place + equal + 64]:
                        equal += 64
            if equal < least:
                i += 1
                continue
            n[i] = equal
            following = int(index[place + equal])
        taken.append(i)
        i = following
    at, found, n = at[taken], found[taken], n[taken]
    return np.stack([at, at - found, n], 1)


def tokens(data: bytes, found: list[tuple[int, int, int]], literals: Sequence, copy: Callable[[int, int], object]) -> list:
    """What stands for each byte between copies, and copy(distance, length) for each of these."""
    out, last = [], 0
    for at, distance, length in found:
        if at > last:
            out.extend(map(literals.__getitem__, data[last:at]))
        out.append(copy(distance, length))
        last = at + length
    out.extend(map(literals.__getitem__, data[last:]))
    return out


def stretched(data: bytes) -> bytes:
    """data with each byte repeated by its value: once to five times."""
    return np.repeat(np.frombuffer(data, np.uint8), np.frombuffer(data, np.uint8) % 5 + 1).tobytes()


def as_zip(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body, how in (("text.txt", data, zipfile.ZIP_DEFLATED), ("head.bin", data[:100], zipfile.ZIP_STORED)):
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), body, how)
    return out.getvalue()


def as_tar(data: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, body in (("a/text.txt", data), ("b" * 120, data[:100])):
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(body), 981_173_106
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def as_bmp(data: bytes) -> bytes:
    """A 24-bit image of all of data (zero-filled), 16 pixels wide and at least one row high."""
    rows = max(1, -(-len(data) // 48))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 48 * rows, 0, 54, 40, 16, -rows, 1, 24, 0, 48 * rows, 0, 0, 0, 0) + data.ljust(48 * rows, b"\0")


#: Runs of equal bytes, each at least two long.
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def as_packbits(data: bytes) -> bytes:
    out, plain, last = [], [], 0

    def flush() -> None:
        raw = b"".join(plain)
        plain.clear()
        for i in range(0, len(raw), 128):
            part = raw[i : i + 128]
            out.append(SINGLE[len(part) - 1] + part)

    for run in RUNS.finditer(data):
        start, end = run.span()
        n = end - start
        if n < 3:
            continue
        plain.append(data[last:start])
        flush()
        value = run[1]
        while n >= 3:
            out.append(SINGLE[257 - min(n, 128)] + value)
            n -= min(n, 128)
        last = end - n
    plain.append(data[last:])
    flush()
    return b"".join(out)


def as_rle90(data: bytes) -> bytes:
    """Runs of more than three bytes as one and a count."""

    def run(found: re.Match) -> bytes:
        value, n, out = found[1], found.end() - found.start(), b""
        one = b"\x90\0" if value == b"\x90" else value
        while n:
            part = min(n, 255)
            out += one + (b"\x90" + SINGLE[part] if part > 3 else one * (part - 1))
            n -= part
        return out

    return re.sub(rb"(.)\1{3,}|(\x90)", lambda found: run(found) if found[1] is not None else b"\x90\0", data, flags=re.DOTALL)


#: Numbers of up to eight bits, lowest bit first, by their size.
LOW_BITS = [[digits(value, n) for value in range(1 << n)] for n in range(9)]
#: Each byte as bytes.
SINGLE = [bytes([b]) for b in range(256)]


def flagged(data: bytes, found: np.ndarray, pairs: np.ndarray, literal: int) -> bytes:
    """The bytes between copies, and pairs (16 bits, least byte first) for these, in groups of eight after a byte that tells, lowest bit first, which are single bytes (bits literal)."""
    raw, at = np.frombuffer(data, np.uint8), found[:, 0]
    starts = token_starts(len(raw), at, found[:, 2])
    copied = np.zeros(len(raw), bool)
    copied[at] = True
    copied = copied[starts]
    sizes = copied + 1
    sizes[::8] += 1  # the byte before each group
    places = np.cumsum(sizes) - 1  # of each last byte
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[places] = raw[starts]
    out[places[copied]] = pairs >> 8
    out[places[copied] - 1] = pairs & 255
    firsts = places[::8] - 1 - copied[::8]
    out[firsts] = np.packbits(copied != literal, bitorder="little")
    if literal:  # bits after the last item are not set
        out[firsts[-1:]] &= (1 << (len(starts) - 1) % 8 + 1) - 1
    return out.tobytes()


def as_lzss(data: bytes, start: int = 4078) -> bytes:
    """Copies name places in the ring, where byte i of the data lies at start + i."""
    found = copy_rows(data, 4000, 3, 18)
    at, distance, length = found.T
    place = (start + at - distance) % 4096
    return flagged(data, found, place & 255 | (place >> 4 & 0xF0 | length - 3) << 8, 1)


def as_hlp_lz77(data: bytes) -> bytes:
    found = copy_rows(data, 4096, 3, 18)
    _, distance, length = found.T
    return flagged(data, found, distance - 1 | length - 3 << 12, 0)


def as_lzw(data: bytes, variant: str = "compress", root: int = 8, most: int | None = None) -> bytes:
    """Greedy phrases; codes have the widths that each variant's decoder expects."""
    high, most = variant == "tiff", most or (16 if variant == "compress" else 13 if variant == "zoo" else 12)
    ends, clear = variant != "compress", 1 << root
    first = clear + (2 if ends else 1)
    table: dict[int, int] = {}  # a phrase's code and the next byte: the code of both
    codes: list[int] = []
    free, full, get, phrase = first, 1 << most, table.get, -1
    for b in data:
        if phrase < 0:
            phrase = b
            continue
        more = phrase << 8 | b
        code = get(more)
        if code is not None:
            phrase = code
            continue
        codes.append(phrase)
        if free < full:
            table[more] = free
            free += 1
        phrase = b
    if phrase >= 0:
        codes.append(phrase)
    # codes grow by a bit each time that the decoder's next code asks for it
    bits, size, at = [binary([clear], root + 1, high)] if ends else [], root + 1, 0
    while size < most and len(codes) > (last := (1 << size) - first - high):
        bits.append(binary(codes[at : last + 1], size, high))
        if variant == "compress":  # in groups of eight
            bits.append(np.zeros((at - last - 1) % 8 * size, np.uint8))
        at, size = last + 1, size + 1
    bits.append(binary(codes[at:] + [clear + 1] * ends, size, high))
    return np.packbits(np.concatenate(bits), bitorder="big" if high else "little").tobytes()


def binary(values: list[int], n: int, high_first: bool) -> np.ndarray:
    """The n bits of each value, a byte each, in the order in which they are written."""
    shifts = np.arange(n, dtype=np.int32)
    return (np.array(values, np.int32)[:, None] >> (shifts[::-1] if high_first else shifts) & 1).astype(np.uint8).ravel()


def as_shrink(data: bytes) -> bytes:
    """LZW that frees the strings with which no other begins each time that the table is full."""
    out, size, table, phrase = Writer(), 9, {bytes([i]): i for i in range(256)}, b""
    made: dict[int, tuple[int, bytes]] = {}  # code: that of its beginning, and its string
    free = 257

    def emit(code: int) -> None:
        nonlocal size
        while code >> size:
            out.put(256, size)
            out.put(1, size)
            size += 1
        out.put(code, size)

    for i in range(len(data)):
        more = phrase + data[i : i + 1]
        if more in table:
            phrase = more
            continue
        code = table[phrase]
        emit(code)
        while free < 8192 and free in made:
            free += 1
        if free < 8192:
            table[more], made[free] = free, (code, more)
        else:
            out.put(256, size)
            out.put(2, size)
            begun = {before for before, _ in made.values()}
            for old in [c for c in made if c not in begun]:
                table.pop(made.pop(old)[1], None)
            free = min(c for c in range(257, 8192) if c not in made)
            made[free] = (code, b"")  # the decoder makes this string, too; its beginning may be gone, so it is not used
        phrase = data[i : i + 1]
    if phrase:
        emit(table[phrase])
    return out.bytes()


def as_reduced(data: bytes, factor: int = 1) -> bytes:
    """Copies first, then bytes by the sets of the most frequent followers of each byte."""
    longest, shift = (1 << 8 - factor) - 1, 8 - factor
    single = SINGLE[:144] + [b"\x90\0"] + SINGLE[145:]
    plain, last = bytearray(), 0
    for at, distance, length in copies(data, 256 << factor, 4, longest + 255):
        n, far = length - 3, distance - 1
        value = far >> 8 << shift | min(n, longest)
        if value:
            plain += data[last:at].replace(b"\x90", single[144])
            plain += bytes([144, value]) + (bytes([n - longest]) if n >= longest else b"") + bytes([far & 255])
            last = at + length
    plain += data[last:].replace(b"\x90", single[144])
    raw = np.frombuffer(bytes(plain), np.uint8).astype(np.int64)
    pairs = np.concatenate([np.zeros(min(1, len(raw)), np.int64), raw[:-1]]) << 8 | raw
    counts = np.bincount(pairs, minlength=1 << 16)
    kinds = np.flatnonzero(counts)
    index = np.zeros(1 << 16, np.int64)
    index[pairs[::-1]] = np.arange(len(pairs))[::-1]  # of each pair, its first place
    order = np.lexsort((index[kinds], -counts[kinds], kinds >> 8))  # the most frequent first, then the earliest
    index[kinds] = np.arange(len(kinds))
    places = index[pairs]
    sets: list[list[int]] = [[] for _ in range(256)]
    ranks = [-1] * len(kinds)
    for k, before, b in zip(order.tolist(), (kinds[order] >> 8).tolist(), (kinds[order] & 255).tolist(), strict=True):
        known = sets[before]
        if len(known) < 32:
            ranks[k] = len(known)
            known.append(b)
    sizes = [max(1, (len(known) - 1).bit_length()) for known in sets]
    codes = ["0" + LOW_BITS[sizes[kind >> 8]][rank] if rank >= 0 else "1" + LOW_BITS[8][kind & 255] for kind, rank in zip(kinds.tolist(), ranks, strict=True)]
    head = [LOW_BITS[6][len(known)] + "".join(map(LOW_BITS[8].__getitem__, known)) for known in reversed(sets)]
    return joined(head + list(map(codes.__getitem__, places.tolist())))


def as_imploded(data: bytes, wide: bool = False, coded: bool = False) -> bytes:
    runs = lambda size, n: bytes([n // 16 - 1]) + bytes([0xF0 | size - 1]) * (n // 16)
    literals, places = code_digits((8,) * 256, 1), code_digits((6,) * 64, 1)
    head = (runs(8, 256) if coded else b"") + runs(6, 64) * 2
    low, least = 7 if wide else 6, 3 if coded else 2

    def copy(distance: int, length: int) -> str:
        n = length - least
        return "0" + digits(distance - 1 & (1 << low) - 1, low) + places[distance - 1 >> low] + places[min(n, 63)] + (digits(n - 63, 8) if n >= 63 else "")

    return head + joined(tokens(data, copies(data, 64 << low, 3, 63 + 255 + least), ["1" + (literals[b] if coded else digits(b, 8)) for b in range(256)], copy))


def as_dcl(data: bytes, coded: bool = False, low: int = 6) -> bytes:
    literals, lengths, places = dcl_digits(coded, low)
    return bytes([coded, low]) + joined([*tokens(data, copies(data, 64 << low, 3, 518), literals, lambda distance, length: lengths[length] + places[distance]), lengths[519]])


@lru_cache
def dcl_digits(coded: bool, low: int) -> tuple[list[str], list[str], list[str]]:
    """The bits of each literal, of each length from 2 and of each distance from 1."""
    sizes, places = code_digits(tuple(codecs.DCL_LENGTHS), 1), code_digits(tuple(codecs.DCL_DISTANCES), 1)
    literals = code_digits(tuple(codecs.DCL_LITERALS), 1) if coded else {b: digits(b, 8) for b in range(256)}
    lengths = [""] * 520
    for symbol, (base, extra) in enumerate(zip(codecs.DCL_BASES, codecs.DCL_EXTRA, strict=True)):
        for k in range(1 << extra):
            lengths[base + k] = "1" + sizes[symbol] + digits(k, extra)
    return ["0" + literals[b] for b in range(256)], lengths, ["", *(places[d >> low] + digits(d & (1 << low) - 1, low) for d in range(64 << low))]


def as_deflate64(data: bytes) -> bytes:
    """One block of the fixed code, with long copies from up to 64 KiB back."""
    from tessera.operators.zip_codecs import _steps

    symbols, places = code_digits((8,) * 144 + (9,) * 112 + (7,) * 24 + (8,) * 8), code_digits((5,) * 32)
    lengths, distances = [*_steps(3, 28, 4), (3, 16)], _steps(1, 32, 2)
    bases, starts = [base for base, _ in lengths[:28]], [base for base, _ in distances]

    def copy(distance: int, length: int) -> str:
        k = 28 if length > 257 else bisect_right(bases, length) - 1
        i = bisect_right(starts, distance) - 1
        return symbols[257 + k] + digits(length - lengths[k][0], lengths[k][1]) + places[i] + digits(distance - starts[i], distances[i][1])

    return joined(["110", *tokens(data, copies(data, 65_536, 3, 65_538), symbols, copy), symbols[256]])


def as_lh(data: bytes, window: int = 13) -> bytes:
    """LHA's static codes, all symbols of equal length, in blocks of 30,000 symbols."""
    width, n_places = (4, 14) if window <= 13 else (5, 16 if window == 15 else 17)
    size = 5 if n_places > 16 else 4
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    at, distance, length = copy_rows(data, 1 << window, 3, 256).T
    values, sizes = raw.copy(), np.full(len(raw), 9)  # of the token that begins at each byte; codes of equal lengths are numbers
    far = distance - 1
    bits = np.searchsorted(1 << np.arange(window + 1), far, "right")
    extra = np.maximum(bits - 1, 0)
    values[at] = (length + 253 << size | bits) << extra | far & (1 << extra) - 1
    sizes[at] += size + extra
    starts = token_starts(len(raw), at, length)
    values, sizes = values[starts], sizes[starts]

    # a block: how many symbols; the only length of codes; the lengths of places
    head, out = [(0, 5), (9 + 2, 5), (510, 9), (n_places, width), *[(size, 3)] * n_places], []
    for start in range(0, len(values), 30_000):
        block = values[start : start + 30_000]
        known = np.array([(len(block), 16), *head])
        out.append((np.append(known[:, 0], block), np.append(known[:, 1], sizes[start : start + 30_000])))
    return packed(*map(np.concatenate, zip(*out, strict=True))) if out else b""


def token_starts(size: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where copies and the single bytes between them begin."""
    inside = np.zeros(size + 1, np.int8)  # 1 at the second byte of a copy, -1 after its last one
    inside[at + 1] = 1
    inside[at + length] -= 1
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, each in so many bits, highest first, zero-filled to whole bytes."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    spread = values << 40 - (firsts & 7) - sizes  # over five bytes
    n = int(ends[-1]) + 7 >> 3
    out = sum(np.bincount((firsts >> 3) + k, spread >> 32 - 8 * k & 255, n + 5) for k in range(5))
    return out[:n].astype(np.uint8).tobytes()


def as_lh1(data: bytes) -> bytes:
    from tessera.operators.adaptive import PLACES, AdaptiveTree

    tree, places = AdaptiveTree(), code_digits(tuple(PLACES))
    out = []
    for symbol in tokens(data, copies(data, 4096, 3, 60), range(256), lambda distance, length: (length + 253, distance - 1)):
        far = None
        if isinstance(symbol, tuple):
            symbol, far = symbol
        out.append(tree.code(symbol))
        tree.use(symbol)
        if far is not None:
            out.append(places[far >> 6] + digits(far & 63, 6, True))
    return joined(out, True)


#: ZIP's methods by number: encoder and the flags that tell the decoder how.
ZIP_ENCODERS = {
    0: (lambda d: d, 0), 1: (as_shrink, 0), 2: (lambda d: as_reduced(d, 1), 0), 3: (lambda d: as_reduced(d, 2), 0), 4: (lambda d: as_reduced(d, 3), 0), 5: (lambda d: as_reduced(d, 4), 0),
    6: (lambda d: as_imploded(d, True, True), 6), 9: (as_deflate64, 0), 10: (as_dcl, 0),
}


def zip_of(members: list[tuple[str, int, bytes, bytes, int]]) -> bytes:
    """A ZIP file of (name, method, coded bytes, plain bytes, flags)."""
    out, directory = bytearray(), bytearray()
    for name, method, coded, plain, flags in members:
        sizes = struct.pack("<III", zlib.crc32(plain), len(coded), len(plain))
        place = len(out)
        out += b"PK\3\4" + struct.pack("<HHHHH", 20, flags, method, 0x6000, 0x2A22) + sizes + struct.pack("<HH", len(name), 0) + name.encode() + coded
        directory += b"PK\1\2" + struct.pack("<HHHHHH", 20, 20, flags, method, 0x6000, 0x2A22) + sizes + struct.pack("<HHHHHII", len(name), 0, 0, 0, 0, 0, place) + name.encode()
    return bytes(out + directory) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), len(out), 0)


def old_zip(data: bytes) -> bytes:
    """A member for each of the methods that modern tools no longer write."""
    return zip_of([(f"m{method}", method, encode(data), data, flags) for method, (encode, flags) in ZIP_ENCODERS.items()])


def arj_of(data: bytes) -> bytes:
    """Members dir/a (stored), b (method 1) and c, whose method nobody reads."""
    def header(kind, method, name, coded=b"", plain=b""):
        head = bytes([30, 11, 1, 0, 0, method, kind, 0]) + struct.pack("<IIIIHHH", 0x2A220000, len(coded), len(plain), zlib.crc32(plain), 0, 0, 0) + name + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(head)) + head + struct.pack("<IH", zlib.crc32(head), 0) + coded

    return header(2, 0, b"main") + header(0, 0, b"dir/a", data, data) + header(0, 1, b"b", as_lh(data, 15), data) + header(0, 4, b"c", b"x", data) + b"\x60\xea\0\0"


def zoo_of(data: bytes) -> bytes:
    """Members a (stored), b (LZW) and c (LH)."""
    out = bytearray(b"ZOO 2.10 Archive.\x1a".ljust(20, b"\0") + struct.pack("<IIIBB", 0xFDC4A7DC, 34, 0, 2, 0))
    for name, method, coded in ((b"a", 0, data), (b"b", 1, as_lzw(data, "zoo")), (b"c", 2, as_lh(data))):
        at = len(out)
        entry = struct.pack("<IBBIIHHHII", 0xFDC4A7DC, 1, method, at + 51 + len(coded), at + 51, 0x2A22, 0, crc16_arc(data), len(data), len(coded)) + bytes(10) + name.ljust(13, b"\0")
        out += entry[:51].ljust(51, b"\0") + coded
    return bytes(out) + struct.pack("<IBBII", 0xFDC4A7DC, 1, 0, 0, 0) + bytes(40)


def huffman_of(data: bytes) -> bytes:
    """A tree of two levels of 16, as the old Macintosh programs store theirs, and the codes."""
    values = sorted(set(data)) or [0]
    bits, codes = "", {}

    def grow(part, code):
        nonlocal bits
        if len(part) == 1:
            bits += f"1{part[0]:08b}"
            codes[part[0]] = code
            return
        bits += "0"
        grow(part[: len(part) // 2], code + "0")
        grow(part[len(part) // 2 :], code + "1")

    grow(values, "")
    return joined([bits, *map(codes.__getitem__, data)], True)


def stuffit_of(data: bytes) -> bytes:
    """A folder with a file of two forks (RLE90 and LZW), and a file b (Huffman)."""
    def header(name, methods, resource=(b"", b""), data=(b"", b"")):
        head = bytes(methods) + bytes([len(name)]) + name.ljust(63, b"\0") + b"TEXTtest" + bytes(6) + struct.pack(">I", 3_000_000_000) + struct.pack(">IIIIHH", len(resource[0]), len(data[0]), len(resource[1]), len(data[1]), crc16_arc(resource[0]), crc16_arc(data[0]))
        head = head.ljust(110, b"\0")
        return head + struct.pack(">H", crc16_arc(head)) + resource[1] + data[1]

    body = header(b"folder", [32, 32]) + header(b"a", [1, 2], (b"rsrc" * 9, as_rle90(b"rsrc" * 9)), (data, as_lzw(data, most=14))) + header(b"f", [33, 33]) + header(b"b", [0, 3], data=(data, huffman_of(data)))
    return b"SIT!" + struct.pack(">HI", 2, 22 + len(body)) + b"rLau" + bytes(8) + body


def cfb_of(data: bytes) -> tuple[bytes, bytes, bytes]:
    """A compound file with a large stream and, in a folder, a small one; the two streams."""
    big, small = data * 3, b"tiny stream"
    sector = lambda raw: raw.ljust(-(-len(raw) // 512) * 512, b"\0")
    n = len(sector(big)) // 512

    def entry(name, kind, child, start, size, right=0xFFFFFFFF):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + bytes(16 + 4 + 8 + 8) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 1, 2, 64) + entry("big", 2, 0xFFFFFFFF, 4, len(big), 2) + entry("folder", 1, 3, 0, 0) + entry("\1small", 2, 0xFFFFFFFF, 0, len(small))
    table = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFE, *range(5, 4 + n), 0xFFFFFFFE]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096 if len(big) >= 4096 else 64, 3, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    small_table = struct.pack("<16I", 0xFFFFFFFE, *[0xFFFFFFFF] * 15)
    return head + sector(struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff")) + sector(directory) + sector(small) + sector(small_table) + sector(big), big, small


def iso_of(data: bytes) -> bytes:
    """A disc with A.TXT and, in the folder SUB, its first five bytes as B."""
    def record(name, start, size, flags=0):
        raw = bytes([0, 0]) + struct.pack("<I", start) + struct.pack(">I", start) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([120, 1, 2, 3, 4, 5, 0, flags, 0, 0]) + struct.pack("<H", 1) + struct.pack(">H", 1) + bytes([len(name)]) + name
        raw += bytes(len(raw) % 2)
        return bytes([len(raw)]) + raw[1:]

    folder = lambda own, up, *files: (record(b"\0", own, 2048, 2) + record(b"\1", up, 2048, 2) + b"".join(files)).ljust(2048, b"\0")
    head = (b"\1CD001\1".ljust(156, b"\0") + record(b"\0", 18, 2048, 2)).ljust(2048, b"\0")
    body = head + b"\xffCD001\1".ljust(2048, b"\0") + folder(18, 18, record(b"A.TXT;1", 20, len(data)), record(b"SUB", 19, 2048, 2)) + folder(19, 18, record(b"B.;1", 20, 5)) + data.ljust(5, b"\0")
    return bytes(16 * 2048) + body


def fat_of(data: bytes) -> bytes:
    """A FAT12 disk with a file of a long name, whose clusters stand in pairs turned round, and SUB/B.BIN."""
    n = -(-len(data) // 512)
    chain = [2 + (i ^ 1) for i in range(n + n % 2)][:n] if n % 2 == 0 else [*(2 + (i ^ 1) for i in range(n - 1)), n + 1]
    clusters = {c: data[512 * i : 512 * i + 512] for i, c in enumerate(chain)}
    folder, inner = n + 2, n + 3
    entry = lambda name, kind, first, size, flags=0: name.ljust(8).encode() + kind.ljust(3).encode() + bytes([flags]) + bytes(10) + struct.pack("<HHHI", 0, 0x2A22, first, size)
    raw = "a long name.txt\0".encode("utf-16-le").ljust(52, b"\xff")
    parts = [bytes([k + 1 | (0x40 if k == 1 else 0)]) + raw[26 * k : 26 * k + 10] + b"\x0f\0\0" + raw[26 * k + 10 : 26 * k + 22] + bytes(2) + raw[26 * k + 22 : 26 * k + 26] for k in (1, 0)]
    root = b"".join(parts) + entry("ALONGN~1", "TXT", chain[0] if chain else 0, len(data)) + b"\xe5" + entry("GONE", "", 2, 9)[1:] + entry("SUB", "", folder, 0, 16) + entry("LABEL", "", 0, 0, 8)
    clusters[folder] = entry(".", "", folder, 0, 16) + entry("..", "", 0, 0, 16) + entry("B", "BIN", inner, 3)
    clusters[inner] = b"abc"
    links = {0: 0xFF0, 1: 0xFFF, folder: 0xFFF, inner: 0xFFF} | dict(zip(chain, [*chain[1:], 0xFFF], strict=False))
    sectors = -(-(n + 8) * 3 // 1024)
    table = bytearray(512 * sectors)
    for k, v in links.items():
        pair = int.from_bytes(table[k * 3 // 2 : k * 3 // 2 + 2], "little") | (v << 4 if k % 2 else v)
        table[k * 3 // 2 : k * 3 // 2 + 2] = pair.to_bytes(2, "little")
    boot = b"\xeb\x3c\x90" + b"test".ljust(8) + struct.pack("<HBHBHHBHHHI", 512, 1, 1, 1, 16, n + 8 + sectors, 0xF9, sectors, 9, 2, 0)
    return boot.ljust(510, b"\0") + b"\x55\xaa" + bytes(table) + root.ljust(512, b"\0") + b"".join(clusters.get(k, b"").ljust(512, b"\0") for k in range(2, n + 6))


def tiff_of(tags: list[tuple[int, int, list[int]]], body: bytes, order: str = "<") -> bytes:
    """A TIFF file with the body at 8 and one directory after it; tags: number, type (1, 3 or 4), values."""
    entries, extra, place = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        data = struct.pack(f"{order}{len(values)}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }".replace(" ", ""), *values)
        if len(data) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), place + len(extra))
            extra += data
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4) + extra


#: TIFF's compressions by number.
TIFF_PACKERS = {1: bytes, 5: lambda d: as_lzw(d, "tiff"), 8: zlib.compress, 32773: as_packbits}


def as_tiff(data: bytes, method: int = 5) -> bytes:
    """An RGB image of all of data (zero-filled), 16 pixels wide, in strips of 8 rows."""
    rows = max(1, -(-len(data) // 48))
    body = data.ljust(48 * rows, b"\0")
    strips = [TIFF_PACKERS[method](body[i : i + 384]) for i in range(0, len(body), 384)]
    places = list(accumulate(map(len, strips[:-1]), initial=8))
    tags = [(256, 3, [16]), (257, 3, [rows]), (258, 3, [8, 8, 8]), (259, 3, [method]), (262, 3, [2]), (273, 4, places), (277, 3, [3]), (278, 3, [8]), (279, 4, [len(x) for x in strips])]
    return tiff_of(tags, b"".join(strips))


@lru_cache
def fax_codes() -> tuple[list[list[str]], dict]:
    """The codes of runs of 0 to 2623 pixels of each colour, and of modes."""
    from tessera.operators import fax

    runs = []
    for table in fax.RUNS:
        code = {n: digits_ for digits_, n in table.items()}
        runs.append([(code[n // 64 * 64] if n >= 64 else "") + code[n % 64] for n in range(2624)])
    return runs, {mode: digits_ for digits_, mode in fax.MODES.items()}


def fax_changes(row: list[int]) -> list[int]:
    """Where the colour of a line changes, which begins with 0."""
    raw = bytes(row)
    out, at, colour = [], 0, 0
    while (at := raw.find(1 - colour, at)) >= 0:
        out.append(at)
        colour ^= 1
    return out


def fax_line(row: list[int], above: list[int] | None = None) -> str:
    """Fax codes of a line of 0 and 1, plain or by the line above."""
    return fax_coded(fax_changes(row), len(row), None if above is None else fax_changes(above))


def fax_coded(own: list[int], width: int, ups: list[int] | None = None) -> str:
    """Fax codes of a line by its changes of colour, plain or by those of the line above."""
    runs, modes = fax_codes()

    def run(n: int, colour: int) -> str:
        out = ""
        while n >= 2624:
            out, n = out + runs[colour][2560][:-len(runs[colour][0])], n - 2560
        return out + runs[colour][n]

    if ups is None:
        edges = [0, *own, width]
        return "".join([run(b - a, i % 2) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    out, at, colour, i, k = [], -1, 0, 0, 0  # i: the next change of this line, k: that above
    while at < width:
        while i < len(own) and (own[i] < at or i % 2 != colour):
            i += 1
        a1 = own[i] if i < len(own) else width
        k = max(0, k - 2)
        while k < len(ups) and (ups[k] <= at or k % 2 != colour):
            k += 1
        b1 = ups[k] if k < len(ups) else width
        b2 = ups[k + 1] if k + 1 < len(ups) else width
        if b2 < a1:
            out.append(modes["pass"])
            at = b2
        elif abs(a1 - b1) <= 3:
            out.append(modes[a1 - b1])
            at, colour = a1, colour ^ 1
        else:
            a2 = own[i + 1] if i + 1 < len(own) else width
            out += [modes["horizontal"], run(a1 - max(at, 0), colour), run(a2 - a1, colour ^ 1)]
            at = a2
    return "".join(out)


def as_fax(rows: list[list[int]], scheme: int) -> bytes:
    """scheme: 2 (lines begin at bytes), 3 (T.4), 4 (T.6), or 5 (T.4 with lines by the line above)."""
    bits, above = [], []
    for i, row in enumerate(rows):
        own = fax_changes(row)
        if scheme == 2:
            line = fax_coded(own, len(row))
            bits.append(line + "0" * (-len(line) % 8))
        elif scheme == 3:
            bits.append("000000000001" + fax_coded(own, len(row)))
        elif scheme == 5:
            bits.append("000000000001" + ("1" + fax_coded(own, len(row)) if i % 3 == 0 else "0" + fax_coded(own, len(row), above)))
        else:
            bits.append(fax_coded(own, len(row), above))
        above = own
    return joined(bits, True)


def as_fax_tiff(data: bytes, scheme: int) -> bytes:
    """The bits of data (zero-filled), 1 black, 128 in a row, as a fax."""
    rows = max(1, -(-len(data) // 16))
    body = data.ljust(16 * rows, b"\0")
    coded = as_fax(np.unpackbits(np.frombuffer(body, np.uint8)).reshape(-1, 128).tolist(), scheme)
    tags = [(256, 3, [128]), (257, 3, [rows]), (259, 3, [min(scheme, 4) if scheme < 5 else 3]), (262, 3, [0]), (273, 4, [8]), (279, 4, [len(coded)]), (292, 4, [int(scheme == 5)])]
    return tiff_of(tags, coded)


def as_bmp_runs(data: bytes) -> bytes:
    """A bitmap of 8 bits in runs, 64 pixels wide, whose palette is gray: all of data (zero-filled), from the bottom row up."""
    rows = max(1, -(-len(data) // 64))
    body, out = data.ljust(64 * rows, b"\0"), bytearray()
    raw = np.frombuffer(body, np.uint8).reshape(-1, 64)[::-1]
    starts = np.ones(raw.shape, bool)
    starts[:, 1:] = raw[:, 1:] != raw[:, :-1]
    firsts = np.flatnonzero(starts)
    pairs = np.stack([np.diff(firsts, append=raw.size), raw.ravel()[firsts]], 1).astype(np.uint8)
    ends = np.flatnonzero(firsts[1:] % 64 == 0) + 1  # an end of line stands before each other row's first run and after all
    out += np.insert(pairs, np.append(ends, len(pairs)), 0, axis=0).tobytes()
    out += b"\0\1"
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    return b"BM" + struct.pack("<IHHI", 1078 + len(out), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, 64, rows, 1, 8, 1, len(out), 0, 0, 256, 0) + palette + bytes(out)


def as_jpeg(data: bytes) -> bytes:
    """Markers with an Exif directory that tells the size of data, and data in comments."""
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    exif = tiff_of([(256, 4, [len(data)]), (257, 3, [7])], b"")
    comments = b"".join(part(0xFE, data[i : i + 60_000]) for i in range(0, len(data), 60_000))
    return b"\xff\xd8" + part(0xE1, b"Exif\0\0" + exif) + comments + part(0xC0, struct.pack(">BHHB", 8, 20, 30, 3)) + b"\xff\xd9"
