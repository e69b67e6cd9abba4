"""Tests of formats that a plain signature cannot tell: each looks at the first and last bytes of a blob, its size and its name, and gives a confidence from 0 to 100."""

from __future__ import annotations

import binascii
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.checksums import crc16_sdlc
from tessera.functions.reading import raw, u32be, u32le

#: Bytes of a blob's beginning and end that probes see.
HEAD, TAIL = 4_096, 512
#: Sizes of COM programs end here.
COM_MOST = 65_280

#: Bytes further inside that some probes ask for: place (or the number that tells it) and size.
FAR: dict[str, tuple[int | Callable[[str], Column], int]] = {
    "iso": (32_768, 2_062), "vtoc": (69_632, 64), "dgi": (32_000, 8), "bsave": (8_007, 11), "map": (lambda c: u32be(c, 4), 16), "qip": (lambda c: u32le(c, 16), 2),
    **{f"cd{unit}.{skip}": (unit * 16 + skip, unit + 14) for unit, skip in ((2336, 8), (2352, 16), (2352, 24), (2448, 16), (2448, 24))},
}


class Look:
    """What probes see of a blob. Bytes outside of it, or outside of what is seen, are zero."""

    def __init__(self, path: str, size: int, head: bytes, tail: bytes, far: dict[str, bytes]):
        self.path, self.size, self.head, self.tail, self.far = path or "", size, head, tail, far

    @cached_property
    def extension(self) -> str:
        name = self.path.replace("\\", "/").rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[1].lower() if "." in name else ""

    def named(self, *extensions: str) -> bool:
        return self.extension in extensions

    def at(self, place: int, n: int) -> bytes:
        """n bytes at a place, from the end if it is negative."""
        if place < 0:
            start = len(self.tail) + place
            part = self.tail[max(0, start) : max(0, start + n)]
            return bytes(min(n, max(0, -start))) + part + bytes(n - len(part) - min(n, max(0, -start)))
        if place + n <= len(self.head) or place >= self.size:
            return self.head[place : place + n].ljust(n, b"\0")
        back = place - self.size
        return self.at(back, n) if back >= -len(self.tail) else self.head[place : place + n].ljust(n, b"\0")

    def byte(self, place: int) -> int:
        return self.head[place] if 0 <= place < len(self.head) else self.at(place, 1)[0]

    def le(self, place: int, n: int = 2) -> int:
        return int.from_bytes(self.at(place, n), "little")

    def be(self, place: int, n: int = 2) -> int:
        return int.from_bytes(self.at(place, n), "big")

    def starts(self, *values: bytes) -> bool:
        return self.head.startswith(values)

    def holds(self, place: int, value: bytes) -> bool:
        return self.at(place, len(value)) == value

    def zeros(self, place: int, n: int) -> bool:
        return not any(self.at(place, n))

    @cached_property
    def sauce(self) -> tuple[int, int] | None:
        """Data and file type of a SAUCE record at the end, or None."""
        return (self.tail[-34], self.tail[-33]) if self.size >= 128 and self.tail[-128:-121] == b"SAUCE00" else None

    @cached_property
    def id3_end(self) -> int:
        """Where an ID3v2 tag at the start ends; 0 without one."""
        if not self.starts(b"ID3"):
            return 0
        size = sum((b & 127) << 7 * i for i, b in enumerate(reversed(self.at(6, 4))))
        return 10 + size + (10 if self.byte(3) >= 4 and self.byte(5) & 0x10 else 0)


def icns(x: Look) -> int:
    return (100 if x.be(4, 4) == x.size else 20) if x.starts(b"icns") else 0


def bmp(x: Look) -> int:
    if not x.starts(b"BM"):
        return 0
    start, info, own = x.le(10, 4), x.le(14, 4), x.named("bmp")
    if not 12 <= info <= 256 or not 14 + info <= start < x.size or info == 68 and x.holds(30, b"JPEG"):
        return 0
    if own and x.le(2, 4) == x.size:
        return 100
    if x.byte(2) == 0xCB:
        return 90 if own else 5
    return 100 if own or info in (12, 40, 108, 124) else 90


def wmf(x: Look) -> int:
    if x.starts(b"\xd7\xcd\xc6\x9a"):
        return 100
    if x.le(2) != 9 or x.le(0) not in (1, 2) or x.le(4) not in (0x100, 0x300):
        return 0
    if x.named("wmf"):
        return 95
    size = 2 * x.le(6, 4)
    return 0 if not 20 <= size <= x.size else 70 if size >= x.size - 8 else 14


def catalogue(kind: bytes) -> Callable[[Look], int]:
    return lambda x: 80 if x.starts(b"CAT ") and x.holds(8, kind) and x.holds(12, b"FORM") and x.le(4, 4) <= x.size else 0


def pcpaint(x: Look) -> int:
    own = x.named("pic")
    if x.starts(b"\x34\x12"):
        if x.byte(11) == 0xFF:
            return 100 if own else 50
        if x.holds(10, b"\1\0"):
            return 60 if own else 10
    return 50 if x.named("clp") and x.le(0) == x.size else 0


def mpeg_audio(x: Look) -> int:
    names = {"mp3": {1}, "mp2": {2}, "mp1": {3}, "mpa": {1, 2, 3}}.get(x.extension, set())
    if not x.id3_end and not names:
        return 0
    word, good = x.be(x.id3_end), False
    if word & 0xFFE0 == 0xFFE0:
        version, layer = word >> 3 & 3, word >> 1 & 3
        good = layer in names and (version != 1 if layer == 1 else version in (2, 3))
    return 100 if good else 80 if x.id3_end else 0


def lha_method(x: Look, place: int = 2) -> bytes | None:
    m = x.at(place, 5)
    if m[0] != m[4]:
        return None
    if m[:3] == b" LH" and m[3:4].isdigit() or m[:1] == b"-" and m[1:2].isalpha() and m[2:4].isalnum() and m.isascii():
        return m
    return None


# The first four bytes of methods of LHA archives.
LHA_METHODS = frozenset("-lh0 -lh1 -lh2 -lh3 -lh4 -lh5 -lh6 -lh7 -lh8 -lh9 -lha -lhb -lhc -lhd -lhe -lhx -lx1 -lz2 -lz3 -lz4 -lz5 -lz7 -lz8 -lzs -pm0 -pm1 -pm2 -ah0 -ari -hf0 -lZ0 -lZ1 -lZ5".split() + [" LH0", " LH5"])


def lha(x: Look) -> int:
    method, level = lha_method(x), x.byte(20)
    if method is None or level > 3 or method[1:3] == b"sw" or method[:4].decode("ascii") not in LHA_METHODS:
        return 0
    first, name = x.byte(0), x.byte(21)
    room = {0: first >= 22 and name + 22 <= first, 1: first >= 25 and name + 25 <= first, 2: x.le(0) >= 26, 3: x.le(0) in (4, 8)}
    return (100 if x.named("lzh", "lha") or x.named("lzs") and method[2:3] == b"z" else 80) if room[level] else 0


def car_lha(x: Look) -> int:
    name = x.byte(15)
    fits = x.at(2, 5) in (b"-lh0-", b"-lh5-") and x.byte(0) == name + 25 and x.holds(name + 24, b"\x20\0\0")
    return 95 if fits and x.named("car") else 0


def zoo_filter(x: Look) -> int:
    if x.size < 6 or x.le(0) != 0x5A32:
        return 0
    a, b = x.at(-4, 2)
    return 45 if a == 0 == b or a and (b <= 2 or b & (b - 1) == 0) else 0


def binhex(x: Look) -> int:
    if not x.named("hqx"):
        return 0
    if b"(This file must be converted with BinHex" in x.head:
        return 100
    return 75 if x.head.lstrip(b"\r\n")[:1] == b":" and x.tail.rstrip(b"\r\n")[-1:] == b":" else 0


def pnm(x: Look) -> int:
    return 40 if x.starts(b"P7\n") or x.starts(*(b"P%d" % i for i in range(1, 7))) and x.byte(2) in b"\t\n\r " else 0


def write_document(x: Look) -> int:
    return 100 if x.starts(b"\x31\xbe\0\0\0\xab", b"\x32\xbe\0\0\0\xab") and x.le(96) else 0


def tga(x: Look) -> int:
    if x.byte(1) > 1 or not x.le(12) or not x.le(14):
        return 0
    if x.tail.endswith(b"TRUEVISION-XFILE.\0"):
        return 100
    kind, own = x.byte(2), x.named("tga")
    if kind not in (1, 2, 3, 9, 10, 11, 32, 33) and not (kind == 0 and x.holds(20, b"IGCH")):
        return 0
    if x.byte(16) not in (1, 8, 15, 16, 24, 32) or x.byte(7) not in (15, 16, 24, 32) and (x.byte(1) or x.byte(7)):
        return 0
    if own:
        return 100
    return 0 if x.byte(17) & 15 not in (0, 1, 8) else 40 if x.named("vst") else 8


def dwc(x: Look) -> int:
    if not x.tail.endswith(b"DWC") or not 27 <= (trailer := x.le(-27)) <= x.size or (entry := x.byte(x.size - 25)) < 30:
        return 0
    usual = trailer == 27 and entry == 34
    return (100 if usual else 10) if x.named("dwc") else 60 if usual else 0


def pict(x: Look) -> int:
    for place, old in ((522, 25), (10, 15)):
        if x.holds(place, b"\x00\x11\x02\xff\x0c\x00"):
            return 85
        if x.holds(place, b"\x11\x01"):
            return old
    return 0


def arj(x: Look) -> int:
    return (100 if x.named("arj") else 75) if x.starts(b"\x60\xea") and 30 <= x.le(2) <= 2600 else 0


def amiga_disk(x: Look) -> int:
    if not x.starts(b"DOS") or x.byte(3) > 5:
        return 0
    whole = x.size in (901_120, 1_802_240)
    return (100 if x.named("adf") else 90) if whole else 60 if x.named("adf") else 20


def apple2_disk(x: Look) -> int:
    if not 143_358 <= x.size <= 143_362:
        return 0
    table = x.far["vtoc"]
    fits = len(table) >= 56 and (table[39], table[52], table[53], table[54:56]) == (122, 35, 16, b"\0\1")
    return (100 if x.starts(b"\x01\xa5\x27\xc9\x09\xd0") else 60) if fits else 0


def ansi_art(x: Look) -> int:
    own = x.named("ans")
    if x.byte(0) == 1 and x.named("adf") or x.starts(b"\x041.4"):
        return 0
    if x.sauce == (1, 1):
        return 100 if own else 91
    if x.starts(b"\x1b[") and (x.at(2, 1) == b"?" or x.at(2, 1).isdigit()):
        return 100 if own else 50
    return 10 if own else 0


def gem_raster(x: Look) -> int:
    version, words, planes, pattern, wide, high = (x.be(2 * i) for i in range(6))
    if version > 3 or not (1 <= planes <= 8 or planes in (15, 16, 24, 32)) or pattern > 4:
        return 0
    if words < 8 or 2 * words > x.size or words > 59 and words not in (107, 203, 395, 779):
        return 0
    own, kind = x.named("img"), x.at(16, 4) if words >= 10 else b""
    sane = wide == high and wide in (0, 1) or all(20 <= v <= 1300 for v in (wide, high)) and 3 * wide >= high and 3 * high >= wide
    if kind == b"XIMG":
        return 90 if own else 70
    if sane and kind in (b"STTT", b"TIMG"):
        return 40
    if version > 1 or not sane and not own or version == 0 and not (own and sane):
        return 0
    if words in (8, 9, 25):
        return 70 if own else 50
    return 14 if own else 0


def uuencode(x: Look) -> int:
    start = 3 if x.starts(b"\xef\xbb\xbf") else 0
    if x.holds(start, b"begin ") and x.at(start + 6, 3).isdigit() and x.at(start + 9, 1) == b" ":
        return 85
    lines = x.head.replace(b"\r", b"\n").split(b"\n")
    return 19 if x.named("uue", "uu") and any(line.startswith((b"begin ", b"begin-base64 ")) for line in lines) else 0


def xxencode(x: Look) -> int:
    if not x.named("xxe", "xx"):
        return 0
    return 90 if x.starts(b"begin ", b"\xef\xbb\xbfbegin ") else 20 if b"\nbegin " in x.head.replace(b"\r", b"\n") else 0


def hp_icon(x: Look) -> int:
    w, h = x.le(4), x.le(6)
    if not x.starts(b"\1\0\1\0") or 8 + (w + 7) // 8 * h != x.size or not (1 <= w <= 2048 and 1 <= h <= 2048):
        return 0
    return 100 if (w, h) == (44, 32) else 60


def amos_bank(x: Look) -> int:
    return (100 if x.named("abk") else 60) if x.starts(b"AmBk", b"AmSp", b"AmIc", b"AmBs") else 0


def stos_screen(x: Look) -> int | None:
    """Resolution of a packed screen of STOS, by itself or in a bank; else None."""
    start = 0
    if x.starts(b"Lionpoubnk"):
        if x.zeros(10, 4) or x.byte(14) != 0x81:
            return None
        start = 18
    resolution = x.be(start + 4)
    if not x.holds(start, b"\x06\x07\x19\x63") or resolution > 2 or 1 <= x.be(start + 14) <= 6 and x.be(start + 18) >= 8:
        return None
    return resolution


def stos_named(extension: str, *resolutions: int) -> Callable[[Look], int]:
    return lambda x: 100 if x.named(extension) and stos_screen(x) in resolutions else 0


def award_logo(x: Look) -> int:
    blocks = x.byte(0) * x.byte(1)
    return (100 if x.named("epa") else 20) if 1 <= blocks <= 256 and x.size == 72 + 15 * blocks else 0


def grasp_archive(x: Look) -> int:
    order, start, size = "little", 2, x.le(0)
    if size == 0x4741 and x.be(2) == 0x100:
        order, start, size = "big", 6, x.be(4)
    if not size or size % 17 or start + size > x.size:
        return 0
    first = int.from_bytes(x.at(start, 4), order)
    if not start + size <= first <= x.size:
        return 0
    return (100 if x.named("gl") else 70) if first == start + size else 5 if x.named("gl") else 0


def zlib_stream(x: Look) -> int:
    a = x.byte(0)
    return 50 if a & 15 == 8 and 8 <= a <= 0x78 and x.be(0) % 31 == 0 else 0


def drhalo_cut(x: Look) -> int:
    return 10 if x.named("cut") and x.le(4) == 0 and 1 <= x.le(0) <= 4096 and 1 <= x.le(2) <= 4096 else 0


def xwd(x: Look) -> int:
    head, version, kind, depth = (x.be(4 * i, 4) for i in range(4))
    colours = x.be(76, 4)
    if version != 7 or not 100 <= head <= 500 or kind > 2 or not 1 <= depth <= 32 or colours > 512 or head + 12 * colours > x.size:
        return 0
    return 100 if x.named("xwd") else 75


def compuserve_rle(x: Look) -> int:
    kind, runs = x.at(2, 1), x.at(3, 64)
    if not x.starts(b"\x1bG") or kind not in (b"M", b"H", b"C") or any(not 0x20 <= b <= 0x7F for b in runs):
        return 0
    if kind == b"C":
        return 60 if x.named("rle") and all(b <= 0x23 for b in runs[1::2]) else 0
    return 0 if b"  " in runs else 92 if x.named("rle") else 32


def lotus_screen(x: Look) -> int:
    packed = x.starts(b"R") and x.named("rle")
    if not packed and not (x.starts(b"B") and x.named("bit")):
        return 0
    across, down, high, stride = (x.le(1 + 2 * i) for i in range(4))
    if across != down or across not in (72, 300) if packed else across >= 600 or down > 600:
        return 0
    if not 1 <= high <= 3300 or not 1 <= stride <= 320:
        return 0
    return 12 if packed else 75 if 9 + high * stride == x.size else 0


def corel_library(x: Look) -> int:
    n = x.le(0)
    if not x.named("clb") or not 1 <= n <= 63 or x.byte(1 + n) or x.le(6 + n, 4) != 1:
        return 0
    return 100 if x.le(18 + n, 4) in (0, 22 + n) else 0


def disc_mark(raw14: bytes) -> bool:
    """Whether a volume descriptor of a compact disc starts here."""
    kind = raw14[0] if raw14[1:6] in (b"CD001", b"CD-I ") else raw14[8] if raw14[9:14] == b"CDROM" else 4
    return kind <= 3 or kind == 255


def iso9660(x: Look) -> int:
    sectors = x.far["iso"]
    return 80 if len(sectors) == 2062 and disc_mark(sectors[:14]) and disc_mark(sectors[2048:2062]) else 0


def raw_disc(x: Look) -> int:
    for name, part in x.far.items():
        if name.startswith("cd") and len(part) > 14 and disc_mark(part[:14]) and disc_mark(part[-14:]):
            return 70
    sync = b"\0" + b"\xff" * 10 + b"\0"
    return 70 if x.starts(sync) and x.holds(2352, sync) and x.holds(528, b"PM") else 0


def spark(x: Look) -> int:
    if x.byte(0) != 0x1A or x.byte(1) not in (0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x88, 0x89, 0xFF):
        return 0
    typed, ended = x.le(29, 4) >> 20 == 0xFFF, x.tail.endswith(b"\x1a\x80")
    return (85 if ended else 30) if typed else 10 if ended else 0


ARC_METHODS = frozenset([*range(12), 20, 21, 22, 30])


def arc(x: Look) -> int:
    start = x.at(0, 4).find(b"\x1a")
    if start < 0:
        return 0
    method = x.byte(start + 1)
    if method not in ARC_METHODS or method > 20 or method == 0 and start or start and not x.named("arc", "ark", "com"):
        return 0
    own = x.named("arc", "ark", "pak", "spk", "sdn", "com")
    strict = 0 if x.named("arc", "ark") and not start else 1 if x.named("pak", "spk") and not start else 2
    if method:
        if strict == 2 and x.byte(start + 2) < 0x20:
            return 0
        if strict:
            after = start + 15 + 10 + (0 if method == 1 else 4) + x.le(start + 15, 4)
            if after != x.size and not (after <= x.size - 2 and x.byte(after) == 0x1A and x.byte(after + 1) in ARC_METHODS):
                return 0
    elif x.size == 2:
        return 100 if x.named("arc") else 15 if x.named("ark", "pak", "spk") else 0
    noted = x.holds(-8, b"PK\xaa\x55")
    ended = x.tail.endswith(b"\x1a\0")
    noted = noted or not ended and x.tail.endswith(b"\xfe\0")
    if not method:
        return 25 if noted else 0
    if ended or noted:
        return 90 if own else 35
    return 24 if own else 19 if not start else 0


def arc_mac(x: Look) -> int:
    kind = x.byte(1)
    return 80 if x.byte(0) == 0x1B and 1 <= kind <= 9 and x.at(59, 2) == bytes([0x1A, kind]) else 0


def dcl_starts(x: Look, place: int) -> bool:
    return x.byte(place) <= 1 and 4 <= x.byte(place + 1) <= 6


def dcl_implode(x: Look) -> int:
    if x.size < 4 or not dcl_starts(x, 0):
        return 0
    last = x.le(-4, 4)
    if not any(last >> i & 0xFFFFFE00 == 0x01FE0200 for i in range(8)):
        return 0
    return 40 if x.starts(b"\0\6") else 10


def cmz(x: Look) -> int:
    if not x.starts(b"Clay"):
        return 0
    name = x.le(16)
    return 60 if not x.le(4, 4) and name else 100 if dcl_starts(x, 20 + name) else 0


def pcshrink(x: Look) -> int:
    if x.byte(13) == 0x74:
        return 60 if not x.byte(0) and x.byte(16) == 0x74 and x.byte(56) and (not x.le(76, 4) or dcl_starts(x, 104)) else 0
    if x.byte(13) or x.le(14) != 0x74 or x.le(18) not in (0x74, 0x75):
        return 0
    if x.le(18) == 0x74 and (not x.byte(58) or x.le(194, 4) and not dcl_starts(x, 226)):
        return 0
    return 40 if x.le(18) == 0x75 or x.byte(0) else 80


def qip(x: Look) -> int:
    if x.starts(b"QP"):
        return 100 if x.byte(8) == 2 and x.le(16, 4) <= x.size and x.far["qip"] == b"QD" else 0
    return 70 if x.starts(b"QD") and not x.le(2) and x.le(8) == 1 else 0


def genus_library(x: Look) -> int:
    signs = x.holds(2, b"Copyri") + (x.le(52) == 100)
    return {2: 100, 1: 25}.get(signs, 0) if x.starts(b"\x01\xca") else 0


def lif(x: Look) -> int:
    digits = x.at(0, 34)
    if any(b not in b"0123456789abcdef" for b in digits) or not 1 <= int(digits[32:], 16) <= 3 or x.byte(34) < 32 or x.byte(53):
        return 0
    return 0 if 54 + int(digits[8:16], 16) > x.size else 45 if x.named("lif") else 15


def ain(x: Look) -> int:
    if x.byte(0) != 0x21 or x.byte(2) or not 24 <= x.le(14, 4) < x.size or sum(x.at(0, 22)) ^ 0x5555 != x.le(22):
        return 0
    return 100 if x.named("ain") else 50


def bsave(x: Look) -> int:
    n = x.le(5)
    if x.size < 12 or x.byte(0) != 0xFD or not 0 < n <= x.size:
        return 0
    return 91 if x.le(1) == 0xB800 and x.size >= 8021 and x.far["bsave"] == b"PCPaint V1." else 10


def xpuzzle(x: Look) -> int:
    w, h, colours = x.be(0, 4), x.be(4, 4), x.byte(8) or 256
    return 20 if 1 <= w <= 4096 and 1 <= h <= 4096 and w * h + 3 * colours + 9 == x.size else 0


def alias_pix(x: Look) -> int:
    w, h = x.be(0), x.be(2)
    if x.be(8) != 24 or not 1 <= w <= 2048 or not 1 <= h <= 2048 or x.be(4) or x.be(6) not in (0, h - 1, h):
        return 0
    place, across = 10, 0
    while across < w:
        run = x.byte(place)
        if not run:
            return 0
        across, place = across + run, place + 4
    return 30 if across == w else 0


def packdir(x: Look) -> int:
    bits = x.le(5, 4)
    return (100 if bits <= 4 else 10 if bits <= 8 else 0) if x.starts(b"PACK\0") else 0


def font_edit(x: Look) -> int:
    jump = x.byte(1)
    return 90 if 822 <= x.size <= 0x2200 and x.byte(0) == 0xEB and jump in (0x32, 0x33) and x.holds(jump + 41, b"\xb8\x10\x11\xcd\x10") else 0


def sized_image(extension: str, extra: int, unit: int, confidence: int) -> Callable[[Look], int]:
    """Images of a width and height (16 bits each, least byte first), told by their name and size only."""
    return lambda x: confidence if x.named(extension) and x.size == 4 + extra + unit * x.le(0) * x.le(2) else 0


def pcx(x: Look) -> int:
    if x.byte(0) == 0x0A and x.byte(1) in (0, 2, 3, 4, 5) and x.byte(2) <= 1:
        return 100 if x.named("pcx") else 16
    return (80 if x.named("pcx") else 8) if x.starts(b"\xeb\x0e\x01\x08") and x.byte(16) == 0xE8 else 0


def pcx_program(x: Look) -> int:
    return 100 if 922 <= x.size <= COM_MOST and x.starts(b"\xb8\x13\0\xcd") and x.tail.endswith(b"\x0c") and x.holds(104, b"\xd3\xe5\xec\xe6\xa0\xd0\xc3\xd8") else 0


def word_screen(x: Look) -> int:
    return (100 if x.named("scr", "mwg") else 10) if x.byte(0) == 0xCD and x.byte(1) in (0, 2, 3, 4, 5) and x.byte(2) == 1 else 0


def macbinary(x: Look) -> int:
    n = x.byte(1)
    if x.byte(0) or not 1 <= n <= 63 or not x.byte(2) or x.byte(74) or x.byte(82):
        return 0
    if x.holds(102, b"mBIN"):
        return 90
    newer = x.byte(122) == 129 == x.byte(123) or x.byte(122) == 130 and x.byte(123) in (129, 130)
    name = x.at(2, n)
    if any(0 < b < 32 for b in (name[:-1] if n > 1 and name[-1] == 13 else name)):
        return 0
    typed = all(32 <= b <= 127 for b in x.at(65, 4))
    data, resource = x.be(83, 4), x.be(87, 4)
    if 128 + data > x.size or 128 + data + resource > x.size + 4096:
        return 0
    least = 128 + data if not resource else 128 + data + -data % 128 + resource
    whole = x.size in (least, least + -least % 128)
    if newer and (not x.zeros(102, 14) and not whole or x.be(120)):
        return 0
    if not newer and (not data and not resource or not x.zeros(99, 25) and not whole):
        return 0
    told = x.be(124)
    bad = newer and told and binascii.crc_hqx(x.at(0, 124), 0) != told
    if newer and whole and typed:
        return 19 if bad else 90
    return 0 if bad else 49 if newer else 29 if typed else 19


def macpaint(x: Look) -> int:
    if x.size < 1024:
        return 0
    if macbinary(x) and x.holds(65, b"PNTG"):
        return 100
    return 25 if x.named("mac", "macp", "pntg") and x.be(0, 4) in (0, 2, 3) else 0


def printshop(x: Look) -> int:
    name = x.path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return 10 if x.size % 572 == 0 and name.startswith("gr") and x.named("dat") else 0


def ro_sprites(x: Look) -> int:
    n, first, end = x.le(0, 4), x.le(4, 4) - 4, x.le(8, 4) - 4
    if not 1 <= n <= 1000 or first not in (12, 28) or first + 48 > x.size or end > x.size:
        return 0
    if n > 1:
        return 55 if end == x.size else 0
    following = x.le(first, 4)
    if following == end == x.size:
        return 15
    return 0 if following + first != end else 80 if end == x.size else 30


def palm_database(x: Look) -> int:
    if not x.named("pdb", "prc", "pqa", "mobi") or any(not 32 <= b < 127 for b in x.at(60, 8)):
        return 0
    program = x.be(32) & 1
    if not program and x.at(60, 8) in (b"vIMGView", b"TEXtREAd", b"pqa clpr", b"BOOKMOBI"):
        return 100
    name, zero, _ = x.at(0, 32).partition(b"\0")
    if not zero or any(b < 32 for b in name):
        return 0
    records = x.be(76)
    end = 78 + records * (10 if program else 8)
    for place in (x.be(52, 4), x.be(56, 4), x.be(84 if program else 78, 4) if records else 0):
        if place and place < end or end > x.size:
            return 0
        end = place or end
    return 9 if not records or end > x.size else 90 if program and x.holds(60, b"appl") else 25


def mac_resources(x: Look) -> int:
    data, table, data_size, table_size = (x.be(4 * i, 4) for i in range(4))
    if data != 256 or data + data_size > table or table_size < 30 or table + table_size > x.size or x.far["map"] != x.at(0, 16):
        return 0
    return 100 if table + table_size == x.size else 75


def pif(x: Look) -> int:
    if x.size == 369:
        return 24 if x.named("pif") else 0
    return (100 if x.named("pif") else 35) if x.size >= 391 and x.holds(369, b"MICROSOFT PIFEX\0") else 0


def fat(x: Look) -> int:
    cluster, tables, media = x.byte(13), x.byte(16), x.byte(21)
    if x.le(11) != 512 or not cluster or cluster & (cluster - 1) or tables not in (1, 2) or 0 < media < 0xE5:
        return 0
    sure = 1 + (2 if x.byte(0) == 0xEB and x.byte(2) == 0x90 else 1 if x.byte(0) in (0xE9, 0x60) else 0)
    sure += 2 * x.holds(510, b"\x55\xaa") + (tables == 2) + (media >= 0xE5) + (x.le(14) == 1) + 2 * (x.le(17) in (112, 224))
    own = x.named("ima", "img", "st")
    return (100 if own else 80) if sure >= 6 else (60 if own else 9) if sure >= 4 else 0


def loaddskf(x: Look) -> int:
    if x.be(0) not in (0xAA58, 0xAA59, 0xAA5A) or not 0xE0 <= x.le(2) <= 0xFF or x.le(4) != 512 or x.byte(10) > 2:
        return 0
    tracks = x.le(24)
    return {80: 100, 40: 60}.get(tracks, 14) if 40 <= tracks <= 85 and 1 <= x.le(26) <= 2 else 0


def ea_data(x: Look) -> int:
    return (100 if x.named(" sf") else 20 if x.zeros(2, 30) else 0) if x.starts(b"ED") else 0


def txt2com(x: Look) -> int:
    places = {0x8D: (14, (b"TXT2COM C",)), 0xE8: (5, (b"TXT2COM C",)), 0xE9: (3, (b"TXT2COM C", b"TXT2RES C", b"TXT2PAS C"))}
    place, names = places.get(x.byte(0), (0, ()))
    return 92 if x.size <= COM_MOST and x.at(place, 9) in names else 0


def show_gmr(x: Look) -> int:
    return 100 if x.size <= COM_MOST and x.byte(0) == 0xE9 and x.tail.endswith(b"\x1a") and x.holds(4, b"\0\x1f\xa0\0\0SHOW") else 0


def grasp_font(x: Look) -> int:
    n, unit = x.byte(2) or 256, x.byte(6)
    return 100 if x.named("set", "fnt") and x.le(0) == x.size == 7 + n * unit else 0


def gem_font(x: Look) -> int:
    if not x.named("fnt", "gft"):
        return 0
    start, wide, high = x.le(76, 4), x.le(80), x.le(82)
    end, usual = start + wide * high, x.holds(62, b"UUUU")
    if start < 88 or not wide or not high or end > x.size:
        return 0
    return (100 if usual else 70) if end == x.size else 25 if usual else 0


def x_face(x: Look) -> int:
    told = x.head[:7].lower() == b"x-face:"
    return (100 if x.named("xface") else 80) if told else 5 if x.named("xface") else 0


def desk_icon(x: Look) -> int:
    return (90 if x.named("icn", "tbi") and x.byte(2) in (0, 3, 255) else 14) if x.size == 515 and x.starts(b"\x1f\x1f") else 0


def pixfolio(x: Look) -> int:
    n = x.le(369)
    date = x.byte(0) >= 0x20 and x.named("cat") and x.at(345, 1) in (b"/", b"-") and x.at(356, 1) == b":"
    return 80 if date and x.le(374 + n, 4) == 40 and x.le(386 + n) == 1 else 0


def pixit(x: Look) -> int:
    if x.byte(0) == 0x50:
        return 90 if x.size == 64_784 and x.holds(1, b"\x58\x40\x01\xc8\0") else 0
    return 100 if 800 <= x.size <= COM_MOST and x.starts(b"\xbc\0\1\xb8\x13\0\xcd\x10") and x.byte(17) == 0xBA and x.holds(x.le(18) - 272, b"PX") else 0


def mahjongg_vga(x: Look) -> int:
    mark = b"\xa6\x05\x2b\x00\x3b"
    return 91 if 1446 <= x.size <= 1536 and x.starts(mark) else 90 if 63_904 <= x.size <= 64_000 and x.holds(96, mark) else 0


def sgi(x: Look) -> int:
    return 60 if x.size >= 513 and x.be(0) == 474 and x.byte(2) <= 1 and 1 <= x.byte(3) <= 2 and x.be(4) <= 4 and x.be(10) <= 4 else 0


def dgi(x: Look) -> int:
    if x.size < 64_008 or not x.named("dgi") and x.size != 64_008 or x.far["dgi"] != b"\1\4\0\0\0\0\0\0":
        return 0
    return 100 if x.named("dgi") and x.size == 64_008 else 20


def storyboard(x: Look) -> int:
    if x.size < 1856 or x.byte(2) != 0xC1 or x.byte(0) not in (0, 0x54):
        return 0
    own, version = x.named("pic", "cap"), x.byte(1)
    if version == 0x84:
        return (90 if own else 50) if x.byte(3) in (1, 3, 7, 8) else 0
    return (51 if own else 11) if version in (0x85, 0x86) else 0


def tc_trs80(x: Look) -> int:
    name, following = x.at(1, 11), x.be(15, 3) + 19
    if x.byte(0) != 1 or x.byte(14) != 1 or x.byte(18) >= 2 or any(b < 32 for b in name) or name[:1] == b" " or x.byte(13) not in (0, 255):
        return 0
    if following >= x.size or x.byte(following) not in (0, 2) or x.byte(following) and following + 20 > x.size:
        return 0
    return 75 if x.named("arc", "tc") else 15


def ea_archive(x: Look) -> int:
    size = x.byte(29)
    return (100 if size == 48 else 45) if x.starts(b"\x1aEA") and not x.byte(15) and x.byte(20) <= 1 and size >= 30 else 0


def ar001(x: Look) -> int:
    size = x.le(0)
    if not 19 <= size <= 1042 or x.size < size + 8 or x.le(2) > 1 or x.byte(4) or x.le(4 + size):
        return 0
    if any(not 32 <= b < 127 for b in x.at(20, size - 18)):
        return 0
    return 91 if crc16_sdlc(x.at(2, size)) == x.le(2 + size) else 0


def bennet_yee(x: Look) -> int:
    return 100 if x.starts(b"!!") and 6 + x.be(4) * ((x.be(2) + 15) // 16) * 2 == x.size else 0


def qdv(x: Look) -> int:
    return (100 if x.named("qdv") else 30) if 8 + 3 * x.byte(4) + x.be(0) * x.be(2) == x.size else 0


def pegasus_pic2(x: Look) -> int:
    return 87 if x.starts(b"PIC2\1") and 4 <= x.le(5, 4) <= 32 else 0


def jigsaw(x: Look) -> int:
    start, info = x.le(10, 4), x.le(14, 4)
    return 95 if x.starts(b"JG") and x.le(2, 4) <= x.size and 12 <= info <= 256 and start >= 14 + info else 0


def windows1_icon(x: Look) -> int:
    kind, w, h = x.byte(0), x.le(6), x.le(8)
    if kind not in (1, 3) or x.byte(1) > 2 or not (16 <= w <= 256 and 16 <= h <= 256) or x.le(10) != (w + 15) // 16 * 2:
        return 0
    own = x.named("cur" if kind == 3 else "ico")
    return 100 if own and w == h and w in (32, 64) else 70 if own else 6


def boot_logo(x: Look) -> int:
    expected = 32
    for i in range(4):
        place, size = x.le(8 * i, 4), x.le(8 * i + 4, 4)
        if place != expected or size < 2:
            return 0
        expected += size
    return 55 if expected == x.size else 0


def artworx(x: Look) -> int:
    palette = x.at(1, 192)
    if x.byte(0) != 1 or not x.named("adf") or max(palette) > 0x3F or not any(palette):
        return 0
    if x.sauce and (x.sauce[0] not in (0, 1) or x.sauce[0] == 1 and 2 <= x.sauce[1] <= 8):
        return 0
    end = int.from_bytes(x.tail[-38:-34], "little") if x.sauce else x.size
    if not 4449 <= end <= x.size:
        return 0
    whole, font = (end - 4289) % 160 == 0, x.zeros(705, 16) and not x.zeros(1233, 16)
    return 85 if whole and x.sauce else 70 if whole and font else 28 if whole else 18 if font else 0


def dl_maker(x: Look) -> int:
    version = x.byte(0)
    if not x.named("dl") or version not in (1, 2, 3) or version == 2 and x.byte(1) > 2:
        return 0
    screens, control, head = {1: (x.byte(21), x.le(22), 792), 2: (x.byte(42), 2 * x.le(43, 4), 815), 3: (x.byte(132), 2 * x.le(134), 906)}[version]
    size = head + control + screens * (5 if version == 3 else 64_000)
    if not screens or not control or x.size < size:
        return 0
    return 10 if version == 3 else 90 if x.size == size else 10 if x.size <= size + 511 else 0


def dos_backup(x: Look) -> int:
    mark, name, part = x.byte(0), x.byte(83), x.le(1)
    if x.size < 128 or mark not in (0, 255) or x.at(5, 1) not in (b"\\", b"/") or not 1 <= part <= 255 or x.le(3) or not 3 <= name <= 78:
        return 0
    if x.byte(3 + name) < 33 or not x.zeros(4 + name, 79 - name) or not x.zeros(84, 44):
        return 0
    return 45 if mark == 255 and part == 1 else 29


def comic_chat(x: Look) -> int:
    kind, two, four = x.be(0), x.le(2), x.le(4)
    if not (kind == 0x8100 and four == 1 and two in (1, 2) or kind == 0x8181 and four == 2 and 1 <= two <= 3):
        return 0
    return {2: 100, 1: 55, 0: 35}[x.tail.endswith(b"\x07\0") + x.named("avb", "bgb")]


def disk_express(x: Look) -> int:
    major, minor, method = x.byte(2), x.byte(3), x.byte(10)
    if x.size < 515 or not x.starts(b"AS") or (major, minor) not in ((1, 1), (1, 4), (2, 0), (2, 30)) or x.at(4, 1) not in b" Aa" or method not in (0, major):
        return 0
    return 95 if major == 2 else 45


def hfs(x: Look) -> int:
    block = x.be(1044, 4)
    return (90 if x.named("hfs") else 15) if x.holds(1024, b"BD") and block and block % 512 == 0 else 0


def jfx(x: Look) -> int:
    end = 12 + x.le(8, 4)
    if not x.starts(b"JFX1") or x.le(4, 4) > 50_000_000 or end > x.size or end <= x.size - 64 and x.holds(-12, b"JPK1"):
        return 0
    return 100 if end == x.size else 50


def iff(x: Look) -> int:
    if x.starts(b"AT&TFORM"):
        return 100
    if x.starts(b"FOR4"):
        return 25
    if x.be(4, 4) >= 0x20202020 and x.size < 0x20000000:
        return 0
    return 9 if x.starts(b"FORM") else (19 if x.holds(12, b"FORM") else 9) if x.starts(b"CAT ") else 0


def riff(x: Look) -> int:
    return 50 if x.starts(b"RIFF", b"XFIR", b"RIFX") and (x.le(4, 4) or x.size == 8) else 0


def tar(x: Look) -> int:
    if not x.named("tar"):
        return 0
    if x.holds(257, b"ustar"):
        return 100
    if x.holds(508, b"tar\0"):
        return 90
    told = x.at(148, 8)
    if any(b not in b"01234567 " for b in told[:6]) or not told[:6].strip():
        return 0
    return 60 if told[6:] == b"\0 " else 15 if told[6:] == b" \0" else 0


def tim(x: Look) -> int:
    return (100 if x.named("tim") else 15) if x.starts(b"\x10\0\0\0") and x.le(4, 4) in (0, 1, 2, 3, 8, 9) else 0


def yes(test: Callable[[Look], bool], confidence: int) -> Callable[[Look], int]:
    return lambda x: confidence if test(x) else 0


#: Format: its place in the order of registration, and its probe.
PROBES: dict[str, tuple[int, Callable[[Look], int]]] = {
    "bmp": (3, bmp), "icns": (16, icns), "pcx": (18, pcx), "wmf": (20, wmf), "pic_cat_sp": (24, catalogue(b"CLIP")), "tplt_cat_sp": (25, catalogue(b"TPLT")), "riff": (30, riff), "iff": (31, iff),
    "tar": (36, tar), "pcpaint": (37, pcpaint), "mpegaudio": (42, mpeg_audio), "car_lha": (49, car_lha), "lha": (50, lha), "zoo_filter": (57, zoo_filter), "binhex": (59, binhex),
    "cs_ilbm": (63, yes(lambda x: x.starts(b"MROF") and x.byte(7) < 0x20 and x.holds(8, b"MBLI"), 100)), "pnm": (67, pnm), "wri": (70, write_document), "tga": (80, tga), "dwc": (81, dwc), "pict": (84, pict),
    "arj": (88, arj), "amiga_adf": (93, amiga_disk), "apple2_dsk": (95, apple2_disk), "ansiart": (100, ansi_art), "bintext": (101, yes(lambda x: bool(x.sauce) and x.sauce[0] == 5, 100)),
    "gemraster": (109, gem_raster), "fnt": (112, yes(lambda x: x.named("fnt") and x.le(0) in (0x100, 0x200, 0x300), 10)), "uuencode": (113, uuencode),
    "binscii": (115, yes(lambda x: x.named("bsc", "bsq") and b"FiLeStArTfIlEsTaRt" in x.head, 35)), "hpicn": (116, hp_icon),
    "nsl": (125, lambda x: (100 if x.named("nsl") else 10) if x.starts(b"FORM") and x.be(4) + 6 == x.size else 0), "abk": (126, amos_bank),
    "stos_pp1": (128, stos_named("pp1", 1)), "stos_pp2": (129, stos_named("pp2", 1)), "stos_pp3": (130, stos_named("pp3", 1)), "stos_daj": (131, stos_named("daj", 0, 1)),
    "stos": (132, yes(lambda x: stos_screen(x) is not None, 99)), "awbm": (136, award_logo), "graspgl": (141, grasp_archive), "zlib": (143, zlib_stream), "tim": (145, tim),
    "drhalocut": (146, drhalo_cut), "xwd": (148, xwd), "cserve_rle": (150, compuserve_rle), "lotus_mscr": (151, lotus_screen), "corel_clb": (157, corel_library), "iso9660": (162, iso9660), "spark": (163, spark),
    "arc": (164, arc), "arcmac": (165, arc_mac), "cpshrink": (170, yes(lambda x: x.named("cpz") and 1 <= x.le(0, 4) <= 0xFFFF and x.byte(27) <= 2, 25)), "qip": (172, qip), "gxlib": (174, genus_library),
    "cmz": (177, cmz), "pcshrink": (178, pcshrink), "lif_kdc": (181, lif), "ain": (182, ain), "bsave": (194, bsave), "xpuzzle": (195, xpuzzle), "alias_pix": (200, alias_pix), "packdir": (203, packdir),
    "fontedit": (213, font_edit), "bob": (216, sized_image("bob", 768, 1, 100)), "mswordscr": (220, word_screen), "pcx2com": (221, pcx_program), "macbinary": (247, macbinary),
    "tinystuff": (236, yes(lambda x: x.byte(0) <= 5 and x.named("tny", "tn1", "tn2", "tn3", "tn4"), 8)), "spectrum512c": (239, yes(lambda x: x.starts(b"SP\0\0") and not x.named("sps"), 10)),
    "degas": (235, yes(lambda x: x.extension in ("pi1", "pi2", "pi3", "pc1", "pc2", "pc3") and x.be(0) <= 2 and x.size > 16_000, 10)),
    "iptc": (244, yes(lambda x: x.byte(0) == 0x1C and 1 <= x.byte(1) <= 15 and x.named("iptc"), 60)), "printshop": (249, printshop),
    "newprintshop": (250, lambda x: (90 if x.size % 572 == 10 else 10) if x.named("pog") else 0), "rosprite": (254, ro_sprites), "palmdb": (256, palm_database), "macrsrc": (257, mac_resources),
    "pif": (258, pif), "fat": (260, fat), "loaddskf": (261, loaddskf), "ea_data": (262, ea_data), "txt2com": (263, txt2com), "show_gmr": (264, show_gmr), "graspfont": (272, grasp_font),
    "gemfont": (273, gem_font), "xface": (274, x_face), "mdesk_icn": (275, desk_icon), "pixfolio": (282, pixfolio), "pixit": (284, pixit), "mjvga": (289, mahjongg_vga), "sgiimage": (307, sgi), "dgi": (308, dgi),
    "storyboard": (310, storyboard), "dclimplode": (313, dcl_implode), "tc_trs80": (321, tc_trs80), "ea_arch": (322, ea_archive), "macpaint": (326, macpaint), "ar001": (327, ar001), "ybm": (330, bennet_yee),
    "qdv": (331, qdv), "pegasus_pic2": (345, pegasus_pic2), "fpaint_pi9": (337, yes(lambda x: x.named("pi4", "pi9") and x.size == 77_824 and not any(x.tail), 60)), "jigsaw_wk": (348, jigsaw),
    "win1ico": (349, windows1_icon), "os2bootlogo": (350, boot_logo), "artworx_adf": (351, artworx), "lumena_cel": (352, lambda x: max(sized_image("cel", 0, u, 25)(x) for u in (2, 4))),
    "bld": (354, yes(lambda x: x.byte(2) < 0x80 and x.named("bld"), 20)), "dlmaker": (357, dl_maker), "dosbackup20": (360, dos_backup), "comicchat": (361, comic_chat), "dskexp": (362, disk_express),
    "nrg": (363, yes(lambda x: x.named("nrg") and (x.holds(-8, b"NERO") or x.holds(-12, b"NER5")), 85)), "cd_raw": (365, raw_disc), "hfs": (366, hfs),
    "hs2": (371, yes(lambda x: x.named("hs2") and x.size > 0 and x.size % 105 == 0, 15)), "jfx1": (376, jfx), "xxencode": (379, xxencode),
}

ANSWERS = "array<struct<confidence:int,before:int,format:string>>"


def answers(look: Look, probes: dict[str, tuple[int, Callable[[Look], int]]]) -> Iterator[tuple[int, int, str]]:
    for name, (order, probe) in probes.items():
        if sure := probe(look):
            yield sure, -order, name


def probed(probes: dict[str, tuple[int, Callable[[Look], int]]], content: str = "content", path: str = "path") -> Column:
    """What probes say of each blob: an array of struct (confidence, before, format). Only the bytes that they look at pass to Python."""

    @F.pandas_udf(ANSWERS)
    def each(paths: pd.Series, sizes: pd.Series, heads: pd.Series, tails: pd.Series, far: pd.DataFrame) -> pd.Series:
        out = []
        for path_, size, head, tail, *others in zip(paths, sizes, heads, tails, *(far[c] for c in far), strict=True):
            look = Look(path_, int(size or 0), head or b"", tail or b"", dict(zip(FAR, others, strict=True)))
            out.append([dict(confidence=a, before=b, format=c) for a, b, c in answers(look, probes)])
        return pd.Series(out)

    blob, size = F.coalesce(F.col(content), F.lit(b"")), F.octet_length(F.coalesce(F.col(content), F.lit(b"")))
    tail = F.substring(blob, F.greatest(size - TAIL, F.lit(0)) + 1, F.lit(TAIL))
    placed = {name: (F.lit(place) if isinstance(place, int) else place(content), n) for name, (place, n) in FAR.items()}
    far = [F.when(place + n <= size, raw(blob, place, n)).otherwise(F.lit(b"")).alias(f"far{i}") for i, (place, n) in enumerate(placed.values())]
    return each(F.col(path), size, F.substring(blob, 1, HEAD), tail, F.struct(*far))
