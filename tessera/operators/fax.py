"""Fax codes of ITU-T T.4 and T.6: runs of white and black pixels, one line at a time or by the line above."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import chain
from operator import le

import numpy as np

from tessera.operators.codecs import Bits

# Codes of runs of 0 to 63 pixels, then of 64, 128 and so on up to 1728.
WHITE = """
    00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000
    00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011
    01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
    11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011
    010011000 010011001 010011010 011000 010011011
"""
BLACK = """
    0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000
    00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110
    000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111
    000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
    0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011
    0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
"""
#: Of both colours, runs of 1792, 1856 and so on.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
#: Of lines by the line above: pass, horizontal, or how far the change lies to the right of that above.
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def run_codes(text: str) -> dict[str, int]:
    runs = [*range(64), *range(64, 1729, 64)]
    return dict(zip(text.split(), runs, strict=True)) | dict(zip(LONG.split(), range(1792, 2561, 64), strict=True))


RUNS = (run_codes(WHITE), run_codes(BLACK))


#: The tables that lines are read by.
TABLES = {id(table): table for table in (*RUNS, MODES)}


@lru_cache
def lookup(which: int, most: int) -> list[tuple[int, object]]:
    """Size and meaning of the code with which each most bits begin; size 0: none."""
    out: list[tuple[int, object]] = [(0, None)] * (1 << most)
    for code, found in TABLES[which].items():
        rest = most - len(code)
        if rest >= 0:
            at = int(code, 2) << rest
            out[at : at + (1 << rest)] = [(len(code), found)] * (1 << rest)
    return out


def ordered(changes: list[int]) -> bool:
    return all(map(le, changes, changes[1:]))


class FaxReader:
    """Lines of pixels from coded data; a line is its changes of colour, beginning with white."""

    def __init__(self, data: bytes, width: int, low_first: bool = False):
        if low_first:
            data = data.translate(bytes(int(f"{b:08b}"[::-1], 2) for b in range(256)))
        self.bits, self.width = Bits(data), width

    def symbol(self, table: dict[str, int], most: int = 13):
        bits, end = self.bits, 8 * len(self.bits.data)
        if bits.have < most:
            bits.fill(most)
        # What is wrong or runs over the end is read bit by bit, as far as it goes.
        size, found = lookup(id(table), most)[bits.held >> bits.have - most]
        if size and 8 * bits.at - bits.have + size <= end:
            bits.have -= size
            bits.held &= (1 << bits.have) - 1
            return found
        code = ""
        while len(code) < most:
            code += str(bits.take(1))
            if code in table:
                return table[code]
            if bits.over:
                raise EOFError
        raise ValueError(f"no such code {code}")

    def run(self, colour: int) -> int:
        total = 0
        while True:
            part = self.symbol(RUNS[colour])
            total += part
            if part < 64:
                return total

    def plain(self) -> list[int]:
        changes, at, colour, width, bits = [], 0, 0, self.width, self.bits
        quick = [lookup(id(table), 13) for table in RUNS]
        end = 8 * len(bits.data)
        while at < width:
            if bits.have < 13:
                bits.fill(13)
            have = bits.have
            size, run = quick[colour][bits.held >> have - 13]
            if size and run < 64 and 8 * bits.at - have + size <= end:
                bits.have = have = have - size
                bits.held &= (1 << have) - 1
                at += run
            else:
                at += self.run(colour)
            changes.append(at if at < width else width)
            colour ^= 1
        return changes

    def by_line_above(self, above: list[int]) -> list[int]:
        changes: list[int] = []
        at, colour, rising = -1, 0, ordered(above)
        while at < self.width:
            # The first change above to the right of here, and of the other colour's beginning.
            if rising:
                k = bisect_right(above, at)
                k += k % 2 != colour
            else:  # damaged
                k = next((i for i, c in enumerate(above) if c > at and i % 2 == colour), len(above))
            first = above[k] if k < len(above) else self.width
            second = above[k + 1] if k + 1 < len(above) else self.width
            mode = self.symbol(MODES, 7)
            if mode == "pass":
                at = second
            elif mode == "horizontal":
                start = max(at, 0)
                a = min(start + self.run(colour), self.width)
                at = min(a + self.run(colour ^ 1), self.width)
                changes += [a, at]
            else:
                at = max(0, min(first + mode, self.width))
                changes.append(at)
                colour ^= 1
        return changes

    def end_of_line(self) -> bool:
        """Skips fill and an end of line where one stands here."""
        data, place = self.bits.data, self.bits.at * 8 - self.bits.have
        at = place
        while at < 8 * len(data):
            rest = data[at >> 3] & 0xFF >> (at & 7)
            at = (at & ~7) + 8 - rest.bit_length()
            if rest:
                break
        if at - place < 11 or at >= 8 * len(data):
            return False
        for start in range(place, at + 1, 32):
            self.bits.take(min(32, at + 1 - start))
        return True


def pixels(lines: list[list[int]], width: int, height: int) -> np.ndarray:
    """1 where black; missing lines are white."""
    out, lines = np.zeros((height, width), np.uint8), lines[:height]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.repeat(np.arange(len(lines)) * (width + 1), sizes)
    places = np.fromiter(chain.from_iterable(lines), np.int64, len(starts)) + starts
    turns = np.bincount(places, minlength=len(lines) * (width + 1)).reshape(len(lines), width + 1)
    out[: len(lines)] = np.cumsum(turns[:, :width], axis=1) & 1  # a pixel is black after an odd number of changes
    for row, changes in zip(out, lines, strict=False):
        if not ordered(changes):  # damaged
            row[:] = 0
            edges = [*changes, width]
            for a, b in zip(edges[::2], edges[1::2], strict=False):
                row[a:b] = 1
    return out


def decode_fax(data: bytes, width: int, height: int, scheme: int, options: int = 0, low_first: bool = False) -> np.ndarray:
    """Rows of 0 (white) and 1 (black). scheme: 2 (lines begin at bytes, without ends), 3 (T.4; bit 0 of options: lines by the line above too) or 4 (T.6). Damage ends the lines."""
    reader, lines, above = FaxReader(data, width, low_first), [], []
    try:
        while len(lines) < height:
            if scheme == 3:
                while reader.end_of_line():
                    pass
                above = reader.by_line_above(above) if options & 1 and not reader.bits.take(1) else reader.plain()
            elif scheme == 4:
                above = reader.by_line_above(above)
            else:
                reader.bits.take(reader.bits.have % 8)
                above = reader.plain()
            lines.append(above)
    except (ValueError, EOFError):
        pass
    return pixels(lines, width, height)
