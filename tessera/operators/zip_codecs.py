"""The older methods of ZIP files: shrink, reduce, implode; and deflate64."""

from __future__ import annotations

from tessera.operators.codecs import QUICK, Bits, Decoded, Tree, bounded, copy_back, tree_of


@bounded
def shrink(data: bytes, limit: int) -> Decoded:
    """Method 1: LZW of 9 to 13 bits, least significant first; code 256 and 1 widen codes, 256 and 2 free all strings that no other begins with."""
    bits, out, size = Bits(data, 0, False), bytearray(), 9
    parent: list[int] = [-1] * 8192  # of a string: its beginning; -1: not in use
    last = bytearray(range(256)) + bytearray(8192 - 256)
    free, before = 257, -1

    def string(code: int) -> bytes | None:
        found = bytearray()
        while code > 256:
            if parent[code] < 0 or len(found) > 8192:
                return None
            found.append(last[code])
            code = parent[code]
        found.append(code)
        return bytes(reversed(found))

    while len(out) < limit:
        code = bits.take(size)
        if bits.over:
            return Decoded(bytes(out), len(data), "unexpected end")
        if code == 256:
            order = bits.take(size)
            if order == 1 and size < 13:
                size += 1
            elif order == 2:
                begun = {p for p in parent[257:] if p > 256}
                for i in range(257, 8192):
                    if i not in begun:
                        parent[i] = -1
                free = 257
            else:
                return Decoded(bytes(out), min(bits.place, len(data)), f"bad order {order}")
            continue
        while free < 8192 and parent[free] >= 0:
            free += 1
        entry = string(code) if code < 256 or parent[code] >= 0 else None
        if entry is None:  # the string that is about to be made
            begin = string(before) if before >= 0 else None
            if begin is None:
                return Decoded(bytes(out), min(bits.place, len(data)), f"bad code {code}")
            entry = begin + begin[:1]
        if before >= 0 and free < 8192:
            parent[free], last[free] = before, entry[0]
        out += entry
        before = code
    return Decoded(bytes(out[:limit]), min(bits.place, len(data)))


@bounded
def reduce(data: bytes, limit: int, factor: int = 1) -> Decoded:
    """Methods 2 to 5 (factors 1 to 4): bytes by the sets of those that may follow each byte, then copies that the byte 144 begins."""
    bits, out = Bits(data, 0, False), bytearray()
    followers: list[list[int]] = [[] for _ in range(256)]
    for before in reversed(range(256)):
        followers[before] = [bits.take(8) for _ in range(bits.take(6))]
    if bits.over:
        return Decoded(b"", len(data), "unexpected end")
    widths = [max(1, (len(known) - 1).bit_length()) for known in followers]
    masks = [(1 << n) - 1 for n in widths]
    longest, shift = (1 << 8 - factor) - 1, 8 - factor
    at, held, have, end, last = bits.at, bits.held, bits.have, len(data), 0
    copying = length = upper = 0  # which byte of a copy comes next, and what was read of it
    append = out.append
    while len(out) < limit:
        if have < 9:
            held |= int.from_bytes(data[at : at + 4], "little") << have
            at, have = at + 4, have + 32
        known = followers[last]
        if not known:
            last = held & 255
            held >>= 8
            have -= 8
        elif held & 1:
            last = held >> 1 & 255
            held >>= 9
            have -= 9
        else:
            n = widths[last]
            place = held >> 1 & masks[last]
            last = known[place] if place < len(known) else 0
            held >>= n + 1
            have -= n + 1
        if not copying:
            if at > end and at - have // 8 > end:
                return Decoded(bytes(out), end, "unexpected end")
            if last == 144:
                copying = 1
            else:
                append(last)
        elif copying == 1:
            if last:
                length, upper = last & longest, last >> shift
                copying = 2 if length == longest else 3
            else:
                append(144)
                copying = 0
        elif copying == 2:
            length += last
            copying = 3
        else:
            copy_back(out, upper * 256 + last + 1, length + 3)
            copying = 0
    return Decoded(bytes(out[:limit]), min(at - have // 8, end))


def _stored_tree(data: bytes, at: int, symbols: int) -> tuple[Tree, int]:
    """A code by runs of lengths: number of bytes - 1, then in each byte times - 1 and length - 1."""
    n = data[at] + 1
    lengths = [size for b in data[at + 1 : at + 1 + n] for size in [(b & 15) + 1] * ((b >> 4) + 1)]
    if len(lengths) != symbols:
        raise ValueError("bad code lengths")
    return tree_of(tuple(lengths)), at + 1 + n


@bounded
def implode(data: bytes, limit: int, wide: bool = False, coded: bool = False) -> Decoded:
    """Method 6: copies from 4 or (wide) 8 KiB back, and literals plain or coded by a third tree. Code bits are stored inverted."""
    out = bytearray()
    try:
        at, literals = 0, None
        if coded:
            literals, at = _stored_tree(data, at, 256)
        lengths, at = _stored_tree(data, at, 64)
        distances, at = _stored_tree(data, at, 64)
        bits, low, least = Bits(data, at, False), 7 if wide else 6, 3 if coded else 2
        near = far = plain = None  # lookups, made when first needed: those of wrong codes are errors
        end = len(data)
        held, have, append = bits.held, bits.have, out.append
        mask, top = (1 << low) - 1, (1 << QUICK) - 1
        while len(out) < limit and (at <= end or at - have // 8 <= end):
            if have < 48:  # all bits that a copy may take, but of codes beyond QUICK
                held |= int.from_bytes(data[at : at + 8], "little") << have
                at, have = at + 8, have + 64
            if held & 1:
                held >>= 1
                have -= 1
                if literals is None:
                    append(held & 255)
                    held >>= 8
                    have -= 8
                    continue
                plain = plain or literals.table(False, 1)
                if (known := plain[held & top]) is not None:
                    held >>= known[0]
                    have -= known[0]
                    append(known[1])
                else:
                    bits.at, bits.held, bits.have = at, held, have
                    append(literals.read(bits, 1))
                    at, held, have = bits.at, bits.held, bits.have
                continue
            distance = held >> 1 & mask
            held >>= low + 1
            have -= low + 1
            far = far or distances.table(False, 1)
            if (known := far[held & top]) is not None:
                held >>= known[0]
                have -= known[0]
                upper = known[1]
            else:
                upper = distances.read(bits, 1)
                at, held, have = bits.at, bits.held, bits.have
            near = near or lengths.table(False, 1)
            if (known := near[held & top]) is not None:
                held >>= known[0]
                have -= known[0]
                length = known[1]
            else:
                bits.at, bits.held, bits.have = at, held, have
                length = lengths.read(bits, 1)
                at, held, have = bits.at, bits.held, bits.have
            if length == 63:
                length += held & 255
                held >>= 8
                have -= 8
            copy_back(out, (distance | upper << low) + 1, length + least)
        bits.at, bits.held, bits.have = at, held, have
    except (ValueError, IndexError) as e:
        return Decoded(bytes(out), len(data), str(e) or "unexpected end")
    return Decoded(bytes(out[:limit]), min(bits.place, len(data)), "unexpected end" if bits.over else None)


# Fixed value: the order in which deflate stores the lengths of the code of code lengths.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _steps(first: int, groups: int, unit: int) -> list[tuple[int, int]]:
    """Bases and extra bits that grow by one bit every unit codes, after groups codes without any."""
    out, base = [], first
    for code in range(groups):
        extra = max(0, code // unit - 1)
        out.append((base, extra))
        base += 1 << extra
    return out


@bounded
def deflate64(data: bytes, limit: int) -> Decoded:
    """Method 9: deflate with distances up to 64 KiB, and a length code of 16 bits in place of that for 258."""
    lengths = [*_steps(3, 28, 4), (3, 16)]
    distances = _steps(1, 32, 2)
    bits, out = Bits(data, 0, False), bytearray()
    try:
        while len(out) < limit:
            final, kind = bits.take(1), bits.take(2)
            if bits.over or kind == 3:
                raise ValueError("unexpected end" if bits.over else "bad block type")
            if kind == 0:
                bits.take(bits.have % 8)
                n, check = bits.take(16), bits.take(16)
                if n ^ check != 0xFFFF:
                    raise ValueError("bad stored block")
                out += bytes(bits.take(8) for _ in range(n) if not bits.over)
            else:
                if kind == 1:
                    symbols, places = tree_of((8,) * 144 + (9,) * 112 + (7,) * 24 + (8,) * 8), tree_of((5,) * 32)
                else:
                    n_symbols, n_places, n_codes = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
                    sizes = [0] * 19
                    for place in LENGTH_ORDER[:n_codes]:
                        sizes[place] = bits.take(3)
                    codes, found = Tree(sizes), []
                    while len(found) < n_symbols + n_places:
                        code = codes.read(bits)
                        found += [code] if code < 16 else [found[-1]] * (bits.take(2) + 3) if code == 16 else [0] * (bits.take(3) + 3 if code == 17 else bits.take(7) + 11)
                    symbols, places = Tree(found[:n_symbols]), Tree(found[n_symbols : n_symbols + n_places])
                quick, near, end, append, top = None, None, len(data), out.append, (1 << QUICK) - 1  # lookups are made when first needed: those of wrong codes are errors
                at, held, have = bits.at, bits.held, bits.have
                while len(out) < limit and (at <= end or at - have // 8 <= end):
                    if have < 64:
                        held |= int.from_bytes(data[at : at + 8], "little") << have
                        at, have = at + 8, have + 64
                    quick = quick or symbols.table(False)
                    if (known := quick[held & top]) is not None:
                        held >>= known[0]
                        have -= known[0]
                        symbol = known[1]
                    else:
                        bits.at, bits.held, bits.have = at, held, have
                        symbol = symbols.read(bits)
                        at, held, have = bits.at, bits.held, bits.have
                    if symbol < 256:
                        append(symbol)
                        continue
                    if symbol == 256:
                        break
                    bits.at, bits.held, bits.have = at, held, have  # what damage reports
                    base, extra = lengths[symbol - 257]
                    length = base + (held & (1 << extra) - 1)
                    held >>= extra
                    have -= extra
                    near = near or places.table(False)
                    if (known := near[held & top]) is not None:
                        held >>= known[0]
                        have -= known[0]
                        place = known[1]
                    else:
                        bits.at, bits.held, bits.have = at, held, have
                        place = places.read(bits)
                        at, held, have = bits.at, bits.held, bits.have
                    base, extra = distances[place]
                    copy_back(out, base + (held & (1 << extra) - 1), length)
                    held >>= extra
                    have -= extra
                bits.at, bits.held, bits.have = at, held, have
            if bits.over:
                raise ValueError("unexpected end")
            if final:
                break
    except (ValueError, IndexError) as e:
        return Decoded(bytes(out), min(bits.place, len(data)), str(e))
    return Decoded(bytes(out[:limit]), min(bits.place, len(data)))
