"""Several numpy arrays in one compressed binary value."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(**arrays: np.ndarray) -> bytes:
    """Unsigned 64-bit arrays, taken as sorted, are kept as differences; all are laid out byte by byte place, which compresses best.

    Before compression: the length of the head (four bytes, little-endian), the head (name:type:length of each array), the arrays.
    """
    head, planes = [], []
    for name, x in arrays.items():
        if x.dtype == np.uint64:
            name, x = f"{name}+", np.diff(x, prepend=np.uint64(0))
        elif x.dtype.kind == "i":
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
        head.append(f"{name}:{x.dtype.str}:{len(x)}")
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    said = ",".join(head).encode()
    return zstandard.compress(len(said).to_bytes(4, "little") + said + b"".join(planes), 3)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays; unsigned integers that were packed from signed ones come back as 64-bit signed."""
    data = zstandard.decompress(blob)
    at = 4 + int.from_bytes(data[:4], "little")
    found = {}
    for said in filter(None, data[4:at].decode().split(",")):
        name, kind, n = said.split(":")
        dtype, n = np.dtype(kind), int(n)
        x = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n).T.copy().reshape(-1).view(dtype)
        at += n * dtype.itemsize
        if name.endswith("+"):
            found[name[:-1]] = np.cumsum(x)
        else:
            found[name] = x.astype("i8") if dtype.kind == "u" else x
    return found
