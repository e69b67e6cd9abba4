"""Outputs written as archives, sounds and lists.

Archives are values of one row for each input, so an executor makes each in its own task; writing
them to files is left to any sink of Spark's.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times of members without one: 1980-01-01, the least that a ZIP file can say.
EARLIEST = 315_532_800


def _clock(unix: float | None) -> tuple[int, int, int, int, int, int]:
    import time

    return time.gmtime(max(EARLIEST, int(unix if unix is not None and unix == unix else EARLIEST)))[:6]


def _zip(rows: pd.DataFrame, level: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for r in rows.itertuples():
            name = r.name + ("/" if r.is_dir and not r.name.endswith("/") else "")
            info = zipfile.ZipInfo(name, _clock(r.mtime_unix))
            info.compress_type = zipfile.ZIP_STORED if r.is_dir or level == 0 else zipfile.ZIP_DEFLATED
            if not pd.isna(r.mtime_unix):
                info.extra = struct.pack("<HHBI", 0x5455, 5, 1, int(r.mtime_unix) & 0xFFFFFFFF)
            z.writestr(info, b"" if r.is_dir else r.data or b"")
    return out.getvalue()


def _tar(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for r in rows.itertuples():
            info = tarfile.TarInfo(r.name.rstrip("/") if r.is_dir else r.name)
            info.mtime = 0 if pd.isna(r.mtime_unix) else int(r.mtime_unix)
            info.type, info.mode = (tarfile.DIRTYPE, 0o755) if r.is_dir else (tarfile.REGTYPE, 0o644)
            info.size = 0 if r.is_dir else len(r.data or b"")
            t.addfile(info, io.BytesIO(r.data or b"") if not r.is_dir else None)
    return out.getvalue()


def as_archives(members: DataFrame, kind: str = "zip", level: int = 9) -> DataFrame:
    """path, content: the members of each path (columns path, file_id, name, is_dir, mtime_unix, data) as a ZIP or TAR file.

    The same members give the same bytes. An archive is one value, so it must fit in a task.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("file_id", kind="stable")
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [_zip(rows, level) if kind == "zip" else _tar(rows)]})

    if kind not in ("zip", "tar"):
        raise ValueError(f"no archives of kind {kind}")
    wanted = members.select("path", "file_id", "name", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "mtime_unix", "data")
    return wanted.groupBy("path").applyInPandas(pack, "path string, content binary")


def as_wav(content: str, rate: int, bits: int = 8, channels: int = 1):
    """PCM samples with a WAV header before them, by native functions."""
    size = F.octet_length(content)
    little = lambda value, n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n))))
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data"
    padding = F.when(size % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    return F.concat(F.lit(b"RIFF"), little(size + size % 2 + 36, 4), F.lit(head), little(size, 4), F.col(content), padding)


def apple_file(data: bytes, resource: bytes, name: str, kind: str, mtime_unix: int | None = None) -> bytes:
    """A Mac file with both forks: applesingle, appledouble (without the data fork), macbinary, or the plain resource fork (rsrc)."""
    import binascii

    raw = name.encode("mac-roman", "replace")[:63]
    if kind == "rsrc":
        return resource
    if kind == "macbinary":
        head = bytearray(128)
        head[1], head[2 : 2 + len(raw)] = len(raw), raw
        head[83:91] = struct.pack(">II", len(data), len(resource))
        head[91:99] = struct.pack(">II", *[(mtime_unix + 2_082_844_800) & 0xFFFFFFFF if mtime_unix is not None else 0] * 2)
        head[122:124] = b"\x81\x81"
        head[124:126] = struct.pack(">H", binascii.crc_hqx(bytes(head[:124]), 0))
        return bytes(head) + data + bytes(-len(data) % 128) + resource + bytes(-len(resource) % 128)
    if kind not in ("applesingle", "appledouble"):
        raise ValueError(f"no Mac files of kind {kind}")
    parts = [(3, name.encode("utf-8"))]
    if mtime_unix is not None:
        parts.append((8, struct.pack(">4i", -0x80000000, mtime_unix - 946_684_800, -0x80000000, -0x80000000)))
    parts += [(1, data)] if kind == "applesingle" else []
    parts += [(2, resource)] if resource else []
    place, table = 26 + 12 * len(parts), b""
    for number, body in parts:
        table += struct.pack(">III", number, place, len(body))
        place += len(body)
    return struct.pack(">II16xH", 0x00051600 if kind == "applesingle" else 0x00051607, 0x00020000, len(parts)) + table + b"".join(b for _, b in parts)


def as_apple_files(forks: DataFrame, kind: str) -> DataFrame:
    """path, name, content of files with the columns path, name, data, resource and mtime_unix; null forks are empty."""

    @F.pandas_udf("binary")
    def each(data: pd.Series, resource: pd.Series, name: pd.Series, when: pd.Series) -> pd.Series:
        return pd.Series([apple_file(d or b"", r or b"", n or "", kind, None if pd.isna(w) else int(w)) for d, r, n, w in zip(data, resource, name, when, strict=True)])

    return forks.select("path", "name", each("data", "resource", "name", "mtime_unix").alias("content"))


def output_list(outputs: DataFrame) -> DataFrame:
    """file_id, crc32 and size of outputs, without their bytes."""
    return outputs.select("path", "file_id", "name", F.crc32("data").alias("crc32"), F.octet_length("data").cast("long").alias("size"))
