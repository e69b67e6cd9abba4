"""Registered queries over the driver's tables, each an operator of this library on blobs, and the SQL that they equal.

Text columns count as blobs of their UTF-8 bytes. Archives and images that some queries read are
made from those texts first, so that what comes out can be held against what went in.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures
from tessera.fixtures import as_bmp, as_tar, as_zip
from tessera.functions import checksums, dates, numbers, reading, text
from tessera.operators import byteops, codecs, identify, members, rasters, screens, selection, sinks
from tessera.operators.fields import fields
from tessera.operators.parts import column_of
from tessera.sources.blobs import blobs_from_column, slice_blob


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs_from_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs_from_column(table(spark, sf_dir, "pages"), "url", "html")


def spread(blobs: DataFrame) -> DataFrame:
    """blobs dealt to all cores: decoding in Python takes far longer than moving its input, and a small table is one task."""
    return blobs.repartition(blobs.sparkSession.sparkContext.defaultParallelism, "path")


def made(work: Callable[[bytes], bytes], content: str = "content") -> Column:
    """A blob made from each blob, for queries that read what they wrote."""

    def each(blob: bytes) -> tuple[bytes, int]:
        found = work(blob)
        return found, len(found)

    return column_of(each, lambda rows: pa.array(rows, pa.binary()), "binary", content)


def byte_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byteops.byte_frequencies(docs(spark, sf_dir)).select("path", "byte", F.col("count").alias("n"), F.col("first")[0].alias("first_at"), "char")


def checksum_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = checksums.all_checksums("content")
    return docs(spark, sf_dir).select("path", sums.alias("s")).select("path", "s.sum_bytes", "s.adler32", "s.sum_u16le", "s.sum_u16be")


def checksum_crcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = checksums.all_checksums("content")
    return docs(spark, sf_dir).select("path", checksums.crc32("content").alias("crc32_native"), checksums.jamcrc("content").alias("jamcrc_native"), sums.alias("s")).select("path", "crc32_native", "jamcrc_native", "s.*")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = byteops.split_blob(pages(spark, sf_dir), 100, 128, most=None)
    return parts.select("path", "part", F.lower(F.hex("content")).alias("bytes_hex"))


def join_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return byteops.join_blobs(turns, ["conv_id"], "turn").select("conv_id", F.decode("content", "UTF-8").alias("joined"))


def xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", F.hex(byteops.xor_blob("content", "5A")).alias("bytes_hex"))


def base16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", F.hex(text.base16("content")).alias("bytes_hex"))


def hexdump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byteops.hexdump(docs(spark, sf_dir))


def rot13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rot13("text").alias("turned"))


def transcode_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", F.md5(text.transcode("content", "latin1")).alias("shown_md5"))


def identify_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = pages(spark, sf_dir).union(docs(spark, sf_dir))
    return identify.identify(blobs).select("path", F.coalesce("format", F.lit("none")).alias("format"), "confidence")


def identify_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = spread(docs(spark, sf_dir).filter(F.col("length") > 0))
    kinds = {"gzip": lambda b: gzip.compress(b, mtime=1), "zip": as_zip, "tar": as_tar, "bmp": as_bmp}
    union = None
    for name, work in kinds.items():
        one = identify.identify(blobs.select("path", made(work).alias("content"))).withColumn("made", F.lit(name))
        union = one if union is None else union.union(one)
    return union.groupBy("made", "format", "confidence").agg(F.count("*").alias("n"))


def overlay_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", F.hex(slice_blob(F.col("content"), 3, 8)).alias("bytes_hex"))


def number_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled reads at the beginnings and ends of blobs."""
    at = F.octet_length("content") - 1
    return docs(spark, sf_dir).select(
        "path", reading.u8("content", 0).cast("long").alias("first_u8"), reading.u16le("content", at).cast("long").alias("last_u16le"),
        reading.u16be("content", at).cast("long").alias("last_u16be"), reading.u32be("content", 2).alias("third_u32be"), reading.i16le("content", 1).cast("long").alias("second_i16le"),
    )


def main_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as outputs of their conversations: those of the user are auxiliary."""
    outputs = table(spark, sf_dir, "conversations").withColumn("is_aux", F.col("role") == "user")
    numbered = selection.number(selection.policy(outputs, aux=False), "conv_id", ["turn", "text"])
    return selection.take(numbered, first=1, most=2).select("conv_id", "turn", F.col("file_id").cast("long").alias("file_id"), selection.output_name(F.lit("output"), F.col("file_id"), F.lit("txt")).alias("name"))


def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "conversations").withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    numbered = selection.number(outputs, "conv_id", ["turn", "text"])
    return selection.within_size(numbered, "conv_id", "size", 400, 1_000).select("conv_id", "turn", F.col("file_id").cast("long").alias("file_id"), "size")


def unrepeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drop_repeats(table(spark, sf_dir, "documents").withColumn("h", F.md5("text")), ["h"], ["doc_id"]).select("doc_id", "h")


def changed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return selection.changed_frames(events, "user_id", "event_id", "event_type")


def date_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    date, time = (k * 7_919 % 65_536).cast("int"), (k * 104_729 % 65_536).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.from_unix(k * 86_399).alias("from_unix"), dates.from_mac(k * 99_991 + 2_000_000_000).alias("from_mac"),
        dates.from_dos(date, time).alias("from_dos"), dates.from_prodos(date, time.bitwiseAND(0x1F3F)).alias("from_prodos"),
        dates.to_unix(dates.from_filetime(k * 10_000_019 + 123_456_789_012_345_678)).alias("filetime_unix"),
    )


def colour_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 65_536
    rows = table(spark, sf_dir, "lineitem").select(value.cast("int").alias("value")).distinct()
    return rows.select("value", numbers.rgb565(F.col("value")).alias("rgb565"), numbers.bgr555(F.col("value")).alias("bgr555"), numbers.css_colour(numbers.rgb565(F.col("value"))).alias("css"),
                       numbers.pad_to(F.col("value"), 4).cast("long").alias("padded"), numbers.dos_attributes(F.col("value") % 64).alias("attributes"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name("url").alias("name"))


def _members(blobs: DataFrame, kind: str, work: Callable[[bytes], bytes]) -> DataFrame:
    found = members.members(spread(blobs).select("path", made(work).alias("content")), kind)
    return found.select("path", "file_id", "name", "orig_len", F.coalesce("crc_ok", F.lit(True)).alias("crc_ok"), F.md5("data").alias("data_md5"), "ok")


def members_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(docs(spark, sf_dir), "zip", as_zip)


def members_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(docs(spark, sf_dir), "tar", as_tar)


def members_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two gzip members each, which join into one output."""
    return _members(docs(spark, sf_dir), "gzip", lambda b: gzip.compress(b[:50], mtime=1) + gzip.compress(b[50:], mtime=1))


def _decoded(blobs: DataFrame, method: str, work: Callable[[bytes], bytes]) -> DataFrame:
    coded = spread(blobs).select("path", made(work).alias("coded"))
    return coded.select("path", codecs.decompress("coded", method).alias("d")).select("path", F.md5("d.data").alias("data_md5"), F.length("d.data").cast("long").alias("size"), "d.ok")


def decode_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def raw(data: bytes) -> bytes:
        coder = zlib.compressobj(9, zlib.DEFLATED, -15)
        return coder.compress(data) + coder.flush()

    return _decoded(docs(spark, sf_dir), "deflate", raw)


def decode_zlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(docs(spark, sf_dir), "zlib", zlib.compress)


def decode_packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with runs of one to five equal bytes."""
    return _decoded(docs(spark, sf_dir), "packbits", lambda b: fixtures.as_packbits(fixtures.stretched(b)))


def decode_rle90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(docs(spark, sf_dir), "rle90", lambda b: fixtures.as_rle90(fixtures.stretched(b)))


def _each(spark: SparkSession, sf_dir: str, kinds: dict[str, tuple[str, Callable[[bytes], bytes]]]) -> DataFrame:
    """What came out of each of several methods, by name."""
    sized = spread(docs(spark, sf_dir))
    parts = [
        sized.select("path", "length", made(work).alias("coded")).select("path", F.lit(name).alias("kind"), codecs.decompress("coded", method, F.col("length")).alias("d"))
        for name, (method, work) in kinds.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select("path", "kind", F.md5("d.data").alias("data_md5"), F.length("d.data").cast("long").alias("size"))


def decode_lzw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of LZW: least significant bit first with and without a stop code, most significant first, and up to 13 bits."""
    return _each(spark, sf_dir, {k: (m, lambda b, v=v: fixtures.as_lzw(b, v)) for k, m, v in (("compress", "lzw", "compress"), ("gif", "lzw_gif", "gif"), ("tiff", "lzw_tiff", "tiff"), ("zoo", "lzw_zoo", "zoo"))})


def decode_lha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LHA's adaptive code and its static ones."""
    return _each(spark, sf_dir, {"lh1": ("lh1", fixtures.as_lh1), "lh5": ("lh5", fixtures.as_lh), "lh6": ("lh6", lambda b: fixtures.as_lh(b, 15)), "lh7": ("lh7", lambda b: fixtures.as_lh(b, 16))})


def decode_dcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and coded literals."""
    return _each(spark, sf_dir, {"plain": ("implode_dcl", fixtures.as_dcl), "coded": ("implode_dcl", lambda b: fixtures.as_dcl(b, True, 4))})


def members_old_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member for each of ZIP's older methods: shrink, reduce, implode, deflate64 and DCL implode."""
    return _members(docs(spark, sf_dir), "zip", fixtures.old_zip)


def _archive(spark: SparkSession, sf_dir: str, kind: str, work: Callable[[bytes], bytes]) -> DataFrame:
    found = members.members(spread(docs(spark, sf_dir)).select("path", made(work).alias("content")), kind)
    return found.select("path", "file_id", "name", "is_dir", "is_aux", F.md5("data").alias("data_md5"), "ok")


def members_arj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, LH and unsupported members."""
    return _archive(spark, sf_dir, "arj", fixtures.arj_of)


def members_zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, LZW and LH members."""
    return _archive(spark, sf_dir, "zoo", fixtures.zoo_of)


def members_stuffit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and forks in RLE90, LZW and Huffman codes."""
    return _archive(spark, sf_dir, "stuffit", fixtures.stuffit_of)


def members_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir, "iso9660", fixtures.iso_of)


def members_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose clusters do not follow one another."""
    return _archive(spark, sf_dir, "fat", fixtures.fat_of)


def _pictures(blobs: DataFrame, kind: str, works: dict[str, Callable[[bytes], bytes]]) -> DataFrame:
    parts = [spread(blobs).select("path", F.lit(name).alias("how"), rasters.raster(made(work), kind).alias("r")) for name, work in works.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select("path", "how", F.col("r.width").cast("long").alias("width"), F.col("r.height").cast("long").alias("height"), F.md5("r.data").alias("data_md5"))


def rasters_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips that are plain, LZW, deflated and PackBits."""
    return _pictures(docs(spark, sf_dir), "tiff", {str(m): lambda b, m=m: fixtures.as_tiff(b, m) for m in fixtures.TIFF_PACKERS})


def rasters_fax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as black and white images in all four fax schemes."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return _pictures(turns, "tiff", {str(k): lambda b, k=k: fixtures.as_fax_tiff(b, k) for k in (2, 3, 4, 5)})


def rasters_bmp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pictures(docs(spark, sf_dir), "bmp", {"runs": fixtures.as_bmp_runs})


def jpeg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers, Exif tags and comments of JPEG files whose comments are whole texts."""
    found = fields(docs(spark, sf_dir).select("path", made(fixtures.as_jpeg).alias("content")), "jpeg")
    return found.select("path", F.array_join("node_path", "/").alias("node"), "tag", "name", F.when(F.col("tag") == "FFFE", F.md5("value")).otherwise(F.col("value")).alias("value"))


def rasters_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, as hexadecimal RGB, of images made of whole texts."""
    images = docs(spark, sf_dir).select("path", rasters.raster(made(as_bmp), "bmp").alias("r"))
    return images.select("path", F.col("r.width").cast("long").alias("width"), F.col("r.height").cast("long").alias("height"), F.md5("r.data").alias("data_md5"))


def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of PNG files that are encoded from decoded images."""
    images = docs(spark, sf_dir).select("path", rasters.raster(made(as_bmp), "bmp").alias("raster"))
    return fields(images.select("path", rasters.png_of(images).alias("content")), "png").select("path", "tag", F.when(F.col("tag") == "IHDR", F.regexp_extract("value", r"width=(\d+) height=(\d+)", 0)).alias("size"))


def archives_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation packed as a ZIP file of its turns, and read again."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("file_id"), F.concat(F.col("turn").cast("string"), F.lit(".txt")).alias("name"),
        F.lit(False).alias("is_dir"), F.lit(1_000_000_001).cast("long").alias("mtime_unix"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
    )
    found = members.members(sinks.as_archives(turns), "zip")
    return found.select("path", "name", "mtime_unix", "crc_ok", F.md5("data").alias("data_md5"))


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("path", F.hex(sinks.as_wav("content", 8_000)).alias("bytes_hex"))


def decode_lzss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(docs(spark, sf_dir), "lzss", fixtures.as_lzss)


def decode_hlp_lz77(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(docs(spark, sf_dir), "hlp_lz77", fixtures.as_hlp_lz77)


def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that hold, not only the best one, for TAR files."""
    made_blobs = spread(docs(spark, sf_dir)).select("path", made(as_tar).alias("content"))
    return identify.detections(made_blobs).select("path", "format", "confidence")


def text_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, with blanks for control characters, as character screens of 80 columns, and their lines again."""
    plain = spread(docs(spark, sf_dir)).select("path", F.encode(F.regexp_replace(F.decode("content", "UTF-8"), "[\\x00-\\x1F\\x7F]", " "), "UTF-8").alias("content"))
    return screens.screen_lines(screens.cells(plain, "ansiart")).select("path", "row", F.md5("line").alias("line_md5"))


def screen_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ANSI art, each in a colour by its turn, bright for the user; how many cells have which colours."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E]", "").alias("t"))
    order = F.concat(F.lit("\x1b["), F.when(F.col("role") == "user", "1;").otherwise("0;"), (F.col("turn") % 8 + 30).cast("string"), F.lit(";4"), (F.col("turn") * 3 % 8).cast("string"), F.lit("m"))
    found = screens.cells(turns.select("path", F.encode(F.concat(order, "t"), "UTF-8").alias("content")), "ansiart")
    return found.groupBy("path", "fg", "bg").agg(F.count("*").alias("cells"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        identify_best, byte_frequencies, checksum_sums, checksum_crcs, split, join_turns, xor, base16, hexdump, rot13, transcode_latin1, identify_made, overlay_and_slice, number_reads, main_outputs,
        size_limits, unrepeated, changed_turns, date_conversions, colour_conversions, safe_names, members_zip, members_tar, members_gzip, decode_deflate, decode_zlib, decode_packbits, decode_rle90, rasters_bmp, png_chunks,
        archives_of_turns, wav_files, decode_lzss, decode_hlp_lz77, all_detections, text_screens, screen_colours, decode_lzw, decode_lha, decode_dcl, members_old_zip,
        members_arj, members_zoo, members_stuffit, members_iso, members_fat, rasters_tiff, rasters_fax, rasters_bmp_runs, jpeg_segments,
    )
}

DOC = "select cast(doc_id as varchar) as path, coalesce(text, '') as t from documents"
#: Texts with the digits of their UTF-8 bytes (h) and the number of bytes (n); the bytes as a list of numbers.
HEX = f"select path, t, hex(encode(t)) as h, octet_length(encode(t)) as n from ({DOC})"
BYTES = "list_transform(regexp_extract_all(h, '..'), lambda d: ('0x' || d)::int::bigint)"
#: What fixtures.stretched makes of a text, as digits.
STRETCHED = "array_to_string(list_transform(regexp_extract_all(h, '..'), lambda d: repeat(d, 1 + ('0x' || d)::int % 5)), '')"


def crc_sql(table: list[int], first: int, step: str) -> str:
    """A fold over the bytes x from first on; step tells the next remainder from the last one c, a byte b and the table t."""
    return f"list_reduce(list_prepend({first}::bigint, x), lambda c, b: {step.replace('t[', f'({table}::bigint[])[')})"


def remainders(polynomial: int, reflected: bool) -> list[int]:
    """The remainder of each byte value: of a reflected polynomial, or of one of 16 bits."""
    out = []
    for value in range(256):
        value = value if reflected else value << 8
        for _ in range(8):
            if reflected:
                value = value >> 1 ^ (polynomial if value & 1 else 0)
            else:
                value = value << 1 & 0xFFFF ^ (polynomial if value & 0x8000 else 0)
        out.append(value)
    return out


REFLECTED, PLAIN = "xor(c >> 8, t[(xor(c, b) & 255) + 1])", "xor((c << 8) & 65535, t[xor(c >> 8, b) + 1])"
#: The character that a DOS screen shows for bytes from 7F on.
UPPER_HALF = "⌂ÇüéâäàåçêëèïîìÄÅÉæÆôöòûùÿÖÜ¢£¥₧ƒáíóúñÑªº¿⌐¬½¼¡«»░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀αßΓπΣσµτΦΘΩδ∞φε∩≡±≥≤⌠⌡÷≈°∙·√ⁿ²■\xa0"
#: Days from 1970 to a date whose day of the month rolls over.
DAYS = "cast(date_diff('day', date '1970-01-01', make_date(cast({y} as int), cast({m} as int), 1)) + {d} - 1 as bigint)"
#: A number as four bytes in hexadecimal, least first.
LITTLE = "printf('%02X%02X%02X%02X', {0} % 256, {0} // 256 % 256, {0} // 65536 % 256, {0} // 16777216)"
FT = "(cast({s} as bigint) + 11644473600) * 10000000"


def whole(extra: str = "") -> str:
    return f"select path, md5(t) as data_md5, octet_length(encode(t)) as size, true as ok{extra} from ({DOC})"


def listed(members_: list[tuple[str, bool, bool, str, bool]]) -> str:
    """A row for each document and member: its name, whether it is a folder or auxiliary, the SQL of its data's digest (null: none), and whether it could be read."""
    return " union all ".join(f"select path, cast({i} as int) as file_id, '{name}' as name, {folder} as is_dir, {aux} as is_aux, cast({digest} as varchar) as data_md5, {ok} as ok from ({HEX})" for i, (name, folder, aux, digest, ok) in enumerate(members_))


RSRC = "md5('" + "rsrc" * 9 + "')"
#: The digits of a text's bytes, zero-filled to whole rows of a number of bytes.
ROWS_OF = "rpad(h, cast(greatest(1, (n + {0} - 1) // {0}) * 2 * {0} as int), '0')"

ORACLE_SQL: dict[str, str] = {
    "members_arj": listed([("dir/a", False, False, "md5(t)", True), ("b", False, False, "md5(t)", True), ("c", False, False, "null", False)]),
    "members_zoo": listed([(name, False, False, "md5(t)", True) for name in "abc"]),
    "members_stuffit": listed([("folder", True, False, "null", True), ("folder/a", False, True, RSRC, True), ("folder/a", False, False, "md5(t)", True), ("b", False, False, "md5(t)", True)]),
    "members_iso": listed([("A.TXT", False, False, "md5(t)", True), ("SUB", True, False, "null", True), ("SUB/B", False, False, "md5(unhex(substr(rpad(h, cast(greatest(n, 5) * 2 as int), '0'), 1, 10)))", True)]),
    "members_fat": listed([("a long name.txt", False, False, "md5(t)", True), ("SUB", True, False, "null", True), ("SUB/B.BIN", False, False, "md5('abc')", True)]),
    "rasters_tiff": f"select path, how, 16 as width, length(r) // 96 as height, md5(unhex(r)) as data_md5 from (select path, {ROWS_OF.format(48)} as r from ({HEX})), (values ('1'), ('5'), ('8'), ('32773')) v(how)",
    "rasters_fax": f"""select path, how, 128 as width, length(r) // 32 as height, md5(unhex(array_to_string(list_transform(regexp_extract_all(r, '.'), lambda d: (['FFFFFFFF', 'FFFFFF00', 'FFFF00FF', 'FFFF0000', 'FF00FFFF', 'FF00FF00', 'FF0000FF', 'FF000000',
        '00FFFFFF', '00FFFF00', '00FF00FF', '00FF0000', '0000FFFF', '0000FF00', '000000FF', '00000000'])[('0x' || d)::int + 1]), ''))) as data_md5
        from (select path, {ROWS_OF.format(16)} as r from (select conv_id || '/' || turn as path, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from conversations)), (values ('2'), ('3'), ('4'), ('5')) v(how)""",
    "rasters_bmp_runs": f"select path, 'runs' as how, 64 as width, length(r) // 128 as height, md5(unhex(regexp_replace(r, '(..)', '\\1\\1\\1', 'g'))) as data_md5 from (select path, {ROWS_OF.format(64)} as r from ({HEX}))",
    "jpeg_segments": f"""with k as (select path, t, n, cast((n + 59999) // 60000 as int) as c from ({HEX}))
        select path, '0' as node, 'FFD8' as tag, 'SOI' as name, cast(null as varchar) as value from k union all select path, '1', 'FFE1', 'APP1', 'Exif' from k union all select path, '1/0/0', '256', 'ImageWidth', cast(n as varchar) from k
        union all select path, '1/0/1', '257', 'ImageLength', '7' from k
        union all select path, cast(2 + i as varchar), 'FFFE', 'COM', md5(array_to_string(list_transform(regexp_extract_all(substr(h, 120000 * i + 1, 120000), '..'), lambda d: chr(('0x' || d)::int)), '')) from (select *, unnest(range(0, (n + 59999) // 60000)) as i from ({HEX}))
        union all select path, cast(2 + c as varchar), 'FFC0', 'SOF0', 'precision=8 height=20 width=30 components=3' from k union all select path, cast(3 + c as varchar), 'FFD9', 'EOI', null from k""",
    "identify_best": f"""select path, max(f).n as format, max(f).c as confidence from (
        select path, unnest(list_filter([{{'c': 0, 'before': 0, 'n': 'none'}}, case when starts_with(t, '<!DOCTYPE html') or starts_with(t, chr(65279) || '<!DOCTYPE html') or starts_with(t, '<html') then {{'c': 20, 'before': -402, 'n': 'html'}} end,
            case when n > 1 and v % 16 = 8 and v between 8 and 120 and (v * 256 + w) % 31 = 0 then {{'c': 50, 'before': -143, 'n': 'zlib'}} end, case when starts_with(t, 'WL') then {{'c': 6, 'before': -156, 'n': 'cdr_wl'}} end,
            case when starts_with(t, 'CI') or starts_with(t, 'CP') or starts_with(t, 'PT') then {{'c': 20, 'before': -38, 'n': 'os2bmp'}} when starts_with(t, 'BA') or starts_with(t, 'IC') then {{'c': 10, 'before': -38, 'n': 'os2bmp'}} end], lambda x: x is not null)) as f
        from (select *, coalesce(('0x' || nullif(substr(h, 1, 2), ''))::int, 0) as v, coalesce(('0x' || nullif(substr(h, 3, 2), ''))::int, 0) as w from ({HEX} union all select url, t, hex(encode(t)), octet_length(encode(t)) from (select url, coalesce(html, '') as t from pages)))) group by path""",
    "byte_frequencies": f"""select path, cast(v as int) as byte, count(*) as n, min(i) as first_at, case when v between 32 and 126 then chr(cast(v as int)) end as char
        from (select path, unnest({BYTES}) as v, unnest(range(0, n)) as i from ({HEX})) group by path, v""",
    "checksum_sums": f"""select path, cast(list_sum(x) as bigint) as sum_bytes,
        cast(((n + list_sum(list_transform(x, lambda v, i: (n - i + 1) * v))) % 65521) * 65536 + (1 + list_sum(x)) % 65521 as bigint) as adler32,
        cast(list_sum(list_transform(x, lambda v, i: case when i % 2 = 1 then v else 256 * v end)) as bigint) as sum_u16le, cast(list_sum(list_transform(x, lambda v, i: case when i % 2 = 0 then v else 256 * v end)) as bigint) as sum_u16be
        from (select path, {BYTES} as x, n from ({HEX}) where n > 0)
        union all select path, 0, 1, 0, 0 from ({DOC}) where t = ''""",
    "checksum_crcs": f"""select path, xor(c, 4294967295) as crc32_native, c as jamcrc_native, xor(c, 4294967295) as crc32_ieee, c as crc32_jamcrc, {crc_sql(remainders(0xEDB88320, True), 0, REFLECTED)} as crc32_pl,
        {crc_sql(remainders(0xA001, True), 0, REFLECTED)} as crc16_arc, {crc_sql(remainders(0x1021, False), 0, PLAIN)} as crc16_xmodem, {crc_sql(remainders(0x1021, False), 0xFFFF, PLAIN)} as crc16_ibm3740,
        xor({crc_sql(remainders(0x8408, True), 0xFFFF, REFLECTED)}, 65535) as crc16_ibmsdlc, cast((n + coalesce(list_sum(list_transform(x, lambda v, i: (n - i + 1) * v)), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(x), 0)) % 65521 as bigint) as adler32,
        cast(coalesce(list_sum(x), 0) as bigint) as sum_bytes, cast(coalesce(list_sum(list_transform(x, lambda v, i: case when i % 2 = 1 then v else 256 * v end)), 0) as bigint) as sum_u16le,
        cast(coalesce(list_sum(list_transform(x, lambda v, i: case when i % 2 = 0 then v else 256 * v end)), 0) as bigint) as sum_u16be
        from (select *, {crc_sql(remainders(0xEDB88320, True), 0xFFFFFFFF, REFLECTED)} as c from (select path, n, {BYTES} as x from ({HEX})))""",
    "split": """select path, cast(i // 128 as int) as part, lower(substr(h, 2 * i + 1, 200)) as bytes_hex
        from (select path, h, unnest(range(0, length(h) // 2, 128)) as i from (select url as path, hex(encode(coalesce(html, ''))) as h from pages))""",
    "join_turns": "select conv_id, string_agg(coalesce(text, ''), '' order by turn) as joined from conversations group by conv_id",
    "xor": f"""select path, coalesce(array_to_string(list_transform({BYTES}, lambda v: printf('%02X', xor(v, 90))), ''), '') as bytes_hex from ({HEX})""",
    "base16": f"""select path, substr(d, 1, length(d) - length(d) % 2) as bytes_hex from (select path, upper(regexp_replace(t, '[^0-9A-Fa-f]', '', 'g')) as d from ({DOC}))""",
    "hexdump": f"""select path, cast(r as int) as row, lpad(cast(16 * r as varchar), cast(length(cast((n - 1) // 16 * 16 as varchar)) as int), ' ') || ': '
        || rpad(rtrim(lower(regexp_replace(piece, '(..)', '\\1 ', 'g'))), 47, ' ') || '  '
        || array_to_string(list_transform(regexp_extract_all(piece, '..'), lambda d: case when ('0x' || d)::int between 32 and 126 then chr(('0x' || d)::int) else '.' end), '') as line
        from (select path, n, unnest(regexp_extract_all(h, '.{{1,32}}')) as piece, unnest(range(0, (n + 15) // 16)) as r from ({HEX}))""",
    "rot13": "select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') as turned from documents",
    "transcode_latin1": f"""select path, md5(coalesce(array_to_string(list_transform({BYTES}, lambda v: chr(cast(v as int))), ''), '')) as shown_md5 from ({HEX}) where not starts_with(t, chr(65279))
        union all select path, md5(substr(t, 2)) from ({DOC}) where starts_with(t, chr(65279))""",
    "identify_made": f"select m.made, m.made as format, m.c as confidence, count(*) as n from ({DOC}) d, (values ('gzip', 100), ('zip', 100), ('tar', 90), ('bmp', 100)) m(made, c) where t <> '' group by all",
    "overlay_and_slice": f"select path, case when n >= 11 then substr(h, 7, 16) end as bytes_hex from ({HEX})",
    "number_reads": f"""select path, ('0x' || substr(f, 1, 2))::bigint as first_u8, case when n = 0 then 0 else ('0x' || substr(f, 2 * n - 1, 2))::bigint end as last_u16le, case when n = 0 then 0 else ('0x' || substr(f, 2 * n - 1, 2))::bigint * 256 end as last_u16be, ('0x' || substr(f, 5, 8))::bigint as third_u32be,
        case when v >= 32768 then v - 65536 else v end as second_i16le from (select path, n, f, ('0x' || substr(f, 5, 2) || substr(f, 3, 2))::bigint as v from (select path, n, h || '0000000000000000' as f from ({HEX})))""",
    "main_outputs": """select conv_id, turn, file_id, 'output.' || lpad(cast(file_id as varchar), 3, '0') || '.txt' as name
        from (select conv_id, turn, row_number() over (partition by conv_id order by turn, text) - 1 as file_id from conversations where role is distinct from 'user') where file_id between 1 and 2""",
    "size_limits": """select conv_id, turn, file_id, size from (select *, sum(size) over w as s, max(size) over w as m from (select conv_id, turn, octet_length(encode(coalesce(text, ''))) as size, row_number() over (partition by conv_id order by turn, text) - 1 as file_id
        from conversations) window w as (partition by conv_id order by file_id)) where s <= 1000 and m <= 400""",
    "unrepeated": "select doc_id, md5(text) as h from documents qualify row_number() over (partition by md5(text) order by doc_id) = 1",
    "changed_turns": "select user_id, event_id, event_type from events qualify lag(event_type) over (partition by user_id order by event_id) is distinct from event_type",
    "date_conversions": f"""select o_orderkey, {FT.format(s="o_orderkey * 86399")} as from_unix, {FT.format(s="o_orderkey * 99991 + 2000000000 - 2082844800")} as from_mac,
        case when d <> 0 and d // 32 % 16 between 1 and 12 and d % 32 between 1 and 31 and t // 2048 < 24 and t // 32 % 64 < 60 and t % 32 <= 30 then {FT.format(s=DAYS.format(y="1980 + d // 512", m="greatest(1, least(12, d // 32 % 16))", d="d % 32") + " * 86400 + t // 2048 * 3600 + t // 32 % 64 * 60 + t % 32 * 2")} end as from_dos,
        case when d <> 0 and d // 32 % 16 between 1 and 12 and d % 32 between 1 and 31 and p // 256 < 24 and p % 64 < 60 then {FT.format(s=DAYS.format(y="1900 + d // 512", m="greatest(1, least(12, d // 32 % 16))", d="d % 32") + " * 86400 + p // 256 * 3600 + p % 64 * 60")} end as from_prodos,
        (o_orderkey * 10000019 + 123456789012345678) // 10000000 - 11644473600 as filetime_unix
        from (select o_orderkey, o_orderkey * 7919 % 65536 as d, o_orderkey * 104729 % 65536 as t, (o_orderkey * 104729 % 65536) & 7999 as p from orders)""",
    "colour_conversions": """select value, 4278190080 + r * 65536 + g * 256 + b as rgb565, 4278190080 + r5 * 65536 + g5 * 256 + b5 as bgr555, printf('#%02x%02x%02x', r, g, b) as css, (value + 3) // 4 * 4 as padded,
        array_to_string(list_filter([case when value % 64 & 1 > 0 then 'read-only' end, case when value % 64 & 2 > 0 then 'hidden' end, case when value % 64 & 4 > 0 then 'system' end, case when value % 64 & 8 > 0 then 'volume label' end,
        case when value % 64 & 16 > 0 then 'directory' end, case when value % 64 & 32 > 0 then 'archive' end], lambda x: x is not null), ' | ') as attributes
        from (select cast(value as int) as value, (value // 2048 * 510 + 31) // 62 as r, (value // 32 % 64 * 510 + 63) // 126 as g, (value % 32 * 510 + 31) // 62 as b,
        (value % 32 * 510 + 31) // 62 as r5, (value // 32 % 32 * 510 + 31) // 62 as g5, (value // 1024 % 32 * 510 + 31) // 62 as b5 from (select distinct (l_orderkey * 31 + l_linenumber) % 65536 as value from lineitem))""",
    "safe_names": r"select page_id, regexp_replace(url, '[^A-Za-z0-9 !#$%&''()+,\-.;=@\[\]^_`{}~\x{A0}-\x{10FFFF}]', '_', 'g') as name from pages",
    "members_zip": f"""select path, 0 as file_id, 'text.txt' as name, octet_length(encode(t)) as orig_len, true as crc_ok, md5(t) as data_md5, true as ok from ({DOC})
        union all select path, 1, 'head.bin', least(100, octet_length(encode(t))), true, md5(unhex(substr(hex(encode(t)), 1, 200))), true from ({DOC})""",
    "members_tar": f"""select path, 0 as file_id, 'a/text.txt' as name, octet_length(encode(t)) as orig_len, true as crc_ok, md5(t) as data_md5, true as ok from ({DOC})
        union all select path, 1, repeat('b', 120), least(100, octet_length(encode(t))), true, md5(unhex(substr(hex(encode(t)), 1, 200))), true from ({DOC})""",
    "members_gzip": f"select path, 0 as file_id, '' as name, octet_length(encode(t)) as orig_len, true as crc_ok, md5(t) as data_md5, true as ok from ({DOC})",
    "decode_deflate": whole(), "decode_zlib": whole(), "decode_lzss": whole(), "decode_hlp_lz77": whole(),
    **{name: f"select path, md5(unhex(s)) as data_md5, length(s) // 2 as size, true as ok from (select path, {STRETCHED} as s from ({HEX}))" for name in ("decode_packbits", "decode_rle90")},
    **{name: f"select path, kind, md5(t) as data_md5, octet_length(encode(t)) as size from ({DOC}), (values {', '.join(f'($${k}$$)' for k in kinds)}) k(kind)" for name, kinds in (("decode_lzw", ("compress", "gif", "tiff", "zoo")), ("decode_lha", ("lh1", "lh5", "lh6", "lh7")), ("decode_dcl", ("plain", "coded")))},
    "members_old_zip": f"select path, cast(file_id as int) as file_id, 'm' || m as name, octet_length(encode(t)) as orig_len, true as crc_ok, md5(t) as data_md5, true as ok from ({DOC}), (values (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 9), (8, 10)) v(file_id, m)",
    "archives_of_turns": "select cast(conv_id as varchar) as path, cast(turn as varchar) || '.txt' as name, 1000000001 as mtime_unix, true as crc_ok, md5(coalesce(text, '')) as data_md5 from conversations",
    "wav_files": f"""select path, '52494646' || {LITTLE.format("(n + n % 2 + 36)")} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {LITTLE.format("n")} || h || repeat('00', n % 2) as bytes_hex from ({HEX})""",
    "all_detections": f"select path, 'tar' as format, 90 as confidence from ({DOC})",
    "text_screens": f"""select path, cast(r as int) as row, md5(regexp_replace(array_to_string(list_transform(regexp_extract_all(piece, '..'), lambda d: case when ('0x' || d)::int < 127 then chr(('0x' || d)::int) else substr('{UPPER_HALF}', ('0x' || d)::int - 126, 1) end), ''), '^$', '')) as line_md5
        from (select path, unnest(regexp_extract_all(h, '.{{1,160}}')) as piece, unnest(range(0, (n + 79) // 80)) as r from (select path, hex(encode(u)) as h, octet_length(encode(u)) as n from (select path, regexp_replace(t, '[\\x00-\\x1F\\x7F]', ' ', 'g') as u from ({DOC}))))""",
    "screen_colours": """select conv_id || '/' || turn as path, fg + case when role = 'user' then 8 else 0 end as fg, bg, octet_length(encode(t)) as cells from (select *, [0, 4, 2, 6, 1, 5, 3, 7][turn % 8 + 1] as fg, [0, 4, 2, 6, 1, 5, 3, 7][turn * 3 % 8 + 1] as bg,
        regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]', '', 'g') as t from conversations) where t <> ''""",
    "rasters_bmp": f"""select path, 16 as width, length(h) // 96 as height, md5(unhex(array_to_string(list_transform(regexp_extract_all(h, '.{{6}}'), lambda p: substr(p, 5, 2) || substr(p, 3, 2) || substr(p, 1, 2)), ''))) as data_md5
        from (select path, rpad(h, cast(greatest(1, (n + 47) // 48) * 96 as int), '0') as h from ({HEX}))""",
    "png_chunks": f"select path, tag, case when tag = 'IHDR' then 'width=16 height=' || greatest(1, (octet_length(encode(t)) + 47) // 48) end as size from ({DOC}), (values ('IHDR'), ('IDAT'), ('IEND')) c(tag)",
}
