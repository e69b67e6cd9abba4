"""The whole way of a blob: identify, extract, select, number, name. Each step is a column or a row of the same pass: nothing is joined to itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import identify, members, selection
from tessera.operators.fields import fields, readers


@dataclass(frozen=True)
class Options:
    """What is extracted.

    only, without: formats (or aliases); main, aux, directories, labels: kinds of outputs; first, most: numbers of
    outputs (most None: no limit, get sets both); list_only: leave data out; largest, total: bytes of an output and
    of all of a blob; force: the format to take all blobs for; level: 1, or 2 to keep members whose headers are wrong.
    """

    only: frozenset[str] | None = None
    without: frozenset[str] = field(default_factory=frozenset)
    main: bool = True
    aux: bool = True
    directories: bool = False
    first: int = 0
    most: int | None = 1_000
    get: int | None = None
    list_only: bool = False
    largest: int = 10 << 30
    total: int = 15 << 30
    force: str | None = None
    level: int = 1


def typed(blobs: DataFrame, options: Options) -> DataFrame:
    """path, content, format and confidence of blobs."""
    rows = blobs.select("path", "content")
    if options.force:
        return rows.withColumns({"format": F.lit(identify.format_name(options.force)), "confidence": F.lit(100)})
    return identify.with_format(rows, only=options.only, without=options.without)


def _members(blobs: DataFrame, options: Options, data: bool) -> DataFrame:
    return members.members(typed(blobs, options), data=data).withColumnRenamed("file_id", "member")


def outputs(blobs: DataFrame, options: Options = Options()) -> DataFrame:
    """Members of blobs (path, content) whose format is known, as selected, with the number and name of each output.

    Numbers count what the policy keeps; first, most and get then choose among them. Blobs that share a path are
    numbered together, one after another.
    """
    found = _members(blobs, options, not options.list_only)
    if options.level < 2:
        found = found.filter(~F.coalesce(F.col("err") == "wrong header checksum", F.lit(False)))
    kept = selection.policy(found, options.main, options.aux, options.directories)
    numbered = selection.number(kept, "path", ["member", "name", "orig_len"])
    chosen = selection.get(numbered, options.get) if options.get is not None else selection.take(numbered, options.first, options.most)
    sized = selection.within_size(chosen, "path", "orig_len", options.largest, options.total)
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    suffix = F.when(F.col("name") != "", F.regexp_replace("name", "[/\\\\]", "_")).otherwise("bin")
    return sized.withColumn("output", selection.output_name(base, F.col("file_id"), suffix))


def diagnostics(blobs: DataFrame, options: Options = Options()) -> DataFrame:
    """path, level, message: blobs of unknown format, damaged members, wrong sums, and outputs beyond the limit. Data stays in the tasks that read it."""
    known = typed(blobs, options)
    unknown = known.filter(F.col("format").isNull()).select("path", F.lit("error").alias("level"), F.lit("unknown format").alias("message"))
    found = members.members(known, data=False)
    broken = found.filter(~F.col("ok")).select("path", F.lit("error").alias("level"), F.concat_ws(": ", "name", "err").alias("message"))
    wrong = found.filter(F.col("ok") & ~F.coalesce("crc_ok", F.lit(True))).select("path", F.lit("warning").alias("level"), F.concat_ws(": ", "name", F.lit("wrong checksum")).alias("message"))
    out = unknown.union(broken).union(wrong)
    if options.most is not None and options.get is None:
        many = found.groupBy("path").count().filter(F.col("count") > options.first + options.most)
        out = out.union(many.select("path", F.lit("error").alias("level"), F.lit("more outputs than the limit").alias("message")))
    return out


def metadata(blobs: DataFrame, options: Options = Options()) -> DataFrame:
    """Fields of all blobs whose format has any."""
    known = typed(blobs, options)
    return fields(known.filter(F.col("format").isin(sorted(readers()))))
