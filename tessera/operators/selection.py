"""Which outputs of a blob are kept, and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def policy(outputs: DataFrame, main: bool = True, aux: bool = True, directories: bool = False, labels: bool = False) -> DataFrame:
    """Filters by the columns is_aux, is_dir and is_label, where the table has them. It comes before numbering: what it drops gets no number."""
    out = outputs
    for column, kept in (("is_dir", directories), ("is_label", labels)):
        if column in out.columns and not kept:
            out = out.filter(~F.coalesce(column, F.lit(False)))
    if "is_aux" in out.columns:
        flag = F.coalesce("is_aux", F.lit(False))
        out = out if main and aux else out.filter(~flag) if main else out.filter(flag) if aux else out.limit(0)
    return out


def number(outputs: DataFrame, by: str | list[str], order: list[str | Column]) -> DataFrame:
    """Adds file_id: the place from 0 among the outputs of each blob."""
    keys = [by] if isinstance(by, str) else by
    return outputs.withColumn("file_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def take(numbered: DataFrame, first: int = 0, most: int | None = None) -> DataFrame:
    """Outputs from number first on, most of them at most; numbers stay."""
    out = numbered.filter(F.col("file_id") >= first)
    return out if most is None else out.filter(F.col("file_id") < first + most)


def get(numbered: DataFrame, file_id: int) -> DataFrame:
    return take(numbered, file_id, 1)


def within_size(numbered: DataFrame, by: str, size: str, largest: int = 10 << 30, total: int = 15 << 30) -> DataFrame:
    """Outputs up to the first of a blob that is larger than largest or with which all become larger than total."""
    running = Window.partitionBy(by).orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = numbered.withColumns({"_sum": F.sum(size).over(running), "_max": F.max(size).over(running)})
    return marked.filter((F.col("_sum") <= total) & (F.col("_max") <= largest)).drop("_sum", "_max")


def output_name(base: Column, file_id: Column, suffix: Column) -> Column:
    """base.000.suffix; numbers have three digits at least."""
    text = file_id.cast("string")
    return F.concat_ws(".", base, F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text), suffix)


def drop_repeats(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of those equal in by. Each task first keeps its own first ones, so no key's rows meet in one."""
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def changed_frames(frames: DataFrame, by: str, order: str, content: str) -> DataFrame:
    """Frames of an animation that differ from the one before."""
    before = F.lag(F.xxhash64(content)).over(Window.partitionBy(by).orderBy(order))
    return frames.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.xxhash64(content))).drop("_before")
