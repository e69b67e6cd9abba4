"""What the operators of this subpackage share: scratch tables, prefix sums and top lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names in spark.checkpoint.dir.

    Without that setting a session on one machine (tests) gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there.

    Unlike a local checkpoint it survives lost executors, and unlike a recomputation it
    gives the same rows in the same places each time it is read. free: the shuffles behind
    it go as soon as it is written, not when the JVM next collects garbage.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREES)
    conf.set(FREES, "true" if free else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(FREES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, free: bool = False, **metrics: Column) -> tuple[DataFrame, Row]:
    """scratch(), with the number of its rows (rows) and other aggregates of them, which the write itself takes."""
    seen = Observation()
    table = scratch(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), name, free)
    return table, Row(**seen.get)


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def quoted(names: list[str]) -> list[Column]:
    """Columns by their very names, whatever characters these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1 and so on: functions on Arrow batches do not take columns of any name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sized(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """df in as many tasks as its (known) number of rows needs, where a shuffle has made more."""
    return df.coalesce(max(1, -(-rows // per_task)))


def bases(spark: SparkSession, counts: dict[int, int], key: str, base: str) -> DataFrame:
    """Running totals before each key, in key order; one row for each partition, so it is small."""
    rows, total = [], 0
    for k in sorted(counts):
        rows.append((k, total))
        total += counts[k]
    return spark.createDataFrame(rows, f"{key} int, {base} long")


def exclusive_prefix_sum(df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of weight over all rows that come before, by order (which must be a key).

    Rows are dealt by ranges of the order and summed in each range, so no task gets all.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch(ranged, "prefix")  # ranges come from a sample: settle them first
    sums = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum(weight)).collect()}
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum(weight).over(before), F.lit(0))
    return ranged.join(F.broadcast(bases(spark, sums, "_range", "_base")), "_range").withColumn(out, start).drop("_range", "_base")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the row's place from 0 in the whole table's order, without one task seeing all rows."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = scratch(ranged.withColumn("_id", F.monotonically_increasing_id()), "rank")
    place = ranged.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = {r[0]: r[1] for r in place.groupBy("_range").count().collect()}
    joined = place.join(F.broadcast(bases(spark, counts, "_range", "_base")), "_range")
    return joined.withColumn(out, F.col("_base") + F.col("_at")).drop("_id", "_range", "_at", "_base")


def merge_tops(lists: DataFrame, k: int, fan: int = 32) -> DataFrame:
    """The k least entries for each query_id from many partial lists.

    lists: query_id, part (from 0), top: array of structs whose order is the wanted one.
    Lists meet in a tree of the given fan, so a task holds fan lists for a query at most.
    """
    least = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    parts = lists.agg(F.max("part")).first()[0]
    level = lists
    while (parts or 0) >= fan:
        level = level.groupBy("query_id", (F.col("part") / fan).cast("int").alias("part")).agg(least)
        parts //= fan
    return level.groupBy("query_id").agg(least)
