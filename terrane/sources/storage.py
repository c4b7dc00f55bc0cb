"""Tables that are written once to the shared folder, and numbering and running sums without a single-partition sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, as in tests, one machine takes a temporary folder; a
    cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="terrane-"))
        root = _own[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    # The shuffles behind a written table are of no more use: their files go when it is written.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, *keys: Column, name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the order of keys, which must tell rows apart.

    Rows are range partitioned and sorted inside partitions; only the partitions' counts come to the driver.
    """
    plain = [f"_k{i}" for i in range(len(keys))]
    n = parts(rows.sparkSession)
    order = [F.col(p) for p in plain]
    dealt = rows.withColumns(dict(zip(plain, keys, strict=True))).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()).drop(*plain))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["count"]) for r in dealt.groupBy(part.alias("p")).count().collect())
    start, offsets = 0, []
    for p, count in counts:
        offsets += [F.lit(p), F.lit(start)]
        start += count
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_at")
    base = F.element_at(F.create_map(*offsets), part)
    return dealt.withColumn(name, (base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def running_sum(rows: DataFrame, pos: str, value: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """rows with the sum of value over all rows of smaller or equal pos (0, 1, 2, ...), in two levels.

    Sums inside blocks of `width` positions, and running sums over the blocks' totals: one row a block.
    """
    block = F.floor(F.col(pos) / F.lit(width))
    cut = rows.withColumn("_v", value.cast("long")).withColumn("_b", block)
    totals = cut.groupBy("_b").agg(F.sum("_v").alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_b").orderBy(pos))
    return cut.withColumn("_in", inside).join(before, "_b").withColumn(name, F.col("_in") + F.col("_before")).drop("_v", "_b", "_in", "_before")


def in_one_task(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over all rows in one task: for steps that are sequential by nature. Memory is that of the rows."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = run(pa.Table.from_batches(held).to_pandas())
            yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()

    return rows.repartition(1).mapInArrow(whole, schema)
