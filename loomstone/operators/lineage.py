"""Ends of lineage and distributed running sums."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that spark.checkpoint.dir names, where driver and executors share it. A local one is made only where that is unset and the master is local."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='loomstone-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable checkpoint files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`df` with, for each name, the sum of its column over all rows before this one in the given order, which must be total.

    Rows are range-partitioned; each part sums for itself, and the parts'
    totals, one row each, are added. No task sees more than its own range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df
    for name, column in sums.items():
        dealt = dealt.withColumn(f"_{name}", column)
    dealt = cut(dealt.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    by = ", ".join(f"`{c}`" for c in order)
    totals = dealt.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    # One row for each part.
    before = totals.select("_part", *(F.expr(f"coalesce(sum(`_t_{k}`) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias(f"_b_{k}") for k in sums))
    own = dealt.select("*", *(F.expr(f"coalesce(sum(`_{k}`) OVER (PARTITION BY _part ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias(f"_o_{k}") for k in sums))
    joined = own.join(F.broadcast(before), "_part")
    return joined.select(*(c for c in df.columns), *((F.col(f"_o_{k}") + F.col(f"_b_{k}")).cast("long").alias(k) for k in sums))
