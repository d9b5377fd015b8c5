"""Exact positions and running sums over a global range sort, without any task holding a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import cut, shuffle_width


def running_total(rows: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """*rows* with ``name``: the sum of *value* (LONG, not null) over all rows before, in the global order.

    Rows are range-partitioned by the whole order, so that no key is too large for a task, sorted and numbered inside
    their partition, and written to the shared folder; the partitions' totals (one row a partition, hence bounded by the
    shuffle width) give the offsets.
    """
    width = shuffle_width(rows.sparkSession)
    schema = rows.select("*", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_in")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = b.column(value).to_numpy()
            upto = np.cumsum(v) + total
            columns = [*b.columns[:-1], b.columns[-1], pa.array(upto - v, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "_in"])
            total = int(upto[-1]) if len(v) else total

    ordered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    done = cut(ordered.mapInArrow(number, schema), "range")
    totals = done.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = totals.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_off"))
    return done.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_in")).drop("_part", "_in", "_off")
