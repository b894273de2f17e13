"""Sums of arrays over a table: each task adds up its own rows', groups of tasks theirs, and the driver gets one array a number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose sums meet in one group.
FAN_IN = 64


def summed(table: DataFrame, one: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sum by number of what ``one`` gives for each batch: flat arrays of doubles, of one length a number.

    The tables that go to the driver have as many numbers as ``one`` names, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in one(b):
                    total[k] = total[k] + v if k in total else v
        if total:
            part = TaskContext.get().partitionId()
            rows = [pa.array(list(total), pa.int64()), pa.array([part] * len(total), pa.int64()), pa.array([np.asarray(v, np.float64).tobytes() for v in total.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["k", "part", "v"])

    def add(t: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(len(t["v"].iloc[0]) // 8)
        for x in t["v"]:
            v += np.frombuffer(x)
        return pd.DataFrame({"k": [t["k"].iloc[0]], "part": [t["part"].iloc[0] // FAN_IN], "v": [v.tobytes()]})

    sums = table.mapInArrow(run, "k long, part long, v binary")
    tasks = table.rdd.getNumPartitions()
    while tasks > FAN_IN:
        sums = sums.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("k", "group").applyInPandas(add, "k long, part long, v binary")
        tasks = -(-tasks // FAN_IN)
    return {r.k: np.frombuffer(r.v) for r in sums.groupBy("k").applyInPandas(add, "k long, part long, v binary").collect()}


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
