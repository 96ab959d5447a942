"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.storage import shared_dir

#: The six ASCII white-space characters between words.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once no later read needs it."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Plan nodes that give a file's rows in the same order each time.
_IN_ORDER = frozenset("Project Filter FileScan BatchScan Scan ColumnarToRow InputAdapter WholeStageCodegen".split())


def repeatable(df: DataFrame) -> DataFrame:
    """df if each reading lists its rows alike (files, filtered and projected), else df written once: for what numbers rows by their place in more than one pass."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = [m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*(?:\*\s?\(\d+\) )?([A-Z]\w+)", line))]
    files = sum(n in ("FileScan", "BatchScan") for n in nodes)
    return df if files == 1 and "ExistingRDD" not in plan and set(nodes) <= _IN_ORDER else written(df)


def unpacked(df: DataFrame, packed: str, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of the struct `packed` in their order, those in `new` replaced: whatever they are called, they clash with nothing on the way."""
    return df.select(*[(new[c] if c in new else F.col(packed).getField(c)).alias(c) for c in columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: log2 of the bits of a filter of numbers, at least and at most (128 MB). As it fills, more rows pass; none that belongs is lost.
LEAST_BITS, MOST_BITS = 20, 30


def _pack_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
    for batch in batches:
        out = []
        for x in batch.column(1):
            bits = np.zeros(1 << 16, np.uint8)
            bits[np.array(x.values, np.int64)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=schema)


def packed_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """The column `slot` (whole numbers below 2 ** bits) as a bit array of 2 ** (bits - 3) bytes on the driver."""
    sliced = slots.select(F.shiftright("slot", 16).cast("int").alias("slice"), F.col("slot").bitwiseAND(0xFFFF).cast("int").alias("bit"))
    sliced = sliced.groupBy("slice").agg(F.collect_set("bit").alias("b"))  # 65,536 numbers at most
    out = np.zeros(1 << max(13, bits - 3), np.uint8)
    for r in sliced.mapInArrow(_pack_bits, "slice int, bits binary").toLocalIterator():
        out[r["slice"] << 13 : (r["slice"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def slots_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (numbers.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def bit_filter(numbers: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the numbers in the only column of `numbers`, of some 16 bits for each."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * numbers.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots_of(batch.column(0).to_numpy(), bits))], names=["slot"])

    return packed_bits(numbers.mapInArrow(run, "slot long"), bits), bits


def in_filter(held: tuple[np.ndarray, int], numbers: np.ndarray) -> np.ndarray:
    slot = slots_of(numbers, held[1])
    return (held[0][slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
