"""Cutting lineage through shared storage.

The checkpoint folder is the one the cluster names in ``spark.checkpoint.dir``; only when nothing is
configured in local mode (tests) is a fresh temporary folder used, and on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="millrace-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name on the shared checkpoint storage, for tables written between two stages."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: a lost executor re-reads the files instead of re-running the plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved_blocks(df: DataFrame, n: int) -> RDD:
    """Rows dealt by ``vk`` to n blocks of about one size, saved on the shared storage: an RDD with a row (block, data) per
    partition, where data is the block as an Arrow stream. Other tasks read the files again, as often as they need to."""
    def pack(batches):
        batches = list(batches)
        if sum(b.num_rows for b in batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batches[0].schema) as writer:
                writer.write_table(pa.Table.from_batches(batches).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    return cut(df.repartition(n, "vk").mapInArrow(pack, "block string, data binary")).rdd
