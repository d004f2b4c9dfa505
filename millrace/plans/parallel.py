"""Using all cores on inputs with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def widened(scan: DataFrame) -> DataFrame:
    """A plain file scan dealt over the cores when it has fewer splits than there are cores.

    Meant ahead of CPU-heavy work (tokenising, profiling, distances) on a few files or row groups. A large
    scan has more splits than cores and is returned as it is, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
