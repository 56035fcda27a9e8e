"""Work for all cores from inputs with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out over all cores if it has fewer splits than there are cores.

    That is for small inputs and for files that cannot be split, such as gzip. Parsing and cleaning cost far more
    per byte than moving it. A scan with enough splits is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
