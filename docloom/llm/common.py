"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.sources import paths

_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = paths.scratch(df.sparkSession, "docloom")
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove all tables that ``materialize`` has written so far; call it once the results that read them are stored."""
    n = len(_written)
    while _written:
        paths.remove(spark, _written.pop())
    return n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan of too few splits, so that Python work uses all cores; else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)
