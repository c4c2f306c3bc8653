"""Folders on the storage Spark itself uses, whatever it is."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staged(rows: DataFrame, root: str) -> Iterator[DataFrame]:
    """``rows`` written below ``root`` and read back, for as long as the block lasts.

    What is used several times is computed once, and a lost executor costs the files it was
    writing, not the rows of others. Folders that begin with an underscore are hidden from scans.
    """
    spark = rows.sparkSession
    path = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        delete_folder(spark, path)
