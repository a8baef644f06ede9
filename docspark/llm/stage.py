"""Written tables between the stages of a job: they cut the lineage, survive the loss of executors and are compressed."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docspark.sources.storage import checkpoint_folder

_made: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again; removed when the program ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(lambda: [_remove(*x) for x in _made])
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a Python kernel holds at once, as Python objects.
AT_ONCE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)
