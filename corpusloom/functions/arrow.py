"""Python functions over Arrow batches whose size is bounded, whatever the table's."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that cross to Python at once. A worker holds a batch several times over: as Arrow, as strings, and its results.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Keep Arrow batches of texts small, unless the session already does."""
    spark = spark or SparkSession.active()
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_PER_BATCH:
        spark.conf.set(rows, str(ROWS_PER_BATCH))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BYTES_PER_BATCH:
        spark.conf.set(size, str(BYTES_PER_BATCH))


def udf(f, kind):
    """``pandas_udf`` in bounded batches."""
    bound_batches()
    return F.pandas_udf(f, kind)
