"""State of a stream as tables by batch in the shared folder.

A batch writes its own folder and overwrites what an earlier, failed run of it left there; it reads only folders of batches before
it. So a batch that is run again gives the same tables, half-written ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.sources.storage import fresh_path


class Table:
    """Rows by batch. whole: each batch writes the table anew, and the one before it is all that is read."""

    def __init__(self, spark: SparkSession, name: str, schema: str, whole: bool = False):
        self.spark, self.schema, self.whole = spark, schema, whole
        self.path = fresh_path(spark, name)

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._folder(batch))
        if self.whole and batch > 1:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(batch - 2))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return self.of(batch)

    def of(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(batch))

    def before(self, batch: int) -> DataFrame:
        """What batches before this one left, without a column for the batch."""
        first = batch - 1 if self.whole else 0
        folders = [self._folder(b) for b in range(max(first, 0), batch)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def all(self, batches: int) -> DataFrame:
        """Everything that so many batches wrote."""
        return self.before(batches)
